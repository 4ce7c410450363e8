import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from brute import documents, frame, same

from skyledger.llm import alignment


def tokens(text):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            tokens.raw = {int(k): base64.b64decode(t) for t, k in map(bytes.split, f)}
    if not text:
        return [], [], [], []
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    spelled = [tokens.raw[k] for k in a]
    pieces = [bytes([int(p[3:5], 16)]) if len(p := tokens.b.id_to_piece(k)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for k in b]
    want = (" " + text).encode()
    if b"".join(spelled) != want or b"".join(pieces) != want:
        return [], [], [], []
    return a, b, spelled, pieces


def brute(rows):
    """Every link of every document, the slow way."""
    done, held = [], Counter()
    for r in rows:
        a, b, spelled, pieces = tokens(r[1])
        ends = [np.cumsum([len(x) for x in s], dtype=int).tolist() for s in (spelled, pieces)]
        common = sorted(set(ends[0]) & set(ends[1])) if a else []
        place = [{e: k + 1 for k, e in enumerate(x)} for x in ends] if a else []
        groups, i, j = [], 0, 0
        for e in common:
            i2, j2 = place[0][e], place[1][e]
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        done.append((r[0], len(a), len(b), groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, na, nb, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
                    sum(held[p] * n for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return out


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_brute_force(spark, head):
    rows = documents()
    more = ["Ünïcödé naïve café 中文字符 \U0001f600\U0001f601 <|endoftext|> </s> <unk>", "===========" * 30, "a▁b", "x\u0000y", " lead  and   trail  ", "tab\tand\nline\r\n"]
    rows += [(100 + k, t, None, None, None, 1, "x", "y", "z", 7) for k, t in enumerate(more)]
    got = alignment.align_documents(frame(spark, rows), head=head).collect()
    same([tuple(r) for r in got], brute(rows))


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(frame(spark).limit(0)).count() == 0


def test_runs_are_measured_exactly():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.sort(rng.choice(np.arange(1, 120), n, replace=False)).tolist()
        y = sorted(set(x) ^ set(rng.choice(np.arange(1, 120), int(rng.integers(0, 6))).tolist())) or [5]
        last = max(x[-1], y[-1]) + 1
        x, y = [*x, last], [*y, last]
        at_x, at_y, runs = alignment.align(x, y)
        cuts = []
        for i, j, k in zip(at_x, at_y, runs):
            cuts += [(i + d, j + d) for d in range(max(1, k))]
        common = sorted(set(x) & set(y))
        assert cuts == [(0, 0), *((x.index(e) + 1, y.index(e) + 1) for e in common[:-1])]
        i = int(rng.integers(0, len(x)))
        k = 0
        while i + k < min(len(x), len(y)) and x[i + k] == y[i + k]:
            k += 1
        if i < len(y):
            assert alignment.run_length(x, y, i, i) == k


def test_large_groups_are_not_spread_out():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 50), rng.integers(0, 9, 60)
    at_a, at_b, runs = np.array([0, 3, 30, 35]), np.array([0, 3, 41, 46]), np.array([3, 0, 5, 0])
    want = alignment.pair_counts(a, b, at_a, at_b, runs)
    got = alignment.pair_counts(a, b, at_a, at_b, runs, crowd=100)
    assert want[2] == got[2] == 3 + 27 * 38 + 5 + 15 * 14
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
