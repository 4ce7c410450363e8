import hashlib

import numpy as np
import pytest
from brute import documents, frame, same

from skyledger.llm import suffixes
from pyspark.sql import functions as F


def removal(rows, width):
    """(doc_id, bytes, removed, spans, sha) of each row."""
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1) if i is not None else ():
            g = b[k : k + width]
            first[g] = min(first.get(g, (i, k)), (i, k))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1) if i is not None else ():
            if first[b[k : k + width]] < (i, k):
                gone[k : k + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width,gram,hot", [(100, 24, 2048), (100, 24, 3), (20, 8, 2048), (20, 8, 1), (7, 7, 2)])
def test_removal_equals_brute_force(spark, width, gram, hot):
    rows = documents()
    rng = np.random.default_rng(width)
    words = ["alpha", "beta", "gamma", "délta", "中文", "\n"]
    made = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    made += [made[k % 5][: 90 + k] + made[k] for k in range(12)] + ["z" * 400, "xy" * 300, "z" * 99, "z" * 100]
    rows += [(200 + k, t, None, None, None, 1, "x", "y", "z", 7) for k, t in enumerate(made)]
    got = suffixes.remove_repeated_bytes(frame(spark, rows), width=width, gram=gram, hot=hot)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same([tuple(r) for r in got.collect()], removal(rows, width))


def test_removal_of_nothing(spark):
    assert suffixes.remove_repeated_bytes(frame(spark).limit(0)).count() == 0


def test_suffix_sort_orders_every_group():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 99, 600, dtype=np.uint8)) * 3
    starts = rng.integers(0, len(text) - 20, 900)
    group = np.sort(rng.integers(0, 40, 900) ** 2 // 40)
    order, equal = suffixes.Suffixes(text, 20).sort(starts, group)
    key = [text[s : s + 20] for s in starts]
    want = sorted(range(900), key=lambda e: (group[e], key[e], e))
    assert order.tolist() == want
    assert equal.tolist() == [k > 0 and group[k] == group[k - 1] and key[want[k]] == key[want[k - 1]] for k in range(900)]


def test_collisions_are_found_and_mended(monkeypatch):
    """Hashes that tell nothing apart: the bytes decide."""
    monkeypatch.setattr(suffixes, "_BYTE_VALUES", np.zeros(256, np.uint64))
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 300, dtype=np.uint8))
    starts, group = rng.integers(0, 290, 200), np.sort(rng.integers(0, 9, 200))
    order, equal = suffixes.Suffixes(text, 5).sort(starts, group)
    key = [(group[e], text[starts[e] : starts[e] + 5]) for e in order]
    assert key == sorted(key)
    assert equal.tolist() == [k > 0 and key[k] == key[k - 1] for k in range(200)]


def test_long_texts_are_cut_into_steps():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 123, 5000, dtype=np.uint8)
    offsets = np.array([0, 40, 3000, 3000, 5000])
    for step in (10_000, 700):
        row, rep, head, tail, at = suffixes.runs_of(data, offsets, step=step)
        assert (tail - head < suffixes.WIDTH - suffixes.GRAM + 1).all() and (at >= tail - head).all()
        windows = [(r, k) for r, h, t in zip(row, head, tail) for k in range(h, t + 1)]
        assert windows == [(r, k) for r in range(4) for k in range(offsets[r + 1] - offsets[r] - suffixes.WIDTH + 1)]
        by = {(r, k): x for r, x, h, t in zip(row, rep, head, tail) for k in range(h, t + 1)}
        whole = whole if step == 700 else by
    assert whole == by
