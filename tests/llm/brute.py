"""Plain statements of what the operators should give, and documents with every awkward case."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _order string, score string, kept string, fp int"


def words(text):
    return WORD.findall(text or "")


def documents():
    """Rows with nulls, empty and long texts, repeated rows, ties and further columns whose names operators use inside."""
    base = [f"w{k % 97}x{k * k % 89}" for k in range(400)]
    passage = [f"passage{k}" for k in range(60)]
    texts = [
        " ".join(base[:120]), " ".join(base[:120]), "\t".join(base[:119]) + "\nother", None, "", " \n\t ", "one two", "a b\u0085c Ü ß",
        " ".join(base[100:160] + passage + base[200:230]), " ".join(base[300:330] + passage + base[10:20]), " ".join(passage), " ".join(["same"] * 130),
        "x\ny\nx\n\nx\r\n" * 30, " ".join(base * 120), "The idiot wrote to anna.lee@mail.example.org and +1 (555) 123-4567.", "# $ % &&& | <b> * " * 20,
        "\U0001f600 " * 70, "don't   stop  <|endoftext|> now",
    ]
    rows = [(k, t, ("en", None, "de")[k % 3], (None, "b", "a", "ä", "Z")[k % 5], len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], "en", "a", 3), (None, None, None, None, None), (8, "another text under a known id", "en", "b", 4)]
    return [(*r, 1, "x", "y", "z", 7) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def removal(rows, width):
    """(doc_id, words, removed, sha) of each row."""
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        left = " ".join(w[k] for k in range(len(w)) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def counts(text):
    t = text or ""
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)
