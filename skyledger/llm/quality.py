"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed in numpy, block by block. Trees are
grown on histograms of a bounded labelled sample and flattened into arrays of
features, thresholds and leaf values, one row a tree, so that scoring walks all
trees of all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import SPACES, blocks, bounded_sample, byte_table, gram_hashes, held_out, rows_of, span_hashes, spans, table
from skyledger.llm.rules import STOP_WORDS

#: documents of each class that training may use: the bound of what reaches the driver
SAMPLE = 4000
PARTS, HELD_PART = 5, 0
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
LEAST_WEIGHT, RIDGE = 5.0, 2.0

#: classes of bytes that are counted
CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "space": SPACES,
    "symbol": b"#*$%&<>{}[]\\^~_=+@", "bar": b"|", "mark": b"!?", "stop": b".", "comma": b",;:", "other": bytes(range(128, 256)),
}
STATISTICS = (
    *(f"{c}_share" for c in CLASSES), "log_words", "word_bytes", "distinct_words", "repeated_windows", "stop_words", "log_lines",
    "repeated_lines", "line_words", "short_lines", "capital_words", "one_byte_words", "long_words", "stops_per_line", "marks_per_word",
)

_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _k
_WORD = ~byte_table(SPACES)
_LINE = ~byte_table(b"\n")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _hash_list(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    return np.sort(span_hashes(np.frombuffer(b" ".join(raw), np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends))


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Different values of each row: the row in the high bits, so one sort serves all."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=rows).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; zeros where there is nothing to count."""
    stops = _hash_list(list(dict.fromkeys(STOP_WORDS)))
    out = []
    for lo, hi, data, offsets in blocks(column):
        n = hi - lo
        size = np.diff(offsets)
        owner = np.repeat(np.arange(n) * (len(CLASSES) + 1), size)
        count = np.bincount(owner + _CLASS[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, : len(CLASSES)].astype(float)
        starts, ends, first = spans(_WORD[data], offsets)
        row, length = rows_of(first), ends - starts
        words = np.diff(first).astype(float)
        h = span_hashes(_FOLD[data], starts, ends)
        windows = gram_hashes(h, 3)
        inside = row[: len(windows)] == row[2:] if len(windows) else np.empty(0, bool)
        n_windows = np.bincount(row[: len(windows)][inside], minlength=n).astype(float)
        distinct_windows = _distinct(row[: len(windows)][inside], windows[inside], n)
        at = np.minimum(np.searchsorted(stops, h), len(stops) - 1)
        l_start, l_end, l_first = spans(_LINE[data], offsets)
        l_row, lines = rows_of(l_first), np.diff(l_first).astype(float)
        distinct_lines = _distinct(l_row, span_hashes(data, l_start, l_end), n)

        def per_word(flag: np.ndarray) -> np.ndarray:
            return np.bincount(row, flag, minlength=n) / np.maximum(1, words)

        chars, some_words, some_lines = np.maximum(1, size), np.maximum(1, words), np.maximum(1, lines)
        first_byte = data[starts] if len(starts) else np.empty(0, np.uint8)
        names = list(CLASSES)
        out.append(np.column_stack([
            count / chars[:, None], np.log1p(words), np.bincount(row, length, minlength=n) / some_words, _distinct(row, h, n) / some_words,
            (n_windows - distinct_windows) / np.maximum(1, n_windows), per_word(stops[at] == h), np.log1p(lines), (lines - distinct_lines) / some_lines, words / some_lines,
            np.bincount(l_row, (l_end - l_start) < 20, minlength=n) / some_lines, per_word((first_byte >= 65) & (first_byte <= 90)), per_word(length == 1), per_word(length > 16),
            count[:, names.index("stop")] / some_lines, count[:, names.index("mark")] / some_words,
        ]))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


class Forest:
    """Complete trees as arrays: node k has the children 2k+1 and 2k+2, and the last level holds the values."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))
        inner = self.feature.shape[1] if len(trees) else 0
        for k in range(0, len(x) if len(trees) else 0, 2048):
            part = x[k : k + 2048]
            node = np.zeros((len(part), len(trees)), np.int64)
            while node[0, 0] < inner:
                over = part[np.arange(len(part))[:, None], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + over
            total[k : k + 2048] += self.value[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Forest:
    """Boost the logistic loss; ``weight``: documents that a row stands for."""
    none = Forest(0.0, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    if not len(x):
        return none
    weight = np.ones(len(x)) if weight is None else weight * len(x) / weight.sum()
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    none.start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    features = x.shape[1]
    cells = np.arange(features) * BINS + binned
    total = np.full(len(x), none.start)
    inner = 2**DEPTH - 1
    fs, ts, vs = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, hess = weight * (y - p), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            key = ((node - base)[:, None] * (features * BINS) + cells).ravel()
            hist = [np.bincount(key, np.repeat(v, features), minlength=width * features * BINS).reshape(width, features, BINS).cumsum(axis=2) for v in (g, hess)]
            left, lw = hist
            right, rw = left[:, :, -1:] - left, lw[:, :, -1:] - lw
            gain = left**2 / (lw + RIDGE) + right**2 / (rw + RIDGE) - (left[:, :, -1:] ** 2) / (lw[:, :, -1:] + RIDGE)
            gain[(lw < LEAST_WEIGHT * 0.1) | (rw < LEAST_WEIGHT * 0.1)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-6 and b < len(edges[j]):
                    feature[base + k], threshold[base + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, hess, minlength=inner + 1) + RIDGE)
        total += value[leaf]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Forest(none.start, np.array(fs), np.array(ts), np.array(vs))


def described(docs: DataFrame, text: str = "text", name: str = "_statistics") -> DataFrame:
    """``docs`` with the statistics of its text in place of it."""
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{name}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(batch.schema.get_field_index(text)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            offsets = pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [*kept, name])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Learn from labelled documents that are not held out: statistics of at most ``sample`` of each class reach the driver."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"), PARTS, HELD_PART))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # at most 2 * sample ids are broadcast
    chosen = bounded_sample(known.withColumn("text", F.lit("")), "quality", counts, sample, "quality").drop("text")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    got = bounded_sample(rows, "quality", dict.fromkeys(counts, 0), sample, "quality").select("text", "quality")
    got = sorted((tuple(r["_statistics"]), r["quality"]) for r in described(got).collect())
    x, y = np.array([g[0] for g in got]).reshape(-1, len(STATISTICS)), np.array([g[1] for g in got], float)
    sizes = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return train(x, y, np.array([counts.get(int(k), 0) / sizes[int(k)] for k in y]) if len(y) else None)


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.3) from the whole text alone.

    Null and empty texts have statistics of zero and are scored by them.
    Repeated rows score alike; an empty table gives no rows; columns named like
    a result are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.scores(statistics(batch.column(batch.schema.get_field_index(text))))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(kept).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, folder, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "score", "predicted")
