"""Toxicity by a small convolutional network over hashed word embeddings.

Words (runs of letters, ASCII folded to lower case) and their first four bytes
are hashed to 24 bits; buckets met in MIN_DOCUMENTS training documents own an
embedding, however large the sample, all others share the zero vector, and a
word is the sum of its two. Filters one, two and three words wide slide over the
whole text, the maximum of each over the text is its feature, and a logistic layer
scores them. The network is trained in numpy on a bounded sample. A threshold
for each language, told from the function words of the text itself, is set on
documents kept aside from training and moved to 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import aside, blocks, bounded_sample, held_out, mix, rows_of, span_hashes, spans, table

#: documents of each class that training may use; the bound of what reaches the driver
SAMPLE = 2000
PARTS, HELD_PART = 5, 0
HASH_BITS, PREFIX = 24, 4
DIMENSION, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
MIN_DOCUMENTS = 3
EPOCHS, STEPS, BATCH = 12, 1500, 32
DECAY = 0.1
#: share of the words that a training step does not see
DROP = 0.3
#: toxic documents that the prior of a threshold counts as
PRIOR = 20
PAD = 3
#: function words that tell the language of a text
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with was on are be this by from".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas".split(),
    "es": "de la que el en y los del se las por un para con no una su al".split(),
}

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_ids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows: for each word the ids of itself and of its beginning (-1: it is no longer), and each row's first word."""
    for _, _, data, offsets in blocks(column):
        data = _FOLD[data]
        starts, ends, first = spans(_LETTERS[data], offsets)
        out = np.full((len(starts), 2), -1, np.int64)
        out[:, 0] = span_hashes(data, starts, ends) >> np.uint64(64 - HASH_BITS)
        long = np.flatnonzero(ends - starts > PREFIX)
        code = np.zeros(len(long), np.uint64)
        for k in range(PREFIX):
            code = code * np.uint64(256) + data[starts[long] + k]
        out[long, 1] = (mix(code) >> np.uint64(64 - HASH_BITS)) + np.uint64(1 << HASH_BITS)
        yield out, first


def ids_of(words: list[str]) -> np.ndarray:
    return np.concatenate([ids[:, 0] for ids, _ in word_ids(pa.array([" ".join(words)]))])


class Network:
    """The trained arrays; a few megabytes at most, since the sample bounds the vocabulary."""

    def __init__(self, vocabulary: np.ndarray, rng: np.random.Generator):
        self.vocabulary = vocabulary
        self.table = rng.normal(0, 0.05, (len(vocabulary) + 1, DIMENSION)).astype(np.float32)
        self.table[0] = 0
        taps = sum(WIDTHS)
        self.taps = rng.normal(0, 0.4, (taps, DIMENSION, FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.votes = np.zeros((len(vocabulary) + 1, len(FUNCTION_WORDS)), np.float32)
        for k, words in enumerate(FUNCTION_WORDS.values()):
            slot = self.slots(ids_of(words))
            self.votes[slot[slot > 0], k] = 1
        self.thresholds = np.full(len(FUNCTION_WORDS) + 1, 0.5)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        """Row of the embedding table for each id; 0 for those it does not know."""
        if not len(self.vocabulary):
            return np.zeros(ids.shape, np.int64)
        at = np.searchsorted(self.vocabulary, ids)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == ids, at + 1, 0)

    def padded(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with zeros after each row, and where each row begins and ends (an empty row owns one pad)."""
        out = np.zeros((len(slots) + PAD * (len(first) - 1), 2), np.int64)
        out[np.arange(len(slots)) + PAD * rows_of(first)] = slots
        begin = first[:-1] + PAD * np.arange(len(first) - 1)
        return out, np.stack([begin, begin + np.maximum(1, np.diff(first))], axis=1)

    def responses(self) -> list[np.ndarray]:
        """For each tap, what every word adds to every filter."""
        return [self.table @ t for t in self.taps]

    def maps(self, words: np.ndarray, responses: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For each width the filters at every position; the last positions see only what is left."""
        whole, prefix = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
        tap = 0
        for width in WIDTHS:
            total = np.take(responses[tap], whole, axis=0)
            total += np.take(responses[tap], prefix, axis=0)
            for j in range(1, width):
                total[:-j] += np.take(responses[tap + j], whole[j:], axis=0)
                total[:-j] += np.take(responses[tap + j], prefix[j:], axis=0)
            tap += width
            yield width, total

    def pooled(self, words: np.ndarray, ends: np.ndarray, responses: list[np.ndarray]) -> np.ndarray:
        """Maximum of each filter over each row."""
        cuts = ends.ravel()
        out = []
        for _, total in self.maps(words, responses):
            total = np.concatenate([total, np.full((1, FILTERS), -np.inf, np.float32)])
            out.append(np.maximum.reduceat(total, cuts, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift[0]

    def language(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Index of the language with most function words; the last index where there are none."""
        total = np.zeros((len(slots) + 1, self.votes.shape[1]), np.float64)
        np.cumsum(self.votes[slots[:, 0]], axis=0, out=total[1:])
        votes = total[first[1:]] - total[first[:-1]]
        return np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), self.votes.shape[1])

    def raw(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        responses, logits, langs = self.responses(), [], []
        for ids, first in word_ids(column):
            slots = self.slots(ids)
            words, ends = self.padded(slots, first)
            logits.append(self.logits(self.pooled(words, ends, responses)))
            langs.append(self.language(slots, first))
        if not logits:
            return np.empty(0), np.empty(0, np.int64)
        return np.concatenate(logits).astype(float), np.concatenate(langs)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated scores: 0.5 is the threshold of the text's language."""
        logits, langs = self.raw(column)
        t = self.thresholds[langs]
        return 1 / (1 + np.exp(-np.clip(logits - np.log(t / (1 - t)), -30, 30)))


def _batch(net: Network, docs: list[np.ndarray], labels: np.ndarray, responses: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the logistic loss over some documents."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    words, ends = net.padded(np.concatenate(docs) if first[-1] else np.empty((0, 2), np.int64), first)
    tops, places = [], []
    for _, total in net.maps(words, responses):
        at = np.stack([total[b:e].argmax(axis=0) + b for b, e in ends])
        places.append(at)
        tops.append(np.take_along_axis(total, at, axis=0))
    pooled = np.concatenate(tops, axis=1)
    live = np.maximum(pooled + net.bias, 0)
    p = 1 / (1 + np.exp(-(live @ net.out + net.shift[0])))
    err = ((p - labels) / len(docs)).astype(np.float32)
    back = np.where(pooled + net.bias > 0, err[:, None] * net.out, 0).astype(np.float32)
    grad = {"out": live.T @ err, "shift": np.array([err.sum()], np.float32), "bias": back.sum(axis=0), "taps": np.zeros_like(net.taps), "table": np.zeros_like(net.table)}
    tap = 0
    for k, width in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            seen = words[np.minimum(places[k] + j, len(words) - 1)]
            grad["taps"][tap] = np.einsum("nf,nfd->df", g, net.table[seen].sum(axis=2))
            add = (g[:, :, None] * net.taps[tap].T[None]).reshape(-1, DIMENSION)
            for side in (0, 1):
                np.add.at(grad["table"], seen[:, :, side].ravel(), add)
            tap += 1
    grad["table"][0] = 0
    return grad


def train(texts: list[str], labels: list[int], weights: dict[int, float] | None = None, seed: int = 5) -> Network:
    """Fit on labelled texts; every fourth is kept aside for the thresholds. ``weights``: documents a sampled one stands for, by class."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    docs = [ids for t in texts for ids in [np.concatenate([x for x, _ in word_ids(pa.array([t], pa.string()))] or [np.empty((0, 2), np.int64)])]]
    aside = np.arange(len(docs)) % 4 == 3
    distinct = [np.unique(d[d >= 0]) for d, a in zip(docs, aside) if not a]
    ids, n = np.unique(np.concatenate([*distinct, np.empty(0, np.int64)]).astype(np.int64), return_counts=True)
    # the same few documents teach a word in every sample, so that words of smaller languages stay known as it grows
    net = Network(ids[n >= MIN_DOCUMENTS], rng)
    slots = [net.slots(d) for d in docs]
    fit = np.flatnonzero(~aside)
    names = ("out", "shift", "bias", "taps", "table")
    mean = {k: np.zeros_like(getattr(net, k)) for k in names}
    square = {k: np.zeros_like(getattr(net, k) if k != "table" else net.table[:1]) for k in names}
    step = 0
    # small samples are seen more often, so that all take some steps
    epochs = min(5 * EPOCHS, max(EPOCHS, STEPS * BATCH // max(1, len(fit))))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            if not len(part):
                continue
            step += 1
            grad = _batch(net, [np.where(rng.random((len(slots[i]), 1)) < DROP, 0, slots[i]) for i in part], y[part], net.responses())
            for k in names:
                mean[k] += 0.1 * (grad[k] - mean[k])
                # one scale for all words: a rare word must not move as far as one that always tells
                square[k] += 0.01 * ((grad[k] ** 2 if k != "table" else (grad[k] ** 2).max(axis=0, keepdims=True)) - square[k])
                value = getattr(net, k)
                value -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                if k in ("taps", "table"):
                    value *= 1 - DECAY * rate
        net.table[0] = 0
    _calibrate(net, [texts[i] for i in np.flatnonzero(aside)], y[aside], weights or {})
    return net


def _calibrate(net: Network, texts: list[str], y: np.ndarray, weights: dict[int, float]) -> None:
    """Each language's threshold: the one with the best F1 on its documents set aside; with few of them, that of all."""
    logits, langs = net.raw(pa.array(texts, pa.string()))
    weight = np.where(y > 0, weights.get(1, 1.0), weights.get(0, 1.0))

    def best(part: np.ndarray) -> float | None:
        if y[part].sum() < 10 or (1 - y[part]).sum() < 10:
            return None
        order = np.argsort(-logits[part])
        values, good, w = logits[part][order], y[part][order], weight[part][order]
        hit, said = np.cumsum(good * w), np.cumsum(w)
        f1 = 2 * hit / (said + (good * w).sum())
        k = int(f1.argmax())
        # halfway to the next score below, in the middle of the gap
        cut = (values[k] + values[k + 1]) / 2 if k + 1 < len(values) else values[k] - 0.5
        # few documents say little: their cut is drawn towards even odds
        cut *= good.sum() / (good.sum() + PRIOR)
        return float(np.clip(1 / (1 + np.exp(-cut)), 0.02, 0.98))

    every = best(np.ones(len(y), bool)) if len(y) else None
    for k in range(len(net.thresholds)):
        own = best(langs == k) if len(y) else None
        net.thresholds[k] = own or every or 0.5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: str = "toxicity") -> Network:
    """Learn from labelled documents that are not held out: at most ``sample`` of each class reach the driver."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), PARTS, HELD_PART))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # the labels are sampled before their texts are looked up (the factor covers labels without a text), so the broadcast is of 4 * sample ids at most
    chosen = bounded_sample(known.withColumn("text", F.lit("")), "toxic", counts, 2 * sample, seed).drop("text")
    rows = bounded_sample(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "toxic", dict.fromkeys(counts, 0), sample, seed)
    got = rows.select("text", "toxic").orderBy(F.md5(F.concat("text", F.col("toxic").cast("string"))), "toxic").collect()
    sizes = {k: sum(r["toxic"] == k for r in got) for k in (0, 1)}
    return train([r["text"] for r in got], [r["toxic"] for r in got], {k: counts.get(k, 0) / max(1, sizes[k]) for k in (0, 1)})


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5) from the text alone.

    Null and empty texts score as texts without known words. Repeated rows
    score alike; an empty table gives no rows; columns named like a result are
    replaced. A text is read whole, in blocks of about a megabyte.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = net.scores(batch.column(batch.schema.get_field_index(text)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(kept).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, folder, "labels"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the network learns from the labels of the folder."""
    net = fit(docs, table(spark, folder, "labels"))
    inner, back = aside(docs, {"score", "predicted"})
    return back(score(inner, net).where("predicted = 0"))
