"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``STEPS`` bytes, so that many windows advance
together; two small gated recurrent units run over each, one from either end. A
softmax layer labels every byte from both states, and the mean of these
probabilities over the whole text is the document's. Gates and states use
x / (1 + |x|) in place of sigmoid and tanh, which numpy computes much faster.
Training is backpropagation through time in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import blocks, bounded_sample, held_out, table

#: training documents of each language, and languages learned (the most frequent ones): the bound of what reaches the driver
SAMPLE, LANGUAGES = 400, 64
PARTS, HELD_PART = 3, 1
STEPS, HIDDEN = 64, 8
BATCH, UPDATES = 512, 250
#: windows that advance together when texts are read
TOGETHER = 4096
UNKNOWN = "und"


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes cut into rows of ``steps`` (short ones filled with 0), the length of each, and the text it belongs to."""
    size = np.diff(offsets)
    n = -(-size // steps)
    owner = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][owner] + steps * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(steps, offsets[1:][owner] - start)
    at = start[:, None] + np.arange(steps)
    out = np.append(data, np.zeros(steps, np.uint8))[np.minimum(at, len(data))]
    short = length < steps
    out[short] *= (np.arange(steps) < length[short, None]).astype(np.uint8)
    return out, length, owner


class Reader:
    """The arrays of the network. Index 0 of the first axis reads forward, 1 backward."""

    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        h, k = HIDDEN, max(1, len(languages))
        self.byte = rng.normal(0, 0.5, (2, 256, 3 * h)).astype(np.float32)  # update, reset, candidate
        self.state = rng.normal(0, 0.4, (2, h, 3 * h)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)
        self.bias = np.zeros(k, np.float32)

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[list[list[np.ndarray]], list]:
        """State after each byte in both directions; what backpropagation needs if asked for. ``x``: windows by step, (steps, windows)."""
        h, both, memory = HIDDEN, [], []
        for side in (0, 1):
            order = range(len(x)) if side == 0 else range(len(x) - 1, -1, -1)
            s = np.zeros((x.shape[1], h), np.float32)
            got: list[np.ndarray] = [s] * len(x)
            for t in order:
                a = np.take(self.byte[side], x[t], axis=0)
                u = s @ self.state[side]
                gate = a[:, : 2 * h] + u[:, : 2 * h]
                gate /= 1 + np.abs(gate)
                gate *= 0.5
                gate += 0.5
                z, r = gate[:, :h], gate[:, h:]
                c = r * u[:, 2 * h :]
                c += a[:, 2 * h :]
                c /= 1 + np.abs(c)
                new = c - s
                new *= z
                new += s
                if keep:
                    memory.append((side, t, s, z, r, c, u[:, 2 * h :]))
                s = new
                got[t] = s
            both.append(got)
        return both, memory

    def labels(self, both: list[list[np.ndarray]], t: int) -> np.ndarray:
        """Probability of each language at one byte."""
        logit = both[0][t] @ self.out[:HIDDEN]
        logit += both[1][t] @ self.out[HIDDEN:]
        logit += self.bias
        logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        return logit

    def read(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (steps, windows, languages): the same as ``states`` and ``labels``, in buffers that stay in the cache."""
        h, half = HIDDEN, np.float32(0.5)
        steps, n = x.shape
        x = x.astype(np.intp)
        out = np.empty((2, steps, n, h), np.float32)
        z, r, c, q, v = (np.empty((n, h), np.float32) for _ in range(5))
        for side in (0, 1):
            byte = [np.ascontiguousarray(self.byte[side][:, k * h : (k + 1) * h]) for k in range(3)]
            state = [np.ascontiguousarray(self.state[side][:, k * h : (k + 1) * h]) for k in range(3)]
            state[2] = state[2] * half  # of r = (1 + squashed) / 2
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                for gate, k in ((z, 0), (r, 1)):
                    np.take(byte[k], x[t], axis=0, out=gate, mode="clip")
                    np.matmul(s, state[k], out=q)
                    gate += q
                    np.abs(gate, out=q)
                    q += 1
                    gate /= q
                    gate += 1
                np.matmul(s, state[2], out=v)
                r *= v
                np.take(byte[2], x[t], axis=0, out=c, mode="clip")
                c += r
                np.abs(c, out=q)
                q += 1
                c /= q
                new = out[side, t]
                np.subtract(c, s, out=new)
                new *= z
                new *= half
                new += s
                s = new
        p = out[0].reshape(-1, h) @ self.out[:h]
        p += out[1].reshape(-1, h) @ self.out[h:]
        p += self.bias
        np.minimum(p, 80, out=p)
        np.exp(p, out=p)
        p /= p @ np.ones((p.shape[1], 1), np.float32) + np.float32(1e-30)
        return p.reshape(steps, n, -1)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Mean of the byte labels over each whole text; zeros for an empty one."""
        parts = []
        for lo, hi, data, offsets in blocks(column):
            total = np.zeros((hi - lo, len(self.languages)))
            every, length, owner = windows(data, offsets)
            for k in range(0, len(every), TOGETHER):
                n = length[k : k + TOGETHER]
                p = self.read(np.ascontiguousarray(every[k : k + TOGETHER].T))
                short = np.flatnonzero(n < len(p))
                for i in short:
                    p[n[i] :, i] = 0
                np.add.at(total, owner[k : k + TOGETHER], p.sum(axis=0))
            parts.append(total / np.maximum(1, np.diff(offsets))[:, None])
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean loss over all bytes."""
        h = HIDDEN
        both, memory = self.states(x, keep=True)
        grad = {k: np.zeros_like(getattr(self, k)) for k in ("byte", "state", "out", "bias")}
        back = [[None] * len(x), [None] * len(x)]
        loss, count = 0.0, float(n.sum())
        rows = np.arange(len(y))
        for t in range(len(x)):
            p = self.labels(both, t)
            live = (t < n).astype(np.float32) / count
            loss -= float((np.log(p[rows, y] + 1e-9) * live).sum())
            p[rows, y] -= 1
            p *= live[:, None]
            grad["out"][:h] += both[0][t].T @ p
            grad["out"][h:] += both[1][t].T @ p
            grad["bias"] += p.sum(axis=0)
            back[0][t], back[1][t] = p @ self.out[:h].T, p @ self.out[h:].T
        carry, last = None, None
        for side, t, s, z, r, c, uc in reversed(memory):
            if side != last:
                carry, last = np.zeros_like(s), side
            d = back[side][t] + carry
            dc = d * z * (1 - np.abs(c)) ** 2  # derivative of x / (1 + |x|) from its value
            dz = d * (c - s) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * uc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            np.add.at(grad["byte"][side], x[t], da)
            grad["state"][side] += s.T @ du
            carry = d * (1 - z) + du @ self.state[side].T
        return grad, loss


def train(texts: list[str], langs: list[str], seed: int = 3, updates: int = UPDATES) -> Reader:
    """Fit on labelled texts: windows are drawn evenly by language from the whole of them."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    net = Reader(names, rng)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    every, length, owner = windows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    if len(names) < 2 or not len(every):
        return net
    y = np.array([names.index(v) for v in langs])[owner]
    pools = [np.flatnonzero((y == k) & (length > 8)) for k in range(len(names))]
    pools = [p if len(p) else np.flatnonzero(y == k) for k, p in enumerate(pools)]
    fields = ("byte", "state", "out", "bias")
    mean = {k: np.zeros_like(getattr(net, k)) for k in fields}
    square = {k: np.zeros_like(getattr(net, k)) for k in fields}
    for step in range(1, updates + 1):
        pick = np.concatenate([rng.choice(p, max(1, BATCH // len(names))) for p in pools if len(p)])
        grad, _ = net.gradients(np.ascontiguousarray(every[pick].T), length[pick], y[pick])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        rate = 0.02 * (1 - step / (updates + 1)) + 0.0005
        for k in fields:
            g = grad[k] * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            value = getattr(net, k)
            value -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Reader:
    """Learn from texts with a language that are not held out: at most ``sample`` of each of the most frequent languages."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"), PARTS, HELD_PART))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    # ids are sampled first, and texts are read only for them: at most ``sample`` ids of each language are broadcast
    chosen = bounded_sample(known.select("doc_id", "lang").withColumn("text", F.lit("")), "lang", counts, sample, "langid").select("doc_id").distinct()
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi")
    got = bounded_sample(rows, "lang", dict.fromkeys(counts, 0), sample, "langid").select("text", "lang").collect()
    got = sorted((r["lang"], r["text"]) for r in got)
    return train([t for _, t in got], [v for v, _ in got])


def identify(docs: DataFrame, net: Reader, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the whole text.

    Null and empty texts, and those without a letter, are ``und`` with score 0,
    and so is everything if the sample taught no language. Repeated rows score
    alike; an empty table gives no rows; columns named like a result are
    replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "lang_pred string, score double"])
    names = np.array([*net.languages, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            p = net.probabilities(column)
            wordless = np.array([v is None or not any(map(str.isalpha, v)) for v in (t.as_py() for t in column)], bool)
            if len(net.languages):
                best, score = p.argmax(axis=1), p.max(axis=1)
            else:
                best, score = np.zeros(len(p), np.int64), np.zeros(len(p))
            best, score = np.where(wordless, len(names) - 1, best), np.where(wordless, 0.0, np.clip(score, 0, 1))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(kept).mapInArrow(run, schema)


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "lang_pred", "score")
