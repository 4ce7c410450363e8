"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. If two differ in at most 3, one 32-bit half of them
differs in at most 1. For each half the anchors are the code words of the
perfect [31, 26] Hamming code over its low 31 bits: covering radius 1. Every
fingerprint is filed at home (the anchor within the radius) and replicated to
all anchors within radius plus threshold (2): at most 16 for a half. So of two
linked fingerprints one meets the other at its home, and comparing homes with
replicas anchor by anchor finds every link, and no other since all 64 bits are
compared. Fingerprints are made distinct before; what leaves an anchor are the
edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_intdigest

from skyledger.llm.common import aside, components, forest, table
from skyledger.session import cut_lineage

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: entries of an anchor that are compared in one piece; fuller anchors are split by the other half of the bits
CROWD = 4096
#: pairs of fingerprints compared at once
PAIRS = 1 << 20


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; null and texts without words have zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = shingle_hashes(words, shingle)
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    parts = map(joined.__getitem__, map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(map(partial(xxh64_intdigest, seed=SEED), parts), np.uint64, len(words) - k + 1)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """``docs`` with its fingerprint as a signed long in a further column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            fp = np.array([fingerprint_of(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            keep = [i for i in range(batch.num_columns) if batch.schema.field(i).name in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fp)], [*(batch.schema.field(i).name for i in keep), name])

    kept = [c for c in docs.columns if c != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{name}` bigint"])
    return docs.mapInArrow(run, schema)


def _anchor_table() -> np.ndarray:
    """For each syndrome of the Hamming code, the masks that lead to all anchors within distance 2; the nearest is first."""
    rows = []
    for s in range(32):
        bit = lambda i: (1 << (i - 1)) if i else 0
        rows.append([bit(s), *({bit(i) ^ bit(i ^ s) for i in range(1, 32) if i != s and i < (i ^ s)} if s else [])])
    width = max(map(len, rows))
    return np.array([r + [-1] * (width - len(r)) for r in rows], np.int64)


def _syndromes(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), np.int64)
    for i in range(1, 32):
        s ^= ((half >> (i - 1)) & 1) * i
    return s


def anchors(fp: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which fingerprint, its anchor in that half (26 of 31 bits are free, so the word itself names it), and whether it is home."""
    low = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
    masks = _anchor_table()[_syndromes(low)]
    row, col = np.nonzero(masks >= 0)
    return row, low[row] ^ masks[row, col], col == 0


def _entries(second: bool):
    """Rows of fingerprints to rows (anchor, fp, home); ``second`` splits crowded anchors by the anchors of the other half's quarters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for half in (0, 1):
                row, word, home = anchors(fp, half)
                yield pa.RecordBatch.from_arrays([pa.array(word | (half << 31)), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, anchor, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "anchor", "home"))
            # of the other half at most 3 bits differ, so of its four bytes one is the same
            other = fp.view(np.uint64) >> np.where(anchor >> 31, 0, 32).astype(np.uint64)
            for part in range(4):
                byte = ((other >> np.uint64(8 * part)) & np.uint64(255)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor | (byte << 32) | ((part + 1) << 40)), pa.array(fp), pa.array(home)], ["anchor", "fp", "home"])

    return split if second else run


def _compare(homes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints, in pieces of at most PAIRS pairs."""
    a, b = [], []
    step = max(1, PAIRS // max(1, len(others)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k : k + step, None] ^ others[None, :]) <= DISTANCE
        i, j = np.nonzero(near)
        a.append(homes[k : k + step][i])
        b.append(others[j])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by anchor to forest edges (a, b); memory is that of a batch and of one anchor."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        x, y = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def solve(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        n, n_home = np.diff(cut), np.add.reduceat(home.astype(np.int64), cut[:-1])
        found = []
        # small anchors all at once: every home of an anchor against every entry of it
        small = (n_home > 0) & (n > 1) & (n * n_home <= PAIRS)
        member = np.repeat(small, n)
        size = np.repeat(n, n)
        first = np.repeat(cut[:-1], n)
        rows = np.flatnonzero(member & home)
        total = np.concatenate([[0], np.cumsum(size[rows])])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
            left = np.repeat(rows[lo:hi], size[rows[lo:hi]])
            right = np.arange(len(left)) - np.repeat(total[lo:hi] - total[lo], size[rows[lo:hi]]) + np.repeat(first[rows[lo:hi]], size[rows[lo:hi]])
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE) & (left != right)
            found.append((fp[left[near]], fp[right[near]]))
            lo = hi
        for g in np.flatnonzero((n_home > 0) & (n > 1) & ~small):
            part, own = fp[cut[g] : cut[g + 1]], home[cut[g] : cut[g + 1]]
            found.append(_compare(part[own], part))
        if found:
            yield out(*(np.concatenate(x) for x in zip(*found)))

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home"))
        new = (new[0], new[1].view(np.uint64), new[2].astype(bool))
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        if not len(held[0]) or held[0][0] == held[0][-1]:
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        yield from solve(*(x[:last] for x in held))
        held = tuple(x[last:] for x in held)
    if held is not None and len(held[0]):
        yield from solve(*held)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same sets of fingerprints as all links do; ``fps``: distinct longs ``fp``."""
    entries = fps.mapInArrow(_entries(False), "anchor bigint, fp bigint, home boolean")
    counts = entries.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).where("n > 1 and n_home > 0")
    # Spark sizes what a task function makes by its input, here up to 34 times too low, and would broadcast it
    met = entries.join(counts.hint("merge"), "anchor")
    crowded = met.where(F.col("n") > CROWD).drop("n", "n_home").mapInArrow(_entries(True), "anchor bigint, fp bigint, home boolean")
    ready = met.where(F.col("n") <= CROWD).drop("n", "n_home").unionAll(crowded)
    # a plain hash decides the partition, so that neighbouring anchors spread
    return ready.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and ties come back as often as they came, with one component;
    a null key belongs to a component but does not name it. An empty table
    gives no rows. Further columns are ignored.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fp = cut_lineage(fingerprints(narrow).select("doc_id", F.col("_fp").alias("fp")))
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    member = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "component")
    rooted = classes.join(member.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(rooted.join(roots.hint("merge"), "root").select("fp", "component_id"))
    return fp.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest id stays.

    Of repeated rows with that id one stays, the first by text, source,
    language and characters. Rows without an id cannot be named and all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    chosen = found.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars")
    inner, back = aside(docs, {"_copy"})
    kept = inner.join(chosen.hint("merge"), "doc_id", "left_semi").withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")
    return back(kept.unionAll(inner.where("doc_id is null")))
