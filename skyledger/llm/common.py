"""Helpers shared by the corpus operators: text blocks as arrays, hashes, samples and components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skyledger.session import cut_lineage

#: bytes of text turned into arrays at once; temporaries take about forty times as much
BLOCK_BYTES = 1 << 20
#: white space as the contracts of the operators define it
SPACES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = 0x9E3779B97F4A7C15


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def process_cache() -> dict:
    """What a Python worker keeps from one task to the next; functions travel by value, so their modules keep nothing."""
    return sys.modules.setdefault("_skyledger_process", types.ModuleType("_skyledger_process")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + np.uint64(_MULTIPLIER)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k mod 2**64 for k up to n."""
    known = process_cache().setdefault("powers", {})
    have = known.get(base)
    if have is None or len(have[0]) <= n:
        size = max(BLOCK_BYTES, n) + 1
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = known[base] = tuple(both)
    return have


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, their bytes and the rows' offsets in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay in one row: starts, ends, and the first run of each row (with a last entry)."""
    n = len(inside)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_table(*chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chars:
        out[list(c)] = True
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: polynomial over randomised byte values, then mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * salt + 1))
    terms = np.empty(len(data) + 1, np.uint64)
    np.multiply(values[data], up[: len(data)], out=terms[:-1])
    terms[-1] = 0
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    sums = np.add.reduceat(terms, cuts)[::2]
    return mix(sums * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every n consecutive items of h (rows are not told apart: mask windows that cross them)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1, base)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of every item, from each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def held_out(key: Column, parts: int, part: int) -> Column:
    """crc32 of the key's decimal text, modulo parts, equals part; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def bounded_sample(df: DataFrame, by: str, counts: dict, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, by a hash of doc_id: repeatable.

    ``counts`` has the number of rows of each value (few values). Only a slice
    of the hash range that holds about four times as many rows as are wanted is
    put in order, so a frequent value sends no more to its task than a rare one.
    """
    cells = 1 << 30
    share = {k: min(cells, -(-4 * (most + 10) * cells // max(1, n))) for k, n in counts.items()}
    if not share:
        return df.limit(0)
    limits = F.create_map(*(F.lit(x) for item in share.items() for x in item))
    sliced = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(cells)) < F.element_at(limits, F.col(by)))
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "text")
    return sliced.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def aside(df: DataFrame, names: set[str]):
    """``df`` with columns of these names (whatever their case) renamed, and what selects the columns of ``df`` under their names again."""
    moved = {c: f"__aside_{k}" for k, c in enumerate(df.columns) if c.lower() in names}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns))

    return df.select(*(F.col(f"`{c}`").alias(moved.get(c, c)) for c in df.columns)), back


def table_hash(df: DataFrame):
    """Row count and an order-free hash of all rows, as one driver-side tuple."""
    part = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(part, 8)), F.lit(0)), F.coalesce(F.sum(part.bitwiseAND(255)), F.lit(0))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it reaches.

    Alternating large-star and small-star rounds over DataFrames; a round cuts
    its lineage in the shared folder. Loops and null ends are ignored.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = table_hash(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        after = table_hash(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between 64-bit ids, at most one edge for each id that joins the same sets: (id, smallest id of its set)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]
