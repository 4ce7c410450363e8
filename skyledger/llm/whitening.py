"""Whitening of vectors through a covariance that is recovered from variances only.

Entries become integers, so sums are exact whatever the order of the rows. The
first pass gives the number of rows n and the sum S of every dimension. The
second adds up, in exact integers, the squared centred values (n*x - S) of
every dimension and of the sum of every pair of dimensions. Polarisation turns
them into covariances, 2 cov(i, j) = var(i + j) - var(i) - var(j), and the
driver takes the eigenvectors of that dims x dims matrix. Only these sums, of a
size that the number of dimensions sets, ever leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import table
from skyledger.session import cut_lineage

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: entries beyond this are refused: their integers would not fit
LARGEST = 2.0**50
#: rows of a block; sums of products of two 24-bit numbers over it stay far below 2**63
BLOCK_ROWS = 2048
_PART_BITS = 24


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as a matrix of floor(64 c) + 1 000 000."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"entries over {LARGEST:g} cannot be whitened exactly")
    return (np.floor(SCALE * flat) + SHIFT).astype(np.int64).reshape(-1, dims)


def usable(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, vec): rows whose vector is there, not empty and has finite entries only."""
    out = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = integers(batch.column(0), dims)
            for lo in range(0, len(x), BLOCK_ROWS):
                part = x[lo : lo + BLOCK_ROWS]
                total = [t + s for t, s in zip(total, part.sum(0).tolist())]
            n += len(x)
        cols = [pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * dims, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["dim", "s", "n"])

    parts = rows.select("vec").mapInArrow(run, "dim int, s decimal(38,0), n bigint")
    found = {r["dim"]: r for r in parts.groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect()}
    return (found[0]["n"], [int(found[d]["s"]) for d in range(dims)]) if found else (0, [0] * dims)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S as 64-bit integers, or as Python integers where those could overflow."""
    wide = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, total), default=0) >= 2**62
    if wide:
        return x.astype(object) * n - np.array(total, dtype=object)
    return x * n - np.array(total, np.int64)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sum of the squares of every column, for up to ``BLOCK_ROWS`` rows."""
    if y.dtype == object or int(np.abs(y).max(initial=0)) >> (2 * _PART_BITS):
        return [int(t) for t in (y.astype(object) ** 2).sum(0)]
    high, low = y >> _PART_BITS, y & ((1 << _PART_BITS) - 1)
    parts = zip((high * high).sum(0).tolist(), (high * low).sum(0).tolist(), (low * low).sum(0).tolist())
    return [(hh << (2 * _PART_BITS)) + (hl << (_PART_BITS + 1)) + ll for hh, hl, ll in parts]


def variance_sums(rows: DataFrame, n: int, total: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of (n*x_i - S_i)**2, at (i, i), and of the square of the sum of two centred dimensions, at (i, j)."""
    dims = len(total)
    first, second = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0] * len(first)
        for batch in batches:
            x = integers(batch.column(0), dims)
            for lo in range(0, len(x), BLOCK_ROWS):
                y = centred(x[lo : lo + BLOCK_ROWS], n, total)
                at = 0
                for i in range(dims):
                    pair = y[:, i:] + y[:, i : i + 1]
                    pair[:, 0] = y[:, i]
                    got = square_sums(pair)
                    held[at : at + len(got)] = [a + b for a, b in zip(held[at : at + len(got)], got)]
                    at += len(got)
        # two decimals of 18 digits and more each, so that a sum over very many rows has room
        with localcontext() as exact:
            exact.prec = 80
            cols = [[Decimal(h >> 60) for h in held], [h & ((1 << 60) - 1) for h in held]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(cols[0], pa.decimal128(38, 0)), pa.array([Decimal(c) for c in cols[1]], pa.decimal128(38, 0))],
                ["i", "j", "high", "low"],
            )

    parts = rows.select("vec").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    added = parts.groupBy("i", "j").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("high", "low")))
    return {(r["i"], r["j"]): (int(r["high"]) << 60) + int(r["low"]) for r in added.collect()}  # dims * (dims + 1) / 2 rows


def covariance(found: dict[tuple[int, int], int], n: int, dims: int) -> np.ndarray:
    """Polarisation: every entry is one exact integer, divided once."""
    out = np.empty((dims, dims))
    for (i, j), t in found.items():
        # the centred values carry a factor n, the mean another one
        out[i, j] = out[j, i] = (t if i == j else t - found[i, i] - found[j, j]) / ((1 if i == j else 2) * n**3)
    return out


def axes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, explained shares), by falling eigenvalue.

    Directions without variance (below 1e-12 of the largest) cannot be scaled to
    one and are left out.
    """
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = np.flatnonzero(e > max(0.0, 1e-12 * e[0]))[:most]
    return e[keep], u[:, keep], e[keep] / np.trace(v)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped,
    and so are those whose length is not the most frequent one (of equally
    frequent lengths the greater). Repeated rows and null keys count and come
    back like others. ``deviation`` is exact; it is null where it does not fit
    a long. An empty table, or vectors without any variance, give no rows;
    entries over 2**50 are refused. Further columns are ignored.
    """
    spark = df.sparkSession
    good = usable(df, vector, key)
    common = good.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    rows = cut_lineage(good.where(F.size("vec") == dims))
    n, total = sums(rows, dims)
    e, u, shares = axes(covariance(variance_sums(rows, n, total), n, dims), components)
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    basis = u / np.sqrt(e)

    def project(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = centred(integers(batch_column, dims), n, total)
        return y, (y / n).astype(np.float64) @ basis

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, mean, count = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                _, w = project(batch.column(0).slice(lo, BLOCK_ROWS))
                cross += w.T @ w
                mean += w.sum(0)
                count += len(w)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[*cross.ravel(), *mean]], pa.list_(pa.float64()))], ["one", "parts"])

    # one array of k * (k + 1) sums from each partition
    parts = rows.select("vec").mapInArrow(moments, "one int, parts array<double>").select(F.posexplode("parts").alias("at", "x"))
    added = np.zeros(k * (k + 1))
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        added[r["at"]] = r["x"]
    mean = added[k * k :] / n
    error = float(np.abs(added[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                y, w = project(part.column(1))
                m = len(w)
                largest = int(np.abs(y).max(initial=0))
                exact = y if y.dtype != object and dims * largest * largest < 2**63 else y.astype(object)
                deviation = [int(d) if d < 2**63 else None for d in (exact * exact).sum(1).tolist()]
                cols = [
                    pc.take(part.column(0), pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pc.take(pa.array(deviation, pa.int64()), pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
