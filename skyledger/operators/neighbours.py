"""Exact k-nearest-neighbour join on vectors, in a grid of bounded blocks or pruned by pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger.functions.vectors import double_array, l2_normalise
from skyledger.operators.blocks import BLOCK, block_pairs, same_key
from skyledger.operators.ranking import exact_quantiles
from skyledger.session import cut_lineage

K_SUMMARY, K_GATE, GATE_QUANTILE = 50, 10, 0.99
DIGITS = 10
SLACK = 1e-6
# blocks on each side of the grid, until a block would have more than GRID_ROWS rows
GRID, GRID_ROWS = 8, 131072
# queries of a tile, its references, references of the first tile
TILE = (256, 4096, 256)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.clip(d2, 0.0, None))


def _nearest_of_block(qid: np.ndarray, a: np.ndarray, rid: np.ndarray, b: np.ndarray, k: int, cosine: bool, exclude_self: bool) -> tuple[np.ndarray, ...]:
    """Rows (query position, id, distance) of each query's k nearest of a block, in order of query, distance and id.

    References come by rising id, a tile at a time, so a later one of an equal
    distance never displaces an earlier one and only closer ones are looked at.
    """
    order = np.argsort(rid, kind="stable")
    rid, b = rid[order], b[order]
    a2, b2 = (a * a).sum(1), (b * b).sum(1)

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = 1 << 16
        parts = [np.sqrt(((a[i[x : x + step]] - b[j[x : x + step]]) ** 2).sum(1)) for x in range(0, len(i), step)]
        return np.concatenate([np.empty(0), *parts])

    out = []
    for q0 in range(0, len(a), TILE[0]):
        rows = np.arange(q0, min(q0 + TILE[0], len(a)))
        best = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
        bound = np.full(len(rows), np.inf)
        start = 0
        while start < len(b):
            stop = min(start + (TILE[1] if start else TILE[2]), len(b))
            dots = a[rows] @ b[start:stop].T
            with np.errstate(invalid="ignore"):
                if cosine:
                    seen = (1.0 - dots) < bound[:, None]
                else:
                    # squares lose digits: what could be closer is measured again
                    squares = a2[rows, None] + b2[None, start:stop]
                    seen = squares - 2.0 * dots < (bound * bound)[:, None] + 1e-12 * squares
            if exclude_self:
                seen &= qid[rows, None] != rid[None, start:stop]
            i, j = np.nonzero(seen)
            d = np.round(1.0 - dots[i, j] if cosine else apart(rows[i], j + start), DIGITS)
            closer = np.isfinite(d) & (d < bound[i])
            i, j, d = np.concatenate([best[0], i[closer]]), np.concatenate([best[1], j[closer] + start]), np.concatenate([best[2], d[closer]])
            by = np.lexsort((j, d, i))
            i, j, d = i[by], j[by], d[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = place < k
            last = place == k - 1
            bound[i[last]] = d[last]
            best = (i[kept], j[kept], d[kept])
            start = stop
        out.append((best[0] + q0, rid[best[1]], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _grid_join(r: DataFrame, q: DataFrame, k: int, cosine: bool, exclude_self: bool, rows: int) -> DataFrame:
    """Nearest references by a grid of query and reference blocks, each pair of blocks in one task.

    The blocks on a side are GRID up to GRID x ``rows`` rows of the larger table,
    so each vector is shuffled that often; beyond that they grow with the table.
    """
    larger = max(r.count(), q.count())
    n = max(1, min(GRID, math.ceil(larger / 256)), math.ceil(larger / rows))

    def spread(df: DataFrame, id: str, mine: str, other: str) -> DataFrame:
        df = df.withColumn(mine, F.pmod(F.xxhash64(id), F.lit(n)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        # few groups of long work: partitions enough to part them
        return df.repartition(4 * n * n, "qb", "rb")

    element = pa.struct([("distance", pa.float64()), ("rid", pa.int64())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        def of(t: pa.Table, id: str) -> tuple[np.ndarray, np.ndarray]:
            t = t.combine_chunks()
            v = t["v"].combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            return t[id].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

        names = pa.schema([("qid", pa.int64()), ("near", pa.list_(element))])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        (qid, a), (rid, b) = of(left, "qid"), of(right, "rid")
        i, ids, d = _nearest_of_block(qid, a, rid, b, k, cosine, exclude_self)
        ends = np.searchsorted(i, np.arange(len(qid) + 1)).astype("int32")
        values = pa.StructArray.from_arrays([pa.array(d), pa.array(ids)], fields=list(element))
        return pa.table([pa.array(qid), pa.ListArray.from_arrays(pa.array(ends), values)], schema=names)

    left, right = spread(q, "qid", "qb", "rb"), spread(r, "rid", "rb", "qb")
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(nearest, "qid long, near array<struct<distance double, rid long>>")
    # k rows for each block of references
    best = found.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("qid", F.posexplode("near").alias("at", "n")).select("qid", "n.rid", "n.distance", (F.col("at") + 1).alias("rank"))


def knn_join(
    refs: DataFrame,
    queries: DataFrame,
    *,
    ref_id: str,
    query_id: str,
    vector: str,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = False,
    pivots: int | None = None,
    block: int = BLOCK,
    grid_rows: int = GRID_ROWS,
) -> DataFrame:
    """Rows (query id, ``neighbour``, ``distance``, ``rank``) of the k nearest references.

    Every query block meets every reference block. Shuffled are a fixed number of
    copies of each vector (up to a million rows) and k rows for each query and
    reference block; the comparisons are quadratic, as vectors without clusters
    leave nothing to prune.

    With ``pivots``, for clustered vectors, references are assigned to their
    nearest pivot. A query first searches its home cell, which bounds its k-th
    distance; other cells are searched only when the triangle inequality says
    they could hold something closer. Both ways are exact. Ties go to the
    smaller reference id at 10 decimals. ``block`` bounds the blocks of pivot
    cells.
    """
    vec = l2_normalise(vector) if metric == "cosine" else double_array(vector)
    r = refs.select(F.col(ref_id).alias("rid"), vec.alias("v"))
    q = queries.select(F.col(query_id).alias("qid"), vec.alias("v"))
    if metric != "cosine":
        whole = ~F.exists("v", lambda e: e.isNull() | F.isnan(e))
        r, q = r.where(whole), q.where(whole)
    if pivots is None:
        found = _grid_join(r, q, k, metric == "cosine", exclude_self, grid_rows)
        return found.select(F.col("qid").alias(query_id), F.col("rid").alias("neighbour"), "distance", "rank")
    chosen = r.orderBy(F.xxhash64("rid"), "rid").limit(pivots).collect()
    if not chosen:
        return q.select(F.col("qid").alias(query_id), F.lit(None).cast("long").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    centres = np.array([c.v for c in chosen])

    @F.pandas_udf("array<double>")
    def to_pivots(v: pd.Series) -> pd.Series:
        return pd.Series(list(_gaps(_matrix(v), centres))) if len(v) else pd.Series([], dtype=object)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("pd", to_pivots("v"))
        return df.withColumn("cell", (F.array_position("pd", F.array_min("pd")) - 1).cast("int"))

    r = placed(r).select("rid", "v", "cell", F.array_min("pd").alias("pd"))
    q = placed(q)
    radius = np.full(len(centres), -np.inf)
    for row in r.groupBy("cell").agg(F.max("pd").alias("m")).collect():
        radius[row.cell] = row.m
    cosine = metric == "cosine"

    def nearest(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values("rid")
        a, b = _matrix(lp["v"]), _matrix(rp["v"])
        d = 1.0 - a @ b.T if cosine else _gaps(a, b)
        qi, ri = lp["qid"].to_numpy(), rp["rid"].to_numpy()
        if exclude_self:
            d = np.where(qi[:, None] == ri[None, :], np.inf, d)
        d = np.where(same_key(lp, rp), np.round(d, DIGITS), np.inf)
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, top, axis=1)
        keep = np.isfinite(dist).ravel()
        return pd.DataFrame(
            {"qid": np.repeat(qi, top.shape[1])[keep], "rid": ri[top].ravel()[keep], "distance": dist.ravel()[keep]}
        )

    schema = "qid long, rid long, distance double"
    by_distance = W.partitionBy("qid").orderBy("distance", "rid")
    home = block_pairs(q.select("qid", "v", "cell"), r.select("rid", "v", "cell"), ["cell"], ["qid"], ["rid"], nearest, schema, block)
    found = home
    if len(centres) > 1:
        best = cut_lineage(home.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k))
        full = best.groupBy("qid").agg(F.count(F.lit(1)).alias("m"), F.max("distance").alias("b"))
        reach = F.when(F.col("m") >= k, F.sqrt(2.0 * F.greatest(F.col("b"), F.lit(0.0))) if cosine else F.col("b"))
        bound = full.select("qid", reach.alias("reach"))
        far = F.array(*[F.lit(float(x)) for x in np.where(np.isfinite(radius), radius, -1e300)])
        order = F.sequence(F.lit(0), F.lit(len(centres) - 1))
        open_cells = F.filter(
            order,
            lambda c: (c != F.col("cell"))
            & (F.get(far, c) > -1e299)
            & (F.col("reach").isNull() | (F.get("pd", c) - F.get(far, c) <= F.col("reach") + SLACK)),
        )
        others = q.join(bound, "qid", "left").select("qid", "v", F.explode(open_cells).alias("cell"))
        away = block_pairs(others, r.select("rid", "v", "cell"), ["cell"], ["qid"], ["rid"], nearest, schema, block)
        found = best.drop("rank").unionByName(away)
    out = found.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
    return out.select(F.col("qid").alias(query_id), F.col("rid").alias("neighbour"), "distance", "rank")


def knn_mean_distance(refs: DataFrame, queries: DataFrame, *, ref_id: str, query_id: str, vector: str, k: int = K_GATE, **options) -> DataFrame:
    """Mean Euclidean distance to the k nearest references; a vector with holes is infinitely far."""
    near = knn_join(refs, queries, ref_id=ref_id, query_id=query_id, vector=vector, k=k, metric="euclidean", **options)
    mean = near.groupBy(query_id).agg(F.avg("distance").alias("knn_distance"))
    out = queries.select(query_id).join(mean, query_id, "left")
    return out.withColumn("knn_distance", F.coalesce("knn_distance", F.lit(float("inf"))))


def knn_summary(near: DataFrame, labels: DataFrame, *, query_id: str, label_id: str, columns: Sequence[str]) -> DataFrame:
    """Median, quartiles, IQR and std of the neighbours' labels, and top and median distance.

    A query's group holds k rows at most.
    """
    j = near.join(labels.select(F.col(label_id).alias("neighbour"), *columns), "neighbour")
    aggs = [F.min("distance").alias("top_distance"), F.percentile("distance", F.lit(0.5)).alias("median_distance")]
    for c in columns:
        aggs += [
            F.percentile(c, F.lit(0.5)).alias(f"knn_{c}_med"),
            F.percentile(c, F.lit(0.25)).alias(f"knn_{c}_p25"),
            F.percentile(c, F.lit(0.75)).alias(f"knn_{c}_p75"),
            (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias(f"knn_{c}_iqr"),
            F.stddev_pop(c).alias(f"knn_{c}_std"),
        ]
    return j.groupBy(query_id).agg(*aggs)


def support_gate(train: DataFrame, validation: DataFrame, application: DataFrame, *, key: str, vector: str, k: int = K_GATE, quantile: float = GATE_QUANTILE, **options) -> DataFrame:
    """Flag application rows farther from the training set than most validation rows."""
    args = {"ref_id": key, "query_id": key, "vector": vector, "k": k, **options}
    limit = exact_quantiles(knn_mean_distance(train, validation, **args), [], "knn_distance", {"q": quantile})
    scored = knn_mean_distance(train, application, **args)
    q = limit.scalar()
    return scored.withColumn("threshold", q).withColumn("latent_support_flag", F.col("knn_distance") > F.col("threshold"))


def k_sensitivity(near: DataFrame, labels: DataFrame, truth: DataFrame, *, query_id: str, label_id: str, column: str, ks: Sequence[int]) -> DataFrame:
    """Error of the neighbour median as a function of k, from one join at the largest k."""
    j = near.join(labels.select(F.col(label_id).alias("neighbour"), F.col(column).alias("y")), "neighbour")
    j = j.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).where(F.col("rank") <= F.col("k"))
    med = j.groupBy(query_id, "k").agg(F.percentile("y", F.lit(0.5)).alias("m"))
    e = med.join(truth.select(query_id, F.col(column).alias("t")), query_id).withColumn("e", F.col("m") - F.col("t"))
    return e.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")
    )
