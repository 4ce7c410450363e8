"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots, in order. Each unordered pair of
its ``nearest`` first pivots names an inverted list, so two vectors meet in a
list if they share at least two of them; they are compared once, in the list of
the two smallest pivots they share, and linked if the cosine of the given
components is high enough in double precision. Equal vectors are made one class
before. Pivots are spread out: a vector close to a chosen pivot is no pivot, so
a large group of near copies owns about one and its members agree on the
others. What leaves a list are counts by class and the edges of a spanning
forest. Lists longer than a block are compared block by block in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import components, forest, table
from skyledger.session import cut_lineage

COSINE = 0.95
#: pivots are a bounded sample; every vector is indexed
PIVOTS, NEAREST = 512, 6
#: vectors that the pivots are chosen from, for each pivot wanted, and the highest cosine between two pivots
WALK, APART = 16, 0.8
#: members of a list that are compared in one piece
BLOCK = 1024


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column to rows of doubles, shorter lists filled with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large and very small components neither overflow nor vanish."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def usable(vector) -> "F.Column":
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """Stored classes of equal vectors: cid, vector, smallest id, copies. ``vectors``: id, vector (usable ones)."""
    return cut_lineage(vectors.groupBy("vector").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()))


def spread(x: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """The first rows, ``most`` at most, that are not closer than ``apart`` to one taken before. ``x``: rows of length one."""
    out, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for row in x:
        if n == len(out):
            break
        if not n or (out[:n] @ row).max() <= apart:
            out[n] = row
            n += 1
    return out[:n]


def pivots_of(classes: DataFrame, count: int, width: int, most: int) -> np.ndarray:
    """Spread-out pivots from about WALK * ``most`` vectors: those of a slice of the hash range, in its order."""
    cells = 1 << 30
    share = min(cells, -(-WALK * most * cells // max(1, count)))
    at = F.xxhash64(F.lit("pivots"), "vector")
    rows = classes.where(F.pmod(at, F.lit(cells)) < share).select(at.alias("at"), "vector").collect()
    found = np.zeros((len(rows), width))
    for k, r in enumerate(sorted(rows, key=lambda r: (r["at"], r["vector"]))):
        found[k, : len(r["vector"])] = r["vector"]
    return spread(unit(found), most)


def postings(classes: DataFrame, pivots: np.ndarray, width: int, nearest: int) -> DataFrame:
    """(list, cid, copies, size, near, vector) for every pair of a class's nearest pivots."""
    nearest = min(nearest, len(pivots))
    pairs = list(combinations(range(nearest), 2)) or [(0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                vector = part.column(2)
                near = np.sort(np.argsort(-(unit(matrix(vector, width)) @ pivots.T), axis=1, kind="stable")[:, :nearest], axis=1).astype(np.int32)
                size = np.diff(vector.offsets.to_numpy()).astype(np.int32)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * nearest, pa.int32()), pa.array(near.ravel()))
                for i, j in pairs:
                    name = near[:, i].astype(np.int64) * len(pivots) + near[:, j]
                    yield pa.RecordBatch.from_arrays([pa.array(name), part.column(0), part.column(1), pa.array(size), packed, vector], ["list", "cid", "copies", "size", "near", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cid", "copies", "vector").mapInArrow(run, f"list bigint, cid bigint, copies bigint, size int, near array<int>, vector {kind}")


def _compare(width: int, pivots: int, least: float):
    """Sorted (list, left, right) groups to rows (cid, other, links): counts have no other, edges no links."""

    def pieces(cid, copies, size, near, x, block, name, left, right):
        """Links of a group; where blocks differ only pairs across them."""
        a = np.flatnonzero(block == left)
        b = a if left == right else np.flatnonzero(block == right)
        if not len(a) or not len(b):
            return
        i, j = np.nonzero((x[a] @ x[b].T >= least) & (size[a][:, None] == size[b][None]))
        i, j = a[i], b[j]
        keep = cid[i] < cid[j] if left == right else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        # the two smallest shared pivots name the list that a pair belongs to
        same = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
        order = np.cumsum(same, axis=1)
        first, second = ((same & (order == k)).argmax(axis=1) for k in (1, 2))
        rows = np.arange(len(i))
        own = near[i, first].astype(np.int64) * pivots + near[i, second] == name if near.shape[1] > 1 else np.ones(len(i), bool)
        yield i[own], j[own]

    def solve(names, lefts, rights, cid, copies, size, near, x, block):
        new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (lefts[1:] != lefts[:-1]) | (rights[1:] != rights[:-1]), [True]]))
        links, edges = [], []
        for s, e in zip(new[:-1], new[1:]):
            if e - s < 2:
                continue
            part = slice(s, e)
            for i, j in pieces(cid[part], copies[part], size[part], near[part], x[part], block[part], names[s], lefts[s], rights[s]):
                if len(i):
                    c, n = cid[part], copies[part]
                    links.append((np.concatenate([c[i], c[j]]), np.concatenate([n[j], n[i]])))
                    edges.append((c[i], c[j]))
        if not links:
            return
        who, n = (np.concatenate(v) for v in zip(*links))
        ids, at = np.unique(who, return_inverse=True)
        a, b = forest(*(np.concatenate(v) for v in zip(*edges)))
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(total)], ["cid", "other", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], ["cid", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                col = {n: part.column(part.schema.get_field_index(n)) for n in part.schema.names}
                plain = [col[n].to_numpy(zero_copy_only=False) for n in ("list", "left", "right", "cid", "copies", "size", "block")]
                near = col["near"].flatten().to_numpy().reshape(part.num_rows, -1)
                new = [*plain[:6], near, unit(matrix(col["vector"], width)), plain[6]]
                held = new if held is None else [np.concatenate(v) for v in zip(held, new)]
                change = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
                at = np.flatnonzero(change)
                if len(at):
                    last = int(at[-1]) + 1
                    yield from solve(*(v[:last] for v in held))
                    held = [v[last:] for v in held]
        if held is not None:
            yield from solve(*held)

    return run


def compared(posted: DataFrame, width: int, pivots: int, least: float, block: int = BLOCK) -> DataFrame:
    """All lists compared: each member of a long list goes to as many pieces as the list has blocks."""
    counts = posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    met = posted.join(counts, "list")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("cid"), blocks)).otherwise(F.lit(0)).cast("int")
    spread = met.withColumn("block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.withColumns({"left": F.least("block", "_other"), "right": F.greatest("block", "_other")}).drop("_other", "n")
    keys = ["list", "left", "right"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(width, pivots, least), "cid bigint, other bigint, links bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Null and zero vectors and those with a null or non-finite component link
    with nothing and are kept. Vectors of different lengths do not link.
    Repeated rows are vectors of their own that link with each other. A null id
    counts as a link but names no component, so it is not kept. An empty table
    gives no rows; further columns are ignored. The index is approximate:
    vectors that share fewer than two of their nearest pivots do not meet.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    good = rows.where(usable(F.col("vector")))
    classes = classes_of(good)
    width, count = classes.agg(F.max(F.size("vector")), F.count("*")).first()
    lone = rows.where(~usable(F.col("vector"))).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if width is None:
        return lone
    found = pivots_of(classes, count, width, pivots)
    met = cut_lineage(compared(postings(classes, found, width, nearest), width, len(found), least, block))
    links = met.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    member = components(met.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    rooted = classes.select("cid", "low", "copies").join(member, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(links, "cid", "left")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(rooted.join(lows, "root").select("cid", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    told = classes.select("cid", F.col("vector").alias("_vector")).join(named, "cid").drop("cid")
    out = good.join(told, good["vector"] == told["_vector"])
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")).unionAll(lone)


def op2_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
