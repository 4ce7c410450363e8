"""Unions, differences and disjointness of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.operators.ranking import first_per_key


def union_arms(arms: dict[str, DataFrame], key: str, tag: str = "sample", validate: bool = True) -> DataFrame:
    """Tag and stack samples; an id in two arms raises."""
    out = None
    for name, df in arms.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if validate:
        shared = out.groupBy(key).agg(F.count_distinct(tag).alias("n")).where("n > 1")
        if not shared.isEmpty():
            raise ValueError(f"arms share {key} values")
    return out


def union_distinct_ids(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Sorted distinct ids of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct().orderBy(key)


def union_dedup_delta(old: DataFrame, new: DataFrame, key: str, ties: Sequence[Column]) -> DataFrame:
    """Old and new together, the old row wins."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
    return first_per_key(both, [key], [F.col("__p"), *ties]).drop("__p")


def except_delta(offered: DataFrame, held: DataFrame, key: str, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Offered ids not held yet; with bounds, a delta outside them raises."""
    delta = offered.select(key).distinct().join(held.select(key), key, "left_anti")
    if bounds is not None:
        n = delta.count()
        if not bounds[0] <= n <= bounds[1]:
            raise ValueError(f"delta of {n} ids is outside {bounds}")
    return delta


def intersect_check(a: DataFrame, b: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: sizes, overlap, and whether the two arms are disjoint and add up."""
    tags = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("w"))
    tags = tags.unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("w")))
    tags = tags.unionByName(whole.select(key, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("w")))
    per = tags.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("w").alias("w"))
    out = per.agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.sum("w").alias("n_whole"),
        F.sum(F.col("a") * F.col("b")).alias("n_overlap"),
        F.sum(F.greatest("a", "b") * F.col("w")).alias("n_covered"),
    )
    return out.withColumn("disjoint", F.col("n_overlap") == 0).withColumn(
        "adds_up", (F.col("n_overlap") == 0) & (F.col("n_covered") == F.col("n_whole"))
    )


def arm_diagnostics(df: DataFrame, tag: str, flags: Sequence[str]) -> DataFrame:
    """Rows and flag rates per arm."""
    rates = [F.avg(F.coalesce(F.col(f).cast("boolean"), F.lit(False)).cast("double")).alias(f"frac_{f}") for f in flags]
    return df.groupBy(tag).agg(F.count(F.lit(1)).alias("n_rows"), *rates)
