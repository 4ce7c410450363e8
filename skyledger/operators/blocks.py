"""Compare two keyed tables block by block without emitting all pairs.

Every key is cut into blocks of bounded size on both sides, so a hot key becomes
many small tasks instead of one large one. Keys that fit into one block are
pooled, so that many small keys share a task call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK = 2048
SAME = "__code"


def same_key(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Matrix of the row pairs that share the join key inside a pool."""
    return left[SAME].to_numpy()[:, None] == right[SAME].to_numpy()[None, :]


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ids: Sequence[str],
    right_ids: Sequence[str],
    compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block: int = BLOCK,
) -> DataFrame:
    """Run ``compare`` on left and right blocks whose keys meet.

    ``compare`` gets both blocks with a column that ``same_key`` reads; it must
    ignore pairs of different keys.
    """
    keys = list(keys)
    nl = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l"))
    nr = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    # file sizes understate these tables: none of them may be broadcast
    sizes = nl.join(nr.hint("merge"), keys)
    larger = F.greatest("__l", "__r")
    pools = sizes.where(larger <= block).agg(F.greatest(F.ceil(F.sum(larger) / block), F.lit(1)).alias("p")).scalar()
    own = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    pooled = F.concat(F.lit("pool"), F.pmod(F.xxhash64(*keys), pools).cast("string"))
    sizes = sizes.select(
        *keys,
        F.ceil(F.col("__l") / block).cast("int").alias("__nl"),
        F.ceil(F.col("__r") / block).cast("int").alias("__nr"),
        F.when(larger <= block, pooled).otherwise(own).alias("__group"),
    )

    def spread(df: DataFrame, ids: Sequence[str], mine: str, other: str, n_mine: str, n_other: str) -> DataFrame:
        out = df.join(sizes.hint("merge"), keys)
        out = out.withColumn(mine, F.pmod(F.xxhash64(*ids), F.col(n_mine)).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        return out.withColumn("__group", F.concat("__group", F.lit(""))).drop("__nl", "__nr")

    lhs = spread(left, left_ids, "__lb", "__rb", "__nl", "__nr")
    rhs = spread(right, right_ids, "__rb", "__lb", "__nr", "__nl")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({n: [] for n in names})
        codes = pd.concat([lp[keys], rp[keys]]).groupby(keys, sort=False).ngroup().to_numpy()
        return compare(lp.assign(**{SAME: codes[: len(lp)]}), rp.assign(**{SAME: codes[len(lp) :]}))

    group = ["__group", "__lb", "__rb"]
    # a fixed partition count: the rows are few but each group is a matrix product,
    # so merging partitions by size would serialise the work
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lhs, rhs = lhs.repartition(n, *group), rhs.repartition(n, *group)
    return lhs.groupBy(*group).cogroup(rhs.groupBy(*group)).applyInPandas(run, schema)
