"""Binned mutual information, bootstrap replicas and class agreement."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.hashing import seeded_hash
from skyledger.operators.ranking import join_on_keys, one_row

POISSON_TERMS = 12


def poisson_cuts(terms: int = POISSON_TERMS) -> list[float]:
    """Cumulative probabilities of a unit Poisson count."""
    cuts, total = [], 0.0
    for n in range(terms):
        total += math.exp(-1.0) / math.factorial(n)
        cuts.append(total)
    return cuts


def replica_sums(df: DataFrame, keys: Sequence[str], ids: Sequence[str], values: Sequence[str], n: int, seed: int) -> DataFrame:
    """Poisson bootstrap: for each key and replica the sum of the weights ``w`` and of each weighted value.

    A row is hashed once; replica r reads its Poisson(1) weight from the number
    (a + r b) mod 2**32, where a and b are the first and the next 32 bits of the
    hash, b made odd. Tasks keep the sums of all replicas as arrays for each
    key, so what is shuffled is keys times replicas, however many rows there
    are. Values must not be NULL; NULL keys are a group.
    """
    part = lambda first: F.conv(F.substring(F.col("__h"), first, 8), 16, 10).cast("long")
    coded = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], seeded_hash(seed, *ids).alias("__h"))
    coded = coded.select(*keys, *values, part(1).alias("__a"), part(9).bitwiseOR(F.lit(1).cast("long")).alias("__b")).withColumn("__key", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    cuts, at = np.array(poisson_cuts()), list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            names = column("__key").dictionary_encode()
            code = names.indices.to_numpy()
            weighed = np.stack([np.ones(batch.num_rows), *(column(v).to_numpy(zero_copy_only=False) for v in at)], 1)
            a, b = column("__a").to_numpy(), column("__b").to_numpy()
            for lo in range(0, batch.num_rows, 4096):
                cut = slice(lo, lo + 4096)
                u = ((a[cut, None] + b[cut, None] * np.arange(n)) % 2**32 + 0.5) / 2**32
                w = np.searchsorted(cuts, u, side="right").astype(float)
                for k in np.unique(code[cut]):
                    rows = code[cut] == k
                    name = names.dictionary[int(k)].as_py()
                    sums[name] = sums.get(name, 0.0) + w[rows].T @ weighed[cut][rows]
        for name, total in sums.items():
            cols = [pa.array([name] * n), pa.array(range(n), pa.int32()), *(pa.array(total[:, k]) for k in range(total.shape[1]))]
            yield pa.RecordBatch.from_arrays(cols, ["__key", "replica", "w", *at])

    schema = ", ".join(["__key string", "replica int", "w double", *(f"`{v}` double" for v in at)])
    out = coded.select("__key", "__a", "__b", *at).mapInArrow(run, schema).groupBy("__key", "replica").agg(*[F.sum(c).alias(c) for c in ("w", *at)])
    if not keys:
        return out.drop("__key")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return out.select(F.from_json("__key", kinds).alias("__k"), "replica", "w", *at).select("__k.*", "replica", "w", *at)


def bootstrap_ci(df: DataFrame, ids: Sequence[str], value: str, n: int, seed: int, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Mean of a value over replicas: average, interval, and whether the lower end is above 0."""
    stats = replica_sums(df.where(F.col(value).isNotNull()), [], ids, [value], n, seed).select(F.try_divide(F.col(value), F.col("w")).alias("s"))
    return stats.agg(
        F.avg("s").alias("bootstrap_mean"),
        F.percentile("s", F.lit(levels[0])).alias("ci_lower"),
        F.percentile("s", F.lit(levels[1])).alias("ci_upper"),
    ).withColumn("passed", F.col("ci_lower") > 0)


def mutual_information(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """I(X;Y) in nats of two binned columns, per key; three small grouped counts."""
    ks = list(keys)
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*ks, x, y).agg(F.count(F.lit(1)).alias("n"))
    nx = joint.groupBy(*ks, x).agg(F.sum("n").alias("nx"))
    ny = joint.groupBy(*ks, y).agg(F.sum("n").alias("ny"))
    out = join_on_keys(join_on_keys(joint, nx, [*ks, x]), ny, [*ks, y])
    if ks:
        out = join_on_keys(out, joint.groupBy(*ks).agg(F.sum("n").alias("total")), ks)
    else:
        out = out.withColumn("total", one_row(joint.agg(F.sum("n").alias("t")))["t"])
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return out.groupBy(*ks).agg(F.sum(term).alias("mi"))


def conditional_mi(df: DataFrame, x: str, y: str, z: Sequence[str]) -> DataFrame:
    """I(X;Y|Z) in nats of binned columns from four grouped counts."""
    z = list(z)
    joint = df.dropna(subset=[x, y, *z]).groupBy(x, y, *z).agg(F.count(F.lit(1)).alias("n"))
    out = joint
    for cols, name in (([x, *z], "nxz"), ([y, *z], "nyz"), (z, "nz")):
        out = out.join(joint.groupBy(*cols).agg(F.sum("n").alias(name)), cols)
    total = one_row(joint.agg(F.sum("n").alias("t")))["t"]
    term = F.col("n") * F.ln(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))
    return out.withColumn("total", total).agg((F.sum(term) / F.max("total")).alias("cmi"))


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.dropna(subset=[truth, pred]).groupBy(
        F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Recall, precision, F1 and migration rate per class, from the K x K table."""
    t = counts.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))).alias("hit"))
    p = counts.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("n_pred"))
    out = t.join(p, "class", "full").fillna(0, ["n_true", "n_pred", "hit"])
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("n_true")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("n_pred")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return out.select(
        "class", "n_true", "n_pred", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"),
        (1.0 - recall).alias("migration"),
    )


def agreement_scores(counts: DataFrame) -> DataFrame:
    """Macro F1, Matthews correlation and adjusted Rand index of the K x K table."""
    per = class_scores(counts)

    def two(c: str) -> Column:
        n = F.col(c).cast("double")
        return n * (n - 1.0) / 2.0

    cells = counts.agg(
        F.sum(F.col("n").cast("double")).alias("s"),
        F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n").cast("double")).otherwise(0.0)).alias("c"),
        F.sum(two("n")).alias("pairs"),
    )
    margins = per.agg(
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("tp"),
        F.sum(F.col("n_true").cast("double") * F.col("n_true")).alias("tt"),
        F.sum(F.col("n_pred").cast("double") * F.col("n_pred")).alias("pp"),
        F.sum(two("n_true")).alias("a"),
        F.sum(two("n_pred")).alias("b"),
    )
    j = cells.withColumn("m", one_row(margins))
    s, c, m = F.col("s"), F.col("c"), F.col("m")
    mcc = F.try_divide(c * s - m["tp"], F.sqrt((s * s - m["pp"]) * (s * s - m["tt"])))
    expected = m["a"] * m["b"] / (s * (s - 1.0) / 2.0)
    ari = F.try_divide(F.col("pairs") - expected, 0.5 * (m["a"] + m["b"]) - expected)
    return j.select(m["macro_f1"].alias("macro_f1"), mcc.alias("mcc"), ari.alias("adjusted_rand"), (1.0 - c / s).alias("migration_rate"))


