"""Data-quality checks: each is one aggregate and one verdict row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.nulls import fail_open

HARD, SOFT = "HARD", "SOFT"
# Parameter bounds and z-score tolerances.
BOUNDS = {
    "teff": (3000.0, 8000.0), "logg": (-0.5, 5.5), "fe_h": (-4.0, 1.1), "mh": (-4.0, 1.0), "alpha_m": (-0.8, 0.8),
}
Z_MEAN_TOL, Z_STD_TOL = 1e-3, 5e-3


def _verdict(df: DataFrame, name: str, level: str, n_bad: Column, passed: Column | None = None) -> DataFrame:
    ok = (F.col("n_bad") == 0) if passed is None else passed
    return df.withColumn("n_bad", n_bad).select(
        F.lit(name).alias("check"), F.lit(level).alias("level"), ok.alias("passed"), F.col("n_bad").cast("long").alias("n_bad")
    )


def check_nan_invariant(df: DataFrame, columns: Sequence[str], flagged_out: Column) -> DataFrame:
    """Missing features may occur on flagged-out rows only; counts per column are summed."""
    live = ~fail_open(flagged_out)
    counts = df.agg(*[F.count_if(F.col(c).isNull() & live).alias(c) for c in columns])
    return _verdict(counts, "feature_nan_invariant", HARD, reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def surprise_counts(df: DataFrame, columns: Sequence[str], flagged_out: Column) -> DataFrame:
    """Unexpected missing values per column, as a long table."""
    live = ~fail_open(flagged_out)
    counts = df.agg(*[F.count_if(F.col(c).isNull() & live).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_surprise")


def check_label_complete(df: DataFrame, labels: Sequence[str], good: Column) -> DataFrame:
    counts = df.where(fail_open(good)).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in labels])
    return _verdict(counts, "label_completeness", HARD, reduce(lambda a, b: a + b, [F.col(c) for c in labels]))


def check_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]], good: Column) -> DataFrame:
    counts = df.where(fail_open(good)).agg(
        *[F.count_if(~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in bounds.items()]
    )
    return _verdict(counts, "parameter_bounds", HARD, reduce(lambda a, b: a + b, [F.col(c) for c in bounds]))


def check_zscore(df: DataFrame, columns: Sequence[str], reference: Column, mean_tol: float = Z_MEAN_TOL, std_tol: float = Z_STD_TOL) -> DataFrame:
    """Mean near 0 and population std near 1 on the reference population."""
    bad = [
        F.when((F.abs(F.avg(c)) < mean_tol) & (F.abs(F.stddev_pop(c) - 1.0) < std_tol), 0).otherwise(1).alias(c) for c in columns
    ]
    counts = df.where(fail_open(reference)).agg(*bad)
    return _verdict(counts, "zscore_validity", SOFT, reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def check_dedup(df: DataFrame, key: str, expected: Column | int) -> DataFrame:
    n = df.groupBy(key).agg(F.lit(1).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    exp = F.lit(expected) if isinstance(expected, int) else expected
    return _verdict(n, "dedup_count", SOFT, F.abs(F.col("n") - exp))


def null_rates(df: DataFrame, columns: Sequence[str], good: Column | None = None) -> DataFrame:
    data = df.where(fail_open(good)) if good is not None else df
    wide = data.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot(["__n"], list(columns), "column", "n_null")
    return long.select("column", "n_null", F.coalesce(F.try_divide("n_null", "__n"), F.lit(0.0)).alias("rate"))


def top_null_rates(df: DataFrame, columns: Sequence[str], good: Column | None = None, k: int = 3) -> DataFrame:
    """The k columns with most missing values; at most one row per column is sorted."""
    return null_rates(df, columns, good).orderBy(F.desc("n_null"), "column").limit(k)


def run_battery(*checks: DataFrame) -> DataFrame:
    """All check rows together with the overall verdict on each."""
    rows = reduce(lambda a, b: a.unionByName(b), checks)
    worst = rows.agg(
        F.max(F.when(~F.col("passed") & (F.col("level") == HARD), 2).when(~F.col("passed"), 1).otherwise(0)).alias("w")
    ).scalar()
    label = F.when(worst == 2, "HARD-FAIL").when(worst == 1, "SOFT-FAIL").otherwise("PASS")
    return rows.withColumn("overall", label)


def verify_outputs(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns the table lacks; reported, not raised."""
    return [c for c in expected if c not in df.columns]


def selfcheck(df: DataFrame, arms: tuple[DataFrame, DataFrame], key: str, *, gate: Column, missing: Column, box: Column, halo: Column) -> DataFrame:
    """Missing scores gated, arms disjoint, share in the box high, halo share low."""
    a, b = arms
    shared = a.select(key).join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    gated = df.agg(F.count_if(fail_open(missing) & ~fail_open(gate)).alias("n")).scalar()
    in_box = b.agg(F.avg(box.cast("double")).alias("f")).scalar()
    low = a.agg(F.avg(halo.cast("double")).alias("f")).scalar()
    one = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return one.select(
        "n_rows", gated.alias("n_ungated"), shared.alias("n_shared"), in_box.alias("frac_in_box"), low.alias("frac_halo")
    ).withColumn(
        "passed",
        (F.col("n_ungated") == 0) & (F.col("n_shared") == 0) & (F.col("frac_in_box") >= 0.97) & (F.col("frac_halo") <= 0.6),
    )
