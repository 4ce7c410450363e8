"""Mahalanobis envelopes: fit in one or two aggregates, score as expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.nulls import all_present, finite
from skyledger.operators.ranking import cumulative_counts, exact_quantiles, join_on_keys

# up to this many columns the covariance and the distance stay plain expressions
EXPRESSION_LIMIT = 12
XP_RIDGE, AUX_RIDGE, KINEMATIC_RIDGE = 1e-6, 1e-4, 1.0
KINEMATIC_MIN_ROWS = LABEL_MIN_ROWS = 100
DISC_VZ_MAX, DISC_VT_MIN = 80.0, 100.0


@dataclass(frozen=True)
class Envelope:
    """k means, a k x k precision matrix and a distance limit; k is the column count."""

    columns: tuple[str, ...]
    mean: np.ndarray
    precision: np.ndarray
    threshold: float
    p_threshold: float
    n_training: int
    ridge: float


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as finite doubles, of rows that have them all."""
    return df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]).where(all_present(*columns))


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample covariance of complete rows, in one aggregate."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]
    row = _complete(df, columns).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *sums).first()
    n, mean = row["n"], np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(k)])
    if n < 2:
        return n, mean, np.eye(k)
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return n, mean, cov


def fit_vector_envelope(df: DataFrame, vector: str, *, p_threshold: float = 0.99, ridge: float = XP_RIDGE) -> Envelope:
    """Envelope of an array column: means per position, then one centred Gram matrix per task, summed by Spark."""
    values = F.col(vector).cast("array<double>")
    whole = df.select(values.alias("x")).where(F.forall("x", lambda e: finite(e).isNotNull()))
    means = whole.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    k = len(means)
    n = means[0]["n"] if means else 0
    if n < k + 2:
        raise ValueError(f"need at least {k + 2} complete rows, got {n}")
    mean = np.zeros(k)
    for r in means:
        mean[r["i"]] = r["m"]

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()) - mean
                total += x.T @ x
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    cov = np.zeros((k, k))
    sums = whole.mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.toLocalIterator():
        cov[r.i, r.j] = cov[r.j, r.i] = r.s / (n - 1)
    precision = np.linalg.inv(cov + ridge * np.eye(k))
    env = Envelope((vector,), mean, precision, float("nan"), p_threshold, n, ridge)
    limit = exact_quantiles(score_vector_envelope(df, env, "__d"), [], "__d", {"q": p_threshold}).first()["q"]
    return Envelope((vector,), mean, precision, float(limit), p_threshold, n, ridge)


def score_vector_envelope(df: DataFrame, env: Envelope, out: str) -> DataFrame:
    """Distance of an array column by one matrix product per Arrow batch; NULL for a vector with holes."""
    mean, precision = env.mean, env.precision

    @F.pandas_udf("double")
    def distance(values: pd.Series) -> pd.Series:
        def usable(v) -> bool:
            return v is not None and len(v) == mean.size and bool(np.isfinite(np.asarray(v, dtype=float)).all())

        ok = np.array([usable(v) for v in values], dtype=bool)
        res = np.full(len(values), np.nan)
        if ok.any():
            x = np.stack([np.asarray(v, dtype=float) for v in values[ok]]) - mean
            res[ok] = np.sqrt(np.clip(np.einsum("bi,ij,bj->b", x, precision, x), 0.0, None))
        return pd.Series(res)

    scored = df.withColumn(out, distance(F.col(env.columns[0]).cast("array<double>")))
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def fit_mahalanobis(
    df: DataFrame, columns: Sequence[str], *, p_threshold: float = 0.99, ridge: float = XP_RIDGE, min_rows: int | None = None
) -> Envelope:
    """Means, ridge-regularised precision, and the distance quantile of the training rows.

    Only k means, k*k covariances and one quantile reach the driver.
    """
    if len(columns) > EXPRESSION_LIMIT:
        # many columns are fitted as one vector; the means and the precision are the same
        need = max(len(columns) + 2, min_rows or 0)
        whole = _complete(df, columns).select(F.array(*columns).alias("__x"))
        env = fit_vector_envelope(whole, "__x", p_threshold=p_threshold, ridge=ridge)
        if env.n_training < need:
            raise ValueError(f"need at least {need} complete rows, got {env.n_training}")
        return replace(env, columns=tuple(columns))
    n, mean, cov = _moments(df, columns)
    need = max(len(columns) + 2, min_rows or 0)
    if n < need:
        raise ValueError(f"need at least {need} complete rows, got {n}")
    precision = np.linalg.inv(cov + ridge * np.eye(len(columns)))
    env = Envelope(tuple(columns), mean, precision, float("nan"), p_threshold, n, ridge)
    scored = score_mahalanobis(df, env, "__d")
    limit = exact_quantiles(scored, [], "__d", {"q": p_threshold}).first()["q"]
    return Envelope(tuple(columns), mean, precision, float(limit), p_threshold, n, ridge)


def fit_dual(df: DataFrame, first: Sequence[str], second: Sequence[str], p_threshold: float = 0.99) -> tuple[Envelope, Envelope]:
    return (
        fit_mahalanobis(df, first, p_threshold=p_threshold, ridge=XP_RIDGE),
        fit_mahalanobis(df, second, p_threshold=p_threshold, ridge=AUX_RIDGE),
    )


def fit_label_envelope(df: DataFrame, columns: Sequence[str], p_threshold: float = 0.99) -> Envelope | None:
    """None when fewer than 100 complete rows exist."""
    if _complete(df, columns).limit(LABEL_MIN_ROWS).count() < LABEL_MIN_ROWS:
        return None
    return fit_mahalanobis(df, columns, p_threshold=p_threshold)


def fit_kinematic(df: DataFrame, v_r: str, v_t: str, v_z: str, p_threshold: float = 0.99) -> Envelope:
    """Fit on disc-like rows only."""
    disc = df.where((F.abs(F.col(v_z)) < DISC_VZ_MAX) & (F.col(v_t) > DISC_VT_MIN))
    return fit_mahalanobis(
        disc, [v_r, v_t, v_z], p_threshold=p_threshold, ridge=KINEMATIC_RIDGE, min_rows=KINEMATIC_MIN_ROWS
    )


def mahalanobis_expression(env: Envelope) -> Column:
    """Distance as one arithmetic expression; NULL as soon as an input is NULL, NaN or infinite."""
    return _distance([finite(F.col(c).cast("double")) - float(m) for c, m in zip(env.columns, env.mean)], env)


def _distance(d: Sequence[Column], env: Envelope) -> Column:
    k = len(d)
    total = None
    for i in range(k):
        for j in range(i, k):
            w = float(env.precision[i, j]) * (1.0 if i == j else 2.0)
            term = w * d[i] * d[j]
            total = term if total is None else total + term
    return F.sqrt(F.greatest(total, F.lit(0.0)) + F.lit(0.0) * total)


def score_mahalanobis(df: DataFrame, env: Envelope, out: str) -> DataFrame:
    if len(env.columns) > EXPRESSION_LIMIT:
        vector = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in env.columns]))
        return score_vector_envelope(vector, replace(env, columns=("__x",)), out).drop("__x")
    # each offset is computed once, not once for every pair
    offsets = {f"__d{i}": finite(F.col(c).cast("double")) - float(m) for i, (c, m) in enumerate(zip(env.columns, env.mean))}
    return df.withColumns(offsets).withColumn(out, _distance([F.col(n) for n in offsets], env)).drop(*offsets)


def mahalanobis_flag(score: str, env: Envelope) -> Column:
    """Not within the limit; a missing score counts as outside."""
    return F.coalesce(F.col(score) > env.threshold, F.lit(True))


def ecdf_percentile(train: DataFrame, query: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """Share of training values at or below each query value.

    Training counts are attached by rank inside the union, so neither side is
    gathered: query values join the distinct values they equal or follow.
    """
    both = train.select(F.col(value), F.lit(1).alias("__t")).unionByName(query.select(F.col(value), F.lit(0).alias("__t")))
    both = both.where(F.col(value).isNotNull())
    ranks = cumulative_counts(both, [], value).select(F.col(value).alias("__v"), "n_le")
    queries = query.where(F.col(value).isNotNull()).select(value)
    own = cumulative_counts(queries, [], value).select(F.col(value).alias("__v"), F.col("n_le").alias("q_le"))
    n = train.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    share = own.join(ranks, "__v").select(
        F.col("__v").alias(value), ((F.col("n_le") - F.col("q_le")) / n).alias(out)
    )
    return join_on_keys(query.withColumn(value, F.col(value).cast("double")), share, [value], "left")
