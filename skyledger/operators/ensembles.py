"""Member predictions in long form: one row per (id, member) with arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.vectors import double_array
from skyledger.operators.ranking import exact_quantiles

EPS = 1e-12
CORRELATION_LIMIT = 0.95
DISAGREEMENT_LIMIT = 0.5


def packed(i: int, j: int) -> int:
    """Position of ``L[i][j]`` (j <= i) in a row-packed lower triangle."""
    return i * (i + 1) // 2 + j


def _at(c: str, i: int) -> Column:
    return F.get(F.col(c), F.lit(i))


def _llt(chol: str, i: int, j: int) -> Column:
    lo = min(i, j)
    return reduce(lambda a, b: a + b, [_at(chol, packed(i, k)) * _at(chol, packed(j, k)) for k in range(lo + 1)])


def ensemble_aggregate(df: DataFrame, key: str, mu: str, chol: str, n: int) -> DataFrame:
    """Mean, aleatoric, epistemic and total covariance (upper triangle) and total sigma per id.

    One combinable aggregate; a row per id leaves each task.
    """
    aggs = [F.avg(_at(mu, i)).alias(f"mu_{i}") for i in range(n)]
    for i in range(n):
        for j in range(i, n):
            aggs.append(F.avg(_llt(chol, i, j)).alias(f"al_{i}_{j}"))
            aggs.append(F.covar_pop(_at(mu, i), _at(mu, j)).alias(f"ep_{i}_{j}"))
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), *aggs)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    return out.select(
        key,
        "n_members",
        F.array(*[F.col(f"mu_{i}") for i in range(n)]).alias("mu"),
        F.array(*[F.col(f"al_{i}_{j}") for i, j in pairs]).alias("aleatoric"),
        F.array(*[F.col(f"ep_{i}_{j}") for i, j in pairs]).alias("epistemic"),
        F.array(*[F.col(f"al_{i}_{j}") + F.col(f"ep_{i}_{j}") for i, j in pairs]).alias("total"),
        F.array(*[F.sqrt(F.col(f"al_{i}_{i}") + F.col(f"ep_{i}_{i}")) for i in range(n)]).alias("sigma"),
    )


def moment_match(df: DataFrame, key: str, mu: str, chol: str, n: int) -> DataFrame:
    """Mean and covariance of the equal-weight mixture of members."""
    return ensemble_aggregate(df, key, mu, chol, n).select(key, "mu", F.col("total").alias("cov"))


def disagreement_ratio(df: DataFrame, key: str, mu: str, sigma: str, n: int, limit: float = DISAGREEMENT_LIMIT) -> DataFrame:
    """Mean over labels of epistemic to total sigma; fewer than two members raises."""
    aggs = []
    for i in range(n):
        aggs += [F.var_pop(_at(mu, i)).alias(f"e{i}"), F.avg(_at(sigma, i) * _at(sigma, i)).alias(f"a{i}")]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("m"), *aggs)
    ratio = reduce(
        lambda a, b: a + b,
        [F.sqrt(F.greatest(F.col(f"e{i}"), F.lit(0.0)) / F.greatest(F.col(f"e{i}") + F.col(f"a{i}"), F.lit(EPS))) for i in range(n)],
    ) / float(n)
    bad = F.raise_error(F.lit("disagreement needs at least two members")).cast("double")
    return out.select(key, F.when(F.col("m") < 2, bad).otherwise(ratio).alias("disagreement")).withColumn(
        "ood_disagreement_flag", F.col("disagreement") > limit
    )


def member_correlation(df: DataFrame, key: str, member: str, values: Sequence[str], members: Sequence[int]) -> DataFrame:
    """Pearson correlation of every member pair on complete rows, per value column.

    Members are spread to columns (their number is fixed), so no self-join is needed.
    """
    wide = df.groupBy(key).agg(
        *[F.max(F.when(F.col(member) == m, F.col(v))).alias(f"{v}__{m}") for v in values for m in members]
    )
    out = None
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]
    for v in values:
        full = reduce(lambda a, b: a & b, [F.col(f"{v}__{m}").isNotNull() for m in members])
        aggs = [F.corr(F.when(full, F.col(f"{v}__{a}")), F.when(full, F.col(f"{v}__{b}"))).alias(f"{v}|{a}|{b}") for a, b in pairs]
        out = aggs if out is None else [*out, *aggs]
    row = wide.agg(*out)
    long = row.unpivot([], row.columns, "__k", "pearson")
    part = F.split("__k", r"\|")
    return long.select(
        F.get(part, F.lit(0)).alias("element"),
        F.get(part, F.lit(1)).cast("int").alias("member_a"),
        F.get(part, F.lit(2)).cast("int").alias("member_b"),
        "pearson",
    )


def diversity_report(pairs: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Median pair correlation per element and the inflation it calls for."""
    rho = exact_quantiles(pairs, ["element"], "pearson", {"rho_median": 0.5})
    too_close = F.col("rho_median") > limit
    return rho.withColumn("fails", too_close).withColumn(
        "inflation", F.when(too_close, F.sqrt(1.0 + F.col("rho_median"))).otherwise(1.0)
    )


def inflate_sigma(df: DataFrame, sigma: str, factor: Column | float, out: str) -> DataFrame:
    if isinstance(factor, float) and factor <= 0:
        raise ValueError("inflation must be positive")
    return df.withColumn(out, F.col(sigma) * factor)


def whitened_residual(mu, chol, y, n: int) -> Column:
    """Solve ``L z = y - mu`` by forward substitution inside one array expression."""
    r = F.zip_with(double_array(y), double_array(mu), lambda a, b: a - b)
    low = double_array(chol)

    def step(z: Column, i: Column) -> Column:
        start = (i * (i + 1) / 2).cast("int")
        row = F.slice(low, start + 1, F.greatest(i, F.lit(1)))
        prior = F.aggregate(F.zip_with(row, z, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
        return F.array_append(z, (F.get(r, i) - prior) / F.get(low, start + i))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<double>"), step)


def squared_length(z: Column) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v)


def score_linear_ensemble(df: DataFrame, features: Sequence[str], weights: Sequence[Sequence[Sequence[float]]], key: str) -> DataFrame:
    """Apply M frozen linear models (bias first) to each row: one long row per member."""
    members = []
    for m, labels in enumerate(weights):
        outs = []
        for w in labels:
            terms = [F.lit(float(w[0]))] + [float(c) * F.col(f) for c, f in zip(w[1:], features)]
            outs.append(reduce(lambda a, b: a + b, terms))
        members.append(F.struct(F.lit(m).alias("member"), F.array(*outs).alias("mu")))
    return df.select(key, F.explode(F.array(*members)).alias("s")).select(key, "s.member", "s.mu")


def feature_noise_sigma(sigma: Column, jacobian: Sequence[Column | float], noise: Sequence[Column]) -> Column:
    """Intrinsic and propagated sigma in quadrature."""
    total = sigma * sigma
    for j, s in zip(jacobian, noise):
        total = total + (j * s) * (j * s)
    return F.sqrt(total)


