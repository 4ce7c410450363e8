"""Residual, coverage and agreement statistics over groups of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions.binning import bin_index
from skyledger.operators.ranking import exact_quantiles, join_on_keys, median_deviation

MAD_TO_SIGMA = 1.4826
LEVELS = (0.68, 0.95, 0.99)
PASS_RATIO = (0.7, 1.4)


def two_sided_z(level: float) -> float:
    return NormalDist().inv_cdf((1.0 + level) / 2.0)


def chi2_quantile(p: float, df: int) -> float:
    """Inverse chi-square distribution by bisection on the regularised gamma series."""

    def cdf(x: float) -> float:
        a, h = df / 2.0, x / 2.0
        term = total = 1.0 / a
        n = 0
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= h / (a + n)
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    lo, hi = 1e-9, 1000.0
    while cdf(hi) < p:
        lo, hi = hi, 2.0 * hi
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2.0


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__one", F.lit(0)), ["__one"])


def mad_scatter(df: DataFrame, keys: Sequence[str], value: str, *, median: str = "median", mad: str = "mad_scatter") -> DataFrame:
    """Median and ``1.4826 * median|x - median|`` per group, exact; no row moves but those of a few slots."""
    out = median_deviation(df, keys, value, median, mad)
    return out.withColumn(mad, F.col(mad) * MAD_TO_SIGMA)


def coverage(residual: Column, sigma: Column, level: float) -> Column:
    """Share of residuals within z sigma; a sigma that is not positive counts as a miss."""
    hit = (sigma > 0) & (F.abs(residual) <= two_sided_z(level) * sigma)
    return F.avg(F.when(residual.isNotNull(), F.coalesce(hit, F.lit(False)).cast("double")))


def coverage_name(level: float) -> str:
    return f"coverage_{round(level * 100)}"


def bland_altman(
    df: DataFrame, keys: Sequence[str], *, pred: str, ref: str, sigma: str, sigma_ref: str | None = None, levels: Sequence[float] = LEVELS, with_mad: bool = True
) -> DataFrame:
    """Agreement per cell: moments in one aggregate, median deviation by exact ranks."""
    sr = F.coalesce(F.col(sigma_ref), F.lit(0.0)) if sigma_ref else F.lit(0.0)
    ok = F.col(pred).isNotNull() & F.col(ref).isNotNull() & F.col(sigma).isNotNull()
    if sigma_ref:
        ok = ok & F.col(sigma_ref).isNotNull()
    base = df.where(ok).select(
        *keys,
        F.col(pred).alias("p"),
        F.col(ref).alias("r"),
        F.col(sigma).alias("s"),
        (F.col(pred) - F.col(ref)).alias("d"),
        (F.col(sigma) * F.col(sigma) + sr * sr).alias("v"),
    )
    out = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("d").alias("bias"),
        F.stddev_samp("d").alias("scatter"),
        F.avg("v").alias("__v"),
        F.corr("p", "r").alias("pearson"),
        *[coverage(F.col("d"), F.col("s"), lv).alias(coverage_name(lv)) for lv in levels],
    )
    out = out.withColumn("bias_se", F.col("scatter") / F.sqrt("n")).withColumn(
        "sigma_ratio", F.try_divide(F.col("scatter"), F.sqrt("__v"))
    ).drop("__v")
    if not with_mad:
        return out
    mad = mad_scatter(base, keys, "d").drop("median")
    return join_on_keys(out, mad, keys)


def agreement_passes(n: Column, bias: Column, ratio: Column, bias_limit: Column, min_n: int = 100) -> Column:
    ok = (n >= min_n) & (F.abs(bias) <= bias_limit) & ratio.between(*PASS_RATIO)
    return F.coalesce(ok, F.lit(False))


def cross_catalogue_report(
    long: DataFrame, bias_limits: Mapping[str, float], *, min_per_bin: int = 100, levels: Sequence[float] = LEVELS
) -> DataFrame:
    """One row per label, catalogue and magnitude bin of a long residual table.

    ``long`` has label, catalogue, mag_bin, pred, ref, sigma, sigma_ref.
    """
    cells = bland_altman(
        long.where(F.col("mag_bin").isNotNull()), ["label", "catalogue", "mag_bin"],
        pred="pred", ref="ref", sigma="sigma", sigma_ref="sigma_ref", levels=levels,
    )
    limit = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(v))) for k, v in bias_limits.items()])
    return cells.withColumn(
        "passes", agreement_passes(F.col("n"), F.col("bias"), F.col("sigma_ratio"), limit, min_per_bin)
    )


def rank_catalogues(report: DataFrame, keys: Sequence[str] = ("label", "mag_bin")) -> DataFrame:
    """Dense ranks of |bias| and scatter among catalogues; the report has one row per cell."""
    w = W.partitionBy(*keys)
    return report.withColumns(
        {
            "bias_rank": F.dense_rank().over(w.orderBy(F.abs("bias"))),
            "scatter_rank": F.dense_rank().over(w.orderBy("scatter")),
        }
    )


def rank_pivot(ranks: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """Catalogue by (label, bin) matrix; the column list is the report's fixed set of cells."""
    keyed = ranks.withColumn("__k", F.concat_ws("__", "label", "mag_bin"))
    return keyed.groupBy("catalogue").pivot("__k", list(columns)).agg(F.max(value))


def trend_curve(df: DataFrame, keys: Sequence[str], x: str, residual: str, edges: Sequence[float], min_n: int) -> DataFrame:
    """Median, 16/84 % and half width per x bin, NULL under the minimum count."""
    binned = df.where(F.col(residual).isNotNull()).withColumn("bin", bin_index(x, edges)).where("bin is not null")
    q = exact_quantiles(binned, [*keys, "bin"], residual, {"bias": 0.5, "p16": 0.16, "p84": 0.84}, "n")
    ok = F.col("n") >= min_n
    return q.select(
        *keys,
        "bin",
        "n",
        *[F.when(ok, F.col(c)).alias(c) for c in ("bias", "p16", "p84")],
        F.when(ok, 0.5 * (F.col("p84") - F.col("p16"))).alias("scatter"),
    )


def cell_heatmap(df: DataFrame, keys: Sequence[str], x: tuple[str, Sequence[float]], y: tuple[str, Sequence[float]], residual: str, min_n: int) -> DataFrame:
    binned = df.where(F.col(residual).isNotNull()).withColumn("i", bin_index(*x)).withColumn("j", bin_index(*y))
    binned = binned.where("i is not null and j is not null")
    q = exact_quantiles(binned, [*keys, "i", "j"], residual, {"bias": 0.5, "p16": 0.16, "p84": 0.84}, "n")
    ok = F.col("n") >= min_n
    return q.select(
        *keys, "i", "j", "n",
        F.when(ok, F.col("bias")).alias("bias"),
        F.when(ok, 0.5 * (F.col("p84") - F.col("p16"))).alias("scatter"),
    )


def benchmark_rank(df: DataFrame, keys: Sequence[str], *, pred: str, truth: str, sigma: str, sigma_ref: str | None = None) -> DataFrame:
    """Several estimators against truth: population scatter, rms, mean |r|/sigma, MAD, correlation."""
    sr = F.coalesce(F.col(sigma_ref), F.lit(0.0)) if sigma_ref else F.lit(0.0)
    s = F.sqrt(F.col(sigma) * F.col(sigma) + sr * sr)
    ok = F.col(pred).isNotNull() & F.col(truth).isNotNull() & F.col(sigma).isNotNull()
    base = df.where(ok).select(
        *keys,
        F.col(pred).alias("p"),
        F.col(truth).alias("t"),
        (F.col(pred) - F.col(truth)).alias("d"),
        F.when(s > 0, F.abs(F.col(pred) - F.col(truth)) / s).alias("u"),
    )
    out = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("d").alias("bias"),
        F.stddev_pop("d").alias("scatter"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.avg("u").alias("sigma_ratio"),
        F.corr("p", "t").alias("pearson"),
    )
    return join_on_keys(out, mad_scatter(base, keys, "d").drop("median"), keys)


def residual_stats(df: DataFrame, keys: Sequence[str], residual: str) -> DataFrame:
    """Count, median, rms and robust sigma of a residual."""
    df, ks = _keyed(df.where(F.col(residual).isNotNull()), keys)
    moments = df.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("rmse")
    )
    robust = mad_scatter(df, ks, residual, median="median", mad="robust_sigma")
    return join_on_keys(moments, robust, ks).drop("__one")


def pull_stats(df: DataFrame, keys: Sequence[str], pred: str, truth: str, sigma: str) -> DataFrame:
    pull = df.withColumn("__pull", F.when(F.col(sigma) > 0, (F.col(pred) - F.col(truth)) / F.col(sigma)))
    pull, ks = _keyed(pull.where(F.col("__pull").isNotNull()), keys)
    moments = pull.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__pull").alias("mean_pull"), F.stddev_pop("__pull").alias("std_pull")
    )
    robust = mad_scatter(pull, ks, "__pull", median="median_pull", mad="robust_pull")
    return join_on_keys(moments, robust, ks).drop("__one")


def bias_by_bin(df: DataFrame, index: Column, n_bins: int, pred: str, truth: str) -> DataFrame:
    """Every open-ended truth bin, empty ones with n = 0."""
    ok = F.col(pred).isNotNull() & F.col(truth).isNotNull()
    stats = df.where(ok).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(pred).alias("pred_mean"),
        F.avg(truth).alias("truth_mean"),
        F.stddev_pop(pred).alias("pred_std"),
        F.stddev_pop(truth).alias("truth_std"),
    )
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(stats, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("bias", F.col("pred_mean") - F.col("truth_mean")).withColumn(
        "std_ratio", F.when(F.col("truth_std") > 0, F.col("pred_std") / F.col("truth_std"))
    )


def residual_slope(df: DataFrame, keys: Sequence[str], x: str, residual: str) -> DataFrame:
    """Least-squares slope of the residual and its standard error, in one combinable pass."""
    d = df.where(F.col(x).isNotNull() & F.col(residual).isNotNull())
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(residual, x).alias("slope"),
        F.regr_intercept(residual, x).alias("intercept"),
        F.regr_sxx(residual, x).alias("sxx"),
        F.regr_sxy(residual, x).alias("sxy"),
        F.regr_syy(residual, x).alias("syy"),
    )
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    se = F.sqrt(rss / F.greatest(F.col("n") - 2, F.lit(1))) / F.greatest(F.sqrt("sxx"), F.lit(1e-12))
    return out.withColumn("slope_se", se).drop("sxx", "sxy", "syy")


def slope_verdict(base: DataFrame, new: DataFrame, key: str, required: float) -> DataFrame:
    """Relative fall of |slope| per element and whether every element reaches the required one."""
    j = base.select(key, F.col("slope").alias("baseline_slope")).join(
        new.select(key, F.col("slope").alias("new_slope")), key
    )
    b, h = F.abs("baseline_slope"), F.abs("new_slope")
    j = j.withColumn("improvement", F.when(b == 0, 0.0).otherwise((b - h) / b))
    j = j.withColumn("passes", F.col("improvement") >= required)
    return j.withColumn("all_pass", F.min("passes").over(W.partitionBy()))


def matched_sigma(df: DataFrame, sigmas: Sequence[str], limits: Column) -> DataFrame:
    """Rows whose every sigma is at or below its own quantile (``limits`` is a one-row struct)."""
    df = df.withColumn("__lim", limits)
    for s in sigmas:
        df = df.where(F.col(s) <= F.col("__lim")[f"{s}_q"])
    return df.drop("__lim")


def sigma_slices(df: DataFrame, sigmas: Sequence[str], limits: Column) -> DataFrame:
    """Each row under the tag ``full`` and, when all its sigmas are small, again under ``matched_sigma``."""
    df = df.withColumn("__lim", limits)
    ok = F.lit(True)
    for s in sigmas:
        ok = ok & F.coalesce(F.col(s) <= F.col("__lim")[f"{s}_q"], F.lit(False))
    tags = F.when(ok, F.array(F.lit("full"), F.lit("matched_sigma"))).otherwise(F.array(F.lit("full")))
    return df.withColumn("slice", F.explode(tags)).drop("__lim")


def repeat_consistency(df: DataFrame, key: str, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Distribution over keys of the scatter among repeated observations of one key."""
    per = df.groupBy(key).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("scatter")).where("n > 1")
    return exact_quantiles(per, [], "scatter", probs, "n_keys")


def seismic_check(df: DataFrame, numax: str, e_numax: str, teff: str, logg: str, sigma: str) -> DataFrame:
    """Predicted against seismic gravity: bias, rms, robust sigma and pull width in one row."""
    from skyledger.functions.coords import seismic_logg

    d = df.where((F.col(numax) > 0) & F.col(teff).isNotNull() & F.col(logg).isNotNull())
    d = d.withColumn("__d", F.col(logg) - seismic_logg(numax, teff))
    seis = F.when(F.col(e_numax).isNotNull(), F.greatest(F.lit(0.0), F.col(e_numax) / F.col(numax) / math.log(10.0)))
    d = d.withColumn("__pull", F.try_divide(F.col("__d"), F.sqrt(F.col(sigma) * F.col(sigma) + seis * seis)))
    moments = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmse"),
        F.stddev_pop("__pull").alias("pull_std"),
    ).withColumn("__one", F.lit(0))
    robust = mad_scatter(d.withColumn("__one", F.lit(0)), ["__one"], "__d", median="bias", mad="robust_sigma")
    return join_on_keys(moments, robust, ["__one"]).drop("__one")


def pairwise_sources(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every pair of estimates of one quantity: n, correlation, mean and median difference."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
        ).alias("s")
    ).select("s.*").where("x is not null and y is not null").withColumn("d", F.col("x") - F.col("y"))
    moments = long.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.avg("d").alias("mean_diff")
    )
    return join_on_keys(moments, exact_quantiles(long, ["a", "b"], "d", {"median_diff": 0.5}), ["a", "b"])
