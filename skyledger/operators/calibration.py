"""Uncertainty calibration per cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.binning import cell_code, cell_decode
from skyledger.functions.coords import _c
from skyledger.operators.ranking import cumulative_counts, exact_quantiles, exact_quantiles_of, join_on_keys, one_row, order_statistics
from skyledger.operators.residuals import chi2_quantile, two_sided_z

EPS = 1e-12
TAU, MIN_CELL, ALPHA_FLOOR = 50.0, 8, 1e-4
# Limits of the pathology flags.
PATHOLOGY = {"hot": 6000.0, "cool": 4000.0, "logg_upper": 3.5, "logg_lower": 1.0, "poor": -1.0, "rich": 0.4}


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution in double precision (Hart's rational form, as given by West 2005)."""
    x = _c(x)
    a = F.abs(x)
    num = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    den = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

    def horner(k):
        acc = F.lit(k[0])
        for c in k[1:]:
            acc = acc * a + c
        return acc

    e = F.exp(-a * a / 2.0)
    frac = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + k / frac
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * horner(num) / horner(den)).otherwise(e / frac / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def temperature_per_cell(df: DataFrame, cell: str, mahal_sq: str, n_labels: int) -> DataFrame:
    """sqrt(mean squared Mahalanobis / n), 1 when the cell has too few rows."""
    t = F.sqrt(F.greatest(F.col("m") / float(n_labels), F.lit(EPS)))
    return df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.avg(mahal_sq).alias("m")).select(
        cell, "n", F.when(F.col("n") < n_labels + 2, 1.0).otherwise(t).alias("temperature")
    )


def shrunken_scale(
    df: DataFrame, cell: str, label: str, z: str, *, tau: float = TAU, min_rows: int = MIN_CELL, floor: float = ALPHA_FLOOR
) -> DataFrame:
    """Per (cell, label) sigma scale shrunk to the label's global scale.

    ``df`` is long: one row per (row, label) with a standardised residual. Cell
    moments come from one aggregate and the global ones are merged from them.
    """
    per = df.groupBy(cell, label).agg(
        F.count(F.lit(1)).alias("n"), F.count(z).alias("k"), F.var_pop(z).alias("v")
    )
    world = df.groupBy(label).agg(F.count(z).alias("gk"), F.var_pop(z).alias("gv"))
    per = join_on_keys(per, world, [label])
    global_alpha = F.when(F.col("gk") >= min_rows, F.sqrt(F.greatest(F.col("gv"), F.lit(EPS)))).otherwise(1.0)
    raw = F.when(F.col("k") >= min_rows, F.sqrt(F.greatest(F.col("v"), F.lit(EPS)))).otherwise(global_alpha)
    lam = F.col("n") / (F.col("n") + tau)
    alpha = F.greatest(lam * raw + (1.0 - lam) * global_alpha, F.lit(floor))
    return per.select(cell, label, "n", global_alpha.alias("global_alpha"), alpha.alias("alpha"))


def apply_scale(df: DataFrame, scales: DataFrame, keys: Sequence[str], scale: str, vector: str) -> DataFrame:
    """Multiply every element of an uncertainty array by its cell's scale, 1 where the cell has none."""
    out = join_on_keys(df, scales.select(*keys, F.col(scale).alias("__s")), keys, "left")
    s = F.coalesce("__s", F.lit(1.0))
    return out.withColumn(vector, F.transform(F.col(vector).cast("array<double>"), lambda x: x * s)).drop("__s")


def isotonic_pit(df: DataFrame, label: str, z: str) -> DataFrame:
    """Monotone map from predicted to empirical distribution per label.

    Predicted and empirical probability both rise with z, so the least-squares
    monotone fit is the mid-rank of each distinct value and needs no pooling.
    """
    c = cumulative_counts(df, [label], z)
    mid = (F.col("n_le") * 2 - F.col("n_equal")) / (F.col("n") * 2.0)
    return c.select(label, z, normal_cdf(z).alias("x"), mid.alias("y"))


def coverage_levels(df: DataFrame, label: str, z: str, levels: Sequence[float]) -> DataFrame:
    """Share of rows with |z| inside each level, per label."""
    wide = df.groupBy(label).agg(
        *[F.avg((F.abs(F.col(z)) <= two_sided_z(lv)).cast("double")).alias(f"cov_{round(lv * 100)}") for lv in levels]
    )
    return wide


def joint_coverage(df: DataFrame, mahal_sq: str, n_labels: int, levels: Sequence[float]) -> DataFrame:
    return df.agg(
        *[F.avg((F.col(mahal_sq) <= chi2_quantile(lv, n_labels)).cast("double")).alias(f"joint_{round(lv * 100)}") for lv in levels]
    )


def conformal_scores(mahal_sq: str) -> Column:
    return F.when(F.col(mahal_sq).isNotNull(), F.sqrt(F.greatest(F.col(mahal_sq), F.lit(0.0))))


def conformal_radius(df: DataFrame, keys: Sequence[str], score: str, level: float, out: str = "radius") -> DataFrame:
    """The ceil((n+1) * level)-th smallest score, capped at the largest."""
    rank = lambda n: F.least(n - 1, F.ceil((n + 1) * F.lit(level)) - 1)
    return order_statistics(df, keys, score, {out: rank})


def variance_decomposition(df: DataFrame, cell: str, label: str, z: str, min_rows: int = MIN_CELL) -> DataFrame:
    """Total, within-cell and between-cell variance of z per label, from cell moments."""
    per = df.where(F.col(z).isNotNull()).groupBy(label, cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("m"), F.var_pop(z).alias("v")
    ).where(F.col("n") >= min_rows)
    total = df.groupBy(label).agg(F.var_pop(z).alias("total_var"))
    mean = per.groupBy(label).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    parts = join_on_keys(per, mean, [label]).groupBy(label).agg(
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within_cell_var"),
        (F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))) / F.sum("n")).alias("between_cell_var"),
    )
    return join_on_keys(total, parts, [label], "left")


def reliability_per_cell(df: DataFrame, cell: str, label: str, z: str, min_rows: int = MIN_CELL) -> DataFrame:
    """Mean over labels of |Var(z) - 1| per cell; a label needs more than ``min_rows`` values."""
    per = df.groupBy(cell, label).agg(F.count(F.lit(1)).alias("n"), F.count(z).alias("k"), F.var_pop(z).alias("v"))
    err = F.when(F.col("k") > min_rows, F.abs(F.col("v") - 1.0))
    return per.groupBy(cell).agg(F.max("n").alias("n"), F.avg(err).alias("e")).select(
        cell, "n", F.when(F.col("n") >= min_rows, F.col("e")).alias("reliability_error")
    )


def adjacent_smoothness(scales: DataFrame, cell: str, label: str, alpha: str, sizes: Sequence[int]) -> DataFrame:
    """Ratio of scales in neighbouring cells: pairs, maximum, median and 90 %."""
    idx = [f"__i{a}" for a in range(len(sizes))]
    coded = scales.where(F.col(alpha) > 0).select(
        cell, label, F.col(alpha).alias("__a"), *[c.alias(n) for n, c in zip(idx, cell_decode(cell, sizes))]
    )
    steps = []
    for a, n in enumerate(sizes):
        nxt = [F.col(i) + (1 if k == a else 0) for k, i in enumerate(idx)]
        steps.append(F.when(F.col(idx[a]) + 1 < n, cell_code(nxt, sizes)))
    left = coded.select(label, "__a", F.explode(F.array(*steps)).alias("__next")).where("__next is not null")
    right = coded.select(label, F.col(cell).alias("__next"), F.col("__a").alias("__b"))
    ratio = left.join(right, [label, "__next"]).select(
        F.exp(F.abs(F.ln(F.col("__a") / F.col("__b")))).alias("r"), F.lit(0).alias("__one")
    )
    top = ratio.groupBy("__one").agg(F.max("r").alias("max_ratio"))
    q = exact_quantiles(ratio, ["__one"], "r", {"median_ratio": 0.5, "p90_ratio": 0.9}, "n_pairs")
    return join_on_keys(top, q, ["__one"]).drop("__one")


def halt_cell_report(df: DataFrame, cell: str, sizes: Sequence[int], z: Sequence[str], medians: Sequence[str], rates: Mapping[str, Column]) -> DataFrame:
    """Per cell: rows, edge or not, Var(z) and E(z), medians and rates of context columns."""
    idx = cell_decode(cell, sizes)
    edge = F.lit(False)
    for i, n in zip(idx, sizes):
        edge = edge | (i == 0) | (i == n - 1)
    aggs = []
    for c in z:
        aggs += [F.var_pop(c).alias(f"var_{c}"), F.avg(c).alias(f"mean_{c}")]
    aggs += [F.avg(r.cast("double")).alias(n) for n, r in rates.items()]
    out = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), *aggs).withColumn("is_edge", edge)
    return join_on_keys(out, exact_quantiles_of(df, [cell], medians, {"median": 0.5}), [cell])


def cell_range_label(index: Column, edges: Sequence[Column | float], name: str, digits: int = 3) -> Column:
    """Readable range of a bin between interior edges."""
    e = [F.format_number(F.lit(x) if isinstance(x, float) else x, f"0.{'0' * digits}") for x in edges]
    arr = F.array(*e)
    last = len(edges)
    return (
        F.when(index == 0, F.concat(F.lit(f"{name} < "), e[0]))
        .when(index == last, F.concat(F.lit(f"{name} > "), e[-1]))
        .otherwise(F.concat(F.get(arr, index - 1), F.lit(f" <= {name} < "), F.get(arr, index)))
    )


def cell_centre(index: Column, edges: Sequence[float]) -> Column:
    """Centre of a bin between interior edges; outer bins get the mean inner width."""
    width = (edges[-1] - edges[0]) / (len(edges) + 1)
    full = [edges[0] - width, *edges, edges[-1] + width]
    mids = F.array(*[F.lit(0.5 * (a + b)) for a, b in zip(full[:-1], full[1:])])
    return F.get(mids, index)


def bias_cell_location(cells: DataFrame, cell: str, sizes: Sequence[int], edges: Sequence[Sequence[float]]) -> DataFrame:
    """Centre of each (teff, logg, mh) cell and the pathologies it falls under."""
    t, g, m = [cell_centre(i, e) for i, e in zip(cell_decode(cell, sizes), edges)]
    p = PATHOLOGY
    flags = [
        F.when(t > p["hot"], "teff_hot"), F.when(t < p["cool"], "teff_cool"),
        F.when(g > p["logg_upper"], "logg_subgiant"), F.when(g < p["logg_lower"], "logg_tipgiant"),
        F.when(m < p["poor"], "mh_poor"), F.when(m > p["rich"], "mh_rich"),
    ]
    return cells.withColumns(
        {"teff_centre": t, "logg_centre": g, "mh_centre": m, "flags": F.concat_ws(",", *flags)}
    )


def reliability_curve(df: DataFrame, sigma: str, residual: str, n_bins: int, ids: Sequence[str], n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Sigma-quantile bins: mean sigma, rms error and a 16-84 % Poisson bootstrap band.

    Each row enters every replica with a hashed Poisson weight and the replicas are
    combinable arrays of sums, so no bin is gathered and no row repeated.
    """
    from skyledger.functions.binning import digitize
    from skyledger.operators.information import replica_sums

    d = df.where((F.col(sigma) > 0) & F.col(residual).isNotNull())
    probs = {f"q{i}": i / n_bins for i in range(1, n_bins)}
    edges = one_row(exact_quantiles(d, [], sigma, probs))
    binned = d.withColumn("__e", edges).withColumn(
        "bin", digitize(sigma, [F.col("__e")[q] for q in probs])
    ).select("bin", F.col(sigma).alias("s"), (F.col(residual) * F.col(residual)).alias("d2"), *ids)
    out = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_sigma"), F.sqrt(F.avg("d2")).alias("rmse")
    )
    if not n_boot:
        return out
    boot = replica_sums(binned, ["bin"], ids, ["d2"], n_boot, seed).select("bin", F.sqrt(F.try_divide(F.col("d2"), F.col("w"))).alias("r"))
    band = boot.groupBy("bin").agg(
        F.percentile("r", F.lit(0.16)).alias("rmse_lo"), F.percentile("r", F.lit(0.84)).alias("rmse_hi")
    )
    return out.join(band, "bin", "left")


