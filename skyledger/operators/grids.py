"""Binned counts, grids and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.binning import bin_index, clamped_index, edge_value, grid_table, labelled
from skyledger.functions.coords import eq_to_gal, sky_pixel
from skyledger.operators.joins import PROB_CEIL, PROB_FLOOR
from skyledger.operators.ranking import exact_quantiles, exact_quantiles_of, join_on_keys, one_row

# Edges of the retention and completeness grids, density limit, smoothing.
B_EDGES = (0.0, 5.0, 10.0, 20.0, 45.0, 90.0)
G_EDGES = (2.0, 11.0, 12.5, 14.0, 15.5, 17.65)
T_EDGES = (3000.0, 4400.0, 4900.0, 6500.0)
L_EDGES = (0.0, 2.5, 5.0)
DENSE_MIN = 100
LAPLACE_NUM, LAPLACE_DEN = 1.0, 2.0


def _clip(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(PROB_FLOOR), F.least(F.lit(PROB_CEIL), p)))


def retention_grid(df: DataFrame, b: Column, g: Column, flagged: Column, b_edges: Sequence[float] = B_EDGES, g_edges: Sequence[float] = G_EDGES) -> DataFrame:
    """Every cell of the grid, empty ones too: total, flagged, rate, clipped retention."""
    binned = df.select(
        bin_index(b, b_edges, closed_last=True).alias("i_b"),
        bin_index(g, g_edges, closed_last=True).alias("i_g"),
        flagged.cast("int").alias("f"),
    )
    counts = binned.groupBy("i_b", "i_g").agg(F.count(F.lit(1)).alias("n_total"), F.sum("f").alias("n_flagged"))
    cells = grid_table(df.sparkSession, b=b_edges, g=g_edges)
    out = cells.join(counts, ["i_b", "i_g"], "left").fillna(0, ["n_total", "n_flagged"])
    rate = F.when(F.col("n_total") > 0, F.col("n_flagged") / F.col("n_total")).otherwise(0.0)
    return out.withColumn("flag_rate", rate).withColumn("selection_prob", _clip(1.0 - F.col("flag_rate")))


def completeness_grids(
    df: DataFrame,
    complete: Column,
    coarse: Mapping[str, tuple[Column, Sequence[float]]],
    extra: Mapping[str, tuple[Column, Sequence[float]]],
    dense_min: int = DENSE_MIN,
) -> DataFrame:
    """Fine grid and its coarse marginal from one pass (GROUPING SETS), Laplace-smoothed.

    Column ``level`` is ``fine`` or ``coarse``.
    """
    ck, xk = [f"i_{a}" for a in coarse], [f"i_{a}" for a in extra]
    binned = df.select(
        *[clamped_index(c, e).alias(f"i_{a}") for a, (c, e) in {**coarse, **extra}.items()],
        complete.cast("int").alias("ok"),
    )
    grouped = binned.groupingSets(
        [[*ck, *xk], ck], *ck, *xk
    ).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum("ok").alias("n_complete"),
        F.grouping_id().alias("gid"),
    )
    inside = F.lit(True)
    for k in xk:
        inside = inside & (F.coalesce(F.col(k), F.lit(0)) >= 0)
    return grouped.where((F.col("gid") > 0) | inside).select(
        F.when(F.col("gid") == 0, "fine").otherwise("coarse").alias("level"),
        *ck,
        *xk,
        "n_total",
        "n_complete",
        (F.col("n_complete") / F.col("n_total")).alias("rate"),
        _clip((F.col("n_complete") + LAPLACE_NUM) / (F.col("n_total") + LAPLACE_DEN)).alias("p_complete"),
        (F.col("n_total") >= dense_min).alias("dense"),
    )


def histogram_1d(df: DataFrame, keys: Sequence[str], value: Column, edges: Sequence[float], closed_last: bool = True) -> DataFrame:
    """Counts in the given edges, every bin of every group present where it has rows."""
    binned = df.select(*keys, bin_index(value, edges, closed_last).alias("bin")).where("bin is not null")
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def density_2d(df: DataFrame, x: tuple[Column, Sequence[float]], y: tuple[Column, Sequence[float]], closed_last: tuple[bool, bool] = (True, True)) -> DataFrame:
    """2-D histogram and each cell's share of its row of equal y; ``closed_last`` says for x and y whether the last edge belongs to the last bin."""
    cells = df.select(bin_index(*x, closed_last[0]).alias("ix"), bin_index(*y, closed_last[1]).alias("iy"))
    cells = cells.dropna().groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("iy").agg(F.sum("n").alias("row_n"))
    return cells.join(rows, "iy").select("ix", "iy", "n", (F.col("n") / F.col("row_n")).alias("share"))


def median_per_cell(df: DataFrame, x: tuple[Column, Sequence[float]], y: tuple[Column, Sequence[float]], value: str, min_n: int) -> DataFrame:
    cells = df.select(bin_index(*x).alias("ix"), bin_index(*y).alias("iy"), value).dropna(subset=["ix", "iy"])
    return exact_quantiles(cells, ["ix", "iy"], value, {"median": 0.5}, "n").where(F.col("n") >= min_n)


def sky_median_map(df: DataFrame, lon: Column, lat: Column, value: str, nside: int, equatorial: bool = True) -> DataFrame:
    """Median and count per equal-area sky pixel."""
    if equatorial:
        lon, lat = eq_to_gal(lon, lat)
    pixels = df.select(sky_pixel(lon, lat, nside).alias("pix"), value)
    return exact_quantiles(pixels, ["pix"], value, {"median": 0.5}, "n")


def completeness_curve(df: DataFrame, keys: Sequence[str], mag: Column, edges: Sequence[float], column: str) -> DataFrame:
    binned = df.withColumn("bin", bin_index(mag, edges)).where("bin is not null")
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(column).isNotNull().cast("double")).alias("completeness")
    )


def rmse_grid(df: DataFrame, x: tuple[Column, Sequence[float]], y: tuple[Column, Sequence[float]], residual: Column) -> DataFrame:
    cells = df.select(bin_index(*x).alias("i"), bin_index(*y).alias("j"), residual.alias("d")).dropna()
    return cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def distance_summary(df: DataFrame, value: str, cut: float) -> DataFrame:
    """Minimum, quartiles, maximum, count and share at or below a cut, in one row."""
    one = df.where(F.col(value).isNotNull()).withColumn("__one", F.lit(0))
    extremes = one.groupBy("__one").agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count_if(F.col(value) <= cut).alias("n_le_cut"),
        F.count(F.lit(1)).alias("n_finite"),
    )
    q = exact_quantiles(one, ["__one"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = join_on_keys(extremes, q, ["__one"]).drop("__one")
    return out.withColumn("frac_le_cut", F.col("n_le_cut") / F.col("n_finite"))


def residual_thresholds(
    df: DataFrame, value: str, by: str, edges: Sequence[float], labels: Sequence[str], catastrophic: float, probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles per bin over normal rows, and over all normal rows under the bin ``all``."""
    tagged = df.withColumn("bin", labelled(by, edges, labels, "missing"))
    both = tagged.withColumn("bin", F.explode(F.array(F.col("bin"), F.lit("all"))))
    normal = F.col(value) < catastrophic
    counts = both.groupBy("bin").agg(F.count_if(F.col(value) >= catastrophic).alias("n_catastrophic"))
    q = exact_quantiles(both.where(normal), ["bin"], value, probs, "n")
    return counts.join(q, "bin")


def contingency(df: DataFrame, a: Column, b: Column, medians: Sequence[str]) -> DataFrame:
    """2x2 flag table with population medians."""
    tagged = df.withColumn("flag_a", a).withColumn("flag_b", b)
    counts = tagged.groupBy("flag_a", "flag_b").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles_of(tagged, ["flag_a", "flag_b"], medians, {"median": 0.5})
    return join_on_keys(counts, q, ["flag_a", "flag_b"])


def geometry_grid(df: DataFrame, r: tuple[Column, Sequence[float]], z: tuple[Column, Sequence[float]], x: str, y: str, split: float) -> DataFrame:
    """Statistics of a plane of two quantities inside each (R, |Z|) panel."""
    cells = df.select(bin_index(*r).alias("i_r"), bin_index(*z).alias("i_z"), x, y).dropna(subset=["i_r", "i_z"])
    return cells.groupBy("i_r", "i_z").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.stddev_pop(x).alias("std_x"),
        F.stddev_pop(y).alias("std_y"),
        F.corr(x, y).alias("pearson"),
        F.avg((F.col(y) > split).cast("double")).alias("frac_high_y"),
    )


def value_by_zone(df: DataFrame, value: str, distance: Column, limits: tuple[float, float], edges: Sequence[float], min_n: int) -> DataFrame:
    """Value against distance in three zones: median and 16/84 % per distance bin."""
    zone = F.when(distance <= limits[0], "near").when(distance <= limits[1], "mid").otherwise("far")
    cells = df.where(distance.isNotNull()).select(zone.alias("zone"), bin_index(distance, edges).alias("bin"), value)
    q = exact_quantiles(
        cells.where("bin is not null"), ["zone", "bin"], value, {"median": 0.5, "p16": 0.16, "p84": 0.84}, "n"
    )
    return q.where(F.col("n") >= min_n)


def tertile_split(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows split at the 33.3 and 66.7 % quantiles of ``by``; the value's distribution in each part."""
    edges = one_row(exact_quantiles(df, [], by, {"t1": 1 / 3, "t2": 2 / 3}))
    part = df.withColumn("__e", edges).withColumn(
        "part", F.when(F.col(by) <= F.col("__e.t1"), "low").when(F.col(by) <= F.col("__e.t2"), "mid").otherwise("high")
    ).where(F.col(by).isNotNull())
    moments = part.groupBy("part").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = exact_quantiles(part, ["part"], value, {"p16": 0.16, "median": 0.5, "p84": 0.84}, "n")
    return join_on_keys(moments, q, ["part"])


def imputation_impact(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Histogram before and after missing values become 0."""
    long = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("raw").alias("kind"), F.col(value).alias("v")),
                F.struct(F.lit("imputed").alias("kind"), F.coalesce(F.col(value), F.lit(0.0)).alias("v")),
            )
        ).alias("s")
    ).select("s.*")
    return histogram_1d(long, ["kind"], F.col("v"), edges)


def vector_band(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise median and 16/84 % over array columns."""
    long = df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "v"))
    return exact_quantiles(long, [*keys, "pos"], "v", {"median": 0.5, "p16": 0.16, "p84": 0.84}, "n")


def label_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of present values per column, as a long table."""
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "label", "finite_rate")


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each cumulative cut, one pass, one row per stage."""
    running, aggs = F.lit(True), []
    for name, cond in stages.items():
        running = running & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(running).alias(name))
    wide = df.agg(F.count(F.lit(1)).alias("before"), *aggs)
    order = ["before", *stages]
    long = wide.unpivot([], order, "stage", "n")
    step = F.coalesce(*[F.when(F.col("stage") == s, F.lit(i)) for i, s in enumerate(order)])
    return long.withColumn("step", step)


def share_breakdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of codes or flags and their share of all rows."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    return counts.withColumn("share", F.col("n") / total)


def bin_edges_of(index: Column, edges: Sequence[float]) -> tuple[Column, Column]:
    return edge_value(index, edges[:-1]), edge_value(index, edges[1:])
