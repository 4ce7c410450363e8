"""Key joins with guards, bridges, anchors and lookups.

No join here forces a broadcast: Spark broadcasts a side when its measured size is
under the threshold and otherwise shuffles it, splitting hot keys at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.binning import bin_index, clamped_index, labelled
from skyledger.functions.nulls import any_missing, fail_open
from skyledger.operators.ranking import first_per_key

PROB_FLOOR, PROB_CEIL = 0.01, 1.0
COMPOUND_FLOOR = PROB_FLOOR * PROB_FLOOR
DISTANCE_CONFLICT = 0.3


def key_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys per side, matches, losses, repeated keys. One shuffle."""
    tagged = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    present = F.col(key).isNotNull()
    return per_key.agg(
        F.sum("l").alias("n_left"),
        F.sum("r").alias("n_right"),
        F.count_if(present & (F.col("l") > 0)).alias("n_unique_left"),
        F.count_if(present & (F.col("r") > 0)).alias("n_unique_right"),
        F.coalesce(F.sum(F.when(present, F.col("l") * F.col("r"))), F.lit(0)).alias("n_joined"),
        F.coalesce(F.sum(F.when((F.col("r") == 0) | ~present, F.col("l"))), F.lit(0)).alias("n_left_lost"),
        F.count_if(F.col("l") > 1).alias("n_left_repeated"),
        F.count_if(F.col("r") > 1).alias("n_right_repeated"),
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"keys {list(keys)} repeat")


def join_1to1_guarded(
    left: DataFrame, right: DataFrame, key: str, *, columns: Sequence[str] | None = None, how: str = "inner", validate: bool = True
) -> DataFrame:
    """Inner or left join, unique on both sides; an inner join that loses rows raises."""
    if columns is not None:
        right = right.select(key, *[c for c in columns if c in right.columns and c != key])
    if validate:
        r = key_report(left, right, key).first()
        if r.n_left_repeated or r.n_right_repeated:
            raise ValueError(f"{key!r} repeats: {r.n_left_repeated} left, {r.n_right_repeated} right")
        if how == "inner" and r.n_left_lost:
            raise ValueError(f"inner join loses {r.n_left_lost} of {r.n_left} rows")
    return left.join(right, key, how)


def join_lookup_default(df: DataFrame, lookup: DataFrame, key: str, flag: str, extra: Sequence[str] = ()) -> DataFrame:
    """Left join of a flag table: missing means not flagged, old columns are replaced."""
    df = df.drop(flag, *extra)
    out = df.join(lookup.select(key, flag, *extra), key, "left")
    return out.withColumn(flag, fail_open(F.col(flag).cast("boolean")))


def join_lookup_rowsafe(df: DataFrame, lookup: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Left join on a lookup reduced to one row per key, so no row of ``df`` is multiplied."""
    one = first_per_key(lookup.select(key, *columns), [key], order)
    return df.join(one, key, "left")


def join_many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", validate: bool = True) -> DataFrame:
    if validate:
        assert_unique(right, [key])
    return left.join(right, key, how)


def join_chain(start: DataFrame, *links: tuple[DataFrame, str]) -> DataFrame:
    """Inner joins one after another, each with its own key."""
    for table, key in links:
        start = start.join(table, key)
    return start


def join_master(left: DataFrame, right: DataFrame, key: str, suffix: str = "_right") -> DataFrame:
    """Inner join in which clashing column names of the right side get a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), key)


def join_bridge(ids: DataFrame, bridge: DataFrame, external: DataFrame, key: str, external_key: str) -> DataFrame:
    """ids to best neighbour to external catalogue, both left."""
    return ids.join(bridge, key, "left").join(external, external_key, "left")


def join_full_coalesce(a: DataFrame, b: DataFrame, key: str, bands: Sequence[str], flag: str = "ir_missing_flag") -> DataFrame:
    return a.join(b, key, "full").withColumn(flag, any_missing(*bands))


def anchor_left(
    ids: DataFrame, matches: DataFrame, key: str, schema: Mapping[str, str], order: Sequence[Column]
) -> DataFrame:
    """One row for each expected id, first match kept, absent columns added, types imposed."""
    one = first_per_key(matches, [key], order)
    out = ids.select(key).distinct().join(one, key, "left")
    cols = [
        (F.col(c).try_cast(kind) if c in out.columns else F.lit(None).cast(kind)).alias(c)
        for c, kind in schema.items()
        if c != key
    ]
    return out.select(key, *cols)


def merge_distances(
    primary: DataFrame, second: DataFrame | None, key: str, *, med: str, lo: str, hi: str, second_med: str, limit: float = DISTANCE_CONFLICT
) -> DataFrame:
    """Primary distance, symmetric sigma, and a conflict flag on the log ratio."""
    out = primary.withColumn("dist_primary_pc", F.col(med)).withColumn(
        "dist_sigma_sym_pc", (F.col(hi) - F.col(lo)) / 2.0
    )
    if second is None:
        return out
    out = out.join(second.select(key, F.col(second_med).alias("dist_second_pc")), key, "left")
    ratio = log_ratio("dist_primary_pc", "dist_second_pc")
    return out.withColumn("dist_conflict", fail_open(F.abs(ratio) > limit))


def log_ratio(a: str, b: str) -> Column:
    """log10(a/b), NULL unless both are positive."""
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log10(F.col(a) / F.col(b)))


def semi_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def anti_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def resume_delta(held: DataFrame, offered: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows already held, plus the offered rows whose key is new, one per key."""
    fresh = first_per_key(anti_ids(offered, held, key), [key], order)
    return first_per_key(held, [key], order).unionByName(fresh)


def enrich_by_ids(ids: DataFrame, catalogue: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One output row per id with the projected catalogue columns, NULL where unknown."""
    return ids.join(catalogue.select(key, *columns), key, "left")


def compare_releases(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    left = a.select(key, *[F.col(c).alias(f"{c}{suffixes[0]}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}{suffixes[1]}") for c in columns])
    return left.join(right, key)


def join_compound_key(grid_a: DataFrame, grid_b: DataFrame, edges: Sequence[str], p_a: str, p_b: str, out: str) -> DataFrame:
    """1:1 join of two grids on their edge columns and the clipped product of probabilities."""
    product = compound_selection(F.col(p_a), F.col(p_b))
    return grid_a.join(grid_b, list(edges)).withColumn(out, product)


def _clip(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(PROB_FLOOR), F.least(F.lit(PROB_CEIL), p)))


def grid_lookup(df: DataFrame, grid: DataFrame, axes: Mapping[str, tuple[Column, Sequence[float]]], prob: str, out: str) -> DataFrame:
    """Clamp each axis, bin it, look the cell probability up and clip it."""
    keys = {f"i_{a}": clamped_index(c, e) for a, (c, e) in axes.items()}
    cells = grid.select(*keys, F.col(prob).alias("__p"))
    out_df = df.withColumns(keys).join(cells, list(keys), "left")
    return out_df.withColumn(out, _clip(F.col("__p"))).drop("__p", *keys)


def grid_lookup_backoff(
    df: DataFrame,
    fine: DataFrame,
    coarse: DataFrame,
    coarse_axes: Mapping[str, tuple[Column, Sequence[float]]],
    extra_axes: Mapping[str, tuple[Column, Sequence[float]]],
    prob: str,
    out: str,
    dense: str = "dense",
) -> DataFrame:
    """Dense fine cell if there is one, else the coarse marginal."""
    ck = {f"i_{a}": clamped_index(c, e) for a, (c, e) in coarse_axes.items()}
    xk = {f"i_{a}": clamped_index(c, e) for a, (c, e) in extra_axes.items()}
    keyed = df.withColumns({**ck, **xk})
    keyed = keyed.join(coarse.select(*ck, F.col(prob).alias("__p2")), list(ck), "left")
    fine = fine.where(F.col(dense)).select(*ck, *xk, F.col(prob).alias("__p4"))
    keyed = keyed.join(fine, [*ck, *xk], "left")
    return keyed.withColumn(out, _clip(F.coalesce("__p4", "__p2"))).drop("__p2", "__p4", *ck, *xk)


def mask_lookup(df: DataFrame, mask: DataFrame, axes: Mapping[str, tuple[str, Sequence[float]]], flag: str, out: str) -> DataFrame:
    """Flag of the grid cell, whether the row lies inside the grid, and the fail-closed combination."""
    keys = {f"i_{a}": bin_index(c, e) for a, (c, e) in axes.items()}
    inside = f"{out}_in_grid"
    keyed = df.withColumns(keys)
    keyed = keyed.withColumn(inside, ~any_missing(*keys))
    keyed = keyed.join(mask.select(*keys, F.col(flag).alias("__flag")), list(keys), "left")
    hit = fail_open(F.col("__flag")) & F.col(inside)
    return keyed.withColumns({out: hit, f"{out}_ambiguous": hit | ~F.col(inside)}).drop("__flag", *keys)


def threshold_lookup(
    df: DataFrame, thresholds: DataFrame, global_limit: Column, *, value: str, by: str, edges: Sequence[float], labels: Sequence[str], out: str
) -> DataFrame:
    """Compare with the limit of the row's bin, the global limit where the bin has none; NULL stays NULL."""
    keyed = df.withColumn("bin", labelled(by, edges, labels, "missing"))
    keyed = keyed.join(thresholds.select("bin", F.col("p99").alias("__p99")), "bin", "left")
    limit = F.coalesce(F.col("__p99"), global_limit)
    return keyed.withColumn(out, (F.col(value) > limit).cast("tinyint")).drop("__p99")


def compound_selection(p_a: Column, p_b: Column, *gates: Column) -> Column:
    """Product of probabilities, 0 when a gate is shut, else clipped."""
    open_ = None
    for g in gates:
        g = fail_open(g)
        open_ = g if open_ is None else open_ & g
    product = p_a * p_b
    product = F.when(product.isNotNull(), F.greatest(F.lit(COMPOUND_FLOOR), F.least(F.lit(PROB_CEIL), product)))
    return product if open_ is None else F.when(open_, product).otherwise(F.lit(0.0))


def selection_or_score(df: DataFrame, column: str, score) -> DataFrame:
    """Use the column when the table has it, else compute it."""
    return df if column in df.columns else score(df)


def fill_fallback(df: DataFrame, column: str, fallback: str, marker: str = "filled") -> DataFrame:
    return df.withColumn(marker, F.col(column).isNull() & F.col(fallback).isNotNull()).withColumn(
        column, F.coalesce(column, fallback)
    )
