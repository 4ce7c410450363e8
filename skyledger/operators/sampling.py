"""Deduplication, seeded samples, splits and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger.functions.binning import bin_index, cell_code, digitize
from skyledger.functions.hashing import hash_slot, seeded_hash
from skyledger.functions.nulls import FLOATS
from skyledger.operators.ranking import (
    exact_quantiles_of,
    first_per_key,
    hash_cut,
    hash_top_k,
    join_on_keys,
    one_row,
    with_group_size,
)


def dedup_best(
    df: DataFrame, key: str, sort_by: str, ties: Sequence[str], *, ascending: bool = False, validate: bool = True
) -> DataFrame:
    """One row per key, the best sort value, ties broken by the given columns.

    A repeated key with a missing (NULL or NaN) sort value has no best row: the
    job fails, unless ``validate`` is off, which puts missing values last.
    """
    missing = F.col(sort_by).isNull()
    if isinstance(df.schema[sort_by].dataType, FLOATS):
        missing = missing | F.isnan(sort_by)
    best = F.asc(sort_by) if ascending else F.desc(sort_by)
    order = [best, *[F.asc(t) for t in ties]]
    if not validate:
        return first_per_key(df, [key], [missing.asc(), *order])
    # missing values come first, and two rows a key tell whether it is repeated: one shuffle of at most two rows a key and task
    by_key = W.partitionBy(key).orderBy(missing.desc(), *order)
    two = df.withColumn("__rn", F.row_number().over(by_key)).where(F.col("__rn") <= 2)
    repeated = F.lead(F.lit(True)).over(by_key).isNotNull()
    two = two.withColumn("__bad", missing & repeated & (F.col("__rn") == 1))
    refuse = F.raise_error(F.lit(f"cannot deduplicate: missing values in {sort_by!r}")).cast("boolean")
    return two.where(F.when(F.col("__bad"), refuse).otherwise(F.col("__rn") == 1)).drop("__rn", "__bad")


def dedup_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, …"""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("multiplicity"))
        .groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n_keys"))
    )


def dedup_stats(df: DataFrame, key: str) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_out"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_keys"),
        F.max("n").alias("max_duplicates_per_key"),
    )


def resolve_match(
    df: DataFrame,
    key: str,
    *,
    separation: str,
    mag_diff: str,
    ties: Sequence[str],
    max_separation: float = 300.0,
    max_mag_diff: float = 0.1,
) -> DataFrame:
    """Cut on both limits, keep the smallest magnitude difference, carry the candidate count."""
    cut = df.where((F.col(separation) < max_separation) & (F.abs(F.col(mag_diff)) < max_mag_diff))
    best = first_per_key(cut, [key], [F.abs(F.col(mag_diff)), *[F.col(t) for t in ties]])
    return join_on_keys(best, cut.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates")), [key])


def with_cells(df: DataFrame, axes: Mapping[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Add half-open bin indices ``i_<axis>`` and drop rows outside the grid."""
    out = df.withColumns({f"i_{a}": bin_index(c, e) for a, (c, e) in axes.items()})
    return out.dropna(subset=[f"i_{a}" for a in axes])


def stratified_cap(df: DataFrame, axes: Mapping[str, tuple[str, Sequence[float]]], ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each grid cell, chosen in seeded hash order."""
    return hash_top_k(with_cells(df, axes), [f"i_{a}" for a in axes], ids, k, seed)


def cell_counts(df: DataFrame, axes: Mapping[str, tuple[str, Sequence[float]]], k: int) -> DataFrame:
    """Available and selected rows per cell."""
    cells = with_cells(df, axes).groupBy(*[f"i_{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n_available"))
    return cells.withColumn("n_selected", F.least(F.col("n_available"), F.lit(k)))


def volume_limited(df: DataFrame, distance: str, cut: float, ids: Sequence[str], n_target: int, seed: int) -> DataFrame:
    """Rows nearer than the cut; a seeded sample of ``n_target`` when there are more."""
    near = df.where(F.col(distance) < cut)
    return seeded_sample(near, ids, n_target, seed)


def target_fill(cells: DataFrame, target: int) -> DataFrame:
    """Smallest per-cell cap whose total ``sum(least(n, k))`` reaches the target, and that total.

    Works on the histogram of cell sizes, so its work does not grow with the rows.
    """
    sizes = cells.groupBy(F.col("n_available").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    up = W.orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    prof = sizes.select(
        "n",
        F.sum(F.col("n") * F.col("c")).over(up).alias("rows_le"),
        F.sum("c").over(up).alias("cells_le"),
        F.sum("c").over(W.partitionBy()).alias("cells"),
    ).withColumn("full", F.col("rows_le") + F.col("n") * (F.col("cells") - F.col("cells_le")))
    reach = prof.where(F.col("full") >= target).agg(F.min("n").alias("n1"))
    below = prof.where(F.col("full") < target).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n0"),
        F.coalesce(F.max("full"), F.lit(0)).alias("t0"),
        F.max("cells_le").alias("done"),
    )
    total_cells = one_row(sizes.agg(F.sum("c").alias("cells")))["cells"]
    biggest = one_row(sizes.agg(F.max("n").alias("m")))["m"]
    left = total_cells - F.coalesce("done", F.lit(0))
    step = F.ceil((F.lit(target) - F.col("t0")) / left)
    k = below.select(
        F.when(one_row(reach)["n1"].isNull(), biggest).otherwise(F.col("n0") + step).cast("long").alias("per_cell")
    )
    per = one_row(k)["per_cell"]
    return cells.select(F.least(F.col("n_available"), per).alias("s"), per.alias("per_cell")).groupBy("per_cell").agg(
        F.sum("s").alias("n_selected")
    )


def quantile_edges(df: DataFrame, columns: Sequence[str], n_bins: Sequence[int], offset: float = 0.0) -> dict[str, list[float]]:
    """Interior quantile edges per column: a fit that brings ``n - 1`` numbers per column to the driver."""
    out: dict[str, list[float]] = {}
    for n in sorted(set(n_bins)):
        cols = [c for c, k in zip(columns, n_bins) if k == n]
        probs = {f"q{i}": min(1.0, max(0.0, i / n + offset / n)) for i in range(1, n)}
        row = exact_quantiles_of(df, [], cols, probs).first() or {}
        for c in cols:
            found = [row[f"{c}_{q}"] for q in probs] if row else []
            out[c] = [float(x) for x in found] if found and None not in found else [0.0] * (n - 1)
    return out


def quantile_bin(df: DataFrame, columns: Sequence[str], n_bins: Sequence[int], ids: Sequence[str], *, seed: int = 0, offset: float = 0.0, prefix: str = "q_") -> DataFrame:
    """Digitise columns by their interior quantiles; a missing value gets a seeded hash bin."""
    edges = quantile_edges(df, columns, n_bins, offset)
    out = {}
    for c, n in zip(columns, n_bins):
        spare = F.pmod(hash_slot(seeded_hash(f"{seed}{c}", *ids)), F.lit(n))
        out[f"{prefix}{c}"] = F.coalesce(digitize(c, edges[c]), spare)
    return df.withColumns(out)


def bin_by_cells(df: DataFrame, columns: Sequence[str], n_bins: Sequence[int], ids: Sequence[str], *, seed: int = 0, offset: float = 0.0, out: str = "cell") -> DataFrame:
    """Per-column quantile bins combined into one mixed-radix cell code."""
    binned = quantile_bin(df, columns, n_bins, ids, seed=seed, offset=offset)
    idx = [f"q_{c}" for c in columns]
    return binned.withColumn(out, cell_code(idx, n_bins)).drop(*idx)


def stratified_split(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], *, n_bins: int = 4, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0, out: str = "split"
) -> DataFrame:
    """Train/val/test inside each joint quantile cell, cut points rounded half to even."""
    cells = bin_by_cells(df, columns, [n_bins] * len(columns), ids, seed=seed, out="__cell")

    def cuts(groups: DataFrame) -> DataFrame:
        return groups.withColumn("cuts", F.array(*[F.bround(F.col("n") * f, 0) for f in (fractions[0], fractions[0] + fractions[1])]))

    parted = hash_cut(cells, ["__cell"], ids, seed, cuts, "__part")
    return parted.withColumn(out, F.get(F.lit(["train", "val", "test"]), "__part")).drop("__cell", "__part")


def decorrelated_sample(df: DataFrame, label: str, priors: Sequence[str], ids: Sequence[str], *, n_bins: int = 4, seed: int = 0) -> DataFrame:
    """Equal numbers from each label bin inside each prior cell; cells lacking a label bin drop out."""
    cols = [*priors, label]
    binned = quantile_bin(df, cols, [n_bins] * len(cols), ids, seed=seed)
    binned = binned.withColumn("__cell", cell_code([f"q_{p}" for p in priors], [n_bins] * len(priors)))
    binned = binned.withColumnRenamed(f"q_{label}", "__bin").drop(*[f"q_{p}" for p in priors])

    def cuts(groups: DataFrame) -> DataFrame:
        targets = groups.groupBy("__cell").agg(F.min("n").alias("__target"), F.count(F.lit(1)).alias("bins")).where(F.col("bins") == n_bins)
        return groups.join(targets, "__cell").withColumn("cuts", F.array("__target"))

    return hash_cut(binned, ["__cell", "__bin"], ids, seed, cuts, "__part").where("__part = 0").drop("__cell", "__bin", "__part")


def inverse_freq_weights(df: DataFrame, column: str, edges: Sequence[float], clip: float, out: str = "weight") -> DataFrame:
    """``min(1/p(bin), clip)``, 1 for missing values, scaled to mean 1."""
    binned = df.withColumn("__bin", digitize(column, edges))
    counts = binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("n"))
    known = one_row(counts.where(F.col("__bin").isNotNull()).agg(F.sum("n").alias("n")))["n"]
    raw = F.when(F.col("__bin").isNull(), 1.0).otherwise(F.least(F.lit(float(clip)), known / F.col("n")))
    counts = counts.withColumn("__w", raw)
    mean = one_row(counts.agg((F.sum(F.col("__w") * F.col("n")) / F.sum("n")).alias("m")))["m"]
    weights = counts.select("__bin", (F.col("__w") / mean).alias(out))
    return join_on_keys(binned, weights, ["__bin"]).drop("__bin")


def seeded_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in seeded hash order (``ids`` identify a row)."""
    return hash_cut(df, [], ids, seed, lambda g: g.withColumn("cuts", F.array(F.lit(n))), "__part").where("__part = 0").drop("__part")


def rows_per_key(df: DataFrame, key: str, out: str = "n_rows") -> DataFrame:
    return with_group_size(df, [key], out)
