"""Release assembly: join, annotate, derive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.flags import (
    AUX_ASSISTED,
    ELEMENTS,
    SIGMA_LIMITS,
    abundance_type,
    element_tier,
    hybrid_compose,
    kin_flag_default,
    magnitude_bin,
    prior_dominated,
    release_tier,
    sigma_inflated,
)
from skyledger.functions.nulls import fail_open
from skyledger.operators.joins import join_1to1_guarded, join_lookup_default
from skyledger.sources.catalogue import project_existing, write_atomic, write_partitioned
from skyledger.sources.lineage import release_sidecar

# Column lists of the derived products.
HRD_COLUMNS = (
    "source_id", "ra", "dec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "parallax", "parallax_error",
    "teff_pred", "teff_sigma", "logg_pred", "logg_sigma", "mh_pred", "mh_sigma", "release_tier", "release_tier__teff",
    "release_tier__logg", "release_tier__mh", "g_mag_bin",
)
KINEMATIC_COLUMNS = (
    "source_id", "ra", "dec", "parallax", "parallax_error", "pmra", "pmra_error", "pmdec", "pmdec_error",
    "phot_g_mean_mag", "teff_pred", "teff_sigma", "logg_pred", "logg_sigma", "mh_pred", "mh_sigma", "alpha_m_pred",
    "alpha_m_sigma", "mg_h_pred", "mg_h_sigma", "release_tier", "release_tier__teff", "release_tier__logg",
    "release_tier__mh", "release_tier__alpha_m", "release_tier__mg_h", "kin_ood_flag", "dist_prior_dominated",
    "g_mag_bin", "xp_abundance_type__alpha_m", "xp_abundance_type__mg_h",
)
SUMMARY_ELEMENTS = ("teff", "logg", "mh", "alpha_m", "mg_h")


def annotate(df: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """All quality and tier columns in one lazy chain."""
    limits = {e: t for e, t in SIGMA_LIMITS.items() if e in elements}
    return (
        df.transform(abundance_type, elements)
        .transform(magnitude_bin)
        .transform(kin_flag_default)
        .transform(prior_dominated)
        .transform(sigma_inflated, limits)
        .transform(element_tier, elements)
        .transform(release_tier, elements)
    )


def hrd_subset(df: DataFrame, tier: int = 1) -> DataFrame:
    return project_existing(df.where(F.col("release_tier") <= tier), HRD_COLUMNS)


def kinematic_subset(df: DataFrame, tier: int = 2) -> DataFrame:
    return project_existing(df.where(F.col("release_tier") <= tier), KINEMATIC_COLUMNS)


def tier1_subset(df: DataFrame, drop_aux: bool = True) -> DataFrame:
    out = df.where(F.col("release_tier") == 1)
    if not drop_aux:
        return out
    patterns = ("{}_pred", "{}_sigma", "release_tier__{}", "xp_abundance_type__{}")
    return out.drop(*[p.format(e) for e in AUX_ASSISTED for p in patterns])


def per_cell_summary(df: DataFrame, cells: Sequence[str] = ("g_mag_bin",), elements: Sequence[str] = SUMMARY_ELEMENTS) -> DataFrame:
    """Per group, the NULL group too: rows, means, tier counts, flag shares."""
    present = [c for c in cells if c in df.columns]
    if not present:
        df, present = df.withColumn("_all", F.lit("all")), ["_all"]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for e in elements:
        for kind in ("pred", "sigma"):
            if f"{e}_{kind}" in df.columns:
                aggs.append(F.avg(f"{e}_{kind}").alias(f"mean_{e}_{kind}"))
        if f"release_tier__{e}" in df.columns:
            aggs += [F.count_if(F.col(f"release_tier__{e}") == t).alias(f"n_tier{t}_{e}") for t in (1, 2, 3)]
    for f, name in (("kin_ood_flag", "frac_kin_ood"), ("dist_prior_dominated", "frac_dist_prior_dominated")):
        if f in df.columns:
            aggs.append(F.avg(fail_open(F.col(f)).cast("double")).alias(name))
    return df.groupBy(*present).agg(*aggs)


def per_magnitude_reliability(df: DataFrame, elements: Sequence[str] = SUMMARY_ELEMENTS) -> DataFrame:
    """Long table (bin x element) from one scan."""
    if "g_mag_bin" not in df.columns:
        df = df.withColumn("g_mag_bin", F.lit("all"))
    rows = [
        F.struct(
            F.lit(e).alias("element"),
            F.col(f"{e}_pred").cast("double").alias("pred"),
            F.col(f"{e}_sigma").cast("double").alias("sigma"),
            F.col(f"release_tier__{e}").alias("tier"),
            F.lit(e in AUX_ASSISTED).alias("aux"),
        )
        for e in elements
        if f"{e}_pred" in df.columns
    ]
    long = df.select("g_mag_bin", F.explode(F.array(*rows)).alias("s")).select("g_mag_bin", "s.*")
    return long.groupBy("g_mag_bin", "element").agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col("tier") == t).alias(f"n_tier{t}") for t in (1, 2, 3)],
        F.avg("sigma").alias("mean_sigma"),
        F.avg(F.col("pred").isNotNull().cast("double")).alias("frac_predicted"),
        F.avg(F.col("aux").cast("double")).alias("frac_aux_assisted"),
    )


def tier_counts(df: DataFrame, tier: str = "release_tier") -> DataFrame:
    return df.agg(*[F.count_if(F.col(tier) == t).alias(f"tier{t}") for t in (1, 2, 3)])


def flag_distribution(df: DataFrame) -> DataFrame:
    """Value counts of magnitude bin and tier, and flag percentages, as one long table."""
    sets = df.groupingSets([["g_mag_bin"], ["release_tier"]], "g_mag_bin", "release_tier").agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.grouping_id().alias("gid")
    )
    counts = sets.select(
        F.when(F.col("gid") == 1, "g_mag_bin").otherwise("release_tier").alias("quantity"),
        F.when(F.col("gid") == 1, F.col("g_mag_bin")).otherwise(F.col("release_tier").cast("string")).alias("level"),
        "value",
    )
    flags = ["dist_prior_dominated", "kin_ood_flag"]
    pct = df.agg(*[(100.0 * F.avg(fail_open(F.col(f)).cast("double"))).alias(f) for f in flags])
    return counts.unionByName(pct.unpivot([], flags, "quantity", "value").withColumn("level", F.lit("pct")))


def attach_hybrid(df: DataFrame, knn: DataFrame, key: str, elements: Sequence[str]) -> DataFrame:
    return hybrid_compose(df.join(knn, key, "left"), elements)


def hybrid_source_counts(df: DataFrame, elements: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(e).alias("element"), F.col(f"{e}_hybrid_source").alias("source"), F.col(f"{e}_hybrid_tier").alias("tier")) for e in elements]
    long = df.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return long.groupBy("element", "source", "tier").agg(F.count(F.lit(1)).alias("n"))


def release_table(predictions: DataFrame, features: DataFrame, key: str, elements: Sequence[str], kin_lookup: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Guarded join, kinematic flag, annotation: the lazy release frame."""
    out = join_1to1_guarded(predictions, features, key, validate=validate)
    if kin_lookup is not None:
        out = join_lookup_default(out, kin_lookup, key, "kin_ood_flag")
    return annotate(out, elements)


def run_release(
    predictions: DataFrame, features: DataFrame, key: str, out_dir: str, elements: Sequence[str], kin_lookup: DataFrame | None = None, knn: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Write the annotated table once and derive every product from it."""
    table = release_table(predictions, features, key, elements, kin_lookup)
    if knn is not None:
        table = attach_hybrid(table, knn, key, elements)
    base = write_atomic(table, f"{out_dir}/annotated")
    gates = [c for c in ("ood_joint_flag", "label_extrapolation_flag") if c in base.columns]
    added = [c for c in base.columns if c not in predictions.columns and c not in features.columns]
    products = {
        "hrd": hrd_subset(base),
        "kinematic": kinematic_subset(base),
        "tier1": tier1_subset(base),
        "per_cell": per_cell_summary(base),
        "per_magnitude": per_magnitude_reliability(base, [e for e in SUMMARY_ELEMENTS if e in elements]),
        "manifest": flag_distribution(base),
        "sidecar": release_sidecar(base, "release_tier", gates, added),
    }
    out = {n: write_atomic(p, f"{out_dir}/{n}") for n, p in products.items()}
    out["partitions"] = write_partitioned(base, f"{out_dir}/by_g_mag_bin", "g_mag_bin")
    out["annotated"] = base
    return out

