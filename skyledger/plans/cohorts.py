"""Cohort chains: each is one lazy plan from scans to the enriched table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.corrections import ABUNDANCE_TRENDS, abundance_trend, derive_ratio, g_mag_correction, parallax_correction
from skyledger.functions.extinction import compose_by_zone, correct_extinction
from skyledger.functions.flags import distance_trust
from skyledger.functions.nulls import ensure_flags
from skyledger.functions.vectors import bad_spectrum, normalise_errors, normalise_vector, project_basis, zscore_vector
from skyledger.operators.joins import join_chain, join_many_to_one, merge_distances, semi_ids
from skyledger.operators.ranking import one_row
from skyledger.operators.sampling import stratified_cap, volume_limited
from skyledger.operators.sets import union_arms
from skyledger.operators.spatial import neighbourhood


def frozen_vector_stats(train: DataFrame, vector: str) -> Column:
    """Mean and standard deviation of every position over the training rows, as arrays ``mean`` and ``sigma`` of a scalar subquery."""
    each = train.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    rows = each.agg(F.sort_array(F.collect_list(F.struct("at", "m", "s"))).alias("r"))  # one entry a position
    return one_row(rows.select(F.transform("r", lambda x: x["m"]).alias("mean"), F.transform("r", lambda x: x["s"]).alias("sigma")))


def _zscored(df: DataFrame, vector: str, name: str, mean: Column | Sequence[float], sigma: Column | Sequence[float]) -> DataFrame:
    """``df`` with the z-scores of a vector; frozen columns are laid beside the rows first, since no lambda may hold a subquery."""
    if not isinstance(mean, Column):
        return df.withColumn(name, zscore_vector(vector, mean, sigma))
    beside = df.withColumn("__mean", mean).withColumn("__sigma", sigma)
    return beside.withColumn(name, zscore_vector(vector, F.col("__mean"), F.col("__sigma"))).drop("__mean", "__sigma")


def preprocess(
    df: DataFrame,
    zero_points: Sequence[tuple[float, float, float]],
    *,
    flux: str | None = None,
    vector: str | None = None,
    mean: Column | Sequence[float] | None = None,
    sigma: Column | Sequence[float] | None = None,
    extinction: bool = True,
    **names: str,
) -> DataFrame:
    """Projection of ``flux`` on the band basis, parallax, magnitude, frozen z-score, dereddening and flags."""
    df = project_basis(df, flux) if flux is not None else df
    out = parallax_correction(df, zero_points, mag=names.get("mag", "phot_g_mean_mag"))
    out = g_mag_correction(out, mag=names.get("mag", "phot_g_mean_mag"))
    if vector is not None:
        out = _zscored(out, vector, f"{vector}_z", mean, sigma)
    if extinction:
        out = correct_extinction(out)
    return ensure_flags(out, ["ood_joint_flag", "label_extrapolation_flag"])


def spectra_ingest(ids: DataFrame, spectra: DataFrame, key: str, coeffs: str, errors: str, *, mean: Column | None = None, sigma: Column | None = None) -> DataFrame:
    """Spectra of an id list: rejected when broken, normalised, optionally z-scored."""
    own = semi_ids(spectra, ids, key).where(~bad_spectrum(coeffs) & ~bad_spectrum(F.transform(errors, lambda x: F.abs(x) + 1.0)))
    out = own.select(key, normalise_vector(coeffs).alias("coeffs_norm"), normalise_errors(coeffs, errors).alias("errors_norm"))
    out = out.withColumn("c0_log", F.get("coeffs_norm", F.lit(0)))
    return out if mean is None else _zscored(out, "coeffs_norm", "coeffs_z", mean, sigma)


def enrich_geometry(
    df: DataFrame, primary: DataFrame, second: DataFrame | None, key: str, *, ra: str, dec: str, value: str, radius: float, med: str, lo: str, hi: str, second_med: str, near: str, mid: str, far: str
) -> DataFrame:
    """Distances, composed extinction and neighbourhood features."""
    out = df.join(merge_distances(primary, second, key, med=med, lo=lo, hi=hi, second_med=second_med), key, "left")
    out = compose_by_zone(out, near=near, mid=mid, far=far, distance="dist_primary_pc", distance_unit="pc")
    return neighbourhood(out, ra, dec, "dist_primary_pc", value, radius=radius)


def seismic_catalogue(stars: DataFrame, distances: DataFrame, extinction: DataFrame, velocities: DataFrame, key: str) -> DataFrame:
    """Left joins of distances, extinction layers and velocities, with trust flags."""
    out = stars.join(distances, key, "left").transform(distance_trust)
    out = out.join(extinction, key, "left").transform(correct_extinction)
    return out.join(velocities, key, "left")


def cohort_1(spectra: DataFrame, stars: DataFrame, key: str, cuts: Mapping[str, Column], zero_points, *, trends=ABUNDANCE_TRENDS, ratio: tuple[str, ...] | None = None) -> DataFrame:
    """Cuts, ratio, trend correction, many-to-one join, preprocessing."""
    out = spectra
    for c in cuts.values():
        out = out.where(c)
    if ratio:
        out = derive_ratio(out, *ratio)
    out = abundance_trend(out, trends=trends)
    return preprocess(join_many_to_one(out, stars, key, validate=False), zero_points)


def cohort_2(start: DataFrame, links: Sequence[tuple[DataFrame, str]], zero_points) -> DataFrame:
    """Join chain through changing keys, then preprocessing."""
    return preprocess(join_chain(start, *links), zero_points)


def cohort_3(parent: DataFrame, axes: Mapping, ids: Sequence[str], per_cell: int, seed: int, *, distance: str, cut: float, n_volume: int, key: str) -> DataFrame:
    """Stratified arm and volume-limited arm of the remaining rows, tagged and stacked."""
    uniform = stratified_cap(parent, axes, ids, per_cell, seed).select(*parent.columns)
    rest = parent.join(uniform.select(key), key, "left_anti")
    volume = volume_limited(rest, distance, cut, ids, n_volume, seed)
    return union_arms({"uniform": uniform, "volume": volume}, key, validate=False)


def cohort_3_features(
    union: DataFrame, stars: DataFrame, infrared: DataFrame, spectra: DataFrame, distances: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Source join, infrared left, spectra inner, distances left, selection probability."""
    out = union.join(stars, key).join(infrared, key, "left").join(spectra, key).join(distances, key, "left")
    return score(out)


def holdout_table(predictions: DataFrame, truth: DataFrame, split: DataFrame, key: str, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions with truth, tiered, held-out ids only."""
    held = split.where(F.col("split").isin("val", "test"))
    return annotate(semi_ids(predictions, held, key).join(truth, key))


def kin_chem_table(predictions: DataFrame, kinematics: DataFrame, key: str, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions with velocities, tier 1 only."""
    return annotate(predictions.join(kinematics, key)).where(F.col("release_tier") == 1)


