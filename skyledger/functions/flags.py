"""Quality flags, release tiers and the choice between two predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.nulls import any_missing, coerce_flag, fail_closed, fail_open

# Element names and the sigma above which a prediction counts as inflated.
SIGMA_LIMITS: dict[str, float] = {
    "teff": 150.0, "logg": 0.3, "mh": 0.2, "fe_h": 0.15, "alpha_m": 0.05, "mg_h": 0.2, "c_h": 0.15,
    "n_h": 0.15, "o_h": 0.15, "na_h": 0.15, "al_h": 0.15, "si_h": 0.15, "s_h": 0.15, "k_h": 0.15,
    "ca_h": 0.15, "ti_h": 0.15, "v_h": 0.15, "cr_h": 0.15, "mn_h": 0.15, "ni_h": 0.15, "ce_h": 0.15,
}
ELEMENTS = tuple(SIGMA_LIMITS)
AUX_ASSISTED = ("alpha_m", "mg_h")
# Magnitude limits, parallax signal-to-noise, distance spread, IQR of a unit normal.
BRIGHT_LIMIT, MID_LIMIT = 15.0, 16.0
PARALLAX_SNR = 5.0
RELATIVE_SPREAD = 0.3
IQR_TO_SIGMA = 1.349
# Exclusion box near the plane.
ENVELOPE_B, ENVELOPE_TEFF, ENVELOPE_LOGG = 5.0, 4750.0, 2.10
# Accepted classes and the parameter box used without a class.
STAGES = ("RGB", "RC", "RGB_candidate")
STAGE_TEFF, STAGE_LOGG = (4000.0, 5500.0), (1.0, 3.5)

MAG_COLUMNS = ("phot_g_mean_mag_corr", "g_mag", "phot_g_mean_mag")


def _any(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def magnitude_bin(df: DataFrame, candidates: Sequence[str] = MAG_COLUMNS, out: str = "g_mag_bin") -> DataFrame:
    name = first_present(df, candidates)
    if name is None:
        return df.withColumn(out, F.lit("unknown"))
    g = F.col(name)
    return df.withColumn(
        out,
        F.when(g.isNull(), "unknown").when(g <= BRIGHT_LIMIT, "bright").when(g <= MID_LIMIT, "mid").otherwise("faint"),
    )


def prior_dominated(df: DataFrame, threshold: float = PARALLAX_SNR, out: str = "dist_prior_dominated") -> DataFrame:
    """Parallax signal-to-noise low, missing or not positive; column fallbacks as available."""
    plx = first_present(df, ("parallax_corr", "parallax"))
    if plx and "parallax_error" in df.columns:
        err = F.when(F.col("parallax_error") > 0, F.col("parallax_error"))
        snr = F.coalesce(F.try_divide(F.col(plx), err), F.lit(0.0))
        flag = (snr < threshold) | F.col(plx).isNull() | (F.col(plx) <= 0)
    elif "parallax_over_error" in df.columns:
        flag = F.coalesce(F.col("parallax_over_error"), F.lit(0.0)) < threshold
    else:
        flag = F.lit(False)
    return df.withColumn(out, fail_closed(flag))


def distance_trust(
    df: DataFrame,
    *,
    med: str = "r_med_photogeo",
    lo: str = "r_lo_photogeo",
    hi: str = "r_hi_photogeo",
    parallax: str = "parallax",
    limit: float = RELATIVE_SPREAD,
) -> DataFrame:
    spread = F.when(F.col(med) > 0, (F.col(hi) - F.col(lo)) / F.col(med))
    df = df.withColumns(
        {
            "dist_has_estimate": F.col(med).isNotNull(),
            "dist_relative_spread_high": fail_closed(spread > limit),
            "dist_negative_parallax": fail_open(F.col(parallax) < 0),
        }
    )
    return df.withColumn(
        "dist_trustworthy",
        F.col("dist_has_estimate") & ~F.col("dist_relative_spread_high") & ~F.col("dist_negative_parallax"),
    )


def sigma_inflated(df: DataFrame, limits: Mapping[str, float] = SIGMA_LIMITS) -> DataFrame:
    """One flag per element and their OR, generated in a single projection."""
    flags = {
        e: (F.coalesce(F.col(f"{e}_sigma"), F.lit(0.0)) > t) if f"{e}_sigma" in df.columns else F.lit(False)
        for e, t in limits.items()
    }
    return df.withColumns(
        {**{f"prediction_sigma_inflated__{e}": c for e, c in flags.items()}, "prediction_sigma_inflated_any": _any(list(flags.values()))}
    )


def abundance_type(df: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    return df.withColumns(
        {f"xp_abundance_type__{e}": F.lit("aux_assisted" if e in AUX_ASSISTED else "spectrum_dominant") for e in elements}
    )


def kin_flag_default(df: DataFrame, out: str = "kin_ood_flag") -> DataFrame:
    return df if out in df.columns else df.withColumn(out, F.lit(False))


def tier_expressions(
    df: DataFrame,
    elements: Sequence[str],
    *,
    ood: str = "ood_joint_flag",
    extrapolated: str = "label_extrapolation_flag",
) -> dict[str, Column]:
    if extrapolated not in df.columns:
        raise ValueError(f"column {extrapolated!r} is required; without it tier 2 would pass as tier 1")
    out_of_range = coerce_flag(df, ood) if ood in df.columns else F.lit(False)
    extra = coerce_flag(df, extrapolated)
    tiers = {}
    for e in elements:
        missing = F.col(f"{e}_pred").isNull() if f"{e}_pred" in df.columns else F.lit(False)
        tiers[e] = F.when(missing | out_of_range, 3).when(extra, 2).otherwise(1).cast("tinyint")
    return tiers


def element_tier(df: DataFrame, elements: Sequence[str] = ELEMENTS, **flags: str) -> DataFrame:
    """Tier 3 when out of distribution or without prediction, 2 when extrapolated, else 1."""
    return df.withColumns({f"release_tier__{e}": c for e, c in tier_expressions(df, elements, **flags).items()})


def release_tier(df: DataFrame, elements: Sequence[str] = ELEMENTS, out: str = "release_tier") -> DataFrame:
    """Worst element tier of the row."""
    cols = [F.col(f"release_tier__{e}") for e in elements]
    return df.withColumn(out, (F.greatest(*cols) if len(cols) > 1 else cols[0]).cast("tinyint"))


def hybrid_compose(df: DataFrame, elements: Sequence[str] = ELEMENTS, limits: Mapping[str, float] = SIGMA_LIMITS) -> DataFrame:
    """Regressor unless its sigma is inflated and a neighbour value exists."""
    out = {}
    for e in elements:
        pred = F.col(f"{e}_pred") if f"{e}_pred" in df.columns else F.lit(None).cast("double")
        sigma = F.col(f"{e}_sigma") if f"{e}_sigma" in df.columns else F.lit(None).cast("double")
        med = F.col(f"knn_{e}_med") if f"knn_{e}_med" in df.columns else F.lit(None).cast("double")
        iqr = F.col(f"knn_{e}_iqr") if f"knn_{e}_iqr" in df.columns else F.lit(None).cast("double")
        inflated = F.coalesce(sigma, F.lit(0.0)) > limits[e]
        use = inflated & med.isNotNull() & iqr.isNotNull()
        out[f"{e}_hybrid_pred"] = F.when(use, med).otherwise(pred)
        out[f"{e}_hybrid_sigma"] = F.when(use, iqr / IQR_TO_SIGMA).otherwise(sigma)
        out[f"{e}_hybrid_source"] = F.when(use, "knn").when(inflated, "regressor_caveat").otherwise("regressor")
        out[f"{e}_hybrid_tier"] = F.when(inflated, 2).otherwise(1).cast("tinyint")
    return df.withColumns(out)


def regime_envelope(df: DataFrame, *, teff: str, logg: str, b: str) -> DataFrame:
    inside = fail_open((F.abs(F.col(b)) < ENVELOPE_B) & (F.col(teff) > ENVELOPE_TEFF) & (F.col(logg) < ENVELOPE_LOGG))
    return df.withColumn("regime_flag", inside).withColumn("regime_clear", ~inside)


def stage_filter_flags(df: DataFrame, *, teff: str = "teff", logg: str = "logg", stage: str = "evol_stage", require_stage: bool = False) -> DataFrame:
    by_class = fail_open(F.col(stage).isin(*STAGES))
    by_box = fail_open(F.col(teff).between(*STAGE_TEFF) & F.col(logg).between(*STAGE_LOGG))
    eligible = by_class if require_stage else by_class | (F.col(stage).isNull() & by_box)
    return df.withColumns({"class_accepted": by_class, "box_accepted": by_box, "eligible": eligible})


def missingness_flags(
    df: DataFrame, *, infrared: Sequence[str], extinction: Sequence[str], parallax: str, parallax_error: str, min_snr: float = PARALLAX_SNR
) -> DataFrame:
    """Computed on raw values, before any imputation."""
    snr = F.when(F.col(parallax_error) > 0, F.col(parallax) / F.col(parallax_error))
    df = df.withColumns(
        {
            "ir_missing_flag": any_missing(*infrared),
            "parallax_missing_flag": ~fail_open(F.abs(snr) >= min_snr),
            "extinction_missing_flag": reduce(lambda a, b: a & b, [F.col(c).isNull() for c in extinction]),
        }
    )
    return df.withColumn(
        "aux_missing_any", F.col("ir_missing_flag") | F.col("parallax_missing_flag") | F.col("extinction_missing_flag")
    )


def completeness_mask(bands: Sequence[str]) -> Column:
    """Every band present and not zero."""
    return fail_open(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != 0.0) for c in bands]))


def ood_status(a: str, b: str) -> Column:
    return (F.col(a).cast("int") + F.col(b).cast("int")).cast("tinyint")
