"""Published catalogue corrections as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.binning import digitize, edge_value

# Solution types of the astrometric fit.
TWO_PARAMETER, FIVE_PARAMETER, SIX_PARAMETER = 3, 31, 95

# Cubic coefficients in colour, colour limits, magnitude limits.
G_BRIGHT = (1.00876, -0.02540, 0.01747, -0.00277)
G_FAINT = (1.00525, -0.02323, 0.01740, -0.00253)
G_COLOUR_LIMITS = (0.25, 3.0)
G_START, G_SPLIT = 13.0, 16.0

# Linear temperature trend per abundance column
# (slope, intercept, offset above the hot limit, offset below the cold limit).
TREND_COLD, TREND_HOT, TREND_LOGG_MAX = 3500.0, 6000.0, 3.8
ABUNDANCE_TRENDS: dict[str, tuple[float, float, float, float]] = {
    "alpha_m_atm": (-2.2918e-5, 0.0861, -0.0514, 0.0059),
    "o_h_atm": (-4.0909e-5, 0.1651, -0.0804, 0.0219),
    "na_h_atm": (-8.2173e-5, 0.4586, -0.0344, 0.1710),
    "mg_h_atm": (-4.3932e-5, 0.1733, -0.0903, 0.0195),
    "al_h_atm": (3.0850e-5, -0.1734, 0.0117, -0.0654),
    "si_h_atm": (1.1688e-5, -0.0594, 0.0107, -0.0185),
    "s_h_atm": (-1.0886e-6, 0.0214, 0.0149, 0.0176),
    "k_h_atm": (-7.0765e-5, 0.3220, -0.1026, 0.0743),
    "ca_h_atm": (5.4495e-5, -0.2832, 0.0438, -0.0925),
    "ti_h_atm": (-1.1466e-4, 0.5137, -0.1743, 0.1124),
    "cr_h_atm": (-6.4991e-6, 0.0099, -0.0291, -0.0128),
    "mn_h_atm": (-1.0168e-4, 0.4999, -0.1102, 0.1440),
    "ni_h_atm": (-2.3203e-5, 0.0806, -0.0586, -0.0006),
    "ce_h_atm": (1.3833e-4, -0.5431, 0.2869, -0.0589),
}


def g_factor(mag: Column, colour: Column, solution: Column) -> Column:
    """Flux factor: a cubic in clipped colour for 2- and 6-parameter solutions from G = 13."""
    c = F.greatest(F.lit(G_COLOUR_LIMITS[0]), F.least(colour, F.lit(G_COLOUR_LIMITS[1])))

    def cubic(k: Sequence[float]) -> Column:
        return k[0] + k[1] * c + k[2] * c * c + k[3] * c * c * c

    eligible = colour.isNotNull() & (solution != FIVE_PARAMETER)
    return (
        F.when(eligible & (mag >= G_START) & (mag <= G_SPLIT), cubic(G_BRIGHT))
        .when(eligible & (mag > G_SPLIT), cubic(G_FAINT))
        .otherwise(F.lit(1.0))
    )


def g_mag_correction(
    df: DataFrame,
    *,
    mag: str = "phot_g_mean_mag",
    colour: str = "bp_rp",
    solution: str = "astrometric_params_solved",
    flux: str | None = None,
    out_mag: str = "phot_g_mean_mag_corr",
    out_flux: str = "phot_g_mean_flux_corr",
) -> DataFrame:
    factor = g_factor(F.col(mag), F.col(colour), F.col(solution))
    df = df.withColumn(out_mag, F.col(mag) - 2.5 * F.log10(factor))
    return df.withColumn(out_flux, F.col(flux) * factor) if flux else df


def zero_point(mag: Column, table: Sequence[tuple[float, float, float]]) -> Column:
    """Zero point from a caller's piecewise table of (edge, value at edge, slope above it)."""
    edges = [t[0] for t in table]
    i = F.greatest(digitize(mag, edges) - 1, F.lit(0))
    base, slope = edge_value(i, [t[1] for t in table]), edge_value(i, [t[2] for t in table])
    return base + slope * (mag - edge_value(i, edges))


# Centres and limits of the colour and latitude terms of the published zero point.
NU_CENTRE, NU_HALF_RANGE, NU_RED, NU_BLUE = 1.48, 0.24, 1.24, 1.72


def zero_point_terms(nu: Column, latitude_deg: Column) -> tuple[list[Column], list[Column]]:
    """Basis functions in effective wavenumber (or pseudocolour) and in ecliptic latitude."""
    low = NU_CENTRE - nu
    colour = [
        F.lit(1.0),
        F.greatest(F.lit(-NU_HALF_RANGE), F.least(F.lit(NU_HALF_RANGE), -low)),
        F.pow(F.least(F.lit(NU_HALF_RANGE), F.greatest(F.lit(0.0), low)), F.lit(3.0)),
        F.least(F.lit(0.0), nu - NU_RED),
        F.greatest(F.lit(0.0), nu - NU_BLUE),
    ]
    sine = F.sin(F.radians(latitude_deg))
    return colour, [F.lit(1.0), sine, sine * sine - 1.0 / 3.0]


def zero_point_of(mag: Column, nu: Column, latitude_deg: Column, edges: Sequence[float], coefficients: Mapping[tuple[int, int], Sequence[float]]) -> Column:
    """Zero point on all its axes from a caller's table.

    ``coefficients[j, k]`` holds the factor of colour term j and latitude term k
    at each magnitude edge; between edges it is linear, outside it stays. NULL
    where an input that a factor needs is NULL.
    """
    colour, latitude = zero_point_terms(nu, latitude_deg)
    m = F.greatest(F.lit(float(edges[0])), F.least(F.lit(float(edges[-1])), mag))
    i = F.least(F.greatest(digitize(m, edges) - 1, F.lit(0)), F.lit(len(edges) - 2))
    share = (m - edge_value(i, edges)) / (edge_value(i + 1, edges) - edge_value(i, edges))
    total = F.when(mag.isNotNull(), F.lit(0.0))
    for (j, k), values in coefficients.items():
        q = edge_value(i, values) * (1.0 - share) + edge_value(i + 1, values) * share
        factor = q
        for j_or_k, terms in ((j, colour), (k, latitude)):
            factor = factor * terms[j_or_k] if j_or_k else factor
        total = total + factor
    return total


def parallax_correction_of(df: DataFrame, five: Column, six: Column, *, parallax: str = "parallax", solution: str = "astrometric_params_solved", zpt: str = "parallax_zpt", out: str = "parallax_corr") -> DataFrame:
    """Subtract the zero point of the solution's own kind; other solutions keep their parallax."""
    zp = F.when(F.col(solution) == FIVE_PARAMETER, five).when(F.col(solution) == SIX_PARAMETER, six)
    return df.withColumn(zpt, zp).withColumn(out, F.col(parallax) - F.coalesce(F.col(zpt), F.lit(0.0)))


def parallax_correction(
    df: DataFrame,
    table: Sequence[tuple[float, float, float]],
    *,
    parallax: str = "parallax",
    mag: str = "phot_g_mean_mag",
    solution: str = "astrometric_params_solved",
    zpt: str = "parallax_zpt",
    out: str = "parallax_corr",
) -> DataFrame:
    """Subtract the zero point for 5- and 6-parameter solutions only."""
    zp = F.when(F.col(solution).isin(FIVE_PARAMETER, SIX_PARAMETER), zero_point(F.col(mag), table))
    return df.withColumn(zpt, zp).withColumn(out, F.col(parallax) - F.coalesce(F.col(zpt), F.lit(0.0)))


def trend_delta(teff: Column, logg: Column, trend: tuple[float, float, float, float]) -> Column:
    a, b, hot, cold = trend
    inside = F.when(teff > TREND_HOT, F.lit(hot)).when(teff < TREND_COLD, F.lit(cold)).otherwise(a * teff + b)
    return F.when(teff.isNotNull() & (logg < TREND_LOGG_MAX), inside)


def abundance_trend(
    df: DataFrame, *, teff: str = "teff", logg: str = "logg", trends: Mapping = ABUNDANCE_TRENDS
) -> DataFrame:
    """Subtract the temperature trend from every abundance column present."""
    t, g = F.col(teff), F.col(logg)
    return df.withColumns(
        {c: F.col(c) - F.coalesce(trend_delta(t, g, k), F.lit(0.0)) for c, k in trends.items() if c in df.columns}
    )


def abundance_trend_summary(
    df: DataFrame, *, teff: str = "teff", logg: str = "logg", trends: Mapping = ABUNDANCE_TRENDS
) -> DataFrame:
    """Rows shifted, mean shift and rms shift per column, in one pass."""
    t, g = F.col(teff), F.col(logg)
    cols = [c for c in trends if c in df.columns]
    shifts = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("element"),
                        F.when(F.col(c).isNotNull(), -trend_delta(t, g, trends[c])).alias("shift"),
                    )
                    for c in cols
                ]
            )
        ).alias("s")
    ).select("s.*")
    return shifts.groupBy("element").agg(
        F.count("shift").alias("n_applied"),
        F.avg("shift").alias("mean_shift"),
        F.sqrt(F.avg(F.col("shift") * F.col("shift"))).alias("rms_shift"),
    )


def derive_ratio(df: DataFrame, a: str, b: str, e_a: str, e_b: str, out: str, e_out: str) -> DataFrame:
    """Difference of two logarithmic abundances with quadrature error."""
    return df.withColumn(out, F.col(a) - F.col(b)).withColumn(
        e_out, F.sqrt(F.col(e_a) * F.col(e_a) + F.col(e_b) * F.col(e_b))
    )
