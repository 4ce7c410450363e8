"""Column expressions: corrections, extinction, coordinates, vectors, flags."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyledger.bindings.b02_filters import FIVE, TIERED, released
from skyledger.bindings.b03_joins import BACKOFF, RETENTION, TEFF_EDGES, TEFF_LABELS, TEFF_LABEL_SQL, axes, completeness, extra_axes, retention
from skyledger.bindings.b05_stats import AV_SQL, FUSED, av_table
from skyledger.bindings.registry import query
from skyledger.bindings.views import PREDS, STARS, preds, stars
from skyledger.functions import coords as co, corrections as cr, extinction as ex, flags as fl, nulls, vectors as v
from skyledger.functions.binning import labelled
from skyledger.operators import ensembles as en, joins
from skyledger.operators.ranking import one_row

C = "greatest(0.25e0, least(bp_rp, 3e0))"


def cubic(k):
    return f"({k[0]}e0 + {k[1]}e0*{C} + {k[2]}e0*{C}*{C} + {k[3]}e0*{C}*{C}*{C})"


FACTOR = f"CASE WHEN bp_rp IS NOT NULL AND sol <> 31 AND g_mag >= 13 AND g_mag <= 16 THEN {cubic(cr.G_BRIGHT)} WHEN bp_rp IS NOT NULL AND sol <> 31 AND g_mag > 16 THEN {cubic(cr.G_FAINT)} ELSE 1e0 END"


@query("g_mag_correction", f"WITH {STARS} SELECT source_id, g_mag - 2.5e0*log10({FACTOR}) AS phot_g_mean_mag_corr, o_totalprice*{FACTOR} AS phot_g_mean_flux_corr FROM stars", r="phot_g_mean_mag_corr phot_g_mean_flux_corr", digits=3)
def _(t):
    return cr.g_mag_correction(stars(t), mag="g_mag", solution="sol", flux="o_totalprice").select("source_id", "phot_g_mean_mag_corr", "phot_g_mean_flux_corr")


ZP = [(0.0, -0.02, 0.0), (11.0, -0.03, 0.002), (14.0, -0.024, -0.004)]
ZPT = "CASE WHEN sol IN (31, 95) THEN CASE WHEN g_mag < 11 THEN -0.02e0 WHEN g_mag < 14 THEN -0.03e0 + 0.002e0*(g_mag - 11) ELSE -0.024e0 - 0.004e0*(g_mag - 14) END END"


@query("parallax_correction", f"WITH {STARS} SELECT source_id, {ZPT} AS parallax_zpt, parallax - coalesce({ZPT}, 0) AS parallax_corr FROM stars", r="parallax_zpt parallax_corr")
def _(t):
    return cr.parallax_correction(stars(t), ZP, mag="g_mag", solution="sol").select("source_id", "parallax_zpt", "parallax_corr")


def trend_sql(name):
    a, b, hot, cold = cr.ABUNDANCE_TRENDS[name]
    return f"CASE WHEN teff IS NOT NULL AND logg < 3.8 THEN CASE WHEN teff > 6000 THEN {hot}::DOUBLE WHEN teff < 3500 THEN {cold}::DOUBLE ELSE ({a}::DOUBLE)*teff + {b}::DOUBLE END END"


def abundances(t):
    return stars(t).select("source_id", "teff", "logg", F.col("alpha_m").alias("alpha_m_atm"), F.col("mh").alias("mg_h_atm"), (F.col("mh") + 0.1).alias("ce_h_atm"))


@query("abundance_trend", f"WITH {STARS} SELECT source_id, alpha_m - coalesce({trend_sql('alpha_m_atm')}, 0) AS alpha_m_atm, mh - coalesce({trend_sql('mg_h_atm')}, 0) AS mg_h_atm, mh + 0.1e0 - coalesce({trend_sql('ce_h_atm')}, 0) AS ce_h_atm FROM stars", r="alpha_m_atm mg_h_atm ce_h_atm")
def _(t):
    return cr.abundance_trend(abundances(t)).drop("teff", "logg")


@query("abundance_trend_summary", f"WITH {STARS} " + " UNION ALL ".join(f"SELECT '{c}' AS element, count(d) AS n_applied, avg(-d) AS mean_shift, sqrt(avg(d*d)) AS rms_shift FROM (SELECT {trend_sql(c)} AS d FROM stars)" for c in ("alpha_m_atm", "mg_h_atm", "ce_h_atm")), r="mean_shift rms_shift")
def _(t):
    return cr.abundance_trend_summary(abundances(t))


@query("derive_ratio", f"WITH {STARS} SELECT source_id, u1 - u2 AS c_n, sqrt(pow(0.1e0*u3, 2) + 0.0004e0) AS e_c_n FROM stars", r="c_n e_c_n")
def _(t):
    df = stars(t).withColumns({"ea": 0.1 * F.col("u3"), "eb": F.lit(0.02)})
    return cr.derive_ratio(df, "u1", "u2", "ea", "eb", "c_n", "e_c_n").select("source_id", "c_n", "e_c_n")


@query("select_by_zone", f"WITH {STARS}, {FUSED} SELECT source_id, av_los, av_los_source FROM fused", r="av_los", i="av_los_source")
def _(t):
    return ex.select_by_zone(av_table(t)).select("source_id", "av_los", "av_los_source")


@query(
    "compose_by_zone",
    f"""WITH {STARS}, {AV_SQL}, c AS (SELECT source_id, CASE WHEN dist_pc < 1250 THEN 0 WHEN dist_pc < 3000 THEN 1 ELSE 2 END AS z, CASE WHEN dist_pc < 1250 THEN av_near WHEN dist_pc < 3000 THEN av_mid ELSE av_far*2.742e0 END AS av FROM av)
SELECT source_id, av, CASE WHEN av IS NULL THEN -1 ELSE z END AS av_source FROM c""",
    r="av", i="av_source",
)
def _(t):
    return ex.compose_by_zone(av_table(t), near="av_near", mid="av_mid", far="av_far", distance="dist_pc").select("source_id", "av", "av_source")


QF = "av_los_source = 3 AS av_is_neighborhood_fallback, coalesce(parallax_over_error < 5, false) AS av_distance_prior_dominated, av_nbhd_std > 0.5e0 AS av_neighbourhood_high_dispersion"


@query("av_quality_flags", f"WITH {STARS}, {FUSED} SELECT source_id, {QF} FROM fused")
def _(t):
    return av_table(t).transform(ex.select_by_zone).transform(ex.av_quality_flags).select("source_id", "av_is_neighborhood_fallback", "av_distance_prior_dominated", "av_neighbourhood_high_dispersion")


DERED = "j_mag - av_los*0.276e0 AS j_mag_dered, k_mag - av_los*0.112e0 AS k_mag_dered, CAST(NULL AS DOUBLE) AS w1_mag_dered"


@query("deredden", f"WITH {STARS}, {FUSED} SELECT source_id, {DERED} FROM fused", r="j_mag_dered k_mag_dered w1_mag_dered")
def _(t):
    return av_table(t).transform(ex.select_by_zone).transform(ex.deredden, "av_los").select("source_id", "j_mag_dered", "k_mag_dered", "w1_mag_dered")


@query("extinction_chain", f"WITH {STARS}, {FUSED} SELECT source_id, av_los, av_los_source, {QF}, {DERED} FROM fused", r="av_los j_mag_dered k_mag_dered w1_mag_dered", i="av_los_source")
def _(t):
    out = av_table(t).transform(ex.correct_extinction)
    return out.select("source_id", "av_los", "av_los_source", "av_is_neighborhood_fallback", "av_distance_prior_dominated", "av_neighbourhood_high_dispersion", "j_mag_dered", "k_mag_dered", "w1_mag_dered")


EMB = "SELECT vec_id, label, i, embedding[i]::DOUBLE AS x, embedding::DOUBLE[] AS e FROM embeddings, range(1, 65) r(i)"


def emb(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def spread(df, col: str, name: str = "v"):
    return df.select("vec_id", F.posexplode(col).alias("pos", name))


@query("deredden_spectrum", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN label = 0 THEN x ELSE x*pow(10e0, 0.4e0*(label/10e0)*(1e0 + (i - 1)/64e0)) END AS v FROM ({EMB})", r="v", i="pos")
def _(t):
    av = F.when(F.col("label") != 0, F.col("label") / 10.0)
    return spread(emb(t).withColumn("f", ex.deredden_spectrum("e", [1.0 + k / 64.0 for k in range(64)], av)), "f")


@query("log_ratio", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND c_acctbal > 0 THEN log10(o_totalprice/c_acctbal) END AS lr FROM orders JOIN customer ON o_custkey = c_custkey", r="lr")
def _(t):
    df = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return df.select("o_orderkey", joins.log_ratio("o_totalprice", "c_acctbal").alias("lr"))


SPH = 'cos(radians("dec"))*cos(radians(ra)) AS ex, cos(radians("dec"))*sin(radians(ra)) AS ey, sin(radians("dec")) AS ez'


@query("sph_to_xyz", f"WITH {STARS} SELECT source_id, dist_pc*ex AS x, dist_pc*ey AS y, dist_pc*ez AS z FROM (SELECT *, {SPH} FROM stars)", r="x y z")
def _(t):
    return stars(t).select("source_id", *[c.alias(n) for n, c in zip("xyz", co.sph_to_xyz("ra", "dec", "dist_pc"))])


def rot(i, x="ex", y="ey", z="ez"):
    m = co.GALACTIC[i]
    return f"({m[0]!r}e0*{x} + {m[1]!r}e0*{y} + {m[2]!r}e0*{z})"


GAL = f"gal AS (SELECT *, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END AS l_deg, degrees(asin(greatest(-1e0, least(gz, 1e0)))) AS b_deg FROM (SELECT *, {rot(0)} AS gx, {rot(1)} AS gy, {rot(2)} AS gz FROM (SELECT *, {SPH} FROM stars)))"


@query("eq_to_gal", f"WITH {STARS}, {GAL} SELECT source_id, l_deg, b_deg FROM gal", r="l_deg b_deg")
def _(t):
    lon, lat = co.eq_to_gal("ra", "dec")
    return stars(t).select("source_id", lon.alias("l_deg"), lat.alias("b_deg"))


UVW = f"""{GAL}, va AS (SELECT *, 4.74047e0*dist_pc/1000*(10e0*(u1 - 0.5e0)) AS va, 4.74047e0*dist_pc/1000*(10e0*(u2 - 0.5e0)) AS vd, 300e0*(u3 - 0.5e0) AS vr FROM gal),
eqv AS (SELECT *, vr*cos(radians("dec"))*cos(radians(ra)) - va*sin(radians(ra)) - vd*sin(radians("dec"))*cos(radians(ra)) AS px, vr*cos(radians("dec"))*sin(radians(ra)) + va*cos(radians(ra)) - vd*sin(radians("dec"))*sin(radians(ra)) AS py, vr*sin(radians("dec")) + vd*cos(radians("dec")) AS pz FROM va),
uvw AS (SELECT *, {rot(0, 'px', 'py', 'pz')} AS "U_kms", {rot(1, 'px', 'py', 'pz')} AS "V_kms", {rot(2, 'px', 'py', 'pz')} AS "W_kms" FROM eqv)"""


def uvw(t):
    s = stars(t).withColumns({"pmra": 10.0 * (F.col("u1") - 0.5), "pmdec": 10.0 * (F.col("u2") - 0.5), "rv": 300.0 * (F.col("u3") - 0.5), "d": F.col("dist_pc") / 1000})
    return s.withColumns(co.eq_to_gal_uvw("ra", "dec", "pmra", "pmdec", "rv", distance_kpc="d"))


@query("eq_to_gal_uvw", f'WITH {STARS}, {UVW} SELECT source_id, l_deg, b_deg, dist_pc/1000 AS d_kpc, "U_kms", "V_kms", "W_kms" FROM uvw', r="l_deg b_deg d_kpc U_kms V_kms W_kms", digits=7)
def _(t):
    return uvw(t).select("source_id", "l_deg", "b_deg", "d_kpc", "U_kms", "V_kms", "W_kms")


CYL = f'{UVW}, cyl AS (SELECT source_id, "U_kms"*cos(6e0*u1) + "V_kms"*sin(6e0*u1) AS "v_R_kms", "V_kms"*cos(6e0*u1) - "U_kms"*sin(6e0*u1) AS v_phi_kms, "W_kms" AS v_z_kms FROM uvw)'


@query("cyl_velocity", f"WITH {STARS}, {CYL} SELECT * FROM cyl", r="v_R_kms v_phi_kms v_z_kms", digits=5)
def _(t):
    df = uvw(t)
    return df.select("source_id", *[c.alias(n) for n, c in co.cyl_velocity("U_kms", "V_kms", "W_kms", 6.0 * F.col("u1")).items()])


@query("toomre", f'WITH {STARS}, {CYL} SELECT source_id, v_phi_kms - 233.1e0 AS along, sqrt("v_R_kms"*"v_R_kms" + v_z_kms*v_z_kms) AS across FROM cyl', r="along across", digits=5)
def _(t):
    df = uvw(t)
    df = df.select("source_id", *[c.alias(n) for n, c in co.cyl_velocity("U_kms", "V_kms", "W_kms", 6.0 * F.col("u1")).items()])
    along, across = co.toomre("v_R_kms", "v_phi_kms", "v_z_kms")
    return df.select("source_id", along.alias("along"), across.alias("across"))


@query("mollweide_coords", f"WITH {STARS} SELECT source_id, -radians(CASE WHEN ra > 180 THEN ra - 360 ELSE ra END) AS lon, radians(\"dec\") AS lat FROM stars", r="lon lat")
def _(t):
    lon, lat = co.mollweide_coords("ra", "dec")
    return stars(t).select("source_id", lon.alias("lon"), lat.alias("lat"))


TILT = math.asin(co.Z0_PC / 1000.0 / co.R0_KPC)


@query(
    "galactocentric_xyz",
    f"""WITH {STARS}, {GAL}, g AS (SELECT source_id, {math.cos(TILT)!r}e0*(dist_pc/1000*gx - 8.21e0) + {math.sin(TILT)!r}e0*dist_pc/1000*gz AS "X", dist_pc/1000*gy AS "Y", {math.cos(TILT)!r}e0*dist_pc/1000*gz - {math.sin(TILT)!r}e0*(dist_pc/1000*gx - 8.21e0) AS "Z" FROM gal)
SELECT *, sqrt("X"*"X" + "Y"*"Y") AS "Rgal" FROM g""",
    r="X Y Z Rgal",
)
def _(t):
    return stars(t).select("source_id", *[c.alias(n) for n, c in co.galactocentric_xyz("ra", "dec", "dist_pc").items()])


@query("normalise_vector", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i = 1 THEN log10(e[1]) ELSE x/e[1] END AS v FROM ({EMB}) WHERE e[1] > 0", r="v", digits=5, i="pos")
def _(t):
    good = emb(t).where(~v.bad_spectrum("e"))
    return spread(good.withColumn("n", v.normalise_vector("e")), "n")


@query(
    "normalise_errors",
    f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i = 1 THEN 0.01e0/(e[1]*ln(10e0)) ELSE sqrt(pow(0.01e0*i/e[1], 2) + pow(x*0.01e0/(e[1]*e[1]), 2)) END AS v FROM ({EMB}) WHERE e[1] > 0.02",
    r="v", digits=4, i="pos",
)
def _(t):
    good = emb(t).where(F.get("e", F.lit(0)) > 0.02).withColumn("s", F.array(*[F.lit(0.01) * (k + 1) for k in range(64)]))
    return spread(good.withColumn("n", v.normalise_errors("e", "s")), "n")


ESTAT = "st AS (SELECT i AS k, avg(embedding[i]::DOUBLE) AS m, stddev_samp(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) r(i) GROUP BY 1)"


def frozen(t):
    from skyledger.sources import lineage as lin

    stats = lin.load_frozen_stats(lin.freeze_stats(t.embeddings, {"emb": "embedding"}), "stats", 64)
    return one_row(stats.select(F.col("bands")["emb"].alias("b")))["b"]


@query("zscore_vector", f"WITH {ESTAT} SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, (x - m)/s AS v FROM ({EMB}) JOIN st ON i = k", r="v", i="pos")
def _(t):
    df = emb(t).withColumn("b", frozen(t))
    return spread(df.withColumn("z", v.zscore_vector("e", F.col("b.mean"), F.col("b.sigma"))), "z")


@query("scale_features", "WITH s AS (SELECT avg(log10(l_extendedprice)) AS m, stddev_pop(log10(l_extendedprice)) AS d, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS dq FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (log10(l_extendedprice) - m)/d AS f_price, (l_quantity - mq)/dq AS f_quantity FROM lineitem, s", r="f_price f_quantity")
def _(t):
    li, x = t.lineitem, F.log10("l_extendedprice")
    s = li.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("d"), F.avg("l_quantity").alias("mq"), F.stddev_pop("l_quantity").alias("dq")).first()
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((x - s.m) / s.d).alias("f_price"), ((F.col("l_quantity") - s.mq) / s.dq).alias("f_quantity"))


@query("unscale_labels", f"WITH {STARS} SELECT source_id, u2*0.5e0 - 1e0 AS first, u1*200e0 + 4800e0 AS second, 0.25e0*u3 AS c00, 100e0*u3 AS c01 FROM stars", r="first second c00 c01")
def _(t):
    df = stars(t).select("source_id", F.array("u1", "u2").alias("z"), F.array("u3", "u3", "u3").alias("c"))
    df = df.withColumns({"y": v.unscale_labels("z", [4800.0, -1.0], [200.0, 0.5], order=[1, 0]), "k": v.unscale_covariance("c", [0.5, 200.0])})
    return df.select("source_id", F.get("y", F.lit(0)).alias("first"), F.get("y", F.lit(1)).alias("second"), F.get("k", F.lit(0)).alias("c00"), F.get("k", F.lit(1)).alias("c01"))


GRID64 = np.geomspace(360.0, 990.0, 64)
SMALL = {"bp": (360.0, 660.0, 510.0, 60.0), "rp": (660.0, 990.0, 825.0, 66.0)}


def basis_sql() -> str:
    """Residual and first coefficients by plain sums with the constant basis."""
    parts = []
    for band, closed in (("bp", False), ("rp", True)):
        inside, w, psi = v.band_basis(GRID64, *SMALL[band], order=6, closed=closed)
        pos = np.flatnonzero(inside) + 1
        rows = ", ".join(f"({int(p)}, {k}, {w[i] * psi[i, k]!r}::DOUBLE, {psi[i, k]!r}::DOUBLE)".replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE") for i, p in enumerate(pos) for k in range(6))
        parts.append(f"SELECT '{band}' AS band, * FROM (VALUES {rows}) v(i, k, wp, p)")
    return "basis AS (" + " UNION ALL ".join(parts) + ")"


@query(
    "project_basis",
    f"""WITH {basis_sql()}, x AS ({EMB}), c AS (SELECT vec_id, band, k, sum(x*wp) AS c FROM x JOIN basis USING (i) GROUP BY 1, 2, 3), h AS (SELECT vec_id, band, i, any_value(x) AS x, sum(c*p) AS fit FROM x JOIN basis USING (i) JOIN c USING (vec_id, band, k) GROUP BY 1, 2, 3)
SELECT h.vec_id, sqrt(avg((x - fit)*(x - fit)) FILTER (band = 'bp')) AS residual_rms_bp, sqrt(avg((x - fit)*(x - fit)) FILTER (band = 'rp')) AS residual_rms_rp, sqrt(avg((x - fit)*(x - fit))) AS residual_rms, (SELECT c FROM c WHERE c.vec_id = h.vec_id AND c.band = 'bp' AND k = 0) AS bp0, (SELECT c FROM c WHERE c.vec_id = h.vec_id AND c.band = 'rp' AND k = 5) AS rp5 FROM h GROUP BY 1""",
    r="residual_rms_bp residual_rms_rp residual_rms bp0 rp5",
)
def _(t):
    out = v.project_basis(t.embeddings.select("vec_id", "embedding"), "embedding", grid=GRID64, bands=SMALL, order=6)
    return out.select("vec_id", "residual_rms_bp", "residual_rms_rp", "residual_rms", F.get("bp_coeffs", F.lit(0)).alias("bp0"), F.get("rp_coeffs", F.lit(5)).alias("rp5"))


@query("assemble_vector", f"WITH {STARS} SELECT source_id, [teff, logg, mh, bp_rp] AS features FROM stars")
def _(t):
    return stars(t).select("source_id", v.assemble_vector(["teff", "logg", "mh", "bp_rp"]).alias("features"))


@query("select_block", "SELECT vec_id, list_transform(embedding[5:12], lambda x: x::DOUBLE) AS block FROM embeddings")
def _(t):
    return emb(t).select("vec_id", v.select_block("e", 4, 8).alias("block"))


@query("ood_status", f"WITH {PREDS} SELECT source_id, CAST(ood_joint_flag AS INTEGER) + CAST(kin_ood_flag AS INTEGER) AS status FROM preds", i="status")
def _(t):
    return preds(t).select("source_id", fl.ood_status("ood_joint_flag", "kin_ood_flag").alias("status"))


@query("coerce_flag", f"WITH {PREDS} SELECT source_id, coalesce(label_extrapolation_flag = 1, false) AS as_int, ood_joint_flag AS as_bool, coalesce(label_extrapolation_flag = 1, false) AS as_float FROM preds")
def _(t):
    p = preds(t).withColumn("f", F.coalesce(F.col("label_extrapolation_flag").cast("double"), F.lit(float("nan"))))
    return p.select("source_id", nulls.coerce_flag(p, "label_extrapolation_flag").alias("as_int"), nulls.coerce_flag(p, "ood_joint_flag").alias("as_bool"), nulls.coerce_flag(p, "f").alias("as_float"))


@query("magnitude_bin", f"WITH {STARS} SELECT source_id, CASE WHEN m IS NULL THEN 'unknown' WHEN m <= 15 THEN 'bright' WHEN m <= 16 THEN 'mid' ELSE 'faint' END AS g_mag_bin FROM (SELECT source_id, CASE WHEN source_id % 10 <> 0 THEN g_mag END AS m FROM stars)")
def _(t):
    df = stars(t).select("source_id", F.when(F.col("source_id") % 10 != 0, F.col("g_mag")).alias("g_mag"))
    return df.transform(fl.magnitude_bin).drop("g_mag")


@query("prior_dominated", f"WITH {TIERED} SELECT source_id, dist_prior_dominated FROM tiered")
def _(t):
    return preds(t).transform(fl.prior_dominated).select("source_id", "dist_prior_dominated")


@query(
    "distance_trust",
    f"""WITH {STARS}, f AS (SELECT source_id, m IS NOT NULL AS dist_has_estimate, coalesce(CASE WHEN m > 0 THEN (m*(1e0 + 0.3e0*u1) - m*0.9e0)/m END > 0.3, true) AS dist_relative_spread_high, coalesce(parallax < 0, false) AS dist_negative_parallax FROM (SELECT *, CASE WHEN source_id % 12 <> 0 THEN dist_pc END AS m FROM stars))
SELECT *, dist_has_estimate AND NOT dist_relative_spread_high AND NOT dist_negative_parallax AS dist_trustworthy FROM f""",
)
def _(t):
    m = F.when(F.col("source_id") % 12 != 0, F.col("dist_pc"))
    df = stars(t).select("source_id", "parallax", m.alias("r_med_photogeo"), (m * 0.9).alias("r_lo_photogeo"), (m * (1.0 + 0.3 * F.col("u1"))).alias("r_hi_photogeo"))
    return df.transform(fl.distance_trust).select("source_id", "dist_has_estimate", "dist_relative_spread_high", "dist_negative_parallax", "dist_trustworthy")


@query("sigma_inflated", f"WITH {PREDS} SELECT source_id, teff_sigma > 150 AS prediction_sigma_inflated__teff, alpha_m_sigma > 0.05e0 AS prediction_sigma_inflated__alpha_m, teff_sigma > 150 OR logg_sigma > 0.3e0 OR mh_sigma > 0.2e0 OR alpha_m_sigma > 0.05e0 OR mg_h_sigma > 0.2e0 AS prediction_sigma_inflated_any FROM preds")
def _(t):
    return preds(t).transform(fl.sigma_inflated).select("source_id", "prediction_sigma_inflated__teff", "prediction_sigma_inflated__alpha_m", "prediction_sigma_inflated_any")


@query("abundance_type", f"WITH {PREDS} SELECT source_id, 'spectrum_dominant' AS xp_abundance_type__teff, 'aux_assisted' AS xp_abundance_type__mg_h FROM preds")
def _(t):
    return preds(t).transform(fl.abundance_type).select("source_id", "xp_abundance_type__teff", "xp_abundance_type__mg_h")


@query("kin_flag_default", f"WITH {STARS} SELECT source_id, false AS kin_ood_flag FROM stars")
def _(t):
    return stars(t).select("source_id").transform(fl.kin_flag_default)


@query("element_tier", f"WITH {TIERED} SELECT source_id, t_teff AS release_tier__teff, t_mg_h AS release_tier__mg_h, t_other AS release_tier__logg FROM tiered", i="release_tier__teff release_tier__mg_h release_tier__logg")
def _(t):
    return preds(t).transform(fl.element_tier, FIVE).select("source_id", "release_tier__teff", "release_tier__mg_h", "release_tier__logg")


@query("release_tier", f"WITH {TIERED} SELECT source_id, release_tier FROM rel", i="release_tier")
def _(t):
    return released(t).select("source_id", "release_tier")


KNN = "k AS (SELECT source_id AS kid, CASE WHEN source_id % 4 <> 0 THEN teff_truth + 10 END AS med, 50e0 + 20e0*u3 AS iqr FROM preds WHERE source_id % 3 <> 0)"
HYB = f"""{PREDS}, {KNN}, hy AS (SELECT source_id, CASE WHEN u THEN med ELSE teff_pred END AS teff_hybrid_pred, CASE WHEN u THEN iqr/1.349e0 ELSE teff_sigma END AS teff_hybrid_sigma, CASE WHEN u THEN 'knn' WHEN infl THEN 'regressor_caveat' ELSE 'regressor' END AS teff_hybrid_source, CASE WHEN infl THEN 2 ELSE 1 END AS teff_hybrid_tier
FROM (SELECT *, teff_sigma > 150 AS infl, teff_sigma > 150 AND med IS NOT NULL AND iqr IS NOT NULL AS u FROM preds LEFT JOIN k ON source_id = kid))"""


def knn_table(t):
    return preds(t).where("source_id % 3 <> 0").select("source_id", F.when(F.col("source_id") % 4 != 0, F.col("teff_truth") + 10).alias("knn_teff_med"), (50.0 + 20.0 * F.col("u3")).alias("knn_teff_iqr"))


@query("hybrid_compose", f"WITH {HYB} SELECT * FROM hy", r="teff_hybrid_pred teff_hybrid_sigma", i="teff_hybrid_tier")
def _(t):
    df = preds(t).join(knn_table(t), "source_id", "left")
    return fl.hybrid_compose(df, ("teff",)).select("source_id", "teff_hybrid_pred", "teff_hybrid_sigma", "teff_hybrid_source", "teff_hybrid_tier")


@query("attach_hybrid", f"WITH {HYB} SELECT 'teff' AS element, teff_hybrid_source AS source, teff_hybrid_tier AS tier, count(*) AS n FROM hy GROUP BY 2, 3", i="tier")
def _(t):
    from skyledger.plans.release import attach_hybrid, hybrid_source_counts

    return hybrid_source_counts(attach_hybrid(preds(t), knn_table(t), "source_id", ["teff"]), ["teff"])


@query(
    "compound_selection",
    f"WITH {STARS}, {RETENTION}, {BACKOFF} SELECT s.source_id, CASE WHEN s.parallax IS NOT NULL AND s.bp_rp IS NOT NULL THEN greatest(0.0001e0, least(1e0, selection_prob*p_ir)) ELSE 0e0 END AS p_compound FROM scored s JOIN retention r ON s.i_b = r.i_b AND s.i_g = r.i_g",
    r="p_compound",
)
def _(t):
    grid = completeness(t)
    s = stars(t).select("source_id", "dec", "g_mag", "teff", "logg", "parallax", "bp_rp")
    s = joins.grid_lookup(s, retention(t), axes(), "selection_prob", "p_ye")
    s = joins.grid_lookup_backoff(s, grid.where("level = 'fine'"), grid.where("level = 'coarse'"), axes(), extra_axes(), "p_complete", "p_ir")
    return s.select("source_id", joins.compound_selection(F.col("p_ye"), F.col("p_ir"), F.col("parallax").isNotNull(), F.col("bp_rp").isNotNull()).alias("p_compound"))


@query("selection_passthrough", f"WITH {STARS} SELECT source_id, u3 AS selection_prob FROM stars", r="selection_prob")
def _(t):
    df = stars(t).select("source_id", F.col("u3").alias("selection_prob"))
    return joins.selection_or_score(df, "selection_prob", lambda d: joins.grid_lookup(d, retention(t), axes(), "selection_prob", "selection_prob"))


@query("fill_fallback", f"WITH {STARS} SELECT CAST(count(*) FILTER (parallax IS NULL AND bp_rp IS NOT NULL) AS BIGINT) AS n_filled, count(coalesce(parallax, bp_rp)) AS n_finite, avg(coalesce(parallax, bp_rp)) AS mean FROM stars", r="mean")
def _(t):
    out = joins.fill_fallback(stars(t), "parallax", "bp_rp")
    return out.agg(F.count_if("filled").alias("n_filled"), F.count("parallax").alias("n_finite"), F.avg("parallax").alias("mean"))


@query("teff_label", f"WITH {STARS} SELECT source_id, {TEFF_LABEL_SQL.format(missing='no_teff')} AS label FROM stars")
def _(t):
    return stars(t).select("source_id", labelled("teff", TEFF_EDGES, TEFF_LABELS, "no_teff").alias("label"))


@query("ensure_flags", "SELECT o_orderkey, CAST(NULL AS BOOLEAN) AS ood_joint_flag, CAST(NULL AS BOOLEAN) AS label_extrapolation_flag FROM orders")
def _(t):
    return nulls.ensure_flags(t.orders.select("o_orderkey"), ["ood_joint_flag", "label_extrapolation_flag"])


@query("whitened_residual", f"WITH {STARS}, r AS (SELECT source_id, 0.1e0 + 0.1e0*u3 AS a, 0.04e0 AS b, 0.05e0 + 0.1e0*u2 AS c, 0.3e0*(u1 - 0.5e0) AS d0, 0.2e0*(u2 - 0.5e0) AS d1 FROM stars) SELECT source_id, d0/a AS z0, (d1 - b*(d0/a))/c AS z1, pow(d0/a, 2) + pow((d1 - b*(d0/a))/c, 2) AS m2 FROM r", r="z0 z1 m2")
def _(t):
    s = stars(t).select("source_id", F.array(F.lit(0.0), F.lit(0.0)).alias("mu"), F.array(0.3 * (F.col("u1") - 0.5), 0.2 * (F.col("u2") - 0.5)).alias("y"), F.array(0.1 + 0.1 * F.col("u3"), F.lit(0.04), 0.05 + 0.1 * F.col("u2")).alias("chol"))
    s = s.withColumn("z", en.whitened_residual("mu", "chol", "y", 2))
    return s.select("source_id", F.get("z", F.lit(0)).alias("z0"), F.get("z", F.lit(1)).alias("z1"), en.squared_length(F.col("z")).alias("m2"))


MEANS = [[0.25, 0.0], [-0.5, 0.2], [-1.25, 0.2]]
COV = [[0.09, 0.0], [0.0, 0.01]]


@query("gmm_assign", f"WITH {STARS}, d AS (SELECT source_id, " + ", ".join(f"pow(mh - ({m[0]}e0), 2)/0.09e0 + pow(alpha_m - {m[1]}e0, 2)/0.01e0 AS d{k}" for k, m in enumerate(MEANS)) + " FROM stars) SELECT source_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS component FROM d", i="component")
def _(t):
    from skyledger.operators.mixtures import gmm_assign

    return stars(t).select("source_id", gmm_assign(["mh", "alpha_m"], MEANS, [np.array(COV)] * 3).alias("component"))


@query("feature_noise_sigma", f"WITH {STARS} SELECT source_id, sqrt(0.01e0 + pow(2e0*0.1e0*u1, 2) + pow(-0.5e0*0.3e0*u2, 2)) AS sigma FROM stars", r="sigma")
def _(t):
    return stars(t).select("source_id", en.feature_noise_sigma(F.lit(0.1), [2.0, -0.5], [0.1 * F.col("u1"), 0.3 * F.col("u2")]).alias("sigma"))
