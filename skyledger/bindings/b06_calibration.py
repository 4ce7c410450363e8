"""Calibration, validation, ensembles, envelopes and information measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings.b02_filters import FIVE
from skyledger.bindings.b04_sampling import edges_sql, qbin_sql
from skyledger.bindings.b05_stats import bin_sql
from skyledger.bindings.registry import query
from skyledger.bindings.views import PREDS, STARS, preds, replica_uniform_sql, stars
from skyledger.functions.binning import bin_index
from skyledger.operators import calibration as cal, ensembles as en, information as info, outliers as od, residuals as rs, sampling as sm, validation as va
from skyledger.operators.ranking import exact_quantiles, one_row
from skyledger.sources import lineage as lin

THREE = ("teff", "logg", "mh")
# standardised residuals per label in long form, cells from a fixed grid of truth
CELL_T, CELL_L = [3300.0, 4050.0, 4800.0, 5550.0, 6300.1], [0.0, 1.15, 2.3, 3.45, 4.61]
ZLONG = f"""{PREDS}, cells AS (SELECT *, ({bin_sql('teff_truth', CELL_T)})*4 + ({bin_sql('logg_truth', CELL_L)}) AS cell FROM preds),
zl AS ({' UNION ALL '.join(f"SELECT source_id, cell, '{e}' AS label, ({e}_truth - {e}_pred)/{e}_sigma AS z FROM cells" for e in THREE)})"""


def celled(t):
    return preds(t).withColumn("cell", bin_index("teff_truth", CELL_T) * 4 + bin_index("logg_truth", CELL_L))


def zlong(t):
    rows = [F.struct(F.lit(e).alias("label"), ((F.col(f"{e}_truth") - F.col(f"{e}_pred")) / F.col(f"{e}_sigma")).alias("z")) for e in THREE]
    return celled(t).select("source_id", "cell", F.explode(F.array(*rows)).alias("s")).select("source_id", "cell", "s.*")


MAHAL = f"{ZLONG}, mh AS (SELECT source_id, cell, sum(z*z) AS m2 FROM zl GROUP BY 1, 2 HAVING count(z) = 3)"


def mahal(t):
    z = [(F.col(f"{e}_truth") - F.col(f"{e}_pred")) / F.col(f"{e}_sigma") for e in THREE]
    return celled(t).select("source_id", "cell", (z[0] * z[0] + z[1] * z[1] + z[2] * z[2]).alias("m2")).where("m2 is not null")


@query("temperature_per_cell", f"WITH {MAHAL} SELECT cell, count(*) AS n, sqrt(avg(m2)/3) AS temperature FROM mh GROUP BY 1", r="temperature", i="cell")
def _(t):
    return cal.temperature_per_cell(mahal(t), "cell", "m2", 3)


SHRUNK = f"""{ZLONG}, g AS (SELECT label, sqrt(var_pop(z)) AS global_alpha FROM zl GROUP BY 1), p AS (SELECT cell, label, count(*) AS n, var_pop(z) AS v FROM zl GROUP BY 1, 2),
scales AS (SELECT cell, p.label, n, global_alpha, greatest(n/(n + 50e0)*sqrt(v) + (1e0 - n/(n + 50e0))*global_alpha, 1e-4) AS alpha FROM p JOIN g ON p.label = g.label)"""


@query("shrunken_scale", f"WITH {SHRUNK} SELECT * FROM scales", r="global_alpha alpha", i="cell")
def _(t):
    return cal.shrunken_scale(zlong(t), "cell", "label", "z")


@query("apply_scale", f"WITH {MAHAL}, tc AS (SELECT cell, sqrt(avg(m2)/3) AS t FROM mh GROUP BY 1) SELECT source_id, teff_sigma*t AS teff_scaled, logg_sigma*t AS logg_scaled FROM cells JOIN tc USING (cell)", r="teff_scaled logg_scaled")
def _(t):
    scales = cal.temperature_per_cell(mahal(t), "cell", "m2", 3)
    df = celled(t).select("source_id", "cell", F.array("teff_sigma", "logg_sigma").alias("sig"))
    out = cal.apply_scale(df, scales, ["cell"], "temperature", "sig")
    return out.select("source_id", F.get("sig", F.lit(0)).alias("teff_scaled"), F.get("sig", F.lit(1)).alias("logg_scaled"))


@query("fit_calibration", f"WITH {MAHAL}, tc AS (SELECT cell, count(*) AS n, sqrt(avg(m2)/3) AS temperature FROM mh GROUP BY 1), r AS (SELECT sqrt(m2) AS s, row_number() OVER (ORDER BY sqrt(m2)) AS k, count(*) OVER () AS n FROM mh) SELECT cell, tc.n, temperature, (SELECT s FROM r WHERE k = least(n, CAST(ceil((n + 1)*0.95e0) AS BIGINT))) AS radius FROM tc", r="temperature radius", i="cell")
def _(t):
    m = mahal(t)
    radius = cal.conformal_radius(m.withColumn("s", cal.conformal_scores("m2")), [], "s", 0.95)
    return cal.temperature_per_cell(m, "cell", "m2", 3).withColumn("radius", one_row(radius)["radius"])


@query(
    "isotonic_pit",
    f"WITH {ZLONG}, r AS (SELECT label, z, count(*) AS k FROM zl WHERE z IS NOT NULL GROUP BY 1, 2) SELECT label, z, (2*sum(k) OVER (PARTITION BY label ORDER BY z) - k)/(2e0*sum(k) OVER (PARTITION BY label)) AS y FROM r",
    r="z y", digits=9,
)
def _(t):
    return cal.isotonic_pit(zlong(t), "label", "z").select("label", "z", "y")


def zcov(c: str, name: str) -> str:
    return ", ".join(f"avg(CAST(abs({c}) <= {rs.two_sided_z(lv)!r}e0 AS INTEGER)) AS {name}_{round(lv * 100)}" for lv in rs.LEVELS)


@query("coverage_levels", f"WITH {ZLONG} SELECT label, {zcov('z', 'cov')} FROM zl WHERE z IS NOT NULL GROUP BY 1", r="cov_68 cov_95 cov_99")
def _(t):
    return cal.coverage_levels(zlong(t).where("z is not null"), "label", "z", rs.LEVELS)


@query("coverage_levels_joint", f"WITH {MAHAL} SELECT " + ", ".join(f"avg(CAST(m2 <= {rs.chi2_quantile(lv, 3)!r}e0 AS INTEGER)) AS joint_{round(lv * 100)}" for lv in rs.LEVELS) + " FROM mh", r="joint_68 joint_95 joint_99")
def _(t):
    return cal.joint_coverage(mahal(t), "m2", 3, rs.LEVELS)


@query("conformal_scores", f"WITH {MAHAL} SELECT source_id, sqrt(m2) AS score FROM mh", r="score")
def _(t):
    return mahal(t).select("source_id", cal.conformal_scores("m2").alias("score"))


@query("conformal_radius", f"WITH {MAHAL}, r AS (SELECT cell, sqrt(m2) AS s, row_number() OVER (PARTITION BY cell ORDER BY m2) AS k, count(*) OVER (PARTITION BY cell) AS n FROM mh) SELECT cell, any_value(n) AS n, max(s) AS radius FROM r WHERE k = least(n, CAST(ceil((n + 1)*0.9e0) AS BIGINT)) GROUP BY 1", r="radius", i="cell")
def _(t):
    return cal.conformal_radius(mahal(t).withColumn("s", cal.conformal_scores("m2")), ["cell"], "s", 0.9)


@query(
    "variance_decomposition",
    f"""WITH {ZLONG}, p AS (SELECT label, cell, count(z) AS n, avg(z) AS m, var_pop(z) AS v FROM zl WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(z) >= 8), mm AS (SELECT label, sum(n*m)/sum(n) AS mm FROM p GROUP BY 1), tot AS (SELECT label, var_pop(z) AS total_var FROM zl GROUP BY 1)
SELECT p.label, any_value(total_var) AS total_var, sum(n*v)/sum(n) AS within_cell_var, sum(n*(m - mm)*(m - mm))/sum(n) AS between_cell_var FROM p JOIN mm ON p.label = mm.label JOIN tot ON p.label = tot.label GROUP BY 1""",
    r="total_var within_cell_var between_cell_var",
)
def _(t):
    return cal.variance_decomposition(zlong(t), "cell", "label", "z")


@query("reliability_per_cell", f"WITH {ZLONG}, p AS (SELECT cell, label, count(*) AS n, CASE WHEN count(z) > 8 THEN abs(var_pop(z) - 1) END AS e FROM zl GROUP BY 1, 2) SELECT cell, max(n) AS n, avg(e) AS reliability_error FROM p GROUP BY 1", r="reliability_error", i="cell")
def _(t):
    return cal.reliability_per_cell(zlong(t), "cell", "label", "z")


@query(
    "adjacent_smoothness",
    f"""WITH {SHRUNK}, s AS (SELECT *, cell//4 AS i, cell%4 AS j FROM scales), pr AS (SELECT exp(abs(ln(a.alpha/b.alpha))) AS r FROM s a JOIN s b ON a.label = b.label AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)))
SELECT count(*) AS n_pairs, max(r) AS max_ratio, median(r) AS median_ratio, quantile_cont(r, 0.9) AS p90_ratio FROM pr""",
    r="max_ratio median_ratio p90_ratio",
)
def _(t):
    scales = cal.shrunken_scale(zlong(t), "cell", "label", "z")
    return cal.adjacent_smoothness(scales, "cell", "label", "alpha", [4, 4])


@query(
    "halt_cell_report",
    f"""WITH {ZLONG}, w AS (SELECT cell, (teff_truth - teff_pred)/teff_sigma AS zt, abs("dec") AS ab, CAST(ood_joint_flag AS INTEGER) AS o FROM cells)
SELECT cell, count(*) AS n, cell//4 IN (0, 3) OR cell%4 IN (0, 3) AS is_edge, var_pop(zt) AS var_zt, avg(zt) AS mean_zt, avg(o) AS frac_ood, median(ab) AS ab_median FROM w GROUP BY 1""",
    r="var_zt mean_zt frac_ood ab_median", i="cell",
)
def _(t):
    df = celled(t).withColumns({"zt": (F.col("teff_truth") - F.col("teff_pred")) / F.col("teff_sigma"), "ab": F.abs("dec")})
    return cal.halt_cell_report(df, "cell", [4, 4], ["zt"], ["ab"], {"frac_ood": F.col("ood_joint_flag")})


@query(
    "bias_cell_location",
    f"""WITH {ZLONG}, c AS (SELECT DISTINCT cell*4 + 1 AS code FROM cells), x AS (SELECT code, ([3900e0, 4200e0, 4800e0, 5400e0])[1 + code//16] AS teff_centre FROM c)
SELECT code, ([3862.5e0, 4425e0, 5175e0, 5737.5e0])[1 + code//16] AS teff_centre, ([0.8625e0, 1.725e0, 2.875e0, 3.7375e0])[1 + (code//4)%4] AS logg_centre, -0.85e0 AS mh_centre,
concat_ws(',', CASE WHEN code//16 = 0 THEN 'teff_cool' END, CASE WHEN (code//4)%4 = 3 THEN 'logg_subgiant' END, CASE WHEN (code//4)%4 = 0 THEN 'logg_tipgiant' END) AS flags FROM x""",
    r="teff_centre logg_centre mh_centre", i="code",
)
def _(t):
    cells = celled(t).select((F.col("cell") * 4 + 1).alias("code")).distinct()
    return cal.bias_cell_location(cells, "code", [4, 4, 4], [[4050.0, 4800.0, 5550.0], [1.15, 2.3, 3.45], [-1.2, -0.5, 0.2]])


# ensembles: three members per star
MEMBERS = f"""{STARS}, mem AS (SELECT source_id, CAST(m AS INTEGER) AS member, [logg + 0.05e0*m*u2, mh - 0.03e0*m*u1] AS mu, [0.1e0 + 0.1e0*u3, 0.02e0*m, 0.05e0 + 0.1e0*u2] AS chol, [0.1e0 + 0.1e0*u3, 0.08e0 + 0.02e0*m] AS sig FROM stars, range(3) r(m))"""


def members(t):
    m, u1, u2, u3 = F.col("member"), F.col("u1"), F.col("u2"), F.col("u3")
    s = stars(t).select("source_id", "logg", "mh", "u1", "u2", "u3", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("member"))
    return s.select(
        "source_id", "member", F.array(F.col("logg") + 0.05 * m * u2, F.col("mh") - 0.03 * m * u1).alias("mu"),
        F.array(0.1 + 0.1 * u3, 0.02 * m, 0.05 + 0.1 * u2).alias("chol"), F.array(0.1 + 0.1 * u3, 0.08 + 0.02 * m).alias("sig"),
    )


AGG = f"""{MEMBERS}, ag AS (SELECT source_id, count(*) AS n_members, avg(mu[1]) AS m0, avg(mu[2]) AS m1, avg(chol[1]*chol[1]) AS a00, avg(chol[1]*chol[2]) AS a01, avg(chol[2]*chol[2] + chol[3]*chol[3]) AS a11,
covar_pop(mu[1], mu[1]) AS e00, covar_pop(mu[1], mu[2]) AS e01, covar_pop(mu[2], mu[2]) AS e11 FROM mem GROUP BY 1)"""


@query("ensemble_aggregate", f"WITH {AGG} SELECT source_id, n_members, m0, a01, e11, sqrt(a00 + e00) AS s0, sqrt(a11 + e11) AS s1 FROM ag", r="m0 a01 e11 s0 s1")
def _(t):
    a = en.ensemble_aggregate(members(t), "source_id", "mu", "chol", 2)
    g = F.get
    return a.select("source_id", "n_members", g("mu", F.lit(0)).alias("m0"), g("aleatoric", F.lit(1)).alias("a01"), g("epistemic", F.lit(2)).alias("e11"), g("sigma", F.lit(0)).alias("s0"), g("sigma", F.lit(1)).alias("s1"))


@query("moment_match", f"WITH {AGG} SELECT source_id, m0, m1, a00 + e00 AS c00, a01 + e01 AS c01, a11 + e11 AS c11 FROM ag", r="m0 m1 c00 c01 c11")
def _(t):
    a = en.moment_match(members(t), "source_id", "mu", "chol", 2)
    return a.select("source_id", *[F.get("mu", F.lit(i)).alias(f"m{i}") for i in (0, 1)], *[F.get("cov", F.lit(i)).alias(n) for i, n in enumerate(("c00", "c01", "c11"))])


@query(
    "disagreement_ratio",
    f"""WITH {MEMBERS}, v AS (SELECT source_id, var_pop(mu[1]) AS e0, var_pop(mu[2]) AS e1, avg(sig[1]*sig[1]) AS a0, avg(sig[2]*sig[2]) AS a1 FROM mem GROUP BY 1), d AS (SELECT source_id, (sqrt(e0/greatest(e0 + a0, 1e-12)) + sqrt(e1/greatest(e1 + a1, 1e-12)))/2 AS disagreement FROM v)
SELECT *, disagreement > 0.3 AS ood_disagreement_flag FROM d""",
    r="disagreement",
)
def _(t):
    return en.disagreement_ratio(members(t), "source_id", "mu", "sig", 2, 0.3)


MCORR = f"{MEMBERS}, w AS (SELECT source_id, " + ", ".join(f"max(CASE WHEN source_id % 6 <> member THEN mu[{i + 1}] END) FILTER (member = {m}) AS v{i}{m}" for i in (0, 1) for m in range(3)) + " FROM mem GROUP BY 1), mc AS (" + " UNION ALL ".join(f"SELECT 'v{i}' AS element, {a} AS member_a, {b} AS member_b, corr(v{i}{a}, v{i}{b}) AS pearson FROM w WHERE v{i}0 IS NOT NULL AND v{i}1 IS NOT NULL AND v{i}2 IS NOT NULL" for i in (0, 1) for a, b in ((0, 1), (0, 2), (1, 2))) + ")"


def member_corr(t):
    m = members(t)
    vals = m.select("source_id", "member", *[F.when(F.col("source_id") % 6 != F.col("member"), F.get("mu", F.lit(i))).alias(f"v{i}") for i in (0, 1)])
    return en.member_correlation(vals, "source_id", "member", ["v0", "v1"], [0, 1, 2])


@query("member_correlation", f"WITH {MCORR} SELECT * FROM mc", r="pearson", digits=8, i="member_a member_b")
def _(t):
    return member_corr(t)


@query("diversity_report", f"WITH {MCORR}, d AS (SELECT element, median(pearson) AS rho_median FROM mc GROUP BY 1) SELECT element, rho_median, rho_median > 0.95 AS fails, CASE WHEN rho_median > 0.95 THEN sqrt(1e0 + rho_median) ELSE 1e0 END AS inflation FROM d", r="rho_median inflation", digits=8)
def _(t):
    return en.diversity_report(member_corr(t))


@query("inflate_sigma", f"WITH {PREDS} SELECT source_id, teff_sigma*1.4e0 AS inflated FROM preds", r="inflated")
def _(t):
    return en.inflate_sigma(preds(t), "teff_sigma", 1.4, "inflated").select("source_id", "inflated")


# two-dimensional envelope with the inverse written out
def envelope_sql(a: str, b: str, table: str, ridge: str, p: float, where: str = "true") -> str:
    return f"""mom AS (SELECT avg({a}) AS ma, avg({b}) AS mb, covar_samp({a}, {a}) + {ridge} AS saa, covar_samp({a}, {b}) AS sab, covar_samp({b}, {b}) + {ridge} AS sbb, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {where}),
sc AS (SELECT t.*, sqrt(({a}-ma)*({a}-ma)*sbb/det - 2*({a}-ma)*({b}-mb)*sab/det + ({b}-mb)*({b}-mb)*saa/det) AS d, {where} AS fit FROM {table} t, (SELECT *, saa*sbb - sab*sab AS det FROM mom)),
lim AS (SELECT quantile_cont(d, {p}) AS threshold FROM sc WHERE fit)"""


ENV = envelope_sql("teff", "parallax", "stars", "1e-6", 0.99)


@query("fit_mahalanobis", f"WITH {STARS}, {ENV} SELECT n AS n_training, ma AS mean_teff, mb AS mean_parallax, threshold FROM mom, lim", r="mean_teff mean_parallax threshold", digits=5)
def _(t):
    e = od.fit_mahalanobis(stars(t), ["teff", "parallax"])
    one = stars(t).where("teff is not null and parallax is not null").agg(F.count(F.lit(1)).alias("n_training"))
    return one.select("n_training", F.lit(float(e.mean[0])).alias("mean_teff"), F.lit(float(e.mean[1])).alias("mean_parallax"), F.lit(e.threshold).alias("threshold"))


@query("mahalanobis_score", f"WITH {STARS}, {ENV} SELECT source_id, d AS score FROM sc", r="score", digits=5)
def _(t):
    s = stars(t)
    return od.score_mahalanobis(s, od.fit_mahalanobis(s, ["teff", "parallax"]), "score").select("source_id", "score")


@query("mahalanobis_flag", f"WITH {STARS}, {ENV} SELECT source_id, coalesce(d > threshold, true) AS flag FROM sc, lim")
def _(t):
    s = stars(t)
    e = od.fit_mahalanobis(s, ["teff", "parallax"])
    return od.score_mahalanobis(s, e, "d").select("source_id", od.mahalanobis_flag("d", e).alias("flag"))


ENV2 = envelope_sql("logg", "mh", "stars", "1e-4", 0.99).replace("mom", "mom2").replace("sc AS", "sc2 AS").replace("FROM sc ", "FROM sc2 ").replace("lim AS", "lim2 AS")


@query("fit_dual", f"WITH {STARS}, {ENV}, {ENV2} SELECT count(*) FILTER (coalesce(sc.d > lim.threshold, true)) AS n_first, count(*) FILTER (coalesce(sc2.d > lim2.threshold, true)) AS n_second, any_value(lim.threshold) AS t_first, any_value(lim2.threshold) AS t_second FROM sc JOIN sc2 ON sc.source_id = sc2.source_id, lim, lim2", r="t_first t_second", digits=5)
def _(t):
    s = stars(t)
    a, b = od.fit_dual(s, ["teff", "parallax"], ["logg", "mh"])
    out = od.score_mahalanobis(od.score_mahalanobis(s, a, "d1"), b, "d2")
    return out.agg(F.count_if(od.mahalanobis_flag("d1", a)).alias("n_first"), F.count_if(od.mahalanobis_flag("d2", b)).alias("n_second"), F.lit(a.threshold).alias("t_first"), F.lit(b.threshold).alias("t_second"))


LENV = envelope_sql("logg_truth", "mh_truth", "preds", "1e-6", 0.99)


@query("fit_label_envelope", f"WITH {PREDS}, {LENV} SELECT count(*) AS n, count(*) FILTER (coalesce(d > threshold, true)) AS n_outside, any_value(threshold) AS threshold FROM sc, lim", r="threshold", digits=5)
def _(t):
    p = preds(t)
    e = od.fit_label_envelope(p, ["logg_truth", "mh_truth"])
    return od.score_mahalanobis(p, e, "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(od.mahalanobis_flag("d", e)).alias("n_outside"), F.lit(e.threshold).alias("threshold"))


# the inverse by elimination on [covariance + ridge | 1], which needs no pivots
XP_SQL = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1)),
cov AS (SELECT list(c ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS c FROM (SELECT i, j, covar_samp(x[i], x[j]) + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS c FROM e, range(1, 65) r(i), range(1, 65) s(j) GROUP BY 1, 2) GROUP BY 1)),
g(k, m) AS (SELECT 1, [list_concat(m[i], [CASE WHEN i = j THEN 1e0 ELSE 0e0 END FOR j IN range(1, 65)]) FOR i IN range(1, 65)] FROM cov UNION ALL
SELECT k + 1, [CASE WHEN i = k THEN [v/m[k][k] FOR v IN m[k]] ELSE [m[i][j] - m[i][k]/m[k][k]*m[k][j] FOR j IN range(1, 129)] END FOR i IN range(1, 65)] FROM g WHERE k <= 64),
inv AS (SELECT [p[65:128] FOR p IN m] AS p FROM g WHERE k = 65),
d AS (SELECT vec_id, sqrt(list_sum([z[i]*list_dot_product(p[i], z) FOR i IN range(1, 65)])) AS score FROM (SELECT vec_id, [x[i] - mu[i] FOR i IN range(1, 65)] AS z FROM e, mu), inv)
SELECT vec_id, score, score > (SELECT quantile_cont(score, 0.99) FROM d) AS flag FROM d"""


@query("fit_xp_envelope", XP_SQL, r="score", digits=5)
def _(t):
    e = od.fit_vector_envelope(t.embeddings, "embedding")
    out = od.score_vector_envelope(t.embeddings.select("vec_id", "embedding"), e, "d")
    return out.select("vec_id", F.col("d").alias("score"), od.mahalanobis_flag("d", e).alias("flag"))


VEL = f"{STARS}, vel AS (SELECT source_id, 100e0*(u1 - 0.5e0) AS v_r, 120e0 + 160e0*u2 AS v_t, 260e0*(u3 - 0.5e0) AS v_z FROM stars)"
INV3 = """m AS (SELECT count(*) AS n, avg(v_r) AS mr, avg(v_t) AS mt, avg(v_z) AS mz, covar_samp(v_r, v_r) + 1 AS a, covar_samp(v_r, v_t) AS b, covar_samp(v_r, v_z) AS c, covar_samp(v_t, v_t) + 1 AS e, covar_samp(v_t, v_z) AS f, covar_samp(v_z, v_z) + 1 AS i FROM vel WHERE abs(v_z) < 80 AND v_t > 100),
dt AS (SELECT *, a*(e*i - f*f) - b*(b*i - f*c) + c*(b*f - e*c) AS det FROM m),
ks AS (SELECT source_id, v_t, v_z, sqrt(((e*i - f*f)*x*x + (a*i - c*c)*y*y + (a*e - b*b)*z*z + 2*((c*f - b*i)*x*y + (b*f - c*e)*x*z + (b*c - a*f)*y*z))/det) AS score FROM (SELECT *, v_r - mr AS x, v_t - mt AS y, v_z - mz AS z FROM vel, dt)),
kl AS (SELECT quantile_cont(score, 0.99) AS threshold FROM ks WHERE abs(v_z) < 80 AND v_t > 100)"""


def velocities(t):
    return stars(t).select("source_id", (100.0 * (F.col("u1") - 0.5)).alias("v_r"), (120.0 + 160.0 * F.col("u2")).alias("v_t"), (260.0 * (F.col("u3") - 0.5)).alias("v_z"))


@query("fit_kinematic", f"WITH {VEL}, {INV3} SELECT n AS n_training, threshold FROM m, kl", r="threshold", digits=5)
def _(t):
    v = velocities(t)
    e = od.fit_kinematic(v, "v_r", "v_t", "v_z")
    return v.where("abs(v_z) < 80 and v_t > 100").agg(F.count(F.lit(1)).alias("n_training"), F.lit(e.threshold).alias("threshold"))


@query("kinematic_score", f"WITH {VEL}, {INV3} SELECT source_id, score, coalesce(score > threshold, true) AS kin_ood_flag FROM ks, kl", r="score", digits=5)
def _(t):
    v = velocities(t)
    e = od.fit_kinematic(v, "v_r", "v_t", "v_z")
    return od.score_mahalanobis(v, e, "score").select("source_id", "score", od.mahalanobis_flag("score", e).alias("kin_ood_flag"))


@query("fit_label_scaler", f"WITH {STARS} " + " UNION ALL ".join(f"SELECT '{c}' AS label, avg({c}) AS mean, greatest(stddev_pop({c}), 1e-8) AS scale FROM stars" for c in ("teff", "logg", "mh")), r="mean scale")
def _(t):
    cols = ("teff", "logg", "mh")
    row = stars(t).agg(F.array(*[F.struct(F.lit(c).alias("label"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias("scale")) for c in cols]).alias("s"))
    return row.select(F.explode("s").alias("s")).select("s.*")


@query(
    "fit_feature_scaler",
    f"""WITH x AS (SELECT log10(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0), q AS (SELECT quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM x) SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS scale FROM x, q WHERE v BETWEEN lo AND hi""",
    r="mean scale",
)
def _(t):
    x = t.lineitem.where("l_extendedprice > 0").select(F.log10("l_extendedprice").alias("v"))
    q = exact_quantiles(x, [], "v", {"lo": 0.001, "hi": 0.999}).first()
    return x.where(F.col("v").between(q["lo"], q["hi"])).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))


@query("zscore_fit_apply", "SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ())/stddev_pop(o_totalprice) OVER () AS z FROM orders", r="z")
def _(t):
    stats = one_row(t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")))
    return t.orders.select("o_orderkey", ((F.col("o_totalprice") - stats["m"]) / stats["s"]).alias("z"))


@query("drift_check", "WITH d AS (SELECT abs(avg(log10(greatest(o_totalprice, 1e-30))) - 5.3e0) AS o_totalprice_drift, stddev_samp(log10(greatest(o_totalprice, 1e-30)))/0.35e0 AS o_totalprice_ratio FROM orders) SELECT *, o_totalprice_drift <= 0.05 AND o_totalprice_ratio BETWEEN 0.9 AND 1.1 AS ok FROM d", r="o_totalprice_drift o_totalprice_ratio")
def _(t):
    return lin.drift_check(t.orders, {"o_totalprice": (5.3, 0.35)})


# gate configurations
CONFIGS = [
    va.GateConfig("production", ("ood_joint_flag",), ("label_extrapolation_flag",), {"teff": 150.0, "alpha_m": 0.05}, use_kin_ood=True),
    va.GateConfig("no_ood", (), ("label_extrapolation_flag",), {"teff": 150.0, "alpha_m": 0.05}),
    va.GateConfig("tight_sigma", ("ood_joint_flag",), (), {"teff": 90.0, "alpha_m": 0.03}),
]


def tier_sql(c: va.GateConfig, e: str) -> str:
    out = " OR ".join([f"{e}_pred IS NULL", *c.ood_flags])
    cav = [f"{e}_sigma > {c.sigma_limits[e]}e0"] + (["coalesce(label_extrapolation_flag, 0) = 1"] if c.caveat_flags else []) + (["kin_ood_flag"] if c.use_kin_ood and e == "alpha_m" else [])
    return f"SELECT source_id, '{c.name}' AS config, '{e}' AS element, CASE WHEN {out} THEN 3 WHEN {' OR '.join(cav)} THEN 2 ELSE 1 END AS tier, {e}_pred AS pred, {e}_sigma AS sigma, {e}_truth AS truth FROM preds"


ABLATED = f"{PREDS}, ab AS (" + " UNION ALL ".join(tier_sql(c, e) for c in CONFIGS for e in ("teff", "alpha_m")) + ")"


def ablated(t):
    return va.ablate_gates(preds(t), CONFIGS, ["teff", "alpha_m"], ["source_id"])


@query("ablate_gates", f"WITH {ABLATED} SELECT source_id, config, element, tier FROM ab", i="tier")
def _(t):
    return ablated(t).select("source_id", "config", "element", "tier")


@query(
    "ablation_metrics",
    f"""WITH {ABLATED}, ok AS (SELECT *, pred - truth AS e, abs(pred - truth)/greatest(sigma, 1e-9) AS z FROM ab WHERE pred IS NOT NULL), g AS (SELECT config, element, 'tier' || tier AS "group", e, z FROM ok UNION ALL SELECT config, element, 'tier12', e, z FROM ok WHERE tier <= 2),
n AS (SELECT config, element, count(*) AS n_ok FROM ok GROUP BY 1, 2) SELECT g.config, g.element, g."group", count(*) AS n, sqrt(avg(e*e)) AS rmse, avg(e) AS bias, avg(abs(e)) AS mae, avg(CAST(z <= 1 AS INTEGER)) AS coverage_1sigma, avg(CAST(z <= 2 AS INTEGER)) AS coverage_2sigma, count(*)/any_value(n_ok) AS frac
FROM g JOIN n ON g.config = n.config AND g.element = n.element GROUP BY 1, 2, 3""",
    r="rmse bias mae coverage_1sigma coverage_2sigma frac",
)
def _(t):
    return va.ablation_metrics(ablated(t))


HOLD = f"{ZLONG}, c AS (SELECT cell, sqrt(avg((mh_pred - mh_truth)*(mh_pred - mh_truth))) AS rmse, avg(mh_pred - mh_truth) AS bias FROM cells GROUP BY 1 HAVING count(*) >= 2), hold AS (SELECT max(rmse) AS worst_rmse, max(abs(bias)) AS worst_bias, median(rmse) AS median_rmse, max(rmse)/median(rmse) AS ratio FROM c)"


@query("holdout_rmse", f"WITH {HOLD} SELECT *, ratio <= 2 AND worst_bias <= 0.05 AS passed FROM hold", r="worst_rmse worst_bias median_rmse ratio")
def _(t):
    return va.holdout_rmse(celled(t), "cell", "mh_pred", "mh_truth")


@query("cluster_precision", f"WITH {STARS}, c AS (SELECT stddev_samp(logg) AS s FROM stars GROUP BY cust HAVING count(*) >= 3) SELECT count(*) AS n_clusters, median(s) AS sigma_intra, median(s) < 1.0*1.5 AS passed FROM c", r="sigma_intra")
def _(t):
    return va.cluster_precision(stars(t), "cust", "logg", 1.0)


EXTERNAL = "(SELECT 'x1' AS catalogue, mh_pred - mh_truth AS d FROM preds UNION ALL SELECT 'x2', mh_pred - mh_truth*1.02e0 FROM preds)"


@query("catalogue_consistency", f"WITH {PREDS}, c AS (SELECT catalogue, avg(d) AS b, stddev_samp(d) AS s FROM {EXTERNAL} GROUP BY 1) SELECT max(abs(b)) AS worst_bias, max(s) AS worst_scatter, max(abs(b)) <= 0.05 AND max(s) <= 0.1 AS passed FROM c", r="worst_bias worst_scatter")
def _(t):
    df = preds(t).withColumns({"x1": F.col("mh_truth"), "x2": F.col("mh_truth") * 1.02})
    return va.catalogue_consistency(df, "mh_pred", ["x1", "x2"], 0.05)


IMP = "imp AS (SELECT i AS feature, abs(corr(CAST(embedding[i] AS DOUBLE), label)) AS importance, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS looco FROM embeddings, range(1, 65) r(i) GROUP BY 1)"


@query("audit_gate", f"WITH {IMP}, n AS (SELECT abs(corr(CAST(embedding[64] AS DOUBLE), label)) AS null_r FROM embeddings) SELECT count(*) FILTER (importance > 0.02) AS n_informative, max(abs(looco)) > 1e-12 AS looco_nontrivial, any_value(null_r) <= 0.2 AS null_ok, any_value(1 - null_r) >= 0.5 AS decorr_ok, count(*) FILTER (importance > 0.02) >= 3 AND max(abs(looco)) > 1e-12 AND any_value(null_r) <= 0.2 AND any_value(1 - null_r) >= 0.5 AS passed FROM imp, n")
def _(t):
    long = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    imp = long.groupBy("pos").agg(F.abs(F.corr("v", "label")).alias("importance"), F.stddev_pop("v").alias("looco"))
    null = t.embeddings.agg(F.abs(F.corr(F.get("embedding", F.lit(63)).cast("double"), "label")).alias("r")).scalar()
    return va.audit_gate(imp, value="importance", looco="looco", null_ratio=null, decorr_ratio=1 - null)


@query(
    "promotion_decision",
    f"""WITH {HOLD.replace('c AS', 'hc AS').replace('FROM c)', 'FROM hc)')}, e AS (SELECT {', '.join(f'sqrt(avg(pow({x}_pred - {x}_truth, 2)))/stddev_pop({x}_truth) AS r_{x}, avg(CAST(abs({x}_pred - {x}_truth) <= {x}_sigma AS INTEGER)) AS c_{x}, count({x}_pred)/count(*) AS f_{x}' for x in FIVE)} FROM preds)
{' UNION ALL '.join(f"SELECT '{x}' AS element, CASE WHEN NOT (f_{x} > 0.5 AND r_{x} < 0.5) THEN 'tier_3_rejected' WHEN NOT (c_{x} >= 0.6) THEN 'tier_3_internal' WHEN c_{x} >= 0.9 THEN 'tier_1' ELSE 'tier_2' END AS tier FROM e" for x in FIVE)}""",
)
def _(t):
    rows = []
    for x in FIVE:
        p, y = F.col(f"{x}_pred"), F.col(f"{x}_truth")
        r = F.sqrt(F.avg((p - y) * (p - y))) / F.stddev_pop(y)
        cov = F.avg((F.abs(p - y) <= F.col(f"{x}_sigma")).cast("double"))
        rows.append(F.struct(F.lit(x).alias("element"), r.alias("ratio"), cov.alias("cov"), (F.count(p) / F.count(F.lit(1))).alias("share")))
    e = preds(t).agg(F.array(*rows).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    ratio, cov, share = F.col("ratio") < 0.5, F.col("cov") >= 0.6, F.col("share") > 0.5
    return e.select("element", va.promotion_decision(share, ratio, ratio, ratio, cov, cov, F.col("cov") >= 0.9).alias("tier"))


DOCS = "docs AS (SELECT l.doc_id, quality, toxic, lang, CAST(n_chars > 1500 AS INTEGER) AS long_doc FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def docs(t):
    return t.labels.join(t.documents.select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("long_doc")), "doc_id")


CONF = "k AS (SELECT quality AS t, long_doc AS p, count(*) AS n FROM docs GROUP BY 1, 2), c AS (SELECT class, coalesce((SELECT sum(n) FROM k WHERE t = class), 0)::DOUBLE AS n_true, coalesce((SELECT sum(n) FROM k WHERE p = class), 0)::DOUBLE AS n_pred, coalesce((SELECT sum(n) FROM k WHERE t = class AND p = class), 0)::DOUBLE AS hit FROM (VALUES (0), (1)) v(class))"


@query("confusion_scores", f"WITH {DOCS}, {CONF} SELECT class, n_true, n_pred, hit/n_true AS recall, hit/n_pred AS \"precision\", 2*hit/(n_true + n_pred) AS f1, 1 - hit/n_true AS migration FROM c", r="recall f1 migration", i="class n_true n_pred")
def _(t):
    return info.class_scores(info.confusion_counts(docs(t), "quality", "long_doc")).withColumn("precision", F.col("precision"))


@query(
    "confusion_agreement",
    f"""WITH {DOCS}, {CONF}, m AS (SELECT avg(2*hit/(n_true + n_pred)) AS macro_f1, sum(n_true*n_pred) AS tp, sum(n_true*n_true) AS tt, sum(n_pred*n_pred) AS pp, sum(n_true*(n_true - 1)/2) AS a, sum(n_pred*(n_pred - 1)/2) AS b, sum(hit) AS c, sum(n_true) AS s FROM c), z AS (SELECT sum(n*(n - 1)/2) AS pairs FROM k)
SELECT macro_f1, (c*s - tp)/sqrt((s*s - pp)*(s*s - tt)) AS mcc, (pairs - a*b/(s*(s - 1)/2))/(0.5e0*(a + b) - a*b/(s*(s - 1)/2)) AS adjusted_rand, 1 - c/s AS migration_rate FROM m, z""",
    r="macro_f1 mcc adjusted_rand migration_rate",
)
def _(t):
    return info.agreement_scores(info.confusion_counts(docs(t), "quality", "long_doc"))


@query(
    "bootstrap_ci",
    f"""WITH {PREDS}, cuts AS (SELECT {info.poisson_cuts()}::DOUBLE[] AS c), rep AS (SELECT r, mh_pred - mh_truth AS d, len(list_filter(c, lambda q: q <= {replica_uniform_sql(4, 'r', 'source_id')})) AS w FROM preds, cuts, range(20) x(r)), s AS (SELECT r, sum(w*d)/sum(w) AS s FROM rep WHERE w > 0 GROUP BY 1)
SELECT avg(s) AS bootstrap_mean, quantile_cont(s, 0.025) AS ci_lower, quantile_cont(s, 0.975) AS ci_upper, quantile_cont(s, 0.025) > 0 AS passed FROM s""",
    r="bootstrap_mean ci_lower ci_upper", digits=8,
)
def _(t):
    df = preds(t).select("source_id", (F.col("mh_pred") - F.col("mh_truth")).alias("d"))
    return info.bootstrap_ci(df, ["source_id"], "d", 20, 4)


MIB = f"{STARS}, {edges_sql('stars', ['teff', 'alpha_m', 'logg'], 4)}, b AS (SELECT {qbin_sql('teff', 4, 0, 'source_id')} AS x, {qbin_sql('alpha_m', 4, 0, 'source_id')} AS y, {qbin_sql('logg', 4, 0, 'source_id')} AS z FROM stars, qe)"


def mi_bins(t):
    return sm.quantile_bin(stars(t).select("source_id", "teff", "alpha_m", "logg"), ["teff", "alpha_m", "logg"], [4, 4, 4], ["source_id"])


@query("mutual_information", f"WITH {MIB}, j AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2), w AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j) SELECT sum(n/t*ln(n*t/(nx*ny))) AS mi FROM w", r="mi")
def _(t):
    return info.mutual_information(mi_bins(t), "q_teff", "q_alpha_m")


@query("conditional_mi", f"WITH {MIB}, j AS (SELECT x, y, z, count(*) AS n FROM b GROUP BY 1, 2, 3), w AS (SELECT n, sum(n) OVER (PARTITION BY x, z) AS nxz, sum(n) OVER (PARTITION BY y, z) AS nyz, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER () AS t FROM j) SELECT sum(n/t*ln(n*nz/(nxz*nyz))) AS cmi FROM w", r="cmi")
def _(t):
    return info.conditional_mi(mi_bins(t), "q_teff", "q_alpha_m", ["q_logg"])


SKILL = f"{PREDS}, sk AS (SELECT " + ", ".join(f"sqrt(avg(pow({x}_pred - {x}_truth, 2))) AS b_{x}, sqrt(avg(pow({x}_pred*0.5e0 - {x}_truth, 2))) AS n_{x}, stddev_pop({x}_truth) AS s_{x}" for x in FIVE) + " FROM preds), skl AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, CASE WHEN 1 - b_{x}/s_{x} > 0 THEN (1 - n_{x}/s_{x})/(1 - b_{x}/s_{x}) END AS skill_ratio, b_{x}/s_{x} AS share FROM sk" for x in FIVE) + ")"


def skills(t):
    rows = []
    for x in FIVE:
        p, y = F.col(f"{x}_pred"), F.col(f"{x}_truth")
        rows.append(F.struct(F.lit(x).alias("label"), F.sqrt(F.avg((p - y) * (p - y))).alias("b"), F.sqrt(F.avg((p * 0.5 - y) * (p * 0.5 - y))).alias("n"), F.stddev_pop(y).alias("s")))
    e = preds(t).agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return e.select("label", va.skill_ratio(F.col("n"), F.col("b"), F.col("s")).alias("skill_ratio"), (F.col("b") / F.col("s")).alias("share"))


@query("skill_ratio", f"WITH {SKILL} SELECT label, skill_ratio FROM skl", r="skill_ratio")
def _(t):
    return skills(t).select("label", "skill_ratio")


@query(
    "classify_label",
    f"""WITH {SKILL}, v AS (SELECT label, CASE WHEN skill_ratio IS NULL OR share IS NULL THEN 'indeterminate' WHEN skill_ratio >= 0.2 AND share < 0.05 THEN 'null-prior-dominated' WHEN skill_ratio >= 0.2 THEN 'prior-augmented' WHEN share >= 0.2 THEN 'information-rich' WHEN share >= 0.05 THEN 'information-poor' ELSE 'null-prior-dominated' END AS verdict FROM skl)
SELECT label, verdict, CASE verdict WHEN 'information-rich' THEN 'tier-1' WHEN 'prior-augmented' THEN 'tier-1-caveat' WHEN 'information-poor' THEN 'tier-2' ELSE 'tier-3' END AS tier, verdict IN ('indeterminate', 'null-prior-dominated') AS halt FROM v""",
)
def _(t):
    return skills(t).withColumns(va.classify_label(F.col("skill_ratio"), F.col("share"))).drop("skill_ratio", "share")


