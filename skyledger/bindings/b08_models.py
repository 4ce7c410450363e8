"""Streaming, grouped models, Spark ML rows and quality batteries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyledger.bindings.b04_sampling import NULLS
from skyledger.bindings.registry import query
from skyledger.bindings.b05_stats import bin_sql
from skyledger.bindings.b07_functions import SPH, rot
from skyledger.bindings.views import PREDS, STARS, md5_sql, preds, stars, uniform_sql
from skyledger.functions.flags import magnitude_bin
from skyledger.functions.hashing import hash_uniform
from skyledger.operators import ensembles as en, learning as ml, mixtures as mx, quality as ql, spatial
from skyledger.streaming import incremental as inc


def events(t):
    return inc.stream_table(t.spark, t.folder, "events.parquet")


@query("score_incremental", "SELECT event_id, (\"value\" - 20e0)/15e0 AS z, \"value\" > 100 AS high FROM events", r="z")
def _(t):
    out, check = inc.folders(t.spark, "score")
    return inc.score_incremental(events(t), lambda d: d.select("event_id", ((F.col("value") - 20.0) / 15.0).alias("z"), (F.col("value") > 100).alias("high")), out, check)


@query("running_counters", "SELECT event_type, count(*) AS n_rows, count(*) FILTER (\"value\" > 100) AS n_high, count(*) FILTER (\"value\" < 1) AS n_low FROM events GROUP BY 1")
def _(t):
    out, check = inc.folders(t.spark, "counters")
    return inc.running_counters(events(t), ["event_type"], {"n_high": F.col("value") > 100, "n_low": F.col("value") < 1}, out, check)


@query("dedup_incremental", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    out, check = inc.folders(t.spark, "dedup")
    return inc.dedup_incremental(events(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], [F.col("ts")], out, check).select("user_id", "event_type")


@query("checkpointed_compute", "SELECT event_id, user_id % 7 AS part, ln(\"value\" + 1) AS lv FROM events", r="lv", i="part")
def _(t):
    out, check = inc.folders(t.spark, "compute")
    return inc.checkpointed_compute(events(t), lambda d: d.select("event_id", (F.col("user_id") % 7).alias("part"), F.log1p("value").alias("lv")), out, check)


BOX_T, BOX_L, BOX_M = [3300.0, 4300.0, 5300.0, 6301.0], [0.0, 2.3, 4.61], [-2.4, -0.9, 0.61]


def log_normal_sql(m: str, v: str) -> str:
    return f"(-0.5e0*(ln(2*pi()*{v}) + (x - {m})*(x - {m})/{v}))"


BIMODAL_SQL = f"""WITH RECURSIVE {STARS}, b AS (SELECT * FROM (SELECT {bin_sql('teff', BOX_T)} AS i_t, {bin_sql('logg', BOX_L)} AS i_l, {bin_sql('mh', BOX_M)} AS i_m, CAST(alpha_m*0.1e0 + CASE WHEN sol = 3 THEN 0.3e0 ELSE 0e0 END AS DOUBLE) AS x FROM stars) WHERE i_t IS NOT NULL AND i_l IS NOT NULL AND i_m IS NOT NULL AND x IS NOT NULL),
m AS (SELECT i_t, i_l, i_m, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM b GROUP BY 1, 2, 3),
d AS (SELECT i_t, i_l, i_m, x - mean AS x FROM b JOIN m USING (i_t, i_l, i_m) WHERE n >= 50 AND var > 0),
em(step, i_t, i_l, i_m, start, w, m1, m2, v1, v2, ll, gain) AS (SELECT 0, i_t, i_l, i_m, start, 0.5e0, lo*sqrt(var), hi*sqrt(var), var, var, -1e300, 1e0 FROM m, (VALUES {', '.join(f'({k}, {a!r}e0, {b!r}e0)' for k, (a, b) in enumerate(mx.STARTS))}) v(start, lo, hi) WHERE n >= 50 AND var > 0 UNION ALL
SELECT step + 1, i_t, i_l, i_m, start, r1/n, rx/r1, (sx - rx)/(n - r1), greatest(rxx/r1 - (rx/r1)*(rx/r1), 0) + 1e-5, greatest((sxx - rxx)/(n - r1) - ((sx - rx)/(n - r1))*((sx - rx)/(n - r1)), 0) + 1e-5, lp, (lp - ll)/n FROM (
SELECT step, i_t, i_l, i_m, start, any_value(ll) AS ll, count(*) AS n, least(greatest(sum(r), 1e-9), count(*) - 1e-9) AS r1, sum(r*x) AS rx, sum(r*x*x) AS rxx, sum(x) AS sx, sum(x*x) AS sxx, sum(lp) AS lp FROM (
SELECT *, exp(a - lp) AS r FROM (SELECT *, greatest(a, c) + ln(exp(a - greatest(a, c)) + exp(c - greatest(a, c))) AS lp FROM (
SELECT *, ln(w) + {log_normal_sql('m1', 'v1')} AS a, ln(1 - w) + {log_normal_sql('m2', 'v2')} AS c FROM em JOIN d USING (i_t, i_l, i_m) WHERE abs(gain) >= 1e-3 AND step < 100))) GROUP BY step, i_t, i_l, i_m, start)),
fin AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY i_t, i_l, i_m, start ORDER BY step DESC) = 1),
top AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY i_t, i_l, i_m ORDER BY ll DESC, start) = 1),
fit AS (SELECT *, least(w, 1 - w) AS minor_weight, abs(m1 - m2) AS mean_sep, abs(gain) < 1e-3 AS converged FROM top)
SELECT i_t, i_l, i_m, n, coalesce(-2*ll + 5*ln(n) + 4 < n*(ln(2*pi()*var) + 1) + 2*ln(n) AND minor_weight >= 0.15 AND mean_sep >= 0.08, false) AS is_bimodal, minor_weight, mean_sep, converged FROM m LEFT JOIN fit USING (i_t, i_l, i_m)"""


@query("bimodality_per_cell", BIMODAL_SQL, r="minor_weight mean_sep", digits=4, i="i_t i_l i_m")
def _(t):
    # two modes where the solution type differs
    df = stars(t).withColumn("a", F.col("alpha_m") * 0.1 + F.when(F.col("sol") == 3, 0.3).otherwise(0.0))
    out = mx.bimodality_per_cell(df, {"t": ("teff", BOX_T), "l": ("logg", BOX_L), "m": ("mh", BOX_M)}, "a")
    return out.select("i_t", "i_l", "i_m", "n", "is_bimodal", "minor_weight", "mean_sep", "converged")


SEEDS = ", ".join(f"({q}, {a!r}e0, {b!r}e0)" for q, (a, b) in enumerate(mx.SEED_MEANS))
MIXTURE_SQL = f"""WITH RECURSIVE {STARS}, whole AS (SELECT source_id, CAST(mh AS DOUBLE) AS a, CAST(alpha_m AS DOUBLE) AS b FROM stars), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM whole WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT source_id, (a - ma)/sa AS x, (b - mb)/sb AS y FROM whole, m WHERE a IS NOT NULL AND b IS NOT NULL),
em(step, q, w, mx, my, cxx, cxy, cyy, ll, gain) AS (SELECT 0, q, 1e0/3, (s1 - ma)/sa, (s2 - mb)/sb, 1e0, 0e0, 1e0, -1e300, 1e0 FROM (VALUES {SEEDS}) v(q, s1, s2), m UNION ALL
SELECT step + 1, q, r/n, x, y, xx/r - x*x + 1e-6, xy/r - x*y, yy/r - y*y + 1e-6, lp, lp - ll FROM (
SELECT step, q, any_value(ll) AS ll, count(*) AS n, sum(r) AS r, sum(r*x)/sum(r) AS x, sum(r*y)/sum(r) AS y, sum(r*x*x) AS xx, sum(r*x*y) AS xy, sum(r*y*y) AS yy, avg(lp) AS lp FROM (
SELECT *, exp(l - lp) AS r FROM (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY source_id)) AS lp FROM (SELECT *, max(l) OVER (PARTITION BY source_id) AS top FROM (
SELECT source_id, x, y, step, q, ll, ln(w) - ln(2*pi()) - 0.5e0*ln(cxx*cyy - cxy*cxy) - 0.5e0*(cyy*(x - mx)*(x - mx) - 2*cxy*(x - mx)*(y - my) + cxx*(y - my)*(y - my))/(cxx*cyy - cxy*cxy) AS l
FROM z, em WHERE abs(gain) >= 1e-3 AND step < 400)))) GROUP BY step, q)),
last AS (SELECT * FROM em WHERE step = (SELECT max(step) FROM em)),
best AS (SELECT source_id, arg_max(q, -ln(cxx*cyy - cxy*cxy) - (cyy*(x - mx)*(x - mx) - 2*cxy*(x - mx)*(y - my) + cxx*(y - my)*(y - my))/(cxx*cyy - cxy*cxy)) AS component FROM z, last GROUP BY 1)
SELECT component, count(*) AS n FROM whole LEFT JOIN best USING (source_id) GROUP BY 1"""


@query("seeded_mixture", MIXTURE_SQL, i="component")
def _(t):
    df = stars(t).select("source_id", "mh", "alpha_m")
    means, covs = mx.seeded_mixture(df, ["mh", "alpha_m"])
    return df.withColumn("component", mx.gmm_assign(["mh", "alpha_m"], means, covs)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def gauss_sql(stream: str) -> str:
    a, b = uniform_sql(f"{stream}a", "draw", "source_id"), uniform_sql(f"{stream}b", "draw", "source_id")
    return f"sqrt(-2e0*ln({a}))*cos({2 * np.pi!r}e0*{b})"


def gauss(stream: str):
    a, b = hash_uniform(f"{stream}a", "draw", "source_id"), hash_uniform(f"{stream}b", "draw", "source_id")
    return F.sqrt(-2.0 * F.ln(a)) * F.cos(2 * np.pi * b)


@query(
    "mc_astrometry",
    f"""WITH {STARS}, d AS (SELECT source_id, parallax + parallax_error*({gauss_sql('p')}) AS plx, 10e0*(u1 - 0.5e0) + 0.1e0*(0.3e0*({gauss_sql('p')}) + sqrt(1 - 0.09e0)*({gauss_sql('m')})) AS pmra FROM stars, range(8) r(draw) WHERE parallax IS NOT NULL)
SELECT source_id, count(*) FILTER (plx > 0) AS n_valid, quantile_cont(CASE WHEN plx > 0 THEN 1000/plx END, 0.5) AS dist_median, quantile_cont(pmra, 0.16) AS pmra_p16, quantile_cont(pmra, 0.84) AS pmra_p84 FROM d GROUP BY 1""",
    r="dist_median pmra_p16 pmra_p84", digits=4,
)
def _(t):
    from skyledger.operators.draws import draw_astrometry

    s = stars(t).select(
        "source_id", "parallax", "parallax_error", (10.0 * (F.col("u1") - 0.5)).alias("pmra"), F.lit(0.1).alias("pmra_error"), (10.0 * (F.col("u2") - 0.5)).alias("pmdec"), F.lit(0.1).alias("pmdec_error"),
        F.lit(0.3).alias("parallax_pmra_corr"), F.lit(0.0).alias("parallax_pmdec_corr"), F.lit(0.0).alias("pmra_pmdec_corr"), (300.0 * (F.col("u3") - 0.5)).alias("rv"), F.lit(2.0).alias("rv_error"),
    ).where("parallax is not null")
    draws = draw_astrometry(s, ["source_id"], 8, names=("p", "m", "d", "v"))
    return draws.groupBy("source_id").agg(
        F.count("dist_pc").alias("n_valid"),
        F.percentile("dist_pc", F.lit(0.5)).alias("dist_median"),
        F.percentile("pmra", F.lit(0.16)).alias("pmra_p16"),
        F.percentile("pmra", F.lit(0.84)).alias("pmra_p84"),
    )


NV = 7


LOS_SQL = f"""WITH {STARS}, cube AS (SELECT source_id % {NV} AS i, (source_id // {NV}) % {NV} AS j, (source_id // {NV} // {NV}) % {NV} AS k, avg(u3)*1e-3 AS density FROM stars GROUP BY 1, 2, 3),
ray AS (SELECT source_id, dist_pc AS d, greatest(2, CAST(ceil(dist_pc/400e0) AS BIGINT) + 1) AS n, {rot(0)} AS ux, {rot(1)} AS uy, {rot(2)} AS uz FROM (SELECT *, {SPH} FROM stars) WHERE dist_pc > 0),
step AS (SELECT source_id, d/(n - 1)*CASE WHEN t = 0 OR t = n - 1 THEN 0.5e0 ELSE 1e0 END AS wt, ux*(d/(n - 1))*t/800 + 3 AS x, uy*(d/(n - 1))*t/800 + 3 AS y, uz*(d/(n - 1))*t/800 + 3 AS z
  FROM (SELECT *, unnest(range(n)) AS t FROM ray WHERE ux*d/800 + 3 BETWEEN 0 AND {NV - 1} AND uy*d/800 + 3 BETWEEN 0 AND {NV - 1} AND uz*d/800 + 3 BETWEEN 0 AND {NV - 1})),
base AS (SELECT *, least(CAST(floor(x) AS BIGINT), {NV - 2}) AS bi, least(CAST(floor(y) AS BIGINT), {NV - 2}) AS bj, least(CAST(floor(z) AS BIGINT), {NV - 2}) AS bk FROM step),
part AS (SELECT source_id, bi + a AS i, bj + b AS j, bk + c AS k, wt*CASE a WHEN 1 THEN x - bi ELSE 1 - (x - bi) END*CASE b WHEN 1 THEN y - bj ELSE 1 - (y - bj) END*CASE c WHEN 1 THEN z - bk ELSE 1 - (z - bk) END AS w FROM base, range(2) r(a), range(2) q(b), range(2) o(c)),
los AS (SELECT source_id, sum(w*density) AS av_los FROM part JOIN cube USING (i, j, k) GROUP BY 1)
SELECT source_id, av_los FROM stars LEFT JOIN los USING (source_id)"""


@query("los_integral", LOS_SQL, r="av_los")
def _(t):
    s = stars(t)
    index = [F.pmod(F.col("source_id"), F.lit(NV)), F.pmod(F.floor(F.col("source_id") / NV), F.lit(NV)), F.pmod(F.floor(F.col("source_id") / NV / NV), F.lit(NV))]
    cube = s.groupBy(*[c.alias(n) for c, n in zip(index, "ijk")]).agg((F.avg("u3") * 1e-3).alias("density"))
    out = spatial.los_integral(s.select("source_id", "ra", "dec", "dist_pc"), cube, "source_id", "ra", "dec", "dist_pc", shape=(NV, NV, NV), voxel_pc=800.0, sun=(3.0, 3.0, 3.0), step_pc=400.0)
    return out.select("source_id", "av_los")


W = [[[0.1, 0.5, -0.2], [1.0, 0.0, 0.3]], [[0.0, 0.6, -0.1], [0.9, 0.1, 0.2]]]


def lin_sql(w):
    return f"({w[0]}e0 + ({w[1]}e0)*u1 + ({w[2]}e0)*u2)"


@query("score_ensemble", f"WITH {STARS}, m AS (SELECT source_id, ({lin_sql(W[0][0])} + {lin_sql(W[1][0])})/2 AS mean0, ({lin_sql(W[0][1])} + {lin_sql(W[1][1])})/2 AS mean1, abs({lin_sql(W[0][0])} - {lin_sql(W[1][0])})/2 AS epistemic0 FROM stars) SELECT * FROM m", r="mean0 mean1 epistemic0")
def _(t):
    long = en.score_linear_ensemble(stars(t), ["u1", "u2"], W, "source_id")
    g = [F.get("mu", F.lit(i)) for i in (0, 1)]
    return long.groupBy("source_id").agg(F.avg(g[0]).alias("mean0"), F.avg(g[1]).alias("mean1"), F.stddev_pop(g[0]).alias("epistemic0"))


def noisy(t):
    return stars(t).withColumn("y", 2.0 * F.col("u1") - 1.5 * F.col("u2") + 0.3 * F.col("u3"))


NOISY = f"{STARS}, noisy AS (SELECT source_id, u1, u2, u3, 2e0*u1 - 1.5e0*u2 + 0.3e0*u3 AS y, u2 - 0.2e0*u3 AS y2, CAST(floor(u3*4) AS INTEGER) AS cell FROM stars)"


def plane_sql(name: str, source: str, a: str, b: str, y: str) -> str:
    """Normal equations of y on two columns: coefficients c0, ca, cb."""
    return f"""{name} AS (SELECT (sbb*say - sab*sby)/(saa*sbb - sab*sab) AS ca, (saa*sby - sab*say)/(saa*sbb - sab*sab) AS cb, my - (sbb*say - sab*sby)/(saa*sbb - sab*sab)*ma - (saa*sby - sab*say)/(saa*sbb - sab*sab)*mb AS c0
FROM (SELECT avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, covar_pop({a}, {a}) AS saa, covar_pop({b}, {b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby FROM {source}))"""


def shuffled_sql(name: str, cell: str = "") -> str:
    """Values of the row with the same rank in another seeded order, over all rows or inside a cell."""
    part = f"PARTITION BY {cell} " if cell else ""
    order = [f"row_number() OVER ({part}ORDER BY {md5_sql(s, 'source_id')}, source_id)" for s in ("0a", "0b")]
    return f"""{name} AS (SELECT a.*, b.v1, b.v2 FROM (SELECT *, {order[0]} AS r FROM noisy) a JOIN (SELECT cell AS c, u1 AS v1, u2 AS v2, {order[1]} AS r FROM noisy) b ON a.r = b.r{' AND a.cell = b.c' if cell else ''})"""


def rms(pred: str, truth: str) -> str:
    return f"sqrt(avg(pow({pred} - {truth}, 2)))"


@query(
    "baseline_regressor",
    f"""WITH {NOISY}, fit AS (SELECT * FROM noisy WHERE source_id % 4 <> 0), held AS (SELECT * FROM noisy WHERE source_id % 4 = 0), {plane_sql('p', 'fit', 'u1', 'u3', 'y')},
o AS (SELECT covar_pop(u3, y)/covar_pop(u3, u3) AS w, avg(y) - covar_pop(u3, y)/covar_pop(u3, u3)*avg(u3) AS c FROM fit),
e AS (SELECT count(*) AS n, {rms('(c + w*u3)', 'y')} AS rmse_aux, {rms('(c0 + ca*u1 + cb*u3)', 'y')} AS rmse_full FROM held, o, p) SELECT *, rmse_full/rmse_aux AS ratio FROM e""",
    r="rmse_aux rmse_full ratio",
)
def _(t):
    df = noisy(t)
    return ml.baseline_regressor(df.where("source_id % 4 <> 0"), df.where("source_id % 4 = 0"), ["u3"], ["u1", "u3"], "y")


def importance_sql(y: str) -> str:
    """Rows (feature, baseline, permuted) for a regression of y on u1 and u2; needs the tables of NOISY."""
    return f"""(WITH {plane_sql('p', 'noisy', 'u1', 'u2', y)}, {shuffled_sql('j')}, e AS (SELECT {rms('(c0 + ca*u1 + cb*u2)', y)} AS b, {rms('(c0 + ca*v1 + cb*u2)', y)} AS e1, {rms('(c0 + ca*u1 + cb*v2)', y)} AS e2 FROM j, p)
SELECT 'u1' AS feature, b AS baseline_rmse, e1 AS permuted_rmse, e1 - b AS importance FROM e UNION ALL SELECT 'u2', b, e2, e2 - b FROM e)"""


@query("permutation_importance", f"WITH {NOISY} SELECT * FROM {importance_sql('y')}", r="baseline_rmse permuted_rmse importance")
def _(t):
    df = noisy(t)
    return ml.permutation_importance(df, ml.fit_linear(df, ["u1", "u2"], "y"), ["u1", "u2"], "y", ["source_id"])


def audit_sql(y: str) -> str:
    return f"""SELECT '{y}' AS label, feature, baseline_rmse, importance, CASE feature WHEN 'u1' THEN l1 ELSE l2 END AS looco_delta_rmse, null_rmse AS shuffled_null_rmse FROM {importance_sql(y)},
(WITH {plane_sql('p', 'noisy', 'u1', 'u2', y)} SELECT abs(ca)*sqrt(avg(u1*u1)) AS l1, abs(cb)*sqrt(avg(u2*u2)) AS l2 FROM noisy, p GROUP BY ca, cb),
(WITH {plane_sql('p', 'noisy', 'u1', 'u2', y)}, {shuffled_sql('j', 'cell')} SELECT {rms('(c0 + ca*v1 + cb*u2)', y)} AS null_rmse FROM j, p)"""


@query("audit_report", f"WITH {NOISY} {audit_sql('y')} UNION ALL {audit_sql('y2')}", r="baseline_rmse importance looco_delta_rmse shuffled_null_rmse")
def _(t):
    df = noisy(t).withColumns({"y2": F.col("u2") - 0.2 * F.col("u3"), "cell": (F.col("u3") * 4).cast("int")})
    out = ml.audit_report(df, ["u1", "u2"], ["y", "y2"], ["u1"], ["cell"], ["source_id"])
    return out.select("label", "feature", "baseline_rmse", "importance", "looco_delta_rmse", "shuffled_null_rmse")


def top_axis_sql(i: int, source: str, name: str) -> str:
    """Largest eigenpair of the 64 x 64 matrix in ``source`` by repeated squaring, and the matrix without it in ``name``."""
    return f"""q{i}(k, m) AS (SELECT 0, m FROM {source} UNION ALL
SELECT k + 1, [[list_dot_product(m[i], m[j])/s FOR j IN range(1, 65)] FOR i IN range(1, 65)] FROM (SELECT k, m, list_sum([list_dot_product(m[i], m[i]) FOR i IN range(1, 65)]) AS s FROM q{i} WHERE k < 22)),
r{i} AS (SELECT m[list_position([m[i][i] FOR i IN range(1, 65)], list_max([m[i][i] FOR i IN range(1, 65)]))] AS v FROM q{i} WHERE k = 22),
v{i} AS (SELECT [x/sqrt(list_dot_product(v, v)) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END FOR x IN v] AS v FROM r{i}),
{name} AS (SELECT v, l, [[m[i][j] - l*v[i]*v[j] FOR j IN range(1, 65)] FOR i IN range(1, 65)] AS m FROM (SELECT v, m, list_sum([v[i]*list_dot_product(m[i], v) FOR i IN range(1, 65)]) AS l FROM (SELECT a.v, b.m FROM v{i} a, {source} b)))"""


COVARIANCE = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1)),
cov AS (SELECT list(c ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS c FROM (SELECT i, j, covar_samp(x[i], x[j]) AS c FROM e, range(1, 65) r(i), range(1, 65) s(j) GROUP BY 1, 2) GROUP BY 1))"""
PCA_SQL = f"""WITH RECURSIVE {COVARIANCE}, {top_axis_sql(1, 'cov', 'c1')}, {top_axis_sql(2, 'c1', 'c2')}, {top_axis_sql(3, 'c2', 'c3')},
z AS (SELECT vec_id, [x[i] - mu[i] FOR i IN range(1, 65)] AS z FROM e, mu)
SELECT vec_id, list_dot_product(z, c1.v) AS pc1, list_dot_product(z, c2.v) AS pc2, list_dot_product(z, c3.v) AS pc3, (c1.l + c2.l + c3.l)/(SELECT list_sum([m[i][i] FOR i IN range(1, 65)]) FROM cov) AS variance_kept FROM z, c1, c2, c3"""


@query("pca_project", PCA_SQL, r="pc1 pc2 pc3 variance_kept", digits=5)
def _(t):
    out, share = ml.pca_project(t.embeddings.select("vec_id", "embedding"), "embedding", 3, ["vec_id"])
    return out.select("vec_id", "pc1", "pc2", "pc3", F.lit(share).alias("variance_kept"))


# quality
GOOD = "flag_bad = 0"


def surprise_sql(c):
    return f"count(*) FILTER ({c} IS NULL AND NOT coalesce(source_id % 19 = 0, false))"


def verdict(name, level, bad):
    return f"SELECT '{name}' AS \"check\", '{level}' AS level, {bad} = 0 AS passed, CAST({bad} AS BIGINT) AS n_bad FROM stars"


CHECKS = {
    "check_nan_invariant": verdict("feature_nan_invariant", "HARD", f"({surprise_sql('teff')} + {surprise_sql('bp_rp')})"),
    "check_label_complete": verdict("label_completeness", "HARD", "(count(*) FILTER (logg IS NULL AND flag_bad = 0) + count(*) FILTER (mh IS NULL AND flag_bad = 0))"),
    "check_bounds": verdict("parameter_bounds", "HARD", "(count(*) FILTER (flag_bad = 0 AND NOT teff BETWEEN 3000 AND 8000) + count(*) FILTER (flag_bad = 0 AND NOT logg BETWEEN -0.5 AND 4.5))"),
    "check_zscore": verdict("zscore_validity", "SOFT", "CASE WHEN abs(avg((u1 - 0.5e0)*sqrt(12e0)) FILTER (flag_bad = 0)) < 0.05 AND abs(stddev_pop((u1 - 0.5e0)*sqrt(12e0)) FILTER (flag_bad = 0) - 1) < 0.05 THEN 0 ELSE 1 END"),
    "check_dedup": "SELECT 'dedup_count' AS \"check\", 'SOFT' AS level, count(DISTINCT l_partkey) = (SELECT count(*) FROM part) AS passed, CAST(abs(count(DISTINCT l_partkey) - (SELECT count(*) FROM part)) AS BIGINT) AS n_bad FROM lineitem",
}


def checks(t):
    s = stars(t)
    good = F.col("flag_bad") == 0
    return {
        "check_nan_invariant": ql.check_nan_invariant(s, ["teff", "bp_rp"], F.col("source_id") % 19 == 0),
        "check_label_complete": ql.check_label_complete(s, ["logg", "mh"], good),
        "check_bounds": ql.check_bounds(s, {"teff": ql.BOUNDS["teff"], "logg": (-0.5, 4.5)}, good),
        "check_zscore": ql.check_zscore(s.withColumn("z", (F.col("u1") - 0.5) * F.sqrt(F.lit(12.0))), ["z"], good, 0.05, 0.05),
        "check_dedup": ql.check_dedup(t.lineitem, "l_partkey", t.part.agg(F.count(F.lit(1)).alias("n")).scalar()),
    }


def _register(name):
    @query(name, f"WITH {STARS} {CHECKS[name]}")
    def _(t):
        return checks(t)[name]


for _name in CHECKS:
    _register(_name)

BATTERY = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in CHECKS.values())


@query("run_battery", f"WITH {STARS}, rows AS ({BATTERY}) SELECT *, (SELECT CASE max(CASE WHEN NOT passed AND level = 'HARD' THEN 2 WHEN NOT passed THEN 1 ELSE 0 END) WHEN 2 THEN 'HARD-FAIL' WHEN 1 THEN 'SOFT-FAIL' ELSE 'PASS' END FROM rows) AS overall FROM rows")
def _(t):
    return ql.run_battery(*checks(t).values())


@query("surprise_counts", f"WITH {STARS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {surprise_sql(c)} AS n_surprise FROM stars" for c in NULLS))
def _(t):
    return ql.surprise_counts(stars(t), NULLS, F.col("source_id") % 19 == 0)


@query("verify_outputs", "SELECT 'g_mag_bin_missing' AS missing, count(*) AS n_rows FROM orders")
def _(t):
    df = stars(t).transform(magnitude_bin)
    absent = ql.verify_outputs(df, ["g_mag_bin", "source_id", "g_mag_bin_missing"])
    return df.groupBy(F.lit(",".join(absent)).alias("missing")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "selfcheck",
    f"""WITH {PREDS}, x AS (SELECT count(*) AS n_rows, count(*) FILTER (teff_pred IS NULL AND NOT ood_joint_flag) AS n_ungated FROM preds)
SELECT x.*, 0 AS n_shared, (SELECT avg(CAST(teff_truth BETWEEN 3900 AND 5400 AS INTEGER)) FROM preds WHERE source_id % 3 <> 0) AS frac_in_box, (SELECT avg(CAST(mh_pred < -1 AS INTEGER)) FROM preds WHERE source_id % 3 = 0) AS frac_halo, false AS passed FROM x""",
    r="frac_in_box frac_halo", i="n_ungated n_shared",
)
def _(t):
    p = preds(t)
    arms = (p.where("source_id % 3 = 0"), p.where("source_id % 3 <> 0"))
    return ql.selfcheck(p, arms, "source_id", gate=F.col("ood_joint_flag"), missing=F.col("teff_pred").isNull(), box=F.col("teff_truth").between(3900, 5400), halo=F.col("mh_pred") < -1)


