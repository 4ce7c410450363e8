"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings.registry import query
from skyledger.bindings.views import PREDS, STARS, preds, stars
from skyledger.functions import flags as fl, nulls, vectors as v
from skyledger.operators import grids, residuals as rs
from skyledger.operators.ranking import exact_quantiles_of, one_row
from skyledger.plans import release as rel
from skyledger.sources import catalogue as cat

FIVE = ("teff", "logg", "mh", "alpha_m", "mg_h")


@query(
    "quality_cuts",
    f"""WITH {STARS} SELECT * FROM (SELECT 'before' AS stage, count(*) AS n, 0 AS step FROM stars
UNION ALL SELECT 'flag_bad', count(*), 1 FROM stars WHERE flag_bad = 0 UNION ALL SELECT 'snr', count(*), 2 FROM stars WHERE flag_bad = 0 AND snr > 70
UNION ALL SELECT 'm_h', count(*), 3 FROM stars WHERE flag_bad = 0 AND snr > 70 AND mh BETWEEN -2.0 AND 0.5)""",
    i="n step",
)
def _(t):
    return grids.stage_counts(stars(t), {"flag_bad": F.col("flag_bad") == 0, "snr": F.col("snr") > 70, "m_h": F.col("mh").between(-2.0, 0.5)})


STAGED = f"""{STARS}, staged AS (SELECT *, CASE WHEN source_id % 5 = 0 THEN 'RGB' WHEN source_id % 5 = 1 THEN 'MS' WHEN source_id % 5 = 2 THEN 'RC' END AS evol_stage FROM stars),
flagged AS (SELECT *, coalesce(evol_stage IN ('RGB', 'RC', 'RGB_candidate'), false) AS class_accepted,
coalesce(teff BETWEEN 4000 AND 5500 AND logg BETWEEN 1.0 AND 3.5, false) AS box_accepted FROM staged)"""


def staged(t):
    s = F.col("source_id") % 5
    return stars(t).withColumn("evol_stage", F.when(s == 0, "RGB").when(s == 1, "MS").when(s == 2, "RC"))


@query("stage_filter_flags", f"WITH {STAGED} SELECT source_id, class_accepted, box_accepted, class_accepted OR (evol_stage IS NULL AND box_accepted) AS eligible FROM flagged")
def _(t):
    return staged(t).transform(fl.stage_filter_flags).select("source_id", "class_accepted", "box_accepted", "eligible")


@query("stage_filter", f"WITH {STAGED} SELECT evol_stage, count(*) AS n, count(*) FILTER (class_accepted) AS n_class, count(*) FILTER (box_accepted) AS n_box FROM flagged WHERE class_accepted OR (evol_stage IS NULL AND box_accepted) GROUP BY 1")
def _(t):
    kept = staged(t).transform(fl.stage_filter_flags).where("eligible")
    return kept.groupBy("evol_stage").agg(F.count(F.lit(1)).alias("n"), F.count_if("class_accepted").alias("n_class"), F.count_if("box_accepted").alias("n_box"))


@query("box_filter", f"WITH {STARS} SELECT source_id, teff, logg FROM stars WHERE teff BETWEEN 4000 AND 5500 AND logg BETWEEN 1.0 AND 3.5", r="teff logg")
def _(t):
    return stars(t).where(F.col("teff").between(4000, 5500) & F.col("logg").between(1.0, 3.5)).select("source_id", "teff", "logg")


@query("probability_cut", f"WITH {STARS} SELECT source_id, u3 AS prob FROM stars WHERE u3 > 0.95e0", r="prob")
def _(t):
    return stars(t).select("source_id", F.col("u3").alias("prob")).where(F.col("prob") > 0.95)


@query("finite_rows", f"WITH {STARS} SELECT source_id, teff, bp_rp, parallax FROM stars WHERE teff IS NOT NULL AND bp_rp IS NOT NULL AND parallax IS NOT NULL", r="teff bp_rp parallax")
def _(t):
    return nulls.finite_rows(stars(t), ["teff", "bp_rp", "parallax"]).select("source_id", "teff", "bp_rp", "parallax")


TIERED = f"""{PREDS}, tiered AS (SELECT *, CASE WHEN ood_joint_flag OR teff_pred IS NULL THEN 3 WHEN coalesce(label_extrapolation_flag,0)=1 THEN 2 ELSE 1 END AS t_teff,
CASE WHEN ood_joint_flag OR mg_h_pred IS NULL THEN 3 WHEN coalesce(label_extrapolation_flag,0)=1 THEN 2 ELSE 1 END AS t_mg_h,
CASE WHEN ood_joint_flag THEN 3 WHEN coalesce(label_extrapolation_flag,0)=1 THEN 2 ELSE 1 END AS t_other,
CASE WHEN g_mag <= 15 THEN 'bright' WHEN g_mag <= 16 THEN 'mid' ELSE 'faint' END AS g_mag_bin,
coalesce(parallax / parallax_error, 0) < 5 OR parallax IS NULL OR parallax <= 0 AS dist_prior_dominated FROM preds),
rel AS (SELECT *, greatest(t_teff, t_mg_h, t_other) AS release_tier FROM tiered)"""


def released(t):
    return rel.annotate(preds(t), FIVE)


HRD = "source_id, ra, \"dec\", parallax, parallax_error, teff_pred, teff_sigma, logg_pred, logg_sigma, mh_pred, mh_sigma, release_tier, t_teff AS release_tier__teff, t_other AS release_tier__logg, t_other AS release_tier__mh, g_mag_bin"


@query("hrd_subset", f"WITH {TIERED} SELECT {HRD} FROM rel WHERE release_tier <= 1", r="ra dec parallax parallax_error teff_pred teff_sigma logg_pred logg_sigma mh_pred mh_sigma", i="release_tier release_tier__teff release_tier__logg release_tier__mh")
def _(t):
    return rel.hrd_subset(released(t))


@query(
    "kinematic_subset",
    f"WITH {TIERED} SELECT source_id, release_tier, kin_ood_flag, dist_prior_dominated, g_mag_bin, t_mg_h AS release_tier__mg_h, mg_h_pred, 'aux_assisted' AS xp_abundance_type__mg_h FROM rel WHERE release_tier <= 2",
    r="mg_h_pred", i="release_tier release_tier__mg_h",
)
def _(t):
    keep = ["source_id", "release_tier", "kin_ood_flag", "dist_prior_dominated", "g_mag_bin", "release_tier__mg_h", "mg_h_pred", "xp_abundance_type__mg_h"]
    return rel.kinematic_subset(released(t)).select(*keep)


@query("tier1_subset", f"WITH {TIERED} SELECT source_id, teff_pred, g_mag_bin, 0 AS n_aux_columns FROM rel WHERE release_tier = 1", r="teff_pred", i="n_aux_columns")
def _(t):
    out = rel.tier1_subset(released(t))
    aux = [c for c in out.columns if c in ("alpha_m_pred", "mg_h_pred", "release_tier__mg_h")]
    return out.select("source_id", "teff_pred", "g_mag_bin", F.lit(len(aux)).alias("n_aux_columns"))


@query("project_existing", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return cat.project_existing(t.orders, ["o_orderkey", "o_absent", "o_totalprice"])


@query(
    "regime_envelope",
    f'WITH {STARS} SELECT source_id, coalesce(abs("dec")<5 AND teff > 4750 AND logg < 2.10, false) AS regime_flag, NOT coalesce(abs("dec")<5 AND teff > 4750 AND logg < 2.10, false) AS regime_clear FROM stars',
)
def _(t):
    return fl.regime_envelope(stars(t), teff="teff", logg="logg", b="dec").select("source_id", "regime_flag", "regime_clear")


SIGMAS = ["teff_sigma", "logg_sigma", "mh_sigma"]
LIMITS = "lim AS (SELECT " + ", ".join(f"quantile_cont({s}, 0.5) AS q_{s}" for s in SIGMAS) + " FROM preds)"
SMALL = " AND ".join(f"{s} <= q_{s}" for s in SIGMAS)


@query("matched_sigma", f"WITH {PREDS}, {LIMITS} SELECT source_id FROM preds, lim WHERE {SMALL}")
def _(t):
    df = preds(t)
    limits = one_row(exact_quantiles_of(df, [], SIGMAS, {"q": 0.5}))
    return rs.matched_sigma(df, SIGMAS, limits).select("source_id")


@query(
    "sigma_slices",
    f"""WITH {PREDS}, {LIMITS}, s AS (SELECT 'full' AS slice, * FROM preds UNION ALL SELECT 'matched_sigma', preds.* FROM preds, lim WHERE {SMALL})
SELECT slice, count(*) AS n, avg(teff_pred - teff_truth) AS bias FROM s GROUP BY 1""",
    r="bias",
)
def _(t):
    df = preds(t)
    limits = one_row(exact_quantiles_of(df, [], SIGMAS, {"q": 0.5}))
    out = rs.sigma_slices(df, SIGMAS, limits)
    return out.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("teff_pred") - F.col("teff_truth")).alias("bias"))


@query("completeness_mask", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount <> 0 AND l_tax <> 0 AND l_quantity <> 0 AS complete FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fl.completeness_mask(["l_discount", "l_tax", "l_quantity"]).alias("complete"))


@query("spectrum_reject", "SELECT count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS embedding_nan_rows, count(*) FILTER (embedding[1] <= 0) AS embedding_nonpos_c0, count(*) FILTER (embedding IS NULL) AS embedding_missing FROM embeddings")
def _(t):
    return v.spectrum_reject_counts(t.embeddings, ["embedding"])


@query(
    "missingness_flags",
    f"""WITH {STARS}, f AS (SELECT source_id, bp_rp IS NULL OR teff IS NULL AS ir_missing_flag,
NOT coalesce(abs(CASE WHEN parallax_error > 0 THEN parallax/parallax_error END) >= 5, false) AS parallax_missing_flag, bp_rp IS NULL AND parallax IS NULL AS extinction_missing_flag FROM stars)
SELECT *, ir_missing_flag OR parallax_missing_flag OR extinction_missing_flag AS aux_missing_any FROM f""",
)
def _(t):
    out = fl.missingness_flags(stars(t), infrared=["bp_rp", "teff"], extinction=["bp_rp", "parallax"], parallax="parallax", parallax_error="parallax_error")
    return out.select("source_id", "ir_missing_flag", "parallax_missing_flag", "extinction_missing_flag", "aux_missing_any")


@query("schema_validate", "SELECT count(*) FILTER (len(embedding) <> 64) AS embedding, count(*) AS n_rows FROM embeddings")
def _(t):
    c = cat.Contract({"vec_id": "bigint", "embedding": "array<float>", "label": "int"}, array_length={"embedding": 64})
    df = c.validate(t.embeddings)
    return c.length_violations(df).withColumn("n_rows", df.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("cast_storage", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part", r="p_retailprice", digits=3, i="p_size")
def _(t):
    return cat.cast_storage(t.part.select("p_partkey", "p_size", "p_retailprice"), {"p_size": "smallint"})


@query("rename_labels", "SELECT s_suppkey AS source_id, s_acctbal AS flux FROM supplier")
def _(t):
    return cat.rename_labels(t.supplier.select("s_suppkey", "s_acctbal"), {"s_suppkey": "source_id", "s_acctbal": "flux"})


@query("consumer_query", f"WITH {TIERED} SELECT source_id, teff_pred, mh_pred, release_tier FROM rel WHERE release_tier = 1 AND g_mag_bin IN ('bright', 'mid') AND NOT kin_ood_flag AND NOT dist_prior_dominated ORDER BY mh_pred DESC, source_id LIMIT 100", r="teff_pred mh_pred", i="release_tier")
def _(t):
    df = released(t).where((F.col("release_tier") == 1) & F.col("g_mag_bin").isin("bright", "mid") & ~F.col("kin_ood_flag") & ~F.col("dist_prior_dominated"))
    return df.select("source_id", "teff_pred", "mh_pred", "release_tier").orderBy(F.desc("mh_pred"), "source_id").limit(100)


