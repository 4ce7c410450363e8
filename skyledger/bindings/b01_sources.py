"""Scans, sinks and lineage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from skyledger.bindings.registry import query
from skyledger.bindings.views import PREDS, STARS, preds, stars
from skyledger.operators import joins
from skyledger.plans.release import annotate
from skyledger.session import work_folder
from skyledger.sources import catalogue as cat, lineage as lin


@query("scan_catalogue", "SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 40")
def _(t):
    return cat.scan_catalogue(t.spark, t.path("lineitem"), ["l_partkey", "l_quantity", "l_extendedprice"], F.col("l_quantity") >= 40)


@query("scan_aliased", "SELECT o_orderkey AS source_id, o_totalprice AS flux, o_orderstatus AS status, o_totalprice/2 AS half_flux FROM orders", r="half_flux")
def _(t):
    return cat.scan_aliased(
        t.spark, t.path("orders"), ["source_id", "flux", "status", "half_flux"],
        {"source_id": "O_ORDERKEY", "flux": "O_TotalPrice", "status": "o_orderstatus"}, {"half_flux": F.col("flux") / 2},
    )


@query("scan_parent", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    schema = T.StructType().add("c_custkey", "long").add("c_name", "string").add("c_acctbal", "double").add("c_mktsegment", "string")
    return cat.scan_parent(t.spark, t.path("customer"), schema, ["c_custkey", "c_acctbal", "c_mktsegment"])


@query(
    "load_training_arrays",
    f"WITH {PREDS} SELECT source_id, [teff_pred, logg_pred, mh_pred] AS features, [teff_truth, logg_truth] AS labels, [teff_sigma, logg_sigma] AS label_errors FROM preds",
)
def _(t):
    return cat.load_training_arrays(preds(t), ["teff_pred", "logg_pred", "mh_pred"], ["teff_truth", "logg_truth"], ["teff_sigma", "logg_sigma"], "source_id")


@query("scan_chunks", "SELECT count(*) AS n_rows, sum(l_quantity) AS total FROM lineitem", r="total", digits=2)
def _(t):
    chunks = cat.scan_chunks(t.spark, t.path("lineitem"), ["l_quantity"])
    per = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("q").alias("total"))


@query("detect_input_schema", f"WITH {PREDS} SELECT 'zscored' AS convention, count(*) AS n FROM preds")
def _(t):
    df = preds(t).withColumnsRenamed({"teff_pred": "bp_c0_z", "logg_pred": "rp_c0_z"})
    kind = cat.detect_input_schema(df.columns, ["bp_c0_z", "rp_c0_z"], ["bp_c0_log", "rp_c0_log"])
    return df.groupBy(F.lit(kind).alias("convention")).agg(F.count(F.lit(1)).alias("n"))


@query("write_atomic", "SELECT p_partkey, p_retailprice FROM part")
def _(t):
    return cat.write_atomic(t.part.select("p_partkey", "p_retailprice"), work_folder(t.spark, "atomic"))


@query("write_incremental", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def _(t):
    parts = [t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice") for s in ("F", "O", "P")]
    return cat.write_incremental(parts, work_folder(t.spark, "incremental"))


BIN = "CASE WHEN g_mag IS NULL THEN 'unknown' WHEN g_mag <= 15 THEN 'bright' WHEN g_mag <= 16 THEN 'mid' ELSE 'faint' END"


@query("write_partitioned", f"WITH {PREDS} SELECT {BIN} AS g_mag_bin, count(*) AS n_rows FROM preds GROUP BY 1")
def _(t):
    df = annotate(preds(t), ("teff", "logg", "mh", "alpha_m", "mg_h"))
    return cat.write_partitioned(df, work_folder(t.spark, "partitioned"), "g_mag_bin")


@query("enrich_by_id_list", "SELECT c.c_custkey, c.c_name, c.c_acctbal FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') i LEFT JOIN customer c USING (c_custkey)")
def _(t):
    ids = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.enrich_by_ids(ids, t.customer, "c_custkey", ["c_name", "c_acctbal"])


@query("enrich_by_upload", "SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity = 50) USING (o_orderkey)")
def _(t):
    ids = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return t.orders.select("o_orderkey", "o_totalprice").join(ids, "o_orderkey")


@query("lookup_catalogues", "SELECT o_orderkey, o_custkey AS c_custkey, c_acctbal, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    ids = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = joins.enrich_by_ids(ids, t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "c_custkey", ["c_acctbal", "n_nationkey"])
    return joins.enrich_by_ids(out, t.nation, "n_nationkey", ["n_name"]).drop("n_nationkey")


@query(
    "resume_delta",
    "SELECT o_orderkey, o_totalprice, 'held' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'fetched' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'O' ORDER BY 1",
)
def _(t):
    base = t.orders.select("o_orderkey", "o_totalprice")
    held = base.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("held"))
    offered = base.join(t.orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey").withColumn("origin", F.lit("fetched"))
    return joins.resume_delta(held, offered, "o_orderkey", [F.col("o_totalprice")]).orderBy("o_orderkey")


@query(
    "annotate_metadata",
    "SELECT * FROM (VALUES ('o_totalprice', 'unit', 'ct'), ('o_totalprice', 'ucd', 'phot.flux'), ('o_orderkey', 'description', 'source key')) v(\"column\", note, text), (SELECT count(*) AS n_rows FROM orders)",
)
def _(t):
    notes = {"o_totalprice": {"unit": "ct", "ucd": "phot.flux"}, "o_orderkey": {"description": "source key"}}
    out = cat.write_atomic(cat.annotate_metadata(t.orders.select("o_orderkey", "o_totalprice"), notes), work_folder(t.spark, "notes"))
    return cat.metadata_table(out).withColumn("n_rows", out.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("lineage_record", f"WITH {STARS} SELECT (SELECT count(*) FROM stars) AS rows_before, count(*) AS rows_after, 7 AS seed, 2 AS n_cuts FROM stars WHERE flag_bad = 0 AND snr > 70", i="seed n_cuts")
def _(t):
    cuts = {"flag": F.col("flag_bad") == 0, "snr": F.col("snr") > 70}
    rec = lin.write_with_lineage(stars(t), cuts, work_folder(t.spark, "lineage"), sources=["orders"], corrections=["none"], seed=7)
    return rec.select("rows_before", "rows_after", "seed", F.size("cuts").alias("n_cuts"))


@query(
    "release_sidecar",
    f"""WITH {PREDS}, x AS (SELECT CASE WHEN ood_joint_flag OR teff_pred IS NULL THEN 3 WHEN coalesce(label_extrapolation_flag, 0) = 1 THEN 2 ELSE 1 END AS tier FROM preds)
SELECT '{{"n_rows":' || count(*) || ',"counts":{{"tier1":' || count(*) FILTER (tier = 1) || ',"tier2":' || count(*) FILTER (tier = 2) || ',"tier3":' || count(*) FILTER (tier = 3) || '}},"gates":["ood_joint_flag","label_extrapolation_flag"],"columns_added":["release_tier"]}}' AS sidecar FROM x""",
)
def _(t):
    df = annotate(preds(t), ("teff",))
    return lin.release_sidecar(df, "release_tier", ["ood_joint_flag", "label_extrapolation_flag"], ["release_tier"])


@query(
    "load_frozen_stats",
    """SELECT CAST(i - 1 AS INTEGER) AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean, stddev_samp(CAST(embedding[i] AS DOUBLE)) AS sigma, count(*) AS n_rows
FROM embeddings, range(1, 65) r(i) GROUP BY i""",
    r="mean sigma", i="pos n_rows",
)
def _(t):
    text = lin.freeze_stats(t.embeddings, {"emb": "embedding"})
    stats = lin.load_frozen_stats(text, "stats", 64)
    band = stats.select("n_rows", F.col("bands")["emb"].alias("b"))
    return band.select("n_rows", F.posexplode(F.arrays_zip("b.mean", "b.sigma")).alias("pos", "z")).select("pos", "n_rows", "z.mean", "z.sigma")


@query("verify_fingerprint", "SELECT count(*) AS n_rows, 64 AS hash_length, true AS matches FROM embeddings", i="n_rows hash_length")
def _(t):
    text = lin.freeze_stats(t.embeddings, {"emb": "embedding"})
    stats = lin.load_frozen_stats(text, "stats", 64)
    checked = lin.verify_fingerprint(stats, lin.fingerprint(F.col("bands")))
    return checked.select("n_rows", F.length("fingerprint").alias("hash_length"), F.lit(True).alias("matches"))


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) FILTER ({c} IS NULL) AS n_null, "
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean" if k != "string" else "NULL, NULL, NULL")
        + f", count(*) FILTER ({c} IS NULL)/count(*) AS null_frac FROM s"
        for c, k in (("teff", "double"), ("bp_rp", "double"), ("parallax", "double"), ("sol", "int"), ("o_orderstatus", "string"))
    ).join([f"WITH {STARS}, s AS (SELECT * FROM stars) ", ""]),
    r="min max mean null_frac",
)
def _(t):
    df = stars(t)
    return cat.profile_columns(df, ["teff", *cat.select_columns(df, match=["bp"]), "parallax", "sol", "o_orderstatus"])


@query("report_long", "SELECT l_returnflag AS cell, u.metric, u.value FROM (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS mean_q, max(l_extendedprice) AS max_p FROM lineitem GROUP BY 1) UNPIVOT (value FOR metric IN (n, mean_q, max_p)) u(l_returnflag, metric, value)", r="value")
def _(t):
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_quantity").alias("mean_q"), F.max("l_extendedprice").alias("max_p")
    )
    return cells.unpivot(["cell"], ["n", "mean_q", "max_p"], "metric", "value")


