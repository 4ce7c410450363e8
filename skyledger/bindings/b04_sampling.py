"""Deduplication, samples, splits, weights and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings.registry import query
from skyledger.bindings.views import IDS, IDS_SQL, PREDS, RESID, STARS, md5_sql, preds, resid, stars
from skyledger.functions import binning as bn
from skyledger.operators import outliers, quality, residuals as rs, sampling as sm, sets

ROW_SQL = f"row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey)"


@query("dedup_best", f"SELECT {IDS_SQL}, l_extendedprice FROM (SELECT *, {ROW_SQL} AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    return sm.dedup_best(t.lineitem.select(*IDS, "l_extendedprice"), "l_partkey", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("dedup_histogram", "SELECT multiplicity, count(*) AS n_keys FROM (SELECT count(*) AS multiplicity FROM lineitem GROUP BY l_partkey) GROUP BY 1")
def _(t):
    return sm.dedup_histogram(t.lineitem, "l_partkey")


@query("dedup_stats", "SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) AS rows_out, count(*) FILTER (n > 1) AS n_duplicate_keys, max(n) AS max_duplicates_per_key FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(t):
    return sm.dedup_stats(t.lineitem, "l_orderkey")


MATCH = "m AS (SELECT l_partkey AS a_id, l_orderkey AS b_id, l_linenumber, l_suppkey, l_quantity*10 AS sep, l_discount - 0.05e0 AS dmag FROM lineitem)"


def matches(t):
    return t.lineitem.select(
        F.col("l_partkey").alias("a_id"), F.col("l_orderkey").alias("b_id"), "l_linenumber", "l_suppkey",
        (F.col("l_quantity") * 10).alias("sep"), (F.col("l_discount") - 0.05).alias("dmag"),
    )


RESOLVE = "cut AS (SELECT * FROM m WHERE sep < 300 AND abs(dmag) < 0.03e0), best AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY abs(dmag), sep, b_id, l_linenumber, l_suppkey) AS rn, count(*) OVER (PARTITION BY a_id) AS n_candidates FROM cut)"


@query("resolve_match", f"WITH {MATCH}, {RESOLVE} SELECT a_id, b_id, sep, dmag, n_candidates FROM best WHERE rn = 1", r="dmag")
def _(t):
    out = sm.resolve_match(matches(t), "a_id", separation="sep", mag_diff="dmag", ties=["sep", "b_id", "l_linenumber", "l_suppkey"], max_mag_diff=0.03)
    return out.select("a_id", "b_id", "sep", "dmag", "n_candidates")


@query("crossmatch", f"WITH {MATCH}, {RESOLVE} SELECT a_id, b_id, n_candidates FROM best WHERE rn = 1 AND a_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(t):
    ids = t.part.where("p_size > 25").select(F.col("p_partkey").alias("a_id"))
    near = matches(t).join(ids, "a_id", "left_semi")
    out = sm.resolve_match(near, "a_id", separation="sep", mag_diff="dmag", ties=["sep", "b_id", "l_linenumber", "l_suppkey"], max_mag_diff=0.03)
    return out.select("a_id", "b_id", "n_candidates")


@query("drop_dupes_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    from skyledger.operators.ranking import first_per_key

    return first_per_key(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


AXES = {"q": ("l_quantity", [1.0, 11.0, 21.0, 31.0, 41.0, 51.0]), "p": ("l_extendedprice", [1000.0, 35000.0, 70000.0, 100000.0]), "d": ("l_discount", [0.0, 0.045, 0.105])}
CELLS = f"""cells AS (SELECT {IDS_SQL}, CAST(floor((l_quantity-1)/10) AS INTEGER) AS i_q, CASE WHEN l_extendedprice < 35000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END AS i_p, CASE WHEN l_discount < 0.045e0 THEN 0 ELSE 1 END AS i_d
FROM lineitem WHERE l_extendedprice >= 1000 AND l_extendedprice < 100000)"""
CAP_ORDER = md5_sql(0, *IDS)


@query("stratified_cap", f"WITH {CELLS} SELECT {IDS_SQL}, i_q, i_p, i_d FROM (SELECT *, row_number() OVER (PARTITION BY i_q, i_p, i_d ORDER BY {CAP_ORDER}, {IDS_SQL}) AS rn FROM cells) WHERE rn <= 50")
def _(t):
    return sm.stratified_cap(t.lineitem, AXES, IDS, 50, 0).select(*IDS, "i_q", "i_p", "i_d")


@query("stratified_cap_counts", f"WITH {CELLS} SELECT i_q, i_p, i_d, count(*) AS n_available, least(count(*), 1500) AS n_selected FROM cells GROUP BY 1, 2, 3", i="n_selected")
def _(t):
    return sm.cell_counts(t.lineitem, AXES, 1500)


@query("stratified_cap_large", f"WITH {CELLS} SELECT i_q, i_p, i_d, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM (SELECT *, row_number() OVER (PARTITION BY i_q, i_p, i_d ORDER BY {CAP_ORDER}, {IDS_SQL}) AS rn FROM cells) WHERE rn <= 1500 GROUP BY 1, 2, 3")
def _(t):
    out = sm.stratified_cap(t.lineitem, AXES, IDS, 1500, 0)
    return out.groupBy("i_q", "i_p", "i_d").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("volume_limited", f"WITH {STARS} SELECT source_id, dist_pc FROM stars WHERE dist_pc < 2500 ORDER BY {md5_sql(3, 'source_id')} LIMIT 2000", r="dist_pc")
def _(t):
    return sm.volume_limited(stars(t).select("source_id", "dist_pc"), "dist_pc", 2500.0, ["source_id"], 2000, 3)


@query(
    "target_fill",
    f"""WITH {CELLS}, c AS (SELECT count(*) AS n FROM cells GROUP BY i_q, i_p, i_d), k AS (SELECT k, sum(least(n, k)) AS s FROM c, (SELECT unnest(range(1, 1 + (SELECT max(n) FROM c))) AS k) GROUP BY 1)
SELECT min(k) AS per_cell, CAST(arg_min(s, k) AS BIGINT) AS n_selected FROM k WHERE s >= (SELECT count(*) // 2 FROM cells)""",
    i="per_cell n_selected",
)
def _(t):
    counts = sm.cell_counts(t.lineitem, AXES, 1)
    target = counts.agg(F.floor(F.sum("n_available") / 2).alias("t")).first()["t"]
    return sm.target_fill(counts, int(target))


def edges_sql(table, cols, n, name="qe"):
    ps = [i / n for i in range(1, n)]
    return f"{name} AS (SELECT " + ", ".join(f"quantile_cont({c}, {ps}) AS e_{c}" for c in cols) + f" FROM {table})"


def qbin_sql(c, n, seed, *ids):
    fallback = f"CAST('0x' || substr({md5_sql(f'{seed}{c}', *ids)}, 1, 3) AS BIGINT) % {n}"
    return f"CAST(coalesce(len(list_filter(e_{c}, lambda q: q <= {c})) + 0*{c}, {fallback}) AS INTEGER)"


SPLIT = f"""{STARS}, {edges_sql('stars', ['teff', 'logg', 'g_mag'], 4)},
coded AS (SELECT source_id, ({qbin_sql('teff', 4, 0, 'source_id')}*4 + {qbin_sql('logg', 4, 0, 'source_id')})*4 + {qbin_sql('g_mag', 4, 0, 'source_id')} AS cell FROM stars, qe),
split AS (SELECT source_id, cell, CASE WHEN rn <= round_even(n*0.7e0, 0) THEN 'train' WHEN rn <= round_even(n*0.85e0, 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {md5_sql(0, 'source_id')}, source_id) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM coded))"""


@query("stratified_split", f"WITH {SPLIT} SELECT source_id, split FROM split")
def _(t):
    return sm.stratified_split(stars(t).select("source_id", "teff", "logg", "g_mag"), ["teff", "logg", "g_mag"], ["source_id"]).select("source_id", "split")


@query("quantile_bin", f"WITH {STARS}, {edges_sql('stars', ['teff', 'bp_rp'], 4)} SELECT source_id, {qbin_sql('teff', 4, 5, 'source_id')} AS q_teff, {qbin_sql('bp_rp', 4, 5, 'source_id')} AS q_bp_rp FROM stars, qe", i="q_teff q_bp_rp")
def _(t):
    return sm.quantile_bin(stars(t).select("source_id", "teff", "bp_rp"), ["teff", "bp_rp"], [4, 4], ["source_id"], seed=5).drop("teff", "bp_rp")


@query("bin_by_cells", f"WITH {SPLIT} SELECT source_id, cell FROM coded", i="cell")
def _(t):
    return sm.bin_by_cells(stars(t).select("source_id", "teff", "logg", "g_mag"), ["teff", "logg", "g_mag"], [4, 4, 4], ["source_id"]).select("source_id", "cell")


@query("cell_decode", f"WITH {SPLIT} SELECT source_id, cell, cell//16 AS i, (cell//4)%4 AS j, cell%4 AS k FROM coded", i="cell i j k")
def _(t):
    df = sm.bin_by_cells(stars(t).select("source_id", "teff", "logg", "g_mag"), ["teff", "logg", "g_mag"], [4, 4, 4], ["source_id"])
    return df.select("source_id", "cell", *[c.alias(n) for n, c in zip("ijk", bn.cell_decode("cell", [4, 4, 4]))])


DECOR = f"""{STARS}, {edges_sql('stars', ['logg', 'g_mag', 'alpha_m'], 3)},
coded AS (SELECT source_id, {qbin_sql('logg', 3, 0, 'source_id')}*3 + {qbin_sql('g_mag', 3, 0, 'source_id')} AS cell, {qbin_sql('alpha_m', 3, 0, 'source_id')} AS b FROM stars, qe),
tgt AS (SELECT cell, min(n) AS target FROM (SELECT cell, b, count(*) AS n FROM coded GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 3)"""


@query("decorrelated_sample", f"WITH {DECOR} SELECT source_id FROM (SELECT *, row_number() OVER (PARTITION BY cell, b ORDER BY {md5_sql(0, 'source_id')}, source_id) AS rn FROM coded JOIN tgt USING (cell)) WHERE rn <= target")
def _(t):
    return sm.decorrelated_sample(stars(t).select("source_id", "logg", "g_mag", "alpha_m"), "alpha_m", ["logg", "g_mag"], ["source_id"], n_bins=3).select("source_id")


@query(
    "inverse_freq_weights",
    f"""WITH {STARS}, b AS (SELECT source_id, CASE WHEN source_id % 41 <> 0 THEN mh END AS m FROM stars), c AS (SELECT *, CAST(m >= -2 AS INTEGER) + CAST(m >= -1.5 AS INTEGER) + CAST(m >= -0.5 AS INTEGER) AS bin FROM b),
w AS (SELECT source_id, CASE WHEN bin IS NULL THEN 1e0 ELSE least(5e0, (count(bin) OVER ())/(count(*) OVER (PARTITION BY bin))) END AS w0 FROM c) SELECT source_id, w0/(avg(w0) OVER ()) AS weight FROM w""",
    r="weight",
)
def _(t):
    s = stars(t).select("source_id", F.when(F.col("source_id") % 41 != 0, F.col("mh")).alias("m"))
    return sm.inverse_freq_weights(s, "m", [-2.0, -1.5, -0.5], 5.0).select("source_id", "weight")


REPORT = f"""cells AS (SELECT label, catalogue, mag_bin, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS scatter FROM resid GROUP BY 1, 2, 3)"""


def report(t):
    return resid(t).groupBy("label", "catalogue", "mag_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("scatter"))


@query("rank_catalogues", f"WITH {RESID}, {REPORT} SELECT *, dense_rank() OVER (PARTITION BY label, mag_bin ORDER BY abs(bias)) AS bias_rank, dense_rank() OVER (PARTITION BY label, mag_bin ORDER BY scatter) AS scatter_rank FROM cells", r="bias scatter", i="bias_rank scatter_rank")
def _(t):
    return rs.rank_catalogues(report(t))


@query(
    "ecdf_percentile",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders t WHERE t.o_orderkey % 2 = 0 AND t.o_totalprice <= q.o_totalprice)/(SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS percentile FROM orders q WHERE o_orderkey % 2 = 1",
    r="percentile",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return outliers.ecdf_percentile(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_totalprice")


NULLS = ["teff", "bp_rp", "parallax", "logg"]


@query("top_null_rates", f"WITH {STARS}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} IS NULL)/count(*) AS rate FROM stars WHERE flag_bad = 0" for c in NULLS) + ") SELECT * FROM u ORDER BY n_null DESC, \"column\" LIMIT 3", r="rate")
def _(t):
    return quality.top_null_rates(stars(t), NULLS, F.col("flag_bad") == 0)


@query("tasks_per_star", f"SELECT {IDS_SQL}, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem")
def _(t):
    return sm.rows_per_key(t.lineitem.select(*IDS), "l_orderkey")


@query("seeded_sample", f"SELECT {IDS_SQL} FROM lineitem ORDER BY {md5_sql(11, *IDS)} LIMIT 5000")
def _(t):
    return sm.seeded_sample(t.lineitem.select(*IDS), IDS, 5000, 11)


@query("sort_by_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders", i="position")
def _(t):
    from skyledger.operators.ranking import sort_by_key

    return sort_by_key(t.orders.select("o_orderkey"), "o_orderkey")


@query("union_arms", "SELECT o_orderkey, 'high' AS sample FROM orders WHERE o_totalprice >= 400000 UNION ALL SELECT o_orderkey, 'low' FROM orders WHERE o_totalprice < 50000")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return sets.union_arms({"high": o.where("o_totalprice >= 400000").drop("o_totalprice"), "low": o.where("o_totalprice < 50000").drop("o_totalprice")}, "o_orderkey")


@query("union_distinct_ids", "SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part UNION ALL SELECT c_custkey FROM customer) ORDER BY 1")
def _(t):
    return sets.union_distinct_ids([t.lineitem.select(F.col("l_partkey").alias("k")), t.part.select(F.col("p_partkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))], "k")


@query("union_dedup_delta", "SELECT k, v, o FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS rn FROM (SELECT c_custkey AS k, c_acctbal AS v, 'old' AS o, 0 AS p FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, -c_acctbal, 'new', 1 FROM customer)) WHERE rn = 1")
def _(t):
    c = t.customer
    old = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("old").alias("o"))
    new = c.select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("v"), F.lit("new").alias("o"))
    return sets.union_dedup_delta(old, new, "k", [F.col("v")])


@query("except_delta", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    li = t.lineitem
    n = t.orders.count()
    return sets.except_delta(li.where("l_quantity > 40").select(F.col("l_orderkey").alias("k")), li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "k", (1, n))


@query(
    "intersect_check",
    "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS n_a, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O') AS n_b, (SELECT count(*) FROM customer) AS n_whole, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus='F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='O')) AS n_overlap, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'O')) AS n_covered, false AS disjoint, false AS adds_up",
    i="n_a n_b n_whole n_overlap n_covered",
)
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return sets.intersect_check(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), t.customer.select(F.col("c_custkey").alias("k")), "k")


ARM = "CASE WHEN source_id % 3 = 0 THEN 'uniform' ELSE 'volume' END"


@query("split_by_tag", f"WITH {PREDS} SELECT {ARM} AS sample, count(*) AS n_rows, avg(CAST(ood_joint_flag AS INTEGER)) AS frac_ood_joint_flag, avg(CAST(kin_ood_flag AS INTEGER)) AS frac_kin_ood_flag FROM preds GROUP BY 1", r="frac_ood_joint_flag frac_kin_ood_flag")
def _(t):
    from skyledger.session import work_folder

    df = preds(t).withColumn("sample", F.when(F.col("source_id") % 3 == 0, "uniform").otherwise("volume"))
    path = work_folder(t.spark, "by-tag")
    df.select("source_id", "sample", "ood_joint_flag", "kin_ood_flag").write.partitionBy("sample").parquet(path)
    return sets.arm_diagnostics(t.spark.read.parquet(path), "sample", ["ood_joint_flag", "kin_ood_flag"])


