"""Key, bridge, grid and geometric joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.bindings.registry import query
from skyledger.bindings.views import PREDS, STARS, preds, stars
from skyledger.functions.flags import completeness_mask
from skyledger.operators import grids, joins, neighbours, spatial
from skyledger.operators.ranking import exact_quantiles, one_row

CUSTOMER = "c_custkey AS o_custkey, c_name, c_acctbal"


@query("join_1to1_guarded", "SELECT p.p_partkey, p_name, p_retailprice, n_lines FROM part p JOIN (SELECT l_partkey AS p_partkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (p_partkey)")
def _(t):
    per = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return joins.join_1to1_guarded(t.part.select("p_partkey", "p_name", "p_retailprice"), per, "p_partkey", columns=["n_lines"])


@query(
    "join_key_report",
    """SELECT (SELECT count(*) FROM orders) AS n_left, (SELECT count(*) FROM lineitem) AS n_right, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_unique_left,
(SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_unique_right, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS n_joined,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_left_lost, 0 AS n_left_repeated,
(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS n_right_repeated""",
    i="n_left n_right n_unique_left n_unique_right n_joined n_left_lost n_left_repeated n_right_repeated",
)
def _(t):
    return joins.key_report(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@query("join_lookup_default", "SELECT o_orderkey, o_custkey, coalesce(flag, false) AS flag, score FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal < 0 AS flag, c_acctbal AS score FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def _(t):
    lookup = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("flag"), F.col("c_acctbal").alias("score"))
    return joins.join_lookup_default(t.orders.select("o_orderkey", "o_custkey", F.lit(True).alias("flag")), lookup, "o_custkey", "flag", ["score"])


@query(
    "join_lookup_rowsafe",
    "SELECT p_partkey, best FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey",
)
def _(t):
    lookup = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").alias("best"))
    return joins.join_lookup_rowsafe(t.part.select("p_partkey"), lookup, "p_partkey", [F.desc("best")], ["best"])


@query("join_many_to_one", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return joins.join_many_to_one(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), o, "l_orderkey")


@query("join_chain", "SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = joins.join_chain(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), (c, "c_custkey"), (n, "n_nationkey"), (t.region, "r_regionkey"))
    return out.select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("join_master", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, s_name AS name_right, s_acctbal AS acctbal_right FROM customer JOIN supplier ON c_custkey = s_suppkey")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return joins.join_master(c, s, "id")


@query("build_training", "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return joins.join_master(t.documents.select("doc_id", "lang", "source", "n_chars"), t.labels, "doc_id")


@query("build_inference", "SELECT d.doc_id, lang, n_chars FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return joins.anti_ids(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")


BRIDGE = "(SELECT l_partkey AS p_partkey, min(l_suppkey) AS s_suppkey FROM lineitem WHERE l_quantity > 48 GROUP BY 1)"


@query("join_bridge", f"SELECT p_partkey, b.s_suppkey, s_name, s_acctbal FROM part LEFT JOIN {BRIDGE} b USING (p_partkey) LEFT JOIN supplier s ON b.s_suppkey = s.s_suppkey")
def _(t):
    bridge = t.lineitem.where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    return joins.join_bridge(t.part.select("p_partkey"), bridge, t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "p_partkey", "s_suppkey")


@query("join_bridge_2", "SELECT c_custkey, b.n_name, r_name FROM customer LEFT JOIN (SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) b USING (c_custkey) LEFT JOIN region ON b.n_regionkey = r_regionkey")
def _(t):
    b = t.customer.where("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return joins.join_bridge(t.customer.select("c_custkey"), b, t.region, "c_custkey", "r_regionkey").drop("r_regionkey")


@query(
    "join_full_coalesce",
    """SELECT coalesce(a.k, b.k) AS k, j_mag, w1_mag, j_mag IS NULL OR w1_mag IS NULL AS ir_missing_flag
FROM (SELECT o_custkey AS k, max(o_totalprice) AS j_mag FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS w1_mag FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON a.k = b.k""",
)
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("j_mag"))
    b = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("w1_mag"))
    return joins.join_full_coalesce(a, b, "k", ["j_mag", "w1_mag"])


@query(
    "anchor_left",
    """SELECT i.k, CAST(o_totalprice AS FLOAT) AS price, o_orderstatus AS status, CAST(NULL AS TINYINT) AS code FROM (SELECT DISTINCT c_custkey AS k FROM customer) i
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_totalprice > 450000) WHERE rn = 1) m ON k = o_custkey""",
    r="price", digits=0, i="code",
)
def _(t):
    m = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    ids = t.customer.select(F.col("c_custkey").alias("k"))
    return joins.anchor_left(ids, m, "k", {"k": "bigint", "price": "float", "status": "string", "code": "tinyint"}, [F.col("o_orderkey")])


@query("join_left_params", "SELECT s_suppkey, s_name, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def _(t):
    return t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")).join(t.nation.where("n_regionkey < 3"), "n_nationkey", "left").drop("n_nationkey")


@query(
    "merge_distances",
    f"""WITH {STARS} SELECT source_id, dist_pc AS dist_primary_pc, (dist_pc*1.2e0 - dist_pc*0.9e0)/2 AS dist_sigma_sym_pc, second AS dist_second_pc,
coalesce(abs(CASE WHEN dist_pc > 0 AND second > 0 THEN log10(dist_pc/second) END) > 0.3, false) AS dist_conflict
FROM stars LEFT JOIN (SELECT source_id AS k, dist_pc*(0.3e0 + 2e0*u2) AS second FROM stars WHERE source_id % 4 <> 0) ON source_id = k""",
    r="dist_primary_pc dist_sigma_sym_pc dist_second_pc",
)
def _(t):
    s = stars(t)
    a = s.select("source_id", F.col("dist_pc").alias("med"), (F.col("dist_pc") * 0.9).alias("lo"), (F.col("dist_pc") * 1.2).alias("hi"))
    b = s.where("source_id % 4 <> 0").select("source_id", (F.col("dist_pc") * (0.3 + 2.0 * F.col("u2"))).alias("second"))
    return joins.merge_distances(a, b, "source_id", med="med", lo="lo", hi="hi", second_med="second").drop("med", "lo", "hi")


@query("semi_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1)")
def _(t):
    ids = t.lineitem.where("l_discount = 0.1d").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.semi_ids(t.orders.select("o_orderkey", "o_totalprice"), ids, "o_orderkey")


@query("anti_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    ids = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_ids(t.customer.select("c_custkey", "c_name"), ids, "c_custkey")


@query(
    "compare_releases",
    f"""WITH {PREDS} SELECT least(4, CAST(floor((a.mh_pred + 2.5e0)/0.6e0) AS INTEGER)) AS bin, count(*) AS n, avg(b.alpha - a.alpha_m_pred) AS shift, avg(a.alpha_m_pred) AS mean_v1, avg(b.alpha) AS mean_v2
FROM preds a JOIN (SELECT source_id, alpha_m_pred + 0.01e0*mh_pred AS alpha FROM preds WHERE source_id % 5 <> 0) b ON a.source_id = b.source_id GROUP BY 1""",
    r="shift mean_v1 mean_v2",
)
def _(t):
    p = preds(t)
    b = p.where("source_id % 5 <> 0").withColumn("alpha_m_pred", F.col("alpha_m_pred") + 0.01 * F.col("mh_pred"))
    j = joins.compare_releases(p, b, "source_id", ["alpha_m_pred", "mh_pred"], ("_v1", "_v2"))
    return j.groupBy(F.least(F.lit(4), F.floor((F.col("mh_pred_v1") + 2.5) / 0.6).cast("int")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("alpha_m_pred_v2") - F.col("alpha_m_pred_v1")).alias("shift"),
        F.avg("alpha_m_pred_v1").alias("mean_v1"),
        F.avg("alpha_m_pred_v2").alias("mean_v2"),
    )


def between_sql(x: str, edges, name: str) -> str:
    """Clamped bin index as SQL."""
    inner = " + ".join(f"CAST({x} >= {float(e)!r}e0 AS INTEGER)" for e in edges[1:-1])
    return f"CASE WHEN {x} IS NULL THEN -1 ELSE {inner} END AS {name}"


B, G, TE, LE = grids.B_EDGES, grids.G_EDGES, grids.T_EDGES, grids.L_EDGES
EDGES_SQL = (
    f"b_edges AS (SELECT unnest(range({len(B) - 1})) AS i_b, unnest({list(B[:-1])}::DOUBLE[]) AS b_lo, unnest({list(B[1:])}::DOUBLE[]) AS b_hi), "
    f"g_edges AS (SELECT unnest(range({len(G) - 1})) AS i_g, unnest({list(G[:-1])}::DOUBLE[]) AS g_lo, unnest({list(G[1:])}::DOUBLE[]) AS g_hi)"
)
# retention: a star counts as flagged when its solution is a two-parameter one
RETENTION = f"""{EDGES_SQL}, ret AS (SELECT i_b, i_g, any_value(b_lo) AS b_lo, any_value(b_hi) AS b_hi, any_value(g_lo) AS g_lo, any_value(g_hi) AS g_hi,
count(source_id) AS n_total, coalesce(CAST(sum(CAST(sol = 3 AS INTEGER)) AS BIGINT), 0) AS n_flagged FROM b_edges, g_edges
LEFT JOIN stars ON abs("dec") >= b_lo AND (abs("dec") < b_hi OR (i_b = 4 AND abs("dec") <= b_hi)) AND g_mag >= g_lo AND (g_mag < g_hi OR (i_g = 4 AND g_mag <= g_hi)) GROUP BY 1, 2),
retention AS (SELECT *, CASE WHEN n_total > 0 THEN n_flagged/n_total ELSE 0e0 END AS flag_rate, greatest(0.01e0, least(1e0, 1e0 - CASE WHEN n_total > 0 THEN n_flagged/n_total ELSE 0e0 END)) AS selection_prob FROM ret)"""
COARSE = f"""keyed AS (SELECT *, {between_sql('abs("dec")', B, 'i_b')}, {between_sql('g_mag', G, 'i_g')}, {between_sql('teff', TE, 'i_t')}, {between_sql('logg', LE, 'i_l')},
CAST(bp_rp IS NOT NULL AND bp_rp <> 0 AND parallax IS NOT NULL AND parallax <> 0 AS INTEGER) AS ok FROM stars),
coarse AS (SELECT i_b, i_g, count(*) AS n_total, sum(ok) AS n_complete, greatest(0.01e0, least(1e0, (sum(ok) + 1e0)/(count(*) + 2e0))) AS p FROM keyed GROUP BY 1, 2),
fine AS (SELECT i_b, i_g, i_t, i_l, count(*) AS n_total, sum(ok) AS n_complete, greatest(0.01e0, least(1e0, (sum(ok) + 1e0)/(count(*) + 2e0))) AS p FROM keyed WHERE i_t >= 0 AND i_l >= 0 GROUP BY 1, 2, 3, 4)"""


def retention(t):
    return grids.retention_grid(stars(t), F.abs("dec"), F.col("g_mag"), F.col("sol") == 3)


def axes():
    return {"b": (F.abs("dec"), B), "g": (F.col("g_mag"), G)}


def extra_axes():
    return {"t": (F.col("teff"), TE), "l": (F.col("logg"), LE)}


def completeness(t):
    return grids.completeness_grids(stars(t), completeness_mask(["bp_rp", "parallax"]), axes(), extra_axes())


def keyed_edges(grid, axes):
    """Put the edge values of bin indices back as columns."""
    for a, e in axes.items():
        lo, hi = grids.bin_edges_of(F.col(f"i_{a}"), e)
        grid = grid.withColumn(f"{a}_lo", lo).withColumn(f"{a}_hi", hi)
    return grid


@query(
    "join_compound_key",
    f"WITH {STARS}, {RETENTION}, {COARSE} SELECT b_lo, b_hi, g_lo, g_hi, selection_prob AS p_ye_retained, c.p AS p_complete, greatest(0.0001e0, least(1e0, selection_prob*c.p)) AS p_compound FROM retention r JOIN coarse c ON r.i_b = c.i_b AND r.i_g = c.i_g",
    r="p_ye_retained p_complete p_compound",
)
def _(t):
    ye = retention(t).select("b_lo", "b_hi", "g_lo", "g_hi", F.col("selection_prob").alias("p_ye_retained"))
    coarse = keyed_edges(completeness(t).where("level = 'coarse'"), {"b": B, "g": G}).select("b_lo", "b_hi", "g_lo", "g_hi", "p_complete")
    return joins.join_compound_key(ye, coarse, ["b_lo", "b_hi", "g_lo", "g_hi"], "p_ye_retained", "p_complete", "p_compound")


@query("grid_lookup_2d", f"WITH {STARS}, {RETENTION}, {COARSE} SELECT source_id, selection_prob AS p_retained FROM keyed k JOIN retention r ON k.i_b = r.i_b AND k.i_g = r.i_g", r="p_retained")
def _(t):
    s = stars(t).select("source_id", "dec", "g_mag")
    return joins.grid_lookup(s, retention(t), axes(), "selection_prob", "p_retained").select("source_id", "p_retained")


BACKOFF = f"{COARSE}, scored AS (SELECT k.*, coalesce(f.p, c.p) AS p_ir FROM keyed k JOIN coarse c ON k.i_b = c.i_b AND k.i_g = c.i_g LEFT JOIN fine f ON k.i_b = f.i_b AND k.i_g = f.i_g AND k.i_t = f.i_t AND k.i_l = f.i_l AND f.n_total >= 100)"


@query("grid_lookup_4d_backoff", f"WITH {STARS}, {BACKOFF} SELECT source_id, p_ir FROM scored", r="p_ir")
def _(t):
    grid = completeness(t)
    s = stars(t).select("source_id", "dec", "g_mag", "teff", "logg")
    out = joins.grid_lookup_backoff(s, grid.where("level = 'fine'"), grid.where("level = 'coarse'"), axes(), extra_axes(), "p_complete", "p_ir")
    return out.select("source_id", "p_ir")


MASK_EDGES = {"t": [3500.0, 4250.0, 5000.0, 6000.0], "l": [0.5, 2.0, 4.0], "m": [-2.0, -1.0, 0.0]}


def inside_sql(x, edges, name):
    inner = " + ".join(f"CAST({x} >= {e!r}e0 AS INTEGER)" for e in edges[1:-1])
    return f"CASE WHEN {x} >= {edges[0]!r}e0 AND {x} < {edges[-1]!r}e0 THEN {inner} END AS {name}"


MASKED = f"cells AS (SELECT source_id, alpha_m, {inside_sql('teff', MASK_EDGES['t'], 'i_t')}, {inside_sql('logg', MASK_EDGES['l'], 'i_l')}, {inside_sql('mh', MASK_EDGES['m'], 'i_m')} FROM stars)"


@query(
    "mask_lookup_3d",
    f"""WITH {STARS}, {MASKED}, mask AS (SELECT i_t, i_l, i_m, stddev_pop(alpha_m) > 0.03e0 AS wide FROM cells WHERE i_t IS NOT NULL AND i_l IS NOT NULL AND i_m IS NOT NULL GROUP BY 1, 2, 3)
SELECT source_id, coalesce(wide, false) AS mode_flag, i_t IS NOT NULL AND i_l IS NOT NULL AND i_m IS NOT NULL AS mode_flag_in_grid,
coalesce(wide, false) OR NOT (i_t IS NOT NULL AND i_l IS NOT NULL AND i_m IS NOT NULL) AS mode_flag_ambiguous FROM cells LEFT JOIN mask USING (i_t, i_l, i_m)""",
)
def _(t):
    from skyledger.operators.sampling import with_cells

    box = {"t": ("teff", MASK_EDGES["t"]), "l": ("logg", MASK_EDGES["l"]), "m": ("mh", MASK_EDGES["m"])}
    s = stars(t).select("source_id", "teff", "logg", "mh", "alpha_m")
    mask = with_cells(s, box).groupBy("i_t", "i_l", "i_m").agg((F.stddev_pop("alpha_m") > 0.03).alias("wide"))
    out = joins.mask_lookup(s, mask, box, "wide", "mode_flag")
    return out.select("source_id", "mode_flag", "mode_flag_in_grid", "mode_flag_ambiguous")


# Temperature bins of the residual thresholds.
TEFF_EDGES = [4000.0, 4500.0, 5000.0, 5500.0, 6000.0]
TEFF_LABELS = ["lt_4000", "4000_4500", "4500_5000", "5000_5500", "5500_6000", "ge_6000"]
TEFF_LABEL_SQL = "CASE WHEN teff IS NULL THEN '{missing}' WHEN teff < 4000 THEN 'lt_4000' WHEN teff < 4500 THEN '4000_4500' WHEN teff < 5000 THEN '4500_5000' WHEN teff < 5500 THEN '5000_5500' WHEN teff < 6000 THEN '5500_6000' ELSE 'ge_6000' END"


@query(
    "threshold_lookup",
    f"""WITH {STARS}, b AS (SELECT source_id, CASE WHEN source_id % 37 <> 0 THEN u3 END AS rms, {TEFF_LABEL_SQL.format(missing='missing')} AS bin FROM stars),
th AS (SELECT bin, quantile_cont(rms, 0.99) AS p99 FROM b WHERE bin <> 'missing' GROUP BY 1), g AS (SELECT quantile_cont(rms, 0.99) AS p99 FROM b)
SELECT source_id, b.bin, CAST(rms > coalesce(th.p99, g.p99) AS INTEGER) AS flag FROM b LEFT JOIN th ON b.bin = th.bin, g""",
    i="flag",
)
def _(t):
    from skyledger.functions.binning import labelled

    s = stars(t).select("source_id", "teff", F.when(F.col("source_id") % 37 != 0, F.col("u3")).alias("rms"))
    th = exact_quantiles(s.withColumn("bin", labelled("teff", TEFF_EDGES, TEFF_LABELS)).where("bin is not null"), ["bin"], "rms", {"p99": 0.99})
    g = one_row(exact_quantiles(s, [], "rms", {"p99": 0.99}))["p99"]
    out = joins.threshold_lookup(s, th, g, value="rms", by="teff", edges=TEFF_EDGES, labels=TEFF_LABELS, out="flag")
    return out.select("source_id", "bin", "flag")


XYZ = """xyz AS (SELECT source_id, bp_rp AS ag, dist_pc*cos(radians("dec"))*cos(radians(ra)) AS x, dist_pc*cos(radians("dec"))*sin(radians(ra)) AS y, dist_pc*sin(radians("dec")) AS z FROM stars)"""


@query(
    "ball_join",
    f"""WITH {STARS}, {XYZ}, near AS (SELECT a.source_id, b.ag FROM xyz a JOIN xyz b ON a.source_id <> b.source_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 62500e0 WHERE b.ag IS NOT NULL),
agg AS (SELECT source_id, count(*) AS n, median(ag) AS m, stddev_pop(ag) AS s FROM near GROUP BY 1)
SELECT x.source_id, coalesce(n, 0) AS nbhd_n, CASE WHEN n >= 5 THEN m END AS nbhd_median, CASE WHEN n >= 5 THEN s END AS nbhd_std FROM xyz x LEFT JOIN agg USING (source_id)""",
    r="nbhd_median nbhd_std",
)
def _(t):
    s = stars(t).select("source_id", "ra", "dec", "dist_pc", F.col("bp_rp").alias("ag"))
    out = spatial.neighbourhood(s, "ra", "dec", "dist_pc", "ag", radius=250.0)
    return out.select("source_id", "nbhd_n", "nbhd_median", "nbhd_std")


SIM = "list_dot_product(a.v, b.v)/(sqrt(list_dot_product(a.v, a.v))*sqrt(list_dot_product(b.v, b.v)))"
EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def knn_sql(k: int, dist: str, a: str = "true", b: str = "true", name: str = "nn") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS "rank" FROM
(SELECT a.vec_id, b.vec_id AS neighbour, round({dist}, 10) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id AND {a} AND {b})) WHERE "rank" <= {k})"""


@query("knn_join", f"WITH {EMB}, {knn_sql(10, f'1e0 - {SIM}')} SELECT * FROM nn", r="distance", digits=8)
def _(t):
    e = t.embeddings
    return neighbours.knn_join(e, e, ref_id="vec_id", query_id="vec_id", vector="embedding", k=10, exclude_self=True)


@query(
    "knn_mean_distance",
    f"WITH {EMB}, {knn_sql(10, 'list_distance(a.v, b.v)', 'a.vec_id % 2 = 1', 'b.vec_id % 2 = 0')} SELECT vec_id, avg(distance) AS knn_distance FROM nn GROUP BY 1",
    r="knn_distance",
)
def _(t):
    e = t.embeddings
    return neighbours.knn_mean_distance(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), ref_id="vec_id", query_id="vec_id", vector="embedding")


@query(
    "knn_summary",
    f"""WITH {EMB}, {knn_sql(20, f'1e0 - {SIM}')} SELECT nn.vec_id, min(distance) AS top_distance, quantile_cont(distance, 0.5) AS median_distance, quantile_cont(CAST(label AS DOUBLE), 0.5) AS knn_label_med,
quantile_cont(CAST(label AS DOUBLE), 0.25) AS knn_label_p25, quantile_cont(CAST(label AS DOUBLE), 0.75) AS knn_label_p75, quantile_cont(CAST(label AS DOUBLE), 0.75) - quantile_cont(CAST(label AS DOUBLE), 0.25) AS knn_label_iqr,
stddev_pop(label) AS knn_label_std FROM nn JOIN e ON nn.neighbour = e.vec_id GROUP BY 1""",
    r="top_distance median_distance knn_label_med knn_label_p25 knn_label_p75 knn_label_iqr knn_label_std",
)
def _(t):
    e = t.embeddings
    near = neighbours.knn_join(e, e, ref_id="vec_id", query_id="vec_id", vector="embedding", k=20, exclude_self=True)
    return neighbours.knn_summary(near, e, query_id="vec_id", label_id="vec_id", columns=["label"])


@query(
    "support_gate",
    f"""WITH {EMB}, {knn_sql(10, 'list_distance(a.v, b.v)', 'a.vec_id % 3 = 1', 'b.vec_id % 3 = 0', 'val')}, {knn_sql(10, 'list_distance(a.v, b.v)', 'a.vec_id % 3 = 2', 'b.vec_id % 3 = 0', 'app')},
lim AS (SELECT quantile_cont(d, 0.9) AS threshold FROM (SELECT avg(distance) AS d FROM val GROUP BY vec_id))
SELECT vec_id, avg(distance) AS knn_distance, any_value(threshold) AS threshold, avg(distance) > any_value(threshold) AS latent_support_flag FROM app, lim GROUP BY 1""",
    r="knn_distance threshold",
)
def _(t):
    e = t.embeddings
    return neighbours.support_gate(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 = 1"), e.where("vec_id % 3 = 2"), key="vec_id", vector="embedding", quantile=0.9)
