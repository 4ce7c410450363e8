"""Catalogue-shaped views of the given tables, as DataFrames and as SQL text.

``stars`` gives each order a sky position, distance, magnitudes and parameters
computed from its own keys and price; ``preds`` adds predictions, errors and
truth; ``obs`` is lineitem as repeated measurements of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.bindings.registry import Tables

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
IDS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def md5_sql(seed, *cols: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


def uniform_sql(seed, *cols: str) -> str:
    return f"((CAST(concat('0x', substr({md5_sql(seed, *cols)}, 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0)"


def replica_uniform_sql(seed, replica: str, *cols: str) -> str:
    """(a + r b) mod 2**32 as a number in (0, 1); a and b are 32 bits each of one hash, b odd."""
    half = lambda first: f"CAST(concat('0x', substr({md5_sql(seed, *cols)}, {first}, 8)) AS BIGINT)"
    return f"((({half(1)} + {replica} * ({half(9)} | 1)) % 4294967296 + 0.5e0) / 4294967296e0)"


STARS = """stars AS (
SELECT *, 360e0*u1 AS ra, 180e0*u2 - 90e0 AS "dec", o_totalprice/100e0 AS dist_pc, 9e0 + 9e0*u3 AS g_mag,
  CASE WHEN source_id % 13 <> 0 THEN 0.1e0 + 3.4e0*u1 END AS bp_rp,
  CAST(CASE source_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 31 ELSE 95 END AS INTEGER) AS sol,
  CASE WHEN source_id % 19 <> 0 THEN 3300e0 + 3000e0*u2 END AS teff, 4.6e0*u1 AS logg, 3e0*u3 - 2.4e0 AS mh,
  0.4e0*u2 - 0.05e0 AS alpha_m,
  CASE WHEN source_id % 17 <> 0 THEN 1000e0/(o_totalprice/100e0) - CASE WHEN source_id % 11 = 0 THEN 1e0 ELSE 0e0 END END AS parallax,
  0.02e0 + 0.3e0*u3 AS parallax_error, 200e0*u1 AS snr, CAST(CASE WHEN source_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS flag_bad
FROM (SELECT o_orderkey AS source_id, o_custkey AS cust, o_totalprice, o_orderstatus, o_orderpriority,
  (o_orderkey*7919 % 10007)/10007e0 AS u1, (o_orderkey*104729 % 10009)/10009e0 AS u2,
  ((o_custkey*15013 + o_orderkey*31) % 10037)/10037e0 AS u3 FROM orders))"""


def stars(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = t.orders.select(
        k.alias("source_id"), c.alias("cust"), "o_totalprice", "o_orderstatus", "o_orderpriority",
        (k * 7919 % 10007 / 10007.0).alias("u1"),
        (k * 104729 % 10009 / 10009.0).alias("u2"),
        ((c * 15013 + k * 31) % 10037 / 10037.0).alias("u3"),
    )
    s, u1, u2, u3 = F.col("source_id"), F.col("u1"), F.col("u2"), F.col("u3")
    d = F.col("o_totalprice") / 100.0
    return base.select(
        "*",
        (360.0 * u1).alias("ra"),
        (180.0 * u2 - 90.0).alias("dec"),
        d.alias("dist_pc"),
        (9.0 + 9.0 * u3).alias("g_mag"),
        F.when(s % 13 != 0, 0.1 + 3.4 * u1).alias("bp_rp"),
        F.when(s % 3 == 0, 3).when(s % 3 == 1, 31).otherwise(95).alias("sol"),
        F.when(s % 19 != 0, 3300.0 + 3000.0 * u2).alias("teff"),
        (4.6 * u1).alias("logg"),
        (3.0 * u3 - 2.4).alias("mh"),
        (0.4 * u2 - 0.05).alias("alpha_m"),
        F.when(s % 17 != 0, 1000.0 / d - F.when(s % 11 == 0, 1.0).otherwise(0.0)).alias("parallax"),
        (0.02 + 0.3 * u3).alias("parallax_error"),
        (200.0 * u1).alias("snr"),
        F.when(s % 10 == 0, 1).otherwise(0).alias("flag_bad"),
    )


ELEMENTS = ("teff", "logg", "mh", "alpha_m", "mg_h")
PREDS = f"""{STARS}, preds AS (
SELECT source_id, ra, "dec", g_mag, dist_pc, u1, u2, u3, parallax, parallax_error,
  3300e0 + 3000e0*u2 AS teff_truth, 4.6e0*u1 AS logg_truth, 3e0*u3 - 2.4e0 AS mh_truth, 0.4e0*u2 - 0.05e0 AS alpha_m_truth, 2e0*u3 - 1.5e0 AS mg_h_truth,
  CASE WHEN source_id % 23 <> 0 THEN 3300e0 + 3000e0*u2 + 120e0*(u3 - 0.5e0) END AS teff_pred, 4.6e0*u1 + 0.4e0*(u2 - 0.5e0) AS logg_pred,
  3e0*u3 - 2.4e0 + 0.2e0*(u1 - 0.5e0) AS mh_pred, 0.4e0*u2 - 0.05e0 + 0.08e0*(u3 - 0.5e0) AS alpha_m_pred,
  CASE WHEN source_id % 27 <> 0 THEN 2e0*u3 - 1.5e0 + 0.3e0*(u2 - 0.5e0) END AS mg_h_pred,
  40e0 + 160e0*u1 AS teff_sigma, 0.05e0 + 0.35e0*u3 AS logg_sigma, 0.03e0 + 0.2e0*u2 AS mh_sigma, 0.01e0 + 0.05e0*u1 AS alpha_m_sigma, 0.05e0 + 0.2e0*u1 AS mg_h_sigma,
  source_id % 29 = 0 AS ood_joint_flag, CAST(CASE WHEN source_id % 7 = 0 THEN 1 WHEN source_id % 7 = 1 THEN NULL ELSE 0 END AS INTEGER) AS label_extrapolation_flag,
  source_id % 31 = 0 AS kin_ood_flag
FROM stars)"""


def preds(t: Tables) -> DataFrame:
    s, u1, u2, u3 = F.col("source_id"), F.col("u1"), F.col("u2"), F.col("u3")
    return stars(t).select(
        "source_id", "ra", "dec", "g_mag", "dist_pc", "u1", "u2", "u3", "parallax", "parallax_error",
        (3300.0 + 3000.0 * u2).alias("teff_truth"),
        (4.6 * u1).alias("logg_truth"),
        (3.0 * u3 - 2.4).alias("mh_truth"),
        (0.4 * u2 - 0.05).alias("alpha_m_truth"),
        (2.0 * u3 - 1.5).alias("mg_h_truth"),
        F.when(s % 23 != 0, 3300.0 + 3000.0 * u2 + 120.0 * (u3 - 0.5)).alias("teff_pred"),
        (4.6 * u1 + 0.4 * (u2 - 0.5)).alias("logg_pred"),
        (3.0 * u3 - 2.4 + 0.2 * (u1 - 0.5)).alias("mh_pred"),
        (0.4 * u2 - 0.05 + 0.08 * (u3 - 0.5)).alias("alpha_m_pred"),
        F.when(s % 27 != 0, 2.0 * u3 - 1.5 + 0.3 * (u2 - 0.5)).alias("mg_h_pred"),
        (40.0 + 160.0 * u1).alias("teff_sigma"),
        (0.05 + 0.35 * u3).alias("logg_sigma"),
        (0.03 + 0.2 * u2).alias("mh_sigma"),
        (0.01 + 0.05 * u1).alias("alpha_m_sigma"),
        (0.05 + 0.2 * u1).alias("mg_h_sigma"),
        (s % 29 == 0).alias("ood_joint_flag"),
        F.when(s % 7 == 0, 1).when(s % 7 != 1, 0).alias("label_extrapolation_flag"),
        (s % 31 == 0).alias("kin_ood_flag"),
    )


# residuals of lineitem prices against part prices, in thousands
RESID = f"""resid AS (
SELECT {IDS_SQL}, l_returnflag AS label, l_linestatus AS catalogue, l_quantity AS x, p_size AS size,
  CASE WHEN l_quantity < 15 THEN 'bright' WHEN l_quantity < 35 THEN 'intermediate' ELSE 'faint' END AS mag_bin,
  l_extendedprice/1000e0 AS pred, p_retailprice*l_quantity/1000e0 AS ref, 15e0 + 300e0*l_discount AS sigma, 100e0*l_tax AS sigma_ref,
  l_extendedprice/1000e0 - p_retailprice*l_quantity/1000e0 AS d
FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def resid(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    li = t.lineitem.select(*IDS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    part = t.part.select("p_partkey", "p_size", "p_retailprice")
    pred, ref = F.col("l_extendedprice") / 1000.0, F.col("p_retailprice") * q / 1000.0
    return li.join(part, li.l_partkey == part.p_partkey).select(
        *IDS,
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("catalogue"),
        q.alias("x"),
        F.col("p_size").alias("size"),
        F.when(q < 15, "bright").when(q < 35, "intermediate").otherwise("faint").alias("mag_bin"),
        pred.alias("pred"),
        ref.alias("ref"),
        (15.0 + 300.0 * F.col("l_discount")).alias("sigma"),
        (100.0 * F.col("l_tax")).alias("sigma_ref"),
        (pred - ref).alias("d"),
    )
