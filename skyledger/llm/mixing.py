"""Mixing sources to target weights by capped water-filling.

Each source asks for its share of the mix by weight. Sources that would exceed
``epochs`` times their size are clamped there; the excess is shared again among
the rest by weight, until none is above. Each document is then taken whole as
often as whole epochs fit, and a seeded order of the documents decides which
are taken once more; the document at the edge gives part of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from skyledger.llm.common import aside, table
from skyledger.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 7
#: leading hex digits of the seeded hash that cut a source into slots
SLOT_DIGITS = 4


def n_words(text) -> "F.Column":
    """Words between the white space of the contract, counted as starts of runs; null has none."""
    return F.coalesce(F.size(_words(text)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS, max_rounds: int = 10_000) -> DataFrame:
    """``sources`` (source, size, weight; one row a source) with ``target``. Each round reads two sums."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    budget = min(share, epochs) * total
    level = None  # target of an unclamped source for each unit of weight; it only rises
    for _ in range(max_rounds):
        cap = F.col("size") * float(epochs)
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        clamped, weight = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double")))).first()
        if not weight:
            break
        new = (budget - clamped) / weight
        if new == level:
            break
        level = max(new, level or 0.0)
    cap = F.col("size") * float(epochs)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def _words(text):
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def _order(key, seed: int):
    """Seeded order of the documents: the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def cursors(narrow: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """One row a source: its size, target, whole epochs, and the point of the seeded order up to which documents count once more.

    ``narrow`` is a stored table (source, size, _order). Sums by slot find the
    slot of that point; only the rows of those slots are put in order.
    """
    slot = F.substring("_order", 1, SLOT_DIGITS)
    slot_sums = cut_lineage(narrow.groupBy("source", slot.alias("_slot")).agg(F.sum("size").alias("n")))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = slot_sums.groupBy("source").agg(F.sum("n").alias("size"))
    sources = cut_lineage(sources.withColumn("weight", F.get(F.lit([float(w) for w in weights]), turn.cast("int"))))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    filled = water_fill(sources, share, epochs)
    filled = filled.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", whole.alias("_whole"), (F.round("target").cast("long") - whole * F.col("size")).alias("_extra"))
    by_slot = Window.partitionBy("source").orderBy("_slot")
    placed = slot_sums.withColumn("_before", F.sum("n").over(by_slot) - F.col("n"))
    at_edge = (F.col("_before") < F.col("_extra")) & (F.col("_extra") <= F.col("_before") + F.col("n"))
    edge_slot = placed.join(filled, placed["source"].eqNullSafe(filled["_s"])).where(at_edge).select(F.col("source").alias("_es"), F.col("_slot").alias("_eslot"), "_before", "_extra")
    # stored, so that Spark knows that this side is the small one and does not broadcast the rows
    edge_slot = cut_lineage(edge_slot)
    rows = narrow.withColumn("_slot", slot)
    rows = rows.join(edge_slot, rows["source"].eqNullSafe(edge_slot["_es"]) & (rows["_slot"] == edge_slot["_eslot"]))
    ties = rows.groupBy("_es", "_order", "size", "_before", "_extra").agg(F.count("*").alias("_k"))
    before = F.col("_before") + F.sum(F.col("size") * F.col("_k")).over(Window.partitionBy("_es").orderBy("_order", "size")) - F.col("size") * F.col("_k")
    ties = ties.withColumn("_at", before).where((F.col("_at") < F.col("_extra")) & (F.col("_extra") <= F.col("_at") + F.col("size") * F.col("_k")))
    point = ties.select("_es", F.col("_order").alias("_edge"), F.col("size").alias("_edge_size"), F.floor((F.col("_extra") - F.col("_at")) / F.col("_k")).cast("long").alias("_part"))
    found = filled.join(point, filled["_s"].eqNullSafe(point["_es"]), "left")
    return cut_lineage(found.select("_s", "source_size", "target", "_whole", "_edge", "_edge_size", "_part"))


def apply(rows: DataFrame, points: DataFrame) -> DataFrame:
    """``rows`` (with source, size, _order) with source_size, target and taken."""
    past = (F.col("_order") < F.col("_edge")) | ((F.col("_order") == F.col("_edge")) & (F.col("size") < F.col("_edge_size")))
    at = (F.col("_order") == F.col("_edge")) & (F.col("size") == F.col("_edge_size"))
    more = F.when(past, F.col("size")).when(at, F.col("_part")).otherwise(F.lit(0))
    met = rows.join(points, rows["source"].eqNullSafe(points["_s"]))
    return met.withColumn("taken", F.col("_whole") * F.col("size") + more).drop("_s", "_whole", "_edge", "_edge_size", "_part", "_order")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Sources in order of code point, null last, take the weights in turn. Null,
    empty and blank texts have size 0 and are taken 0 times. Rows that tie at
    the edge of a source, such as repeated rows, share its words evenly. A null
    key is ordered like the text "null". An empty table gives no rows. Further
    columns are ignored.
    """
    narrow = cut_lineage(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast(StringType()).alias("source"), n_words(F.col(text)).alias("size"), _order(F.col(key), seed).alias("_order")))
    return apply(narrow, cursors(narrow.select("source", "size", "_order"), weights, share, epochs))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("source")


OP4_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
src AS (
    SELECT source, source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
    FROM (SELECT source, sum(size)::DOUBLE AS source_size FROM docs GROUP BY source)),
fill AS (
    SELECT 0 AS round, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM src) AS level
    UNION ALL
    SELECT round + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (w * f.level >= 2 * source_size), 0)) / sum(w) FILTER (w * f.level < 2 * source_size) FROM src)
    FROM fill f WHERE round < 40 AND (SELECT count(*) FROM src WHERE w * f.level < 2 * source_size) > 0),
target AS (
    SELECT source, source_size, least(2 * source_size, w * (SELECT max(level) FROM fill)) AS target FROM src),
run AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
           count(*) OVER (PARTITION BY d.source, o, size) AS k, sum(d.size) OVER (PARTITION BY d.source ORDER BY o, size RANGE UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM docs d JOIN target t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(size, floor((round(target)::BIGINT - whole * source_size::BIGINT - (upto - size * k)) / k))))::BIGINT AS taken
FROM run
"""


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    Of the document at a source's edge the part that is taken is its leading
    words, joined by one space. Texts without words stay once, since they cost
    the mix nothing.
    """
    inner, back = aside(docs, {"size", "source_size", "target", "taken", "_order", "_words", "_s", "_whole", "_edge", "_edge_size", "_part"})
    points = cursors(cut_lineage(inner.select("source", n_words(F.col("text")).alias("size"), _order(F.col("doc_id"), SEED).alias("_order"))), WEIGHTS, SHARE, EPOCHS)
    taken = apply(inner.withColumns({"size": n_words(F.col("text")), "_order": _order(F.col("doc_id"), SEED)}), points)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    text = F.when(F.col("_words") > 0, F.array_join(F.slice(_words(F.col("text")), F.lit(1), F.greatest(F.lit(1), F.col("_words").cast("int"))), " ")).otherwise(F.col("text"))
    rows = taken.withColumn("_words", F.explode(copies)).withColumn("text", text)
    return back(rows.withColumn("n_chars", F.when(F.col("_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))
