"""Lineage records, frozen statistics and their fingerprints."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

FROZEN_SCHEMA = "fingerprint string, n_rows long, bands map<string, struct<mean: array<double>, sigma: array<double>>>"

#: name of the note that columns carry
STATS_MARK = "stats_fingerprint"


def write_with_lineage(
    df: DataFrame, cuts: Mapping[str, Column], path: str, *, sources: Sequence[str], corrections: Sequence[str] = (), seed: int | None = None, extra: Mapping[str, str] | None = None
) -> DataFrame:
    """Apply cuts, write the result, and write a one-row record beside it.

    Row counts are observed while the rows stream through the write.
    """
    before, after = Observation("before"), Observation("after")
    out = df.observe(before, F.count(F.lit(1)).alias("n"))
    for cond in cuts.values():
        out = out.where(cond)
    out.observe(after, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    record = lineage_record(
        df.sparkSession, path, sources, list(cuts), corrections, before.get["n"], after.get["n"], seed, extra
    )
    record.write.mode("overwrite").json(path.rstrip("/") + ".lineage")
    return record


def lineage_record(
    spark: SparkSession, output: str, sources: Sequence[str], cuts: Sequence[str], corrections: Sequence[str], rows_before: int, rows_after: int, seed: int | None = None, extra: Mapping[str, str] | None = None
) -> DataFrame:
    schema = (
        "output string, sources array<struct<kind: string, location: string>>, cuts array<string>, corrections array<string>, "
        "rows_before long, rows_after long, seed long, extra map<string, string>"
    )
    src = [("local", s) for s in sources]
    row = (output, src, list(cuts), list(corrections), rows_before, rows_after, seed, dict(extra or {}))
    return spark.createDataFrame([row], schema)


def mark_fingerprint(df: DataFrame, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Note on columns (all, unless named) with which frozen statistics they were made.

    The note is column metadata: it goes through selections and joins, and
    Parquet keeps it with the schema.
    """
    for c in columns or df.columns:
        df = df.withMetadata(c, {**df.schema[c].metadata, STATS_MARK: value})
    return df


def marked_fingerprint(df: DataFrame) -> str | None:
    """The fingerprint noted on the columns; None if there is none, an error if there are several."""
    found = {f.metadata[STATS_MARK] for f in df.schema if STATS_MARK in f.metadata}
    if len(found) > 1:
        raise ValueError(f"columns made with different statistics: {sorted(found)}")
    return next(iter(found), None)


def release_sidecar(df: DataFrame, tier: str, gates: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Tier counts, gates in force, added columns and, if one is noted on the columns, the statistics' fingerprint as one JSON text."""
    noted = marked_fingerprint(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(tier) == t).alias(f"tier{t}") for t in (1, 2, 3)],
    )
    return counts.select(
        F.to_json(
            F.struct(
                "n_rows",
                F.struct("tier1", "tier2", "tier3").alias("counts"),
                F.array(*[F.lit(g) for g in gates]).alias("gates"),
                F.array(*[F.lit(a) for a in added]).alias("columns_added"),
                *([F.lit(noted).alias(STATS_MARK)] if noted else []),
            )
        ).alias("sidecar")
    )


def freeze_stats(df: DataFrame, vectors: Mapping[str, str]) -> DataFrame:
    """Element-wise mean and sample sigma per vector band as one JSON text."""
    parts = []
    for band, col in vectors.items():
        stats = df.select(F.posexplode(F.col(col).cast("array<double>")).alias("pos", "v")).groupBy("pos").agg(
            F.avg("v").alias("m"), F.stddev_samp("v").alias("s")
        )
        ordered = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("l"))
        parts.append(ordered.select(F.lit(band).alias("band"), F.col("l.m").alias("mean"), F.col("l.s").alias("sigma")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bands = out.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", F.struct("mean", "sigma"))))).alias("bands"))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return bands.select(F.to_json(F.struct(fingerprint(F.col("bands")).alias("fingerprint"), n.alias("n_rows"), "bands")).alias("stats"))


def fingerprint(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


def load_frozen_stats(text: DataFrame, column: str, length: int) -> DataFrame:
    """Parse frozen statistics; a band of the wrong length or with sigma <= 0 raises."""
    parsed = text.select(F.from_json(column, FROZEN_SCHEMA).alias("s")).select("s.*")
    bad = F.exists(F.map_values("bands"), lambda b: (F.size(b["mean"]) != length) | (F.size(b["sigma"]) != length) | F.exists(b["sigma"], lambda x: ~(x > 0)))
    stop = F.raise_error(F.lit("frozen statistics: wrong length or sigma not positive"))
    return parsed.withColumn("fingerprint", F.when(F.coalesce(bad, F.lit(True)), stop.cast("string")).otherwise(F.col("fingerprint")))


def verify_fingerprint(stats: DataFrame, expected: Column | str) -> DataFrame:
    """Raise when the basis hash differs from the expected one."""
    exp = F.lit(expected) if isinstance(expected, str) else expected
    stop = F.raise_error(F.concat(F.lit("basis fingerprint differs: "), F.col("fingerprint"))).cast("string")
    return stats.withColumn("fingerprint", F.when(F.col("fingerprint") == exp, F.col("fingerprint")).otherwise(stop))


def drift_check(df: DataFrame, columns: Mapping[str, tuple[float, float]], *, mean_tol: float = 0.05, ratio_tol: float = 0.1) -> DataFrame:
    """Mean drift and sigma ratio of log10 values against frozen (mean, sigma), with the verdict."""
    aggs = []
    for c, (m, s) in columns.items():
        x = F.when(F.col(c).isNotNull(), F.log10(F.greatest(F.col(c), F.lit(1e-30))))
        aggs += [F.abs(F.avg(x) - m).alias(f"{c}_drift"), (F.stddev_samp(x) / max(s, 1e-30)).alias(f"{c}_ratio")]
    out = df.agg(*aggs)
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(f"{c}_drift") <= mean_tol) & F.col(f"{c}_ratio").between(1 - ratio_tol, 1 + ratio_tol)
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))


