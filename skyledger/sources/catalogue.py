"""Scans, contracts and sinks of catalogue tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skyledger.sources.publish import ChunkedRun
from skyledger.functions.nulls import nan_to_null


def scan_catalogue(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Column-pruned Parquet read with NaN and infinities as NULL.

    ``where`` is applied to the stored values, so the reader can skip row groups.
    """
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return nan_to_null(df.select(*columns) if columns else df)


def scan_aliased(
    spark: SparkSession, path: str, wanted: Sequence[str], aliases: Mapping[str, str], derived: Mapping[str, Column] | None = None
) -> DataFrame:
    """Read wanted columns under their aliases, case-insensitively; absent ones are derived or raise."""
    df = spark.read.parquet(path)
    actual = {c.lower(): c for c in df.columns}
    derived = derived or {}
    found, absent = {}, []
    for name in wanted:
        for candidate in (name, aliases.get(name, name)):
            if candidate.lower() in actual:
                found[name] = F.col(actual[candidate.lower()])
                break
        else:
            if name not in derived:
                absent.append(name)
    if absent:
        raise KeyError(f"columns not found: {absent}")
    out = nan_to_null(df.select(*[c.alias(n) for n, c in found.items()]))
    return out.withColumns({n: derived[n] for n in wanted if n not in found}).select(*wanted)


def scan_parent(spark: SparkSession, path: str, schema: T.StructType, allowed: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Read a parent table with a declared schema, allowed columns only."""
    unknown = [c for c in columns or [] if c not in allowed]
    if unknown:
        raise KeyError(f"columns not allowed: {unknown}")
    return nan_to_null(spark.read.schema(schema).parquet(path).select(*(columns or allowed)))


def load_training_arrays(df: DataFrame, features: Sequence[str], labels: Sequence[str], errors: Sequence[str], key: str) -> DataFrame:
    """Key, feature array, label array and label-error array in declared order."""

    def pack(cols: Sequence[str]) -> Column:
        return F.array(*[F.col(c).cast("double") for c in cols])

    return df.select(key, pack(features).alias("features"), pack(labels).alias("labels"), pack(errors).alias("label_errors"))


def scan_chunks(spark: SparkSession, path: str, columns: Sequence[str], max_bytes: str = "128m") -> DataFrame:
    """Bounded chunks of a table: its input partitions, numbered in column ``chunk``.

    The bound is a reader option, so the session keeps its own.
    """
    return spark.read.option("maxPartitionBytes", max_bytes).parquet(path).select(*columns).withColumn("chunk", F.spark_partition_id())


def detect_input_schema(columns: Sequence[str], scaled: Sequence[str], raw: Sequence[str]) -> str:
    has_scaled, has_raw = set(scaled) <= set(columns), set(raw) <= set(columns)
    if has_scaled == has_raw:
        raise ValueError("both conventions present" if has_scaled else "neither convention present")
    return "zscored" if has_scaled else "raw"


@dataclass(frozen=True)
class Contract:
    """Declared columns of a table, with types and fixed array lengths."""

    required: Mapping[str, str]
    optional: Mapping[str, str] = None
    array_length: Mapping[str, int] = None
    version: int = 1

    def missing(self, df: DataFrame) -> list[str]:
        return [c for c in self.required if c not in df.columns]

    def length_violations(self, df: DataFrame) -> DataFrame:
        """One row: arrays of the wrong length per array column."""
        return df.agg(
            *[F.count_if(F.coalesce(F.size(c) != n, F.lit(True))).alias(c) for c, n in (self.array_length or {}).items()]
        )

    def validate(self, df: DataFrame, check_arrays: bool = False) -> DataFrame:
        absent = self.missing(df)
        if absent:
            raise KeyError(f"required columns missing: {absent}")
        wrong = {c: t for c, t in self.required.items() if df.schema[c].dataType.simpleString() != t}
        if wrong:
            raise TypeError(f"columns of another type: {wrong}")
        if check_arrays and self.array_length:
            bad = {k: v for k, v in self.length_violations(df).first().asDict().items() if v}
            if bad:
                raise ValueError(f"arrays of the wrong length: {bad}")
        return df


def cast_storage(df: DataFrame, integers: Mapping[str, str] | None = None) -> DataFrame:
    """Doubles to floats for storage, selected integers to narrower types."""
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    casts.update({c: F.col(c).cast(t) for c, t in (integers or {}).items()})
    return df.withColumns(casts) if casts else df


def rename_labels(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise KeyError(f"cannot rename, missing: {absent}")
    return df.withColumnsRenamed(dict(names))


def project_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def annotate_metadata(df: DataFrame, notes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Attach unit, UCD and description; the Parquet schema keeps them."""
    return df.select(*[F.col(c).alias(c, metadata=dict(notes[c])) if c in notes else F.col(c) for c in df.columns])


def metadata_table(df: DataFrame) -> DataFrame:
    """The annotations as a long table, one row per column and note."""
    rows = [(f.name, k, str(v)) for f in df.schema.fields for k, v in (f.metadata or {}).items()]
    return df.sparkSession.createDataFrame(rows, "column string, note string, text string")


def select_columns(df: DataFrame, match: Sequence[str] = (), exact: Sequence[str] = (), regex: str | None = None) -> list[str]:
    hit = [c for c in df.columns if any(m.lower() in c.lower() for m in match) or c in exact]
    return hit + [c for c in df.columns if regex and re.search(regex, c) and c not in hit]


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: nulls, null share, minimum, maximum and mean of numbers; one pass."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        number = F.col(c).cast("double") if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c].simpleString()).alias("dtype"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                F.min(number).alias("min"),
                F.max(number).alias("max"),
                F.avg(number).alias("mean"),
            ).alias(f"s_{c}")
        )
    wide = df.agg(*aggs)
    long = wide.select("__n", F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s"))
    return long.select("s.*", F.coalesce(F.try_divide(F.col("s.n_null"), F.col("__n")), F.lit(0.0)).alias("null_frac"))


def write_atomic(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """One distributed write; the commit protocol publishes it as a whole."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_incremental(parts: Sequence[DataFrame], path: str, run: str | None = None) -> DataFrame:
    """Chunk outputs one after the other, published together at the end; see ``publish.ChunkedRun``.

    With the name of a ``run`` that was stopped, chunks it finished are not computed again.
    """
    out = ChunkedRun(parts[0].sparkSession, path, run)
    for number, part in enumerate(parts):
        out.write(f"{number:06d}", part)
    return out.close()


def write_partitioned(df: DataFrame, path: str, by: str, *, rows_per_group: int = 25_000, level: int = 10) -> DataFrame:
    """Partitioned zstd release; REBALANCE lets AQE split a bin that holds most rows.

    Files are sized by bytes (the session's advisory partition size) and hold
    row groups of at most ``rows_per_group``, so a bin of any size stays a few
    files per task and can be read in parts. Returns the manifest: rows per partition.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .partitionBy(by)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", str(level))
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path).groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
