"""Resumable batch work as Structured Streaming over files.

Each query processes what is new and stops (``availableNow``); progress lives in
a checkpoint on shared storage, so a lost driver or executor repeats at most one
micro-batch and never publishes it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.operators.ranking import first_per_key, join_on_keys
from skyledger.session import work_folder
from skyledger.sources.publish import read_published, write_version


def stream_table(spark: SparkSession, folder: str, name: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from the files already there."""
    path = f"{folder.rstrip('/')}/{name}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", name)
    return reader.parquet(folder)


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def score_incremental(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Score every new batch with frozen statistics (stateless) and append the output."""
    _finish(score(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return stream.sparkSession.read.parquet(out)


def running_counters(stream: DataFrame, keys: Sequence[str], counters: dict[str, Column], out: str, checkpoint: str) -> DataFrame:
    """Flag counters accumulated over batches; the sink holds the latest totals.

    Each batch writes a version of its own and then publishes it, so a batch
    that fails leaves the totals before it to be read.
    """
    totals = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    _finish(totals.writeStream.outputMode("complete").foreachBatch(lambda batch, number: write_version(batch, out, number)).option("checkpointLocation", checkpoint))
    return read_published(stream.sparkSession, out, totals.schema)


def dedup_incremental(stream: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, checkpoint: str, *, time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key, whenever it comes; keys already published are skipped, however old they are.

    A micro-batch is reduced to one row per key (``order`` decides) and
    anti-joined with the keys published by other batches. It overwrites its own
    folder, so repeating a batch changes nothing. NULL keys count as equal.

    With ``time`` and ``delay`` the memory is bounded instead: rows later than
    the watermark are dropped, and a key may come back once it has passed it.
    """
    spark, names = stream.sparkSession, list(keys)
    if delay is not None:
        fresh = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
        _finish(fresh.dropDuplicatesWithinWatermark(names).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
        return spark.read.parquet(out)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def publish(batch: DataFrame, batch_id: int) -> None:
        first = first_per_key(batch, names, order)
        held = spark.read.parquet(out).where(F.col("batch") != batch_id).select(names)
        join_on_keys(first, held, names, "left_anti").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _finish(stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint))
    return spark.read.parquet(out).drop("batch")


def checkpointed_compute(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Each micro-batch overwrites its own folder, so repeating it changes nothing."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _finish(stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint))
    return stream.sparkSession.read.parquet(out).drop("batch")


def folders(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Output and checkpoint folders for one run."""
    base = work_folder(spark, purpose)
    return f"{base}/out", f"{base}/checkpoint"
