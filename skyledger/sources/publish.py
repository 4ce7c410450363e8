"""Results that appear as a whole: versions in folders of their own, and a mark for each that is complete.

Under a result's root every version has a folder. An empty file in
``_published``, made after the version is complete, names it; readers take the
version of the last mark, so nobody sees a version that is still being written,
and a run that is killed leaves the one before it in place. All files are
reached through Hadoop's file systems, so the root can be in any store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MARKS = "_published"
STAGING = "_staging"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder in order, none if it is not there."""
    fs, place = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def put(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file, complete when it has its name: written under another and renamed."""
    fs, place = _place(spark, path)
    aside = place.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(place, False)
    if not fs.rename(aside, place):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def published(spark: SparkSession, root: str) -> str | None:
    """Folder of the last complete version."""
    marks = [n for n in names_in(spark, f"{root}/{MARKS}") if not n.endswith(".tmp")]
    return f"{root}/{marks[-1]}" if marks else None


def publish(spark: SparkSession, root: str, version: str, keep: int = 2) -> None:
    """Mark a complete version; of the older ones only ``keep`` - 1 stay, for those who still read them."""
    put(spark, f"{root}/{MARKS}/{version}")
    for old in [n for n in names_in(spark, f"{root}/{MARKS}") if not n.endswith(".tmp")][:-keep]:
        remove(spark, f"{root}/{MARKS}/{old}")
        remove(spark, f"{root}/{old}")


def write_version(df: DataFrame, root: str, order: int) -> None:
    """``df`` as the version ``order``; of several attempts at one order the last mark counts."""
    version = f"v{order:015d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    publish(df.sparkSession, root, version)


def read_published(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The last complete version; with a ``schema`` an empty table where nothing is published yet."""
    folder = published(spark, root)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(f"nothing is published in {root}")
        return spark.createDataFrame([], schema)
    return spark.read.option("mergeSchema", "true").parquet(folder)


class ChunkedRun:
    """A result written chunk by chunk and published at close.

    Chunks go to a staging folder of the run, each with a mark when it is
    complete; a run that is opened again under its name skips them. ``close``
    writes the manifest (chunks and their rows), moves the folder to its place
    with one rename and publishes it, so chunks of earlier runs do not stay and
    a reader meets all chunks or none.
    """

    def __init__(self, spark: SparkSession, root: str, run: str | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.run = run or uuid.uuid4().hex
        self.staging = f"{self.root}/{STAGING}/{self.run}"

    def done(self) -> list[str]:
        """Complete chunks, in order of their names."""
        return [n for n in names_in(self.spark, f"{self.staging}/_done") if not n.endswith(".tmp")]

    def write(self, chunk: str, df: DataFrame) -> bool:
        """Compute and stage a chunk; False if an earlier attempt at this run has it."""
        if chunk in self.done():
            return False
        df.write.mode("overwrite").parquet(f"{self.staging}/chunk={chunk}")
        put(self.spark, f"{self.staging}/_done/{chunk}")
        return True

    def close(self) -> DataFrame:
        """Publish what is staged and return it."""
        chunks, staged = self.done(), f"{self.staging}/"
        if not chunks:
            raise ValueError("no chunk was written")
        for name in names_in(self.spark, self.staging):
            if name.startswith("chunk=") and name.removeprefix("chunk=") not in chunks:
                remove(self.spark, staged + name)
        counted = self.spark.read.option("mergeSchema", "true").option("basePath", self.staging).parquet(*[f"{staged}chunk={c}" for c in chunks])
        rows = {r["at"]: r["n"] for r in counted.groupBy(F.regexp_extract(F.input_file_name(), "chunk=([^/]+)/", 1).alias("at")).agg(F.count("*").alias("n")).collect()}
        put(self.spark, f"{staged}_manifest.json", json.dumps({"run": self.run, "chunks": [{"chunk": c, "rows": rows.get(c, 0)} for c in chunks]}))
        last = published(self.spark, self.root)
        order = int(last.rsplit("/", 1)[1].split("-")[0][1:]) + 1 if last else 0
        version = f"v{order:015d}-{self.run}"
        fs, place = _place(self.spark, self.staging)
        if not fs.rename(place, _place(self.spark, f"{self.root}/{version}")[1]):
            raise OSError(f"cannot publish {self.staging}")
        publish(self.spark, self.root, version)
        return read_published(self.spark, self.root).drop("chunk")

    @staticmethod
    def manifest(spark: SparkSession, root: str) -> dict:
        """The manifest of what is published."""
        return json.loads(read_text(spark, f"{published(spark, root)}/_manifest.json"))
