"""Queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None, r: str = "", digits: int = 6, i: str = ""):
    """Register ``fn(tables) -> DataFrame``.

    Columns named in ``r`` are rounded and those in ``i`` made BIGINT on both sides.
    """
    rounded, ints = r.split(), i.split()

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(tune(spark), folder))
            # as SQL engines round doubles; F.round with digits goes through the decimal text and parts at ties
            scale = float(10**digits)
            casts = {c: F.round(F.col(c).cast("double") * scale) / scale + 0.0 for c in rounded}
            casts.update({c: F.col(c).cast("long") for c in ints})
            return df.withColumns(casts) if casts else df

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            repl = [f"round(CAST({c} AS DOUBLE), {digits}) + 0e0 AS {c}" for c in rounded]
            repl += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql})" if repl else sql
        return fn

    return register
