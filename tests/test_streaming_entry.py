from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyledger.session import work_folder
from skyledger.streaming import incremental as inc


def test_incremental_scoring_resumes(spark):
    src = work_folder(spark, "src")
    out, check = inc.folders(spark, "t")

    def score(d):
        return d.select("id", (F.col("id") * 2).alias("s"))

    spark.range(5).write.parquet(src)
    inc.score_incremental(inc.stream_table(spark, src), score, out, check)
    spark.range(5, 8).write.mode("append").parquet(src)
    got = inc.score_incremental(inc.stream_table(spark, src), score, out, check)
    assert sorted(r.id for r in got.collect()) == list(range(8))


def test_checkpointed_compute_publishes_once(spark):
    src = work_folder(spark, "src")
    out, check = inc.folders(spark, "t")
    spark.range(10).write.parquet(src)
    for _ in range(2):
        got = inc.checkpointed_compute(inc.stream_table(spark, src), lambda d: d, out, check)
    assert got.count() == 10


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert 1 <= df.count() <= 3 and "mean_teff_pred" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) > 260 and set(sql) <= set(qs)


def test_incremental_dedup_keeps_late_new_keys_and_skips_old_ones(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from skyledger.streaming import incremental as inc

    source = str(tmp_path / "in")
    days = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 3, 1)), (1, datetime(2024, 3, 2)), (3, datetime(2024, 1, 2)), (None, datetime(2024, 1, 3)), (None, datetime(2024, 1, 4))]
    for row in days:
        spark.createDataFrame([row], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = inc.stream_table(spark, source, max_files=1)
    out = inc.dedup_incremental(stream, ["id"], [F.col("ts")], str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted(((r.id is None, r.id), r.ts.day, r.ts.month) for r in out.collect())
    assert [g[0][1] for g in got] == [1, 2, 3, None]


def test_chunks_append_once_and_releases_have_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from skyledger.sources import catalogue as cat

    parts = [spark.range(10), spark.range(10, 15)]
    for _ in range(2):  # repeating the run adds nothing
        assert sorted(r.id for r in cat.write_incremental(parts, str(tmp_path / "inc")).collect()) == list(range(15))
    assert cat.write_incremental([spark.range(10), spark.range(20, 21)], str(tmp_path / "inc")).count() == 11
    rows = spark.range(7000).selectExpr("id", "id % 2 as b")
    assert {r.b: r.n_rows for r in cat.write_partitioned(rows, str(tmp_path / "rel"), "b", rows_per_group=1000).collect()} == {0: 3500, 1: 3500}
    sizes = [m.row_group(k).num_rows for f in glob.glob(f"{tmp_path}/rel/*/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert max(sizes) <= 1000 and sum(sizes) == 7000


def test_failed_batch_leaves_the_totals_before_it(spark):
    import pytest

    from skyledger.sources.publish import names_in, read_published

    src = work_folder(spark, "src")
    out, check = inc.folders(spark, "t")
    spark.range(1, 5).write.parquet(src)
    count = lambda: inc.running_counters(inc.stream_table(spark, src), [], {"n_odd": (F.when(F.col("id") > 90, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long") % 2) == 1}, out, check)
    assert [tuple(r) for r in count().collect()] == [(4, 2)]
    spark.range(100, 101).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        count()
    assert [tuple(r) for r in read_published(spark, out).collect()] == [(4, 2)]
    assert len(names_in(spark, f"{out}/_published")) == 1


def test_totals_keep_few_versions(spark):
    from skyledger.sources.publish import names_in

    src = work_folder(spark, "src")
    out, check = inc.folders(spark, "t")
    for k in range(4):
        spark.range(k, k + 1).write.mode("append").parquet(src)
        got = inc.running_counters(inc.stream_table(spark, src), [], {"n_odd": F.col("id") % 2 == 1}, out, check)
        assert got.first().n_rows == k + 1
    assert len(names_in(spark, f"{out}/_published")) == 2 and len([n for n in names_in(spark, out) if n.startswith("v")]) == 2


def test_chunks_appear_together_and_a_stopped_run_goes_on(spark):
    import pytest

    from skyledger.sources import catalogue as cat
    from skyledger.sources.publish import ChunkedRun, read_published

    root = work_folder(spark, "chunks")
    first = ChunkedRun(spark, root, "a")
    assert first.write("0", spark.range(3))
    with pytest.raises(FileNotFoundError):
        read_published(spark, root)
    # stopped here: the run is opened again, and only what is missing is computed
    again = ChunkedRun(spark, root, "a")
    assert not again.write("0", spark.range(99)) and again.write("1", spark.range(3, 8))
    assert sorted(r.id for r in again.close().collect()) == list(range(8))
    assert [(c["chunk"], c["rows"]) for c in ChunkedRun.manifest(spark, root)["chunks"]] == [("0", 3), ("1", 5)]
    # a run that is killed in a chunk leaves the result before it, and a shorter one replaces all of it
    killed = ChunkedRun(spark, root, "b")
    killed.write("0", spark.range(50))
    spark.range(7).write.parquet(f"{killed.staging}/chunk=1")
    assert read_published(spark, root).count() == 8
    assert ChunkedRun(spark, root, "b").close().count() == 50
    assert sorted(r.id for r in cat.write_incremental([spark.range(2)], root).collect()) == [0, 1]
    with pytest.raises(ValueError):
        ChunkedRun(spark, root, "c").close()
