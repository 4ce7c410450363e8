import pytest
from pyspark.sql import functions as F

from skyledger.functions import nulls
from skyledger.operators import joins as jn, sampling as sm, sets


def ids(spark, values, extra="1"):
    return spark.createDataFrame([(v,) for v in values], "source_id long").withColumn("x", F.lit(extra))


def test_guarded_join_raises_on_loss_and_repeats(spark):
    a, b = ids(spark, [1, 2, 3]), ids(spark, [1, 2]).withColumnRenamed("x", "y")
    with pytest.raises(ValueError, match="loses 1 of 3"):
        jn.join_1to1_guarded(a, b, "source_id")
    assert jn.join_1to1_guarded(a, b, "source_id", how="left").count() == 3
    with pytest.raises(ValueError, match="repeats"):
        jn.join_1to1_guarded(a, ids(spark, [1, 1, 2, 3]).drop("x"), "source_id")


def test_lookup_default_and_rowsafe(spark):
    df = ids(spark, [1, 2, 3])
    look = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, None)], "source_id long, f double")
    out = jn.join_lookup_rowsafe(df, look, "source_id", [F.desc("f")], ["f"])
    assert {r.source_id: r.f for r in out.collect()} == {1: 5.0, 2: None, 3: None}
    flags = look.groupBy("source_id").agg((F.max("f") > 1).alias("flag"))
    got = {r.source_id: r.flag for r in jn.join_lookup_default(df.withColumn("flag", F.lit(True)), flags, "source_id", "flag").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_resolve_match_cuts_are_strict(spark):
    rows = [(1, 10, 300.0, 0.0), (2, 20, 10.0, 0.1), (3, 30, 10.0, -0.05), (3, 31, 10.0, 0.02), (4, 40, 10.0, -0.02), (4, 41, 10.0, 0.02)]
    df = spark.createDataFrame(rows, "a long, b long, sep double, dm double")
    got = {r.a: (r.b, r.n_candidates) for r in sm.resolve_match(df, "a", separation="sep", mag_diff="dm", ties=["b"]).collect()}
    assert got == {3: (31, 2), 4: (40, 2)}


def test_dedup(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (1, 30.0, 2), (2, 5.0, 3), (3, 1.0, 4), (3, 1.0, 5)], "s long, snr double, t int")
    assert {r.s: r.t for r in sm.dedup_best(df, "s", "snr", ["t"]).collect()} == {1: 2, 2: 3, 3: 4}
    assert {r.s: r.t for r in sm.dedup_best(df, "s", "snr", ["t"], ascending=True).collect()}[1] == 1
    assert {r.multiplicity: r.n_keys for r in sm.dedup_histogram(df, "s").collect()} == {1: 1, 2: 2}
    holes = df.withColumn("snr", F.when(F.col("t") != 2, F.col("snr")))
    with pytest.raises(Exception, match="missing values"):
        sm.dedup_best(holes, "s", "snr", ["t"]).collect()
    assert {r.s: r.t for r in sm.dedup_best(holes, "s", "snr", ["t"], validate=False).collect()} == {1: 1, 2: 3, 3: 4}


def test_dedup_refuses_nan_only_where_a_key_repeats(spark):
    df = spark.createDataFrame([(1, float("nan"), 1), (1, 2.0, 2), (2, float("nan"), 3), (3, 1.0, 4)], "s long, snr double, t int")
    with pytest.raises(Exception, match="missing values"):
        sm.dedup_best(df, "s", "snr", ["t"]).collect()
    assert {r.s: r.t for r in sm.dedup_best(df.where("t <> 2"), "s", "snr", ["t"]).collect()} == {1: 1, 2: 3, 3: 4}
    assert {r.s: r.t for r in sm.dedup_best(df, "s", "snr", ["t"], validate=False).collect()} == {1: 2, 2: 3, 3: 4}


def test_stratified_cap_drops_outside_and_keeps_small_cells(spark):
    rows = [(i, 0.5) for i in range(20)] + [(100, 1.0), (101, 1.99), (200, 2.0), (201, -0.1), (202, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    out = sm.stratified_cap(df, {"v": ("v", [0.0, 1.0, 2.0])}, ["id"], 5, 0)
    got = {r.i_v: r["count"] for r in out.groupBy("i_v").count().collect()}
    assert got == {0: 5, 1: 2}
    again = sm.stratified_cap(df.repartition(3), {"v": ("v", [0.0, 1.0, 2.0])}, ["id"], 5, 0)
    assert {r.id for r in out.collect()} == {r.id for r in again.collect()}
    other = sm.stratified_cap(df, {"v": ("v", [0.0, 1.0, 2.0])}, ["id"], 5, 1)
    assert {r.id for r in out.collect()} != {r.id for r in other.collect()}


def test_volume_limited(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(99, None)], "id long, d double")
    assert sm.volume_limited(df, "d", 5.0, ["id"], 100, 0).count() == 5
    assert sm.volume_limited(df, "d", 5.0, ["id"], 3, 0).count() == 3


@pytest.mark.parametrize("target", [1, 4, 7, 13, 17, 30, 1000])
def test_target_fill_is_the_smallest_cap(spark, target):
    sizes = [1, 1, 4, 7, 20]
    out = sm.target_fill(spark.createDataFrame([(s,) for s in sizes], "n_available long"), target).first()
    want = next((k for k in range(1, 21) if sum(min(s, k) for s in sizes) >= target), 20)
    assert (out.per_cell, out.n_selected) == (want, sum(min(s, want) for s in sizes))


def test_split_sizes_and_missing_values(spark):
    df = spark.createDataFrame([(i, float(i % 10), None if i % 9 == 0 else float(i)) for i in range(400)], "id long, a double, b double")
    out = sm.stratified_split(df, ["a", "b"], ["id"])
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 400 and abs(n["train"] - 280) < 12 and abs(n["val"] - 60) < 12


def test_decorrelated_sample_is_balanced(spark):
    df = spark.createDataFrame([(i, float(i % 17), float((i * 7) % 31)) for i in range(600)], "id long, y double, p double")
    out = sm.quantile_bin(sm.decorrelated_sample(df, "y", ["p"], ["id"], n_bins=2), ["y"], [2], ["id"])
    assert out.count() > 100


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 90 + [5] * 9 + [9]] + [(None,)], "v double")
    out = sm.inverse_freq_weights(df, "v", [3.0, 7.0], 20.0)
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    w = {r.v: r.weight for r in out.distinct().collect()}
    assert w[9.0] / w[0.0] == pytest.approx(20.0 / (100 / 90)) and w[None] < w[0.0]


def test_set_operations(spark):
    a, b = ids(spark, [1, 2]), ids(spark, [2, 3])
    with pytest.raises(ValueError, match="share"):
        sets.union_arms({"a": a, "b": b}, "source_id")
    r = sets.intersect_check(ids(spark, [1]), ids(spark, [2]), ids(spark, [1, 2]), "source_id").first()
    assert r.disjoint and r.adds_up
    with pytest.raises(ValueError, match="outside"):
        sets.except_delta(b, a, "source_id", (5, 9))
    kept = sets.union_dedup_delta(ids(spark, [1], "old"), ids(spark, [1, 2], "new"), "source_id", [F.col("x")])
    assert {r.source_id: r.x for r in kept.collect()} == {1: "old", 2: "new"}


def test_missing_value_policy(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), None), (2.0, 0)], "v double, f int")
    clean = nulls.nan_to_null(df)
    assert [r.v for r in clean.collect()] == [None, None, 2.0]
    got = [r[0] for r in df.select(nulls.coerce_flag(df, "f")).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in clean.select(nulls.fail_closed(F.col("v") > 5)).collect()] == [True, True, False]
    assert nulls.finite_rows(df, ["v"]).count() == 1


def test_grid_lookup_clamps_and_keeps_missing(spark):
    grid = spark.createDataFrame([(0, 0.5), (1, 0.001)], "i_a int, p double")
    df = spark.createDataFrame([(1, -9.0), (2, 99.0), (3, 0.2), (4, None)], "id long, a double")
    out = jn.grid_lookup(df, grid, {"a": (F.col("a"), [0.0, 1.0, 2.0])}, "p", "q")
    assert {r.id: r.q for r in out.collect()} == {1: 0.5, 2: 0.01, 3: 0.5, 4: None}
