import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and a third of all rows share one value."""
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n))
    value = np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 50, n).round(3))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": value})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = {"p01": 0.01, "p16": 0.16, "p50": 0.5, "p999": 0.999, "lo": 0.0, "hi": 1.0}
    for r in rk.exact_quantiles(df, ["k"], "v", probs, "n").collect():
        want = pdf[pdf.k == r.k].v
        assert r.n == len(want)
        assert [r[p] for p in probs] == pytest.approx([np.quantile(want, p) for p in probs.values()])


def test_global_quantile_and_empty(spark, skewed):
    pdf, df = skewed
    assert rk.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(pdf.v.median())
    assert rk.exact_quantiles(df.where("k = 99"), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_keep_null_keys_and_drop_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.m for r in rk.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "b": 2.0}


def test_cumulative_counts(skewed):
    pdf, df = skewed
    got = rk.cumulative_counts(df, ["k"], "v").toPandas()
    for k, g in got.groupby("k"):
        want = np.sort(pdf[pdf.k == k].v.to_numpy())
        assert (g.n_le == np.searchsorted(want, g.v, side="right")).all()


def test_hash_rank_is_a_permutation_and_stable(skewed):
    pdf, df = skewed
    a = rk.hash_rank(df, ["k"], ["id"], 3, size="n").toPandas()
    for k, g in a.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1)) and (g.n == len(g)).all()
    b = rk.hash_rank(df.repartition(7), ["k"], ["id"], 3).toPandas().set_index("id")["rank"]
    assert (b.loc[a.id].to_numpy() == a["rank"].to_numpy()).all()


def test_top_k_same_rows_on_both_paths(skewed, monkeypatch):
    _, df = skewed
    small = {r.id for r in rk.hash_top_k(df, ["k"], ["id"], 40, 0).select("id").collect()}
    monkeypatch.setattr(rk, "GROUP_LIMIT", 1)
    large = {r.id for r in rk.hash_top_k(df, ["k"], ["id"], 40, 0).select("id").collect()}
    assert small == large and len(small) == 40 * 6


def test_first_per_key_limits_on_the_map_side(skewed):
    _, df = skewed
    plan = rk.first_per_key(df, ["k"], [F.desc("v"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_order_statistic_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in [5, 1, 4, 2, 3]], "v double")
    out = rk.order_statistics(df, [], "v", {"second": lambda n: F.lit(1), "last": lambda n: n - 1}).first()
    assert (out.second, out["last"], out.n) == (2.0, 5.0, 5)


def test_large_keys_stay_apart(spark):
    base = 4_300_000_000_000_000_001
    df = spark.createDataFrame([(base + k,) for k in range(5)] + [(base + 2,), (None,)], "k long")
    counts = {r.k: r.n_le for r in rk.cumulative_counts(df, [], "k").collect()}
    assert counts == {base: 1, base + 1: 2, base + 2: 4, base + 3: 5, base + 4: 6}
    placed = sorted((r.position, r.k) for r in rk.sort_by_key(df, "k").collect())
    assert placed == list(enumerate([None, base, base + 1, base + 2, base + 2, base + 3, base + 4], 1))


def test_scatter_plans_without_running(spark):
    """No job runs while the plan is made."""
    from skyledger.operators import residuals as rs

    group, tracker = "plan-only", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    out = rs.mad_scatter(spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v"), ["g"], "v")
    assert len(tracker.getJobIdsForGroup(group)) == 0
    got = {r.g: (r.median, round(r.mad_scatter / 1.4826, 6)) for r in out.collect()}
    assert got[1] == (499.0, 249.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("df", [900, 950, 1500])
def test_chi2_quantile_of_many_degrees(df):
    from skyledger.operators.residuals import chi2_quantile

    # Wilson-Hilferty
    want = df * (1 - 2 / (9 * df) + 2.3263478740408408 * (2 / (9 * df)) ** 0.5) ** 3
    assert abs(chi2_quantile(0.99, df) / want - 1) < 1e-3


def test_cuts_equal_ranks_and_move_no_payload(spark):
    """Each group divided at 0, a third, all and more than all of it, against the ranks; one group is hot."""
    df = spark.range(5000).selectExpr("id", "case when id < 4000 then 0 when id % 7 = 0 then null else id % 5 end as g", "repeat('x', 50) as payload")

    def cuts(groups):
        return groups.withColumn("cuts", F.array(F.lit(0), F.floor(F.col("n") / 3), F.col("n"), F.col("n") + 5))

    got = {r.id: r.part for r in rk.hash_cut(df, ["g"], ["id"], 3, cuts).collect()}
    for r in rk.hash_rank(df, ["g"], ["id"], 3, "rank", "size").collect():
        assert got[r.id] == (1 if r.rank <= r.size // 3 else 2)
    top = rk.hash_cut(df, [], ["id"], 3, lambda g: g.withColumn("cuts", F.array(F.lit(1200)))).where("part = 0")
    want = {r.id for r in rk.hash_rank(df, [], ["id"], 3, "rank").where("rank <= 1200").collect()}
    assert {r.id for r in top.collect()} == want
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("scalar-subquery")[0] and "Join" not in plan.split("scalar-subquery")[0]
    assert rk.hash_cut(df.limit(0), ["g"], ["id"], 3, cuts).count() == 0


def test_median_deviation_equals_numpy_in_every_group(spark, skewed):
    """A hot key, a third of equal values, single rows, ties around the median, null keys and null values."""
    pdf, df = skewed
    more = spark.createDataFrame([(-1, None, 5.0), (-2, None, 9.0), (-3, 77, 4.0), (-4, 78, None), (-5, 79, 1.0), (-6, 79, 1.0), (-7, 79, 3.0), (-8, 79, 3.0)], "id long, k long, v double")
    got = {r.k: (r.m, r.d) for r in rk.median_deviation(df.union(more), ["k"], "v", "m", "d").collect()}
    want = {int(k): g.to_numpy() for k, g in pdf.groupby("k").v}
    want |= {None: np.array([5.0, 9.0]), 77: np.array([4.0]), 79: np.array([1.0, 1.0, 3.0, 3.0])}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx((np.median(v), np.median(np.abs(v - np.median(v)))))
    whole = rk.median_deviation(df, [], "v", "m", "d").first()
    assert (whole.m, whole.d) == pytest.approx((pdf.v.median(), (pdf.v - pdf.v.median()).abs().median()))
    assert rk.median_deviation(df.limit(0), ["k"], "v", "m", "d").count() == 0


def test_median_deviation_moves_the_rows_once(skewed):
    """Deviations are never made for all rows: one exchange of values serves both medians."""
    _, df = skewed
    plan = rk.median_deviation(df, ["k"], "v", "m", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "abs((__v" in plan and "abs((v" not in plan
