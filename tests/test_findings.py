import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from skyledger.operators import learning as ml, neighbours as nb, spatial as sp


def test_density_2d_leaves_out_the_last_price_edge(spark, tmp_path):
    rows = pd.DataFrame({"l_extendedprice": [1000.0, 104999.99, 105000.0, 105000.0, 900.0, None], "l_quantity": [50.0, 50.0, 50.0, 3.0, 2.0, 1.0]})
    path = str(tmp_path / "lineitem.parquet")
    rows.to_parquet(path)
    got = sorted((r.ix, r.iy, r.n, r.share) for r in queries()["density_2d"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    want = sorted(con.execute(f"SELECT ix, iy, n, share FROM ({oracle_sql()['density_2d']})").fetchall())
    assert got == want == [(0, 4, 1, 0.5), (12, 4, 1, 0.5)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("rows", [40, 131072])
def test_knn_join_in_a_grid_is_exact(spark, metric, rows):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (90, 5)) for c in (-2, 0, 3)] + [np.ones((330, 5)), np.zeros((1, 5))])
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, vec array<double>")
    got = nb.knn_join(df, df.where("id % 2 = 0"), ref_id="id", query_id="id", vector="vec", k=7, metric=metric, exclude_self=True, grid_rows=rows).toPandas()
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = (1 - u @ u.T).round(10)
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).round(10)
    np.fill_diagonal(d, np.inf)
    assert set(got.id) == {i for i in ids if i % 2 == 0}
    for i, g in got.groupby("id"):
        row = d[list(ids).index(i)]
        best = np.lexsort((ids, row))[:7]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 8)) and list(g.neighbour) == list(ids[best])
        np.testing.assert_allclose(g.distance, row[best], atol=1e-9)


def test_doubles_are_rounded_as_the_sql_does(spark, tmp_path, monkeypatch):
    from skyledger.bindings import registry

    monkeypatch.setattr(registry, "QUERIES", {})
    monkeypatch.setattr(registry, "ORACLES", {})
    ties = [(i + 0.5) / 1e6 * s for i in range(0, 1_000_000, 997) for s in (1, -1)]
    path = str(tmp_path / "x.parquet")
    pd.DataFrame({"v": [*ties, *np.random.default_rng(0).normal(0, 1e5, 2000), 0.0, None, float("inf")]}).to_parquet(path)
    registry.query("rounded", f"SELECT v FROM '{path}'", r="v")(lambda t: t.spark.read.parquet(t.path("x")))
    got = [r.v for r in registry.QUERIES["rounded"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in duckdb.sql(registry.ORACLES["rounded"]).fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("limits", [{}, {"rows": 30, "most": 10**6}, {"rows": 30, "most": 330}])
@pytest.mark.parametrize("own", [False, True])
def test_ball_join_in_boxes_and_in_blocks(spark, limits, own):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 40, (500, 3)), rng.normal(0, 2, (300, 3)), np.repeat([[1.0, 1.0, 1.0]], 60, axis=0), [[900.0, 900.0, 900.0]]])
    v = rng.normal(0, 1, len(pts)).round(3)
    v[:20] = np.nan
    v[300:500] = 0.25
    v[-10] = 1e6
    p = pd.DataFrame(pts, columns=list("xyz")).assign(v=v, id=np.arange(len(pts)))
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = sp.ball_join(df, list("xyz"), "v", radius=10.0, include_self=own, **limits).toPandas().sort_values("id")
    for i, row in enumerate(got.itertuples()):
        ball = ((pts - pts[i]) ** 2).sum(1) <= 100.0
        ball[i] = own
        held = v[ball & ~np.isnan(v)]
        assert row.nbhd_n == len(held)
        if len(held) < 5:
            assert np.isnan(row.nbhd_median) and np.isnan(row.nbhd_std)
        else:
            assert row.nbhd_median == np.median(held)
            np.testing.assert_allclose(row.nbhd_std, held.std(), rtol=1e-6, atol=1e-6)


def test_copies_of_a_point_in_the_ball_join_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 4, (2000, 3)), rng.normal(0, 60, (700, 3)), np.repeat([[2.0, -1.0, 0.5]], 300, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(v=rng.normal(0, 1, len(pts)), id=np.arange(len(pts))))
    monkeypatch.setattr(sp, "BOXES", 8, raising=False)
    got = sp.ball_join(df, list("xyz"), "v", radius=10.0, rows=16).toPandas().sort_values("id")
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    assert (got.nbhd_n.to_numpy() == (d2 <= 100.0).sum(1) - 1).all()

    def points_met(q, qv, p, *_):
        return np.where(np.arange(len(q)) == 0, len(p), 0), np.zeros(len(q)), np.zeros(len(q))

    monkeypatch.setattr(sp, "_ball_stats", points_met)
    met = sp.ball_join(df, list("xyz"), "v", radius=10.0, rows=16).agg(F.sum("nbhd_n")).first()[0]
    assert len(pts) <= met <= 8 * len(pts)


def test_crowded_boxes_of_the_ball_join_list_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = rng.normal(0, 3, (1000, 3))
    v = np.concatenate([rng.normal(0, 1, 400), np.full(600, 0.5)])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=list("xyz")).assign(v=v, id=np.arange(len(pts))))
    stored, cut = [], sp.cut_lineage

    def counted(frame):
        out = cut(frame)
        stored.append(out.count())
        return out

    monkeypatch.setattr(sp, "cut_lineage", counted)
    got = sp.ball_join(df, list("xyz"), "v", radius=10.0, most=300).toPandas().sort_values("id")
    held = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= 100.0
    np.fill_diagonal(held, False)
    assert (got.nbhd_n.to_numpy() == held.sum(1)).all()
    few = held.sum(1) < 5
    assert (got.nbhd_median.isna().to_numpy() == few).all()
    full = np.flatnonzero(~few)
    np.testing.assert_array_equal(got.nbhd_median.to_numpy()[full], [np.median(v[held[i]]) for i in full])
    np.testing.assert_allclose(got.nbhd_std.to_numpy()[full], [v[held[i]].std() for i in full], rtol=1e-9, atol=1e-12)
    # a row for each query and band of 150 points
    assert max(stored) <= 7 * len(pts)


def test_a_step_of_the_ball_join_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if f.getName().startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    out = sp._stored(spark.range(5000).selectExpr("id", "id % 70 k").groupBy("k").count())
    assert out.count() == 70 and out.agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get(name) == setting
    # those of the two counts above remain; 70 rows of the stored step are gone
    sp.cut_lineage(spark.range(5000).selectExpr("id", "id % 70 k").groupBy("k").count())
    kept = files() - before
    again = files()
    sp._stored(spark.range(5000).selectExpr("id", "id % 70 k").groupBy("k").count())
    for _ in range(50):
        if files() <= again:
            break
        time.sleep(0.1)
    assert kept and files() <= again


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_pairs_on_the_edge_of_a_ball_are_measured(far):
    at = np.stack(np.meshgrid(*[np.arange(-3.0, 4)] * 3), -1).reshape(-1, 3) + far
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    for r2 in (1.0, 2.0, 5.0, 9.0):
        assert (sp._within(at, at, r2) == (d2 <= r2)).all()


def test_labels_of_an_audit_share_shuffles_only_where_rows_agree(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "id * 7 % 31 / 31.0D a", "id * 5 % 17 / 17.0D b", "cast(id % 3 as int) cell")
    df = df.selectExpr("*", "2 * a - b + a * a y", "b - a * b z", "if(id % 4 = 0, null, a + b * b) w")
    calls, whole = [], ml.shuffle_within
    monkeypatch.setattr(ml, "shuffle_within", lambda *a, **b: calls.append(1) or whole(*a, **b))
    out = ml.audit_report(df, ["a", "b"], ["y", "w", "z"], ["a"], ["cell"], ["id"]).collect()
    # once over all rows and once in cells, for y and z together and for w
    assert len(calls) == 4 and len(out) == 6
    got = {(r.label, r.feature): r for r in out}
    for label in ("y", "w", "z"):
        model = ml.fit_linear(df, ["a", "b"], label)
        null = ml.shuffled_null(df, model, ["a", "b"], ["a"], label, ["cell"], ["id"]).first().null_rmse
        alone = {r.feature: r.looco_delta_rmse for r in ml.leave_one_out(df, model, ["a", "b"]).collect()}
        for r in ml.permutation_importance(df, model, ["a", "b"], label, ["id"]).collect():
            g = got[label, r.feature]
            np.testing.assert_allclose([g.baseline_rmse, g.permuted_rmse, g.importance], [r.baseline_rmse, r.permuted_rmse, r.importance], atol=1e-12)
            np.testing.assert_allclose([g.looco_delta_rmse, g.shuffled_null_rmse], [alone[r.feature], null], atol=1e-12)
