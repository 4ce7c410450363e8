import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import coords as co
from skyledger.operators import blocks, neighbours as nb, spatial as sp


def brute_ball(p, r, own=False):
    xyz, v = p[["x", "y", "z"]].to_numpy(), p.v.to_numpy()
    out = []
    for i in range(len(p)):
        m = ((xyz - xyz[i]) ** 2).sum(1) <= r * r
        if not own:
            m[i] = False
        s = v[m]
        s = s[~np.isnan(s)]
        out.append((len(s), np.median(s) if len(s) >= 5 else np.nan, np.std(s) if len(s) >= 5 else np.nan))
    return np.array(out)


@pytest.mark.parametrize("block", [32, 1024])
def test_ball_join_with_a_hot_cell_and_copies(spark, block):
    rng = np.random.default_rng(0)
    far, hot = rng.normal(0, 40, (120, 3)), rng.normal(0, 2, (80, 3))
    pts = np.vstack([far, hot, np.repeat(hot[:1], 60, axis=0)])
    v = rng.normal(0, 1, len(pts)).round(2)
    v[200:] = v[120]
    v[:10] = np.nan
    p = pd.DataFrame(pts, columns=list("xyz")).assign(v=v, id=np.arange(len(pts)))
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = sp.ball_join(df, list("xyz"), "v", radius=10.0, block=block).toPandas().sort_values("id")
    want = brute_ball(p, 10.0)
    assert (got.nbhd_n.to_numpy() == want[:, 0]).all()
    np.testing.assert_allclose(got.nbhd_median.to_numpy(dtype=float), want[:, 1], atol=1e-9)
    np.testing.assert_allclose(got.nbhd_std.to_numpy(dtype=float), want[:, 2], atol=1e-7)


def test_stars_on_a_line(spark):
    rows = [(i, 10.0 * i, 0.0, 0.0, float(a)) for i, a in enumerate([0, 1, 100, 1, 0])]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, v double")
    r = {x.id: x for x in sp.ball_join(df, ["x", "y", "z"], "v", radius=50.0, min_neighbours=4).collect()}[2]
    assert (r.nbhd_n, r.nbhd_median, r.nbhd_std) == (4, 0.5, pytest.approx(0.5))
    assert sp.ball_join(df, ["x", "y", "z"], "v", radius=50.0).where("nbhd_median is not null").count() == 0


@pytest.mark.parametrize("metric,pivots,block", [("cosine", 1, 2048), ("cosine", 9, 16), ("euclidean", 7, 16), ("euclidean", 1, 2048)])
def test_knn_join_is_exact(spark, metric, pivots, block):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (40, 5)) for c in (-2, 0, 3)] + [np.ones((60, 5))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    got = nb.knn_join(df, df.where("id % 2 = 0"), ref_id="id", query_id="id", vector="vec", k=7, metric=metric, exclude_self=True, pivots=pivots, block=block).toPandas()
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i, g in got.groupby("id"):
        assert len(g) == 7
        np.testing.assert_allclose(g.sort_values("rank").distance, np.sort(d[i])[:7], atol=1e-6)


def test_knn_distance_of_a_vector_with_holes(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, float("nan")]), (3, [1.0, 1.0])], "id long, vec array<double>")
    got = {r.id: r.knn_distance for r in nb.knn_mean_distance(df, df, ref_id="id", query_id="id", vector="vec", k=2).collect()}
    assert got[2] == float("inf") and got[1] == pytest.approx(0.5)


def test_block_pairs_meets_every_pair_once(spark):
    left = spark.createDataFrame([(i, 0 if i < 50 else i % 5) for i in range(80)], "a long, k long")
    right = spark.createDataFrame([(i, 0 if i < 40 else i % 5) for i in range(60)], "b long, k long")

    def compare(lp, rp):
        i, j = np.nonzero(blocks.same_key(lp, rp))
        return pd.DataFrame({"a": lp["a"].to_numpy()[i], "b": rp["b"].to_numpy()[j]})

    got = blocks.block_pairs(left, right, ["k"], ["a"], ["b"], compare, "a long, b long", block=8)
    want = left.join(right, "k").select("a", "b")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_los_integral_of_constant_and_linear_density(spark):
    n = 9
    cube = [(i, j, k, 2.0 + 0.5 * i) for i in range(n) for j in range(n) for k in range(n)]
    cube = spark.createDataFrame(cube, "i long, j long, k long, density double")
    df = spark.createDataFrame([(1, 10.0, 20.0, 25.0), (2, 200.0, -60.0, 7.0), (3, 0.0, 0.0, 900.0), (4, 0.0, 0.0, -1.0), (5, 0.0, 0.0, None)], "id long, ra double, dec double, d double")
    out = {r.id: r.av_los for r in sp.los_integral(df, cube, "id", "ra", "dec", "d", shape=(n, n, n), sun=(4.0, 4.0, 4.0)).collect()}
    ux = {r.id: r.u for r in df.select("id", co.rotate(co.sph_to_xyz("ra", "dec", F.lit(1.0)))[0].alias("u")).collect()}
    for i, d in ((1, 25.0), (2, 7.0)):
        assert out[i] == pytest.approx(d * (2.0 + 0.5 * (4.0 + ux[i] * d / 10.0 / 2.0)))
    assert out[3] is None and out[4] is None and out[5] is None


def test_galactic_frame(spark):
    df = spark.createDataFrame([(266.40499, -28.93617), (192.85948, 27.12825)], "ra double, dec double")
    lon, lat = co.eq_to_gal("ra", "dec")
    centre, pole = df.select(lon.alias("l"), lat.alias("b")).collect()
    assert min(centre.l, 360 - centre.l) < 1e-3 and abs(centre.b) < 1e-3 and pole.b == pytest.approx(90.0, abs=1e-3)


def test_pixels_cover_the_sphere(spark):
    g = spark.range(20000).select((F.col("id") * 137.50776 % 360).alias("l"), F.degrees(F.asin(1 - 2 * (F.col("id") + 0.5) / 20000)).alias("b"))
    n = g.groupBy(co.sky_pixel("l", "b", 4).alias("p")).count().toPandas()
    assert sorted(n.p) == list(range(192)) and n["count"].between(80, 130).all()


def test_non_positive_parallax_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0)], "ra double, dec double, plx double")
    with pytest.raises(Exception, match="non-positive parallax"):
        df.select(*co.eq_to_gal_uvw("ra", "dec", F.lit(1.0), F.lit(1.0), F.lit(1.0), parallax="plx").values()).collect()


@pytest.mark.parametrize("wrong", [{"radius": 0.0}, {"radius": float("nan")}, {"radius": -1.0}, {"min_neighbours": 0}])
def test_ball_join_checks_its_arguments(spark, wrong):
    with pytest.raises(ValueError):
        sp.ball_join(spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "x double, y double, z double, v double"), list("xyz"), "v", **wrong)
