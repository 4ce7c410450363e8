import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.functions import corrections as cr, extinction as ex, flags as fl, vectors as vc
from skyledger.operators import calibration as cal, ensembles as en, information as info, learning as ml, mixtures as mx, outliers as od, residuals as rs
from skyledger.plans import release as rel
from skyledger.sources import catalogue as cat, lineage as lin


def test_vector_envelope_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 20)) @ rng.normal(0, 1, (20, 20))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, [float("nan")] * 20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    env = od.fit_vector_envelope(df, "v")
    got = od.score_vector_envelope(df, env, "d").withColumn("f", od.mahalanobis_flag("d", env)).toPandas().set_index("id")
    p = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(20))
    want = np.sqrt(np.einsum("bi,ij,bj->b", x - x.mean(0), p, x - x.mean(0)))
    np.testing.assert_allclose(got.d[:300], want, rtol=1e-8)
    assert env.threshold == pytest.approx(np.quantile(want, 0.99)) and got.f[999] and np.isnan(got.d[999])


def test_small_envelope_and_limits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, [1, 2, 3], (200, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    env = od.fit_mahalanobis(df, ["a", "b", "c"])
    p = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3))
    want = np.sqrt(np.einsum("bi,ij,bj->b", x - x.mean(0), p, x - x.mean(0)))
    assert env.threshold == pytest.approx(np.quantile(want, 0.99))
    with pytest.raises(ValueError, match="at least"):
        od.fit_kinematic(df.limit(3), "a", "b", "c")
    assert od.fit_label_envelope(df.limit(50), ["a", "b"]) is None


def test_bimodality_by_aggregates(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(0.1, 0.03, 400)
    two = np.r_[rng.normal(0.05, 0.02, 300), rng.normal(0.3, 0.02, 150)]
    few = rng.normal(0, 1, 20)
    pdf = pd.DataFrame({"t": np.r_[np.full(400, 0.5), np.full(450, 1.5), np.full(20, 2.5)], "a": np.r_[one, two, few]})
    got = {r.i_t: r for r in mx.bimodality_per_cell(spark.createDataFrame(pdf), {"t": ("t", [0.0, 1.0, 2.0, 3.0])}, "a").collect()}
    assert not got[0].is_bimodal and got[1].is_bimodal and not got[2].is_bimodal
    assert got[0].converged and got[1].converged and got[2].converged is None
    assert got[1].mean_sep == pytest.approx(0.25, abs=0.01) and got[1].minor_weight == pytest.approx(1 / 3, abs=0.01)


def test_seeded_mixture_orders_components(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(m, 0.05, (200, 2)) for m in ([0.25, 0.0], [-0.5, 0.2], [-1.25, 0.2])])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["mh", "am"]))
    means, covs = mx.seeded_mixture(df, ["mh", "am"])
    for k, (m, c) in enumerate(zip(means, covs)):
        own = pts[200 * k : 200 * (k + 1)]
        assert np.allclose(m, own.mean(axis=0), atol=0.01) and np.allclose(c, np.cov(own.T, bias=True), atol=0.001)
    sizes = {r.c: r["count"] for r in df.groupBy(mx.gmm_assign(["mh", "am"], means, covs).alias("c")).count().collect()}
    assert sizes == {0: 200, 1: 200, 2: 200}
    spoilt = df.unionAll(spark.createDataFrame([(float("nan"), 0.0), (None, 1.0)], "mh double, am double"))
    again, _ = mx.seeded_mixture(spoilt.repartition(5), ["mh", "am"])
    assert np.allclose(again, means, atol=1e-9)


def test_linear_models_and_shuffles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(500), y=3 * x[:, 0] + rng.normal(0, 0.1, 500), cell=np.arange(500) % 3)
    df = spark.createDataFrame(pdf)
    model = ml.fit_linear(df, ["a", "b"], "y")
    imp = {r.feature: r.importance for r in ml.permutation_importance(df, model, ["a", "b"], "y", ["id"]).collect()}
    assert imp["a"] > 3 and abs(imp["b"]) < 0.05
    s = ml.shuffle_within(df, ["cell"], ["a"], ["id"], 0).toPandas()
    assert len(s) == 500 and (s.a != s["a__shuffled"]).mean() > 0.9
    for _, g in s.groupby("cell"):
        assert sorted(g.a) == sorted(g["a__shuffled"])
    r = ml.baseline_regressor(df, df, ["b"], ["a", "b"], "y").first()
    assert r.ratio < 0.1
    _, kept = ml.pca_project(df, ["a", "b"], 2, ["id"])
    assert kept == pytest.approx(1.0)


def test_bland_altman_known_answers(spark):
    rng = np.random.default_rng(4)
    n = 4000
    ref = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"k": 0, "ref": ref, "pred": ref + 0.1 + rng.normal(0, 0.5, n), "s": 0.5, "z": 0.0})
    r = rs.bland_altman(spark.createDataFrame(pdf), ["k"], pred="pred", ref="ref", sigma="s", sigma_ref="z").first()
    d = pdf.pred - pdf.ref
    assert r.bias == pytest.approx(d.mean()) and r.scatter == pytest.approx(d.std())
    assert r.mad_scatter == pytest.approx(1.4826 * (d - d.median()).abs().median())
    assert r.sigma_ratio == pytest.approx(d.std() / 0.5)
    outliers = spark.createDataFrame(pd.DataFrame({"k": 0, "d": np.r_[rng.normal(0, 1, 2000), np.full(60, 1e6)]}))
    assert rs.mad_scatter(outliers, ["k"], "d").first().mad_scatter == pytest.approx(1.0, abs=0.1)


def test_chi2_and_normal(spark):
    assert rs.chi2_quantile(0.95, 3) == pytest.approx(7.814727903251178)
    assert rs.chi2_quantile(0.68, 2) == pytest.approx(-2 * np.log(0.32))
    xs = [-8.0, -3.0, -1.96, 0.0, 0.5, 2.5758293035489004, 6.0]
    import math

    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(cal.normal_cdf("x").alias("p")).collect()]
    np.testing.assert_allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-12, atol=1e-16)


def test_conformal_radius_and_isotonic_ties(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "s double")
    assert cal.conformal_radius(df, [], "s", 0.8).first().radius == 9.0
    assert cal.conformal_radius(df, [], "s", 0.99).first().radius == 10.0
    ties = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 1.0), ("a", 2.0)], "l string, z double")
    assert [r.y for r in cal.isotonic_pit(ties, "l", "z").orderBy("z").collect()] == [0.25, 0.625, 0.875]


def test_ensemble_rules(spark):
    rows = [(1, 0, [1.0], [0.5]), (1, 1, [1.0], [0.5]), (2, 0, [0.0], [0.3])]
    df = spark.createDataFrame(rows, "id long, m int, mu array<double>, s array<double>")
    a = en.disagreement_ratio(df.where("id = 1"), "id", "mu", "s", 1).first()
    assert a.disagreement == 0.0
    with pytest.raises(Exception, match="two members"):
        en.disagreement_ratio(df, "id", "mu", "s", 1).collect()


def test_whitened_residual_matches_solve(spark):
    rng = np.random.default_rng(6)
    low = np.tril(rng.normal(0, 1, (4, 4))) + 3 * np.eye(4)
    mu, y = rng.normal(0, 1, 4), rng.normal(0, 1, 4)
    row = ([float(a) for a in mu], [float(low[i, j]) for i in range(4) for j in range(i + 1)], [float(a) for a in y])
    df = spark.createDataFrame([row], "mu array<double>, chol array<double>, y array<double>")
    np.testing.assert_allclose(df.select(en.whitened_residual("mu", "chol", "y", 4)).first()[0], np.linalg.solve(low, y - mu))


def test_projection_reproduces_the_basis(spark):
    grid = vc.sampling_grid()
    inside, w, psi = vc.band_basis(grid, *vc.BANDS["bp"], order=vc.BASIS_SIZE, closed=False)
    np.testing.assert_allclose((psi * w[:, None]).T @ psi, np.eye(vc.BASIS_SIZE), atol=1e-8)
    flux = np.zeros(grid.size)
    flux[inside] = psi[:, 3]
    df = spark.createDataFrame([(1, [float(a) for a in flux])], "id long, flux array<double>")
    r = vc.project_basis(df, "flux").first()
    assert r.bp_coeffs[3] == pytest.approx(1.0) and r.residual_rms < 1e-8
    with pytest.raises(Exception, match="330 samples"):
        vc.project_basis(spark.createDataFrame([(1, [1.0, 2.0])], "id long, flux array<double>"), "flux").collect()


def test_normalise_vector_and_errors(spark):
    df = spark.createDataFrame([([10.0, 5.0], [1.0, 0.5])], "c array<double>, e array<double>")
    r = df.select(vc.normalise_vector("c").alias("n"), vc.normalise_errors("c", "e").alias("s")).first()
    assert r.n == [1.0, 0.5] and r.s == pytest.approx([0.1 / np.log(10), np.hypot(0.05, 0.05)])
    bad = spark.createDataFrame([([0.0, 1.0],), ([1.0, None],), ([2.0, 1.0],), (None,)], "c array<double>")
    assert [x[0] for x in bad.select(vc.bad_spectrum("c")).collect()] == [True, True, False, True]


def test_zones_and_trends(spark):
    rows = [(1.25, 1.0, 2.0, 3.0, 4.0), (1.26, 1.0, 2.0, 3.0, 4.0), (3.01, 1.0, None, None, 4.0), (None, None, None, None, 4.0), (0.5, None, None, None, None)]
    df = spark.createDataFrame(rows, "r_med_photogeo double, av_near double, av_mid double, av_far double, av_nbhd_median double")
    got = [(r.av_los, r.av_los_source) for r in ex.select_by_zone(df).collect()]
    assert got == [(1.0, 0), (2.0, 1), (1.0, 0), (4.0, 3), (None, -1)]
    tdf = spark.createDataFrame([(6500.0, 2.0, 0.0), (3000.0, 2.0, 0.0), (5000.0, 3.8, 0.0), (None, 2.0, 0.0)], "teff double, logg double, mg_h_atm double")
    assert [r.mg_h_atm for r in cr.abundance_trend(tdf).collect()] == [0.0903, -0.0195, 0.0, 0.0]


def test_tiers_fail_closed(spark):
    rows = [(1.0, False, 0), (None, False, 0), (1.0, True, 0), (1.0, False, 1), (1.0, None, None)]
    df = spark.createDataFrame(rows, "teff_pred double, ood_joint_flag boolean, label_extrapolation_flag int")
    assert [r.release_tier__teff for r in fl.element_tier(df, ("teff",)).collect()] == [1, 3, 3, 2, 1]
    with pytest.raises(ValueError, match="required"):
        fl.element_tier(df.drop("label_extrapolation_flag"), ("teff",))
    knn = spark.createDataFrame([(1.0, 200.0, 5.0, 13.49), (1.0, 200.0, None, 1.0), (1.0, 10.0, 5.0, 1.0)], "teff_pred double, teff_sigma double, knn_teff_med double, knn_teff_iqr double")
    got = [(r.teff_hybrid_pred, r.teff_hybrid_source, r.teff_hybrid_tier) for r in fl.hybrid_compose(knn, ("teff",)).collect()]
    assert got == [(5.0, "knn", 2), (1.0, "regressor_caveat", 2), (1.0, "regressor", 1)]


def test_summary_keeps_the_null_group(spark):
    df = spark.createDataFrame([("bright", 1.0), (None, 2.0)], "g_mag_bin string, teff_pred double")
    assert {r.g_mag_bin for r in rel.per_cell_summary(df).collect()} == {"bright", None}


def test_contract_and_frozen_stats(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.5])], "id long, v array<double>")
    with pytest.raises(ValueError, match="wrong length"):
        cat.Contract({"id": "bigint"}, array_length={"v": 2}).validate(df, check_arrays=True)
    with pytest.raises(KeyError):
        cat.Contract({"absent": "int"}).validate(df)
    assert cat.detect_input_schema(["a_z"], ["a_z"], ["a_log"]) == "zscored"
    with pytest.raises(ValueError):
        cat.detect_input_schema(["a_z", "a_log"], ["a_z"], ["a_log"])
    text = lin.freeze_stats(spark.createDataFrame([([1.0],), ([1.0],)], "v array<double>"), {"b": "v"})
    with pytest.raises(Exception, match="sigma not positive"):
        lin.load_frozen_stats(text, "stats", 1).collect()
    good = lin.load_frozen_stats(lin.freeze_stats(spark.createDataFrame([([1.0],), ([3.0],)], "v array<double>"), {"b": "v"}), "stats", 1)
    with pytest.raises(Exception, match="fingerprint differs"):
        lin.verify_fingerprint(good, "0" * 64).collect()


def test_information_measures(spark):
    df = spark.createDataFrame([(i % 2, i % 2, i % 3) for i in range(600)], "x int, y int, z int")
    assert info.mutual_information(df, "x", "y").first().mi == pytest.approx(np.log(2))
    assert info.mutual_information(df, "x", "z").first().mi == pytest.approx(0.0, abs=1e-12)
    assert info.conditional_mi(df, "x", "y", ["z"]).first().cmi == pytest.approx(np.log(2))
    s = info.agreement_scores(info.confusion_counts(df, "x", "y")).first()
    assert (s.macro_f1, s.mcc, s.adjusted_rand) == (1.0, 1.0, 1.0)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 7) / 10) for i in range(400)], "id long, v double")
    r = info.bootstrap_ci(df, ["id"], "v", 40, 0)
    r = r.first()
    assert r.ci_lower < 1.3 < r.ci_upper and r.passed and r.ci_upper - r.ci_lower < 0.1


def test_replica_sums_equal_weights_taken_one_by_one(spark):
    import hashlib

    rows = [(i, None if i % 5 == 0 else i % 3, float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, v double").repartition(3)
    cuts, want = info.poisson_cuts(), {}
    for i, k, v in rows:
        h = hashlib.md5(f"9:{i}".encode()).hexdigest()
        a, b = int(h[:8], 16), int(h[8:16], 16) | 1
        for r in range(50):
            u = ((a + r * b) % 2**32 + 0.5) / 2**32
            w = sum(c <= u for c in cuts)
            s = want.setdefault((k, r), [0, 0.0])
            s[0] += w
            s[1] += w * v
    got = {(r.k, r.replica): (r.w, r.v) for r in info.replica_sums(df, ["k"], ["id"], ["v"], 50, 9).collect()}
    assert got == {k: pytest.approx(tuple(v)) for k, v in want.items()}
    assert sum(w for w, _ in got.values()) / 50 == pytest.approx(200, rel=0.1)
    plan = info.replica_sums(df, ["k"], ["id"], ["v"], 50, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert info.replica_sums(df.limit(0), [], ["id"], ["v"], 5, 9).count() == 0


def test_envelope_ignores_rows_that_are_not_finite(spark):
    from skyledger.operators import outliers as od

    rng = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(300, 2))]
    clean = spark.createDataFrame(rows, "a double, b double")
    spoilt = clean.unionAll(spark.createDataFrame([(float("nan"), 0.0), (0.0, float("inf"))], "a double, b double"))
    one, two = (od.fit_mahalanobis(df, ["a", "b"]) for df in (clean, spoilt))
    assert np.allclose(one.mean, two.mean) and np.allclose(one.precision, two.precision) and abs(one.threshold - two.threshold) < 1e-9
    far = spark.createDataFrame([(1e9, 0.0), (float("nan"), 0.0), (0.0, 0.0)], "a double, b double")
    flags = [r.f for r in od.score_mahalanobis(far, two, "d").select(od.mahalanobis_flag("d", two).alias("f")).collect()]
    assert flags == [True, True, False]


def test_envelope_of_many_columns(spark):
    from skyledger.operators import outliers as od

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 14))
    names = [f"c{k}" for k in range(14)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    env = od.fit_mahalanobis(df, names)
    assert env.columns == tuple(names) and np.allclose(env.mean, x.mean(axis=0))
    d = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("bi,ij,bj->b", d, np.linalg.inv(np.cov(x.T) + od.XP_RIDGE * np.eye(14)), d))
    assert np.allclose(sorted(r.d for r in od.score_mahalanobis(df, env, "d").collect()), sorted(want), atol=1e-6)


def test_zero_point_on_all_axes(spark):
    edges = [6.0, 10.8, 11.2, 21.0]
    q = {(0, 0): [-26.0, -27.0, -30.0, -39.0], (1, 0): [0.0, 1.5, -2.0, -8.0], (0, 1): [-9.0, -3.0, 1.0, 2.0], (2, 1): [10.0, -20.0, 30.0, 5.0], (4, 2): [3.0, 4.0, -5.0, 6.0]}
    rng = np.random.default_rng(8)
    rows = [(float(m), float(n), float(b), int(s), 1.0) for m, n, b, s in zip(rng.uniform(5, 22, 300), rng.uniform(1.0, 2.0, 300), rng.uniform(-90, 90, 300), rng.choice([31, 95, 3], 300))]
    df = spark.createDataFrame([*rows, (None, 1.5, 0.0, 31, 1.0)], "g double, nu double, beta double, sol int, parallax double")
    five = cr.zero_point_of(F.col("g"), F.col("nu"), F.col("beta"), edges, q)
    six = cr.zero_point_of(F.col("g"), F.col("nu"), F.col("beta"), edges, {(0, 0): q[0, 0]})
    got = cr.parallax_correction_of(df, five, six, solution="sol").collect()

    def want(m, n, b, table):
        colour = [1.0, np.clip(n - 1.48, -0.24, 0.24), np.clip(1.48 - n, 0, 0.24) ** 3, min(0.0, n - 1.24), max(0.0, n - 1.72)]
        sine = np.sin(np.radians(b))
        return sum(np.interp(m, edges, v) * colour[j] * [1.0, sine, sine**2 - 1 / 3][k] for (j, k), v in table.items())

    for r in got:
        if r.g is None or r.sol == 3:
            assert r.parallax_zpt is None and r.parallax_corr == 1.0
        else:
            assert r.parallax_zpt == pytest.approx(want(r.g, r.nu, r.beta, q if r.sol == 31 else {(0, 0): q[0, 0]}), abs=1e-9)


def test_published_constants_are_as_published():
    """Pinned here, because the SQL of the queries reads the same tables."""
    from skyledger.functions import coords as co

    assert cr.G_BRIGHT == (1.00876, -0.02540, 0.01747, -0.00277) and cr.G_FAINT == (1.00525, -0.02323, 0.01740, -0.00253)
    assert (cr.G_START, cr.G_SPLIT, cr.G_COLOUR_LIMITS) == (13.0, 16.0, (0.25, 3.0))
    assert (cr.TREND_COLD, cr.TREND_HOT, cr.TREND_LOGG_MAX) == (3500.0, 6000.0, 3.8)
    assert cr.ABUNDANCE_TRENDS["alpha_m_atm"] == (-2.2918e-5, 0.0861, -0.0514, 0.0059) and cr.ABUNDANCE_TRENDS["ce_h_atm"] == (1.3833e-4, -0.5431, 0.2869, -0.0589)
    assert ex.BAND_RATIOS == {"j_mag": 0.276, "h_mag": 0.176, "k_mag": 0.112, "w1_mag": 0.063, "w2_mag": 0.050} and ex.R_V == 3.1 and ex.REDDENING_TO_AV == 2.742
    assert co.KMS_PER_MASYR_KPC == 4.74047 and co.SOLAR_MOTION == (-11.1, 12.24, 7.25)
    # a trend that switches at its limits
    assert info.poisson_cuts(4) == pytest.approx([0.36787944, 0.73575888, 0.91969860, 0.98101184], abs=1e-8)


def test_fingerprint_goes_from_the_statistics_to_the_release(spark):
    import json

    from skyledger.bindings.b02_filters import FIVE
    from skyledger.bindings.b09_plans import release_inputs
    from skyledger.bindings.registry import Tables
    from skyledger.plans import release as rel
    from skyledger.session import work_folder
    from skyledger.sources import lineage as lin

    predictions, features, kin = release_inputs(Tables(spark, "/root/testdata/sf0.001"))
    folder = work_folder(spark, "predictions")
    lin.mark_fingerprint(predictions, "abc123", [f"{e}_pred" for e in FIVE]).write.parquet(folder)
    stored = spark.read.parquet(folder)
    assert lin.marked_fingerprint(stored) == "abc123"
    out = rel.run_release(stored, features, "source_id", work_folder(spark, "release"), FIVE, kin)
    side = json.loads(out["sidecar"].first().sidecar)
    assert side["stats_fingerprint"] == "abc123" and side["n_rows"] == stored.count()
    assert lin.marked_fingerprint(out["annotated"]) == "abc123"
    plain = rel.run_release(predictions, features, "source_id", work_folder(spark, "release"), FIVE, kin)
    assert "stats_fingerprint" not in json.loads(plain["sidecar"].first().sidecar)
    mixed = lin.mark_fingerprint(stored, "other", ["teff_pred"])
    with pytest.raises(ValueError):
        lin.marked_fingerprint(mixed)


def test_preprocess_projects_and_scales(spark):
    from skyledger.bindings.b07_functions import ZP
    from skyledger.bindings.b09_plans import raw_stars
    from skyledger.bindings.registry import Tables
    from skyledger.plans import cohorts as ch

    grid = vc.sampling_grid()
    df = raw_stars(Tables(spark, "/root/testdata/sf0.001")).limit(20).withColumn("flux", F.transform(F.sequence(F.lit(1), F.lit(int(grid.size))), lambda i: F.col("u1") + F.sqrt(i.cast("double"))))
    frozen = ch.frozen_vector_stats(vc.project_basis(df, "flux"), [c for c in vc.project_basis(df, "flux").columns if c.endswith("_coeffs")][0])
    name = [c for c in vc.project_basis(df, "flux").columns if c.endswith("_coeffs")][0]
    got = ch.preprocess(df, ZP, flux="flux", vector=name, mean=frozen["mean"], sigma=frozen["sigma"], extinction=False)
    assert "flux" not in got.columns and "residual_rms" in got.columns
    z = np.array([r[0] for r in got.select(f"{name}_z").collect()])
    first = z[:, 0]
    assert first.mean() == pytest.approx(0, abs=1e-9) and first.std(ddof=1) == pytest.approx(1)
