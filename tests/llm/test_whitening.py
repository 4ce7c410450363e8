import math
from fractions import Fraction

import numpy as np
import pytest

from skyledger.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n long, deviation string, vec int"


def rows(rng, n=300, dims=6):
    mix = rng.normal(size=(dims, dims))
    out = [(k, (rng.normal(size=dims) @ mix).astype(np.float32).tolist()) for k in range(n)]
    out += [out[0], out[0], (None, out[1][1]), (7000, None), (7001, []), (7002, [1.0] * (dims - 1)), (7003, [float("nan")] * dims), (7004, [float("inf")] * dims), (7005, [None] + [1.0] * (dims - 1))]
    return [(*r, 0, 1, "x", 2) for r in out]


def good(data, dims):
    return [(r[0], r[1]) for r in data if r[1] and len(r[1]) == dims and None not in r[1] and np.isfinite(r[1]).all()]


def test_whitening_equals_exact_arithmetic(spark):
    dims = 6
    data = rows(np.random.default_rng(1), dims=dims)
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    kept = good(data, dims)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(r, total)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    white = np.array([[v / n for v in r] for r in y]) @ (u / np.sqrt(e))
    assert len(got) == n * dims
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(by[0, 1]) == 3
    signs = [np.sign(by[5, k + 1][0]["whitened"] * white[5, k]) for k in range(dims)]
    for (i, _), r, w in zip(kept, y, white):
        for k in range(dims):
            for g in by[i, k + 1]:
                assert g["n"] == n and g["deviation"] == sum(a * a for a in r)
                assert g["whitened"] == pytest.approx(signs[k] * w[k], abs=1e-9)
                assert g["explained"] == pytest.approx(e[k] / np.trace(cov), rel=1e-9)
                assert 0 <= g["identity_error"] < 1e-9


def test_components_are_limited_and_flat_directions_left_out(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(100, 3))
    data = [(k, [*v, 2.5, float(v[0])]) for k, v in enumerate(flat.tolist())]
    got = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))
    assert {r["component"] for r in got.collect()} == {1, 2, 3}
    two = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), components=2).collect()
    assert {r["component"] for r in two} == {1, 2} and len(two) == 200


def test_whitening_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.select("vec_id", whitening.F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_square_sums_are_exact():
    rng = np.random.default_rng(3)
    for bits in (10, 40, 47, 55, 61):
        y = rng.integers(-(2**bits), 2**bits, (500, 4))
        assert whitening.square_sums(y) == [sum(int(a) ** 2 for a in c) for c in y.T]


def test_polarisation_keeps_small_covariances(spark):
    """Large offsets would drown these in floating point."""
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (400, 2))
    data = [(k, [float(2**40 + a), float(2**40 + a + b), float(b)]) for k, (a, b) in enumerate(base.tolist())]
    got = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    a, b = base.T * 64.0
    v = np.cov(np.stack([a, a + b, b]), bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    shares = {r["component"]: r["explained"] for r in got}
    assert shares == {1: pytest.approx(e[0] / e.sum(), rel=1e-9), 2: pytest.approx(e[1] / e.sum(), rel=1e-9)}
    assert max(r["identity_error"] for r in got) < 1e-6
