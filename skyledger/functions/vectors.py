"""Fixed-length vectors held as array columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LN10 = math.log(10.0)

# Sampling grid and orthogonal basis of the two spectral bands (nm).
SAMPLES, SAMPLE_LO, SAMPLE_HI = 330, 360.0, 990.0
BANDS = {"bp": (360.0, 660.0, 510.0, 30.0), "rp": (660.0, 990.0, 825.0, 33.0)}
BASIS_SIZE = 55


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def double_array(c) -> Column:
    return _c(c).cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bad_spectrum(c) -> Column:
    """Missing vector, missing element, or first coefficient not positive."""
    c = _c(c)
    holes = F.exists(c, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(c.isNull() | holes | (F.get(c, F.lit(0)) <= 0), F.lit(True))


def spectrum_reject_counts(df: DataFrame, columns: Sequence[str], present: str | None = None) -> DataFrame:
    """One row: vectors with holes, with first coefficient <= 0, and rows without a spectrum."""
    aggs = []
    for c in columns:
        holes = F.exists(c, lambda x: x.isNull() | F.isnan(x))
        aggs += [
            F.count_if(F.coalesce(holes, F.lit(False))).alias(f"{c}_nan_rows"),
            F.count_if(F.get(c, F.lit(0)) <= 0).alias(f"{c}_nonpos_c0"),
            F.count_if(F.col(c).isNull()).alias(f"{c}_missing"),
        ]
    if present:
        aggs.append(F.count_if(~F.coalesce(F.col(present), F.lit(False))).alias("flagged_absent"))
    return df.agg(*aggs)


def normalise_vector(coeffs) -> Column:
    """log10 of the first coefficient, then the others divided by it."""
    c = double_array(coeffs)
    c0 = F.get(c, F.lit(0))
    return F.transform(c, lambda x, i: F.when(i == 0, F.log10(c0)).otherwise(x / c0))


def normalise_errors(coeffs, errors) -> Column:
    """First-order errors of ``normalise_vector``."""
    c, e = double_array(coeffs), double_array(errors)
    c0, s0 = F.get(c, F.lit(0)), F.get(e, F.lit(0))

    def ratio_error(x, s):
        a, b = s / c0, x * s0 / (c0 * c0)
        return F.sqrt(a * a + b * b)

    tail = F.zip_with(c, e, ratio_error)
    return F.transform(tail, lambda v, i: F.when(i == 0, s0 / (c0 * LN10)).otherwise(v))


def zscore_vector(values, mean, sigma) -> Column:
    """Element-wise ``(x - mean) / sigma``; ``mean`` and ``sigma`` are array columns or sequences."""
    m = mean if isinstance(mean, Column) else literal_vector(mean)
    s = sigma if isinstance(sigma, Column) else literal_vector(sigma)
    centred = F.zip_with(double_array(values), m, lambda x, u: x - u)
    return F.zip_with(centred, s, lambda x, u: x / u)


def unscale_labels(values, mean, scale, order: Sequence[int] | None = None) -> Column:
    """``x * scale + mean`` per element, then an optional reordering."""
    x = F.zip_with(double_array(values), literal_vector(scale), lambda v, s: v * s)
    x = F.zip_with(x, literal_vector(mean), lambda v, m: v + m)
    return F.array(*[F.get(x, F.lit(i)) for i in order]) if order else x


def unscale_covariance(upper, scale: Sequence[float]) -> Column:
    """Upper-triangular covariance multiplied by ``s_i * s_j``."""
    n = len(scale)
    factors = [scale[i] * scale[j] for i in range(n) for j in range(i, n)]
    return F.zip_with(double_array(upper), literal_vector(factors), lambda v, f: v * f)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(double_array(a), double_array(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def l2_normalise(values) -> Column:
    """Missing elements become 0, then unit length."""
    v = F.transform(double_array(values), lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def assemble_vector(columns: Sequence[str]) -> Column:
    """Columns in contract order as one array; missing values stay missing."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def select_block(values, start: int, length: int) -> Column:
    """A sub-block of an array column, 0-based."""
    return F.slice(_c(values), start + 1, length)


def sampling_grid(n: int = SAMPLES, lo: float = SAMPLE_LO, hi: float = SAMPLE_HI) -> np.ndarray:
    return np.geomspace(lo, hi, n)


def trapezoid_weights(grid: np.ndarray) -> np.ndarray:
    gaps = np.diff(grid)
    return np.concatenate([[gaps[0]], gaps[:-1] + gaps[1:], [gaps[-1]]]) / 2.0


def oscillator_functions(order: int, u: np.ndarray) -> np.ndarray:
    """Orthonormal Hermite functions 0..order-1 by their three-term recurrence, one column each."""
    columns = [np.exp(-u * u / 2.0) * math.pi**-0.25]
    previous = np.zeros_like(u)
    for n in range(1, order):
        following = math.sqrt(2.0 / n) * u * columns[-1] - math.sqrt((n - 1) / n) * previous
        previous = columns[-1]
        columns.append(following)
    return np.stack(columns, axis=1)


def band_basis(grid: np.ndarray, lo: float, hi: float, centre: float, scale: float, order: int, closed: bool):
    """Weighted-orthonormal basis on the part of the grid inside the band (driver-size constant)."""
    inside = (grid >= lo) & ((grid <= hi) if closed else (grid < hi))
    w = trapezoid_weights(grid)[inside]
    raw = oscillator_functions(order, (grid[inside] - centre) / scale)
    q, r = np.linalg.qr(raw * np.sqrt(w)[:, None])
    q = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return inside, w, q / np.sqrt(w)[:, None]


def project_basis(
    df: DataFrame,
    flux: str,
    *,
    grid: np.ndarray | None = None,
    bands: dict[str, tuple[float, float, float, float]] = BANDS,
    order: int = BASIS_SIZE,
) -> DataFrame:
    """Project each spectrum on the fixed basis of every band; keep coefficients and residual rms.

    Arrow batches in, one matrix product per batch; a row of the wrong width raises.
    """
    grid = sampling_grid() if grid is None else grid
    names = list(bands)
    parts = {
        b: band_basis(grid, *bands[b], order=order, closed=(b == names[-1])) for b in names
    }
    schema = ", ".join([f"{b} array<double>, rms_{b} double" for b in names] + ["rms double"])

    @F.pandas_udf(schema)
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            if any(len(v) != grid.size for v in s):
                raise ValueError(f"spectrum must have {grid.size} samples")
            x = np.stack(s.to_numpy()).astype(float) if len(s) else np.zeros((0, grid.size))
            out, total, width = {}, 0.0, 0
            for b, (inside, w, psi) in parts.items():
                f = x[:, inside]
                c = (f * w) @ psi
                r2 = (f - c @ psi.T) ** 2
                out[b] = list(c)
                out[f"rms_{b}"] = np.sqrt(r2.mean(axis=1))
                total, width = total + r2.sum(axis=1), width + r2.shape[1]
            out["rms"] = np.sqrt(total / width)
            yield pd.DataFrame(out)

    kept = [F.col(c) for c in df.columns if c != flux]
    return df.select(*kept, project(double_array(flux)).alias("p")).select(
        *[c for c in df.columns if c != flux],
        *[F.col(f"p.{b}").alias(f"{b}_coeffs") for b in names],
        *[F.col(f"p.rms_{b}").alias(f"residual_rms_{b}") for b in names],
        F.col("p.rms").alias("residual_rms"),
    )
