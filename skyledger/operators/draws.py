"""Monte Carlo draws of correlated astrometry, reproducible from hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.hashing import hash_uniform


def unit_normal(seed: str, *ids: str) -> Column:
    """Standard normal number by the Box-Muller transform of two hashed uniforms."""
    return F.sqrt(-2.0 * F.ln(hash_uniform(f"{seed}a", *ids))) * F.cos(2.0 * math.pi * hash_uniform(f"{seed}b", *ids))


def draw_astrometry(df: DataFrame, ids: Sequence[str], n: int, names: tuple[str, str, str, str] = ("0p", "0m", "0d", "0v")) -> DataFrame:
    """``n`` draws per row of parallax and proper motion with their 3x3 covariance, and of velocity.

    The Cholesky factor of the correlation matrix is written out. A draw with a
    parallax that is not positive has no distance.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    out = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.withColumns({f"__z{i}": unit_normal(s, "draw", *ids) for i, s in enumerate(names)})
    z = [F.col(f"__z{i}") for i in range(4)]
    a, b, c = F.col("parallax_pmra_corr"), F.col("parallax_pmdec_corr"), F.col("pmra_pmdec_corr")
    l22 = F.sqrt(F.greatest(1.0 - a * a, F.lit(1e-12)))
    l32 = (c - a * b) / l22
    l33 = F.sqrt(F.greatest(1.0 - b * b - l32 * l32, F.lit(0.0)))
    plx = F.col("parallax") + F.col("parallax_error") * z[0]
    return out.select(
        *ids,
        "draw",
        F.when(plx > 0, 1000.0 / plx).alias("dist_pc"),
        (F.col("pmra") + F.col("pmra_error") * (a * z[0] + l22 * z[1])).alias("pmra"),
        (F.col("pmdec") + F.col("pmdec_error") * (b * z[0] + l32 * z[1] + l33 * z[2])).alias("pmdec"),
        (F.col("rv") + F.col("rv_error") * z[3]).alias("radial_velocity"),
    )
