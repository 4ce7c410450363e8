"""Gaussian mixtures: two modes per cell, and a seeded mixture of a plane."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.binning import bin_index
from skyledger.functions.nulls import finite

MIN_CELL, MIN_MINOR, MIN_SEPARATION, BIC_GAIN = 50, 0.15, 0.08, 4.0
REG = 1e-5
# first centres of the two components, in standard deviations
STARTS = ((-1.0, 1.0), (-0.5, 1.5), (-1.5, 0.5))
# Physical positions of the three seeds.
SEED_MEANS = ((0.25, 0.00), (-0.50, 0.20), (-1.25, 0.20))


def bimodality_per_cell(
    df: DataFrame,
    axes: Mapping[str, tuple[str, Sequence[float]]],
    value: str,
    *,
    min_cell: int = MIN_CELL,
    min_minor: float = MIN_MINOR,
    min_separation: float = MIN_SEPARATION,
    bic_gain: float = BIC_GAIN,
    max_iter: int = 100,
    tol: float = 1e-3,
) -> DataFrame:
    """One against two Gaussian components in every grid cell, compared by BIC.

    Two components are fitted from three fixed starts (in units of the cell's
    scatter around its mean) and the likeliest is kept; ``converged`` tells
    whether its last step gained less than ``tol`` for each row.

    Each EM step is a combinable aggregate over all cells at once, so the size of a
    cell does not matter. Between steps only the parameters of the cells, whose
    number the grid edges fix, pass through the driver.
    """
    spark = df.sparkSession
    keys = [f"i_{a}" for a in axes]
    binned = df.select(*[bin_index(c, e).alias(f"i_{a}") for a, (c, e) in axes.items()], F.col(value).cast("double").alias("x"))
    binned = binned.dropna()
    moments = binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    usable = moments.where((F.col("n") >= min_cell) & (F.col("var") > 0))
    data = binned.join(usable.select(*keys, "mean"), keys).select(*keys, (F.col("x") - F.col("mean")).alias("x")).persist()
    cells = {tuple(r[k] for k in keys): r for r in usable.collect()}
    state = {
        (*c, i): [0.5, low * math.sqrt(r["var"]), high * math.sqrt(r["var"]), r["var"], r["var"], -math.inf]
        for c, r in cells.items()
        for i, (low, high) in enumerate(STARTS)
    }
    active, runs = set(state), [*keys, "start"]
    schema = ", ".join([f"{k} int" for k in runs] + ["w double, m1 double, m2 double, v1 double, v2 double"])

    def log_normal(m: str, v: str) -> Column:
        return -0.5 * (F.ln(2.0 * math.pi * F.col(v)) + (F.col("x") - F.col(m)) * (F.col("x") - F.col(m)) / F.col(v))

    try:
        for _ in range(max_iter):
            if not active:
                break
            params = spark.createDataFrame([(*c, *state[c][:5]) for c in sorted(active)], schema)
            j = data.join(params, keys)
            a = F.ln("w") + log_normal("m1", "v1")
            b = F.ln(1.0 - F.col("w")) + log_normal("m2", "v2")
            top = F.greatest(a, b)
            j = j.withColumn("lp", top + F.ln(F.exp(a - top) + F.exp(b - top))).withColumn("r", F.exp(a - F.col("lp")))
            sums = j.groupBy(*runs).agg(
                F.sum("lp").alias("ll"),
                F.sum("r").alias("r"),
                F.sum(F.col("r") * F.col("x")).alias("rx"),
                F.sum(F.col("r") * F.col("x") * F.col("x")).alias("rxx"),
                F.sum("x").alias("sx"),
                F.sum(F.col("x") * F.col("x")).alias("sxx"),
                F.count(F.lit(1)).alias("n"),
            )
            for s in sums.collect():
                c = tuple(s[k] for k in runs)
                n, r1 = s["n"], min(max(s["r"], 1e-9), s["n"] - 1e-9)
                r2 = n - r1
                m1, m2 = s["rx"] / r1, (s["sx"] - s["rx"]) / r2
                v1 = max(s["rxx"] / r1 - m1 * m1, 0.0) + REG
                v2 = max((s["sxx"] - s["rxx"]) / r2 - m2 * m2, 0.0) + REG
                gain = (s["ll"] - state[c][5]) / n
                state[c] = [r1 / n, m1, m2, v1, v2, s["ll"]]
                if abs(gain) < tol:
                    active.discard(c)
    finally:
        data.unpersist()
    rows = []
    for c, r in cells.items():
        best = max(((*c, i) for i in range(len(STARTS))), key=lambda k: state[k][5])
        w, m1, m2, _, _, ll2 = state[best]
        n = r["n"]
        ll1 = -0.5 * n * (math.log(2.0 * math.pi * r["var"]) + 1.0)
        bic1, bic2 = -2.0 * ll1 + 2 * math.log(n), -2.0 * ll2 + 5 * math.log(n)
        minor, gap = min(w, 1.0 - w), abs(m1 - m2)
        flag = bic2 + bic_gain < bic1 and minor >= min_minor and gap >= min_separation
        rows.append((*c, bool(flag), float(bic1 - bic2), float(minor), float(gap), best not in active))
    fits = spark.createDataFrame(rows, ", ".join([f"{k} int" for k in keys] + ["bimodal boolean, bic_gain double, minor_weight double, mean_sep double, converged boolean"]))
    out = moments.select(*keys, "n").join(fits, keys, "left")
    return out.withColumn("is_bimodal", F.coalesce("bimodal", F.lit(False))).drop("bimodal")


def seeded_mixture(
    df: DataFrame, columns: Sequence[str], seeds: Sequence[Sequence[float]] = SEED_MEANS, max_iter: int = 400, tol: float = 1e-3, ridge: float = 1e-6
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Full-covariance mixture started at the given centres; component i grows from seed i.

    Columns are z-scored; weights start equal and covariances as unit matrices,
    so the result depends on the rows alone. A step is one combinable aggregate
    of a few sums for each component. Returns means and covariances in the
    original units: k small matrices.
    """
    k, d = len(seeds), len(columns)
    data = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]).dropna()
    row = data.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    mean = np.array([row[f"m_{c}"] for c in columns])
    sd = np.array([row[f"s_{c}"] or 1.0 for c in columns])
    z = data.select(*[((F.col(c) - float(m)) / float(s)).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(columns, mean, sd))]).persist()
    means = [(np.asarray(s) - mean) / sd for s in seeds]
    covs, weights, before = [np.eye(d) for _ in seeds], [1.0 / k] * k, -math.inf
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    try:
        for _ in range(max_iter):
            logs = []
            for w, m, c in zip(weights, means, covs):
                inv, off = np.linalg.inv(c), [F.col(f"z{i}") - float(v) for i, v in enumerate(m)]
                shape = sum((float(inv[i, j]) * (1.0 if i == j else 2.0) * off[i] * off[j] for i, j in pairs), F.lit(0.0))
                logs.append(F.lit(math.log(w) - 0.5 * (d * math.log(2.0 * math.pi) + float(np.linalg.slogdet(c)[1]))) - 0.5 * shape)
            step = z.select("*", *[v.alias(f"l{i}") for i, v in enumerate(logs)]).withColumn("top", F.greatest(*[f"l{i}" for i in range(k)]))
            step = step.withColumn("lp", F.col("top") + F.ln(sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in range(k)), F.lit(0.0))))
            sums = [F.count(F.lit(1)).alias("n"), F.sum("lp").alias("ll")]
            for q in range(k):
                r = F.exp(F.col(f"l{q}") - F.col("lp"))
                sums += [F.sum(r).alias(f"r{q}"), *[F.sum(r * F.col(f"z{i}")).alias(f"x{q}_{i}") for i in range(d)]]
                sums += [F.sum(r * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"y{q}_{i}_{j}") for i, j in pairs]
            got = step.agg(*sums).first()
            for q in range(k):
                r = max(got[f"r{q}"], 1e-9)
                m = np.array([got[f"x{q}_{i}"] / r for i in range(d)])
                c = np.zeros((d, d))
                for i, j in pairs:
                    c[i, j] = c[j, i] = got[f"y{q}_{i}_{j}"] / r - m[i] * m[j]
                weights[q], means[q], covs[q] = r / got["n"], m, c + ridge * np.eye(d)
            gain, before = got["ll"] / got["n"] - before, got["ll"] / got["n"]
            if abs(gain) < tol:
                break
    finally:
        z.unpersist()
    scale = np.diag(sd)
    return [m * sd + mean for m in means], [scale @ c @ scale for c in covs]


def gmm_assign(columns: Sequence[str], means: Sequence[Sequence[float]], covs: Sequence[np.ndarray]) -> Column:
    """Index of the component with the largest log density."""
    scores = []
    for m, c in zip(means, covs):
        c = np.asarray(c, dtype=float)
        inv, logdet = np.linalg.pinv(c), float(np.linalg.slogdet(c)[1])
        d = [F.col(x) - float(v) for x, v in zip(columns, m)]
        total = F.lit(logdet)
        for i in range(len(d)):
            for j in range(len(d)):
                total = total + float(inv[i, j]) * d[i] * d[j]
        scores.append(-0.5 * total)
    arr = F.array(*scores)
    return F.when(F.col(columns[0]).isNotNull(), (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))
