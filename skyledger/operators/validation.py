"""Gate ablations and the tests behind a promotion decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.flags import AUX_ASSISTED
from skyledger.functions.nulls import coerce_flag
from skyledger.operators.ranking import exact_quantiles, join_on_keys

EPS = 1e-12
NULL_SKILL_LIMIT, PERM_MIN_FRAC, RICH_FRAC = 0.2, 0.05, 0.2


@dataclass(frozen=True)
class GateConfig:
    """A named set of flags and sigma limits."""

    name: str
    ood_flags: tuple[str, ...] = ()
    caveat_flags: tuple[str, ...] = ()
    sigma_limits: Mapping[str, float] = field(default_factory=dict)
    caveat_per_element: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    sigma_units: float | None = None
    use_kin_ood: bool = False


def _or(df: DataFrame, flags: Sequence[str]) -> Column:
    out = F.lit(False)
    for f in flags:
        if f in df.columns:
            out = out | coerce_flag(df, f)
    return out


def gate_tier(df: DataFrame, cfg: GateConfig, element: str, train_sigma: Mapping[str, float] | None = None) -> Column:
    caveat = _or(df, cfg.caveat_per_element.get(element, cfg.caveat_flags))
    limit = cfg.sigma_units * train_sigma[element] if cfg.sigma_units is not None else cfg.sigma_limits[element]
    caveat = caveat | (F.coalesce(F.col(f"{element}_sigma"), F.lit(0.0)) > float(limit))
    if cfg.use_kin_ood and element in AUX_ASSISTED:
        caveat = caveat | _or(df, ("kin_ood_flag",))
    out = F.col(f"{element}_pred").isNull() | _or(df, cfg.ood_flags)
    return F.when(out, 3).when(caveat, 2).otherwise(1)


def ablate_gates(
    df: DataFrame, configs: Sequence[GateConfig], elements: Sequence[str], keep: Sequence[str], train_sigma: Mapping[str, float] | None = None
) -> DataFrame:
    """One row per (row, configuration, element) with its tier, from a single scan."""
    rows = [
        F.struct(
            F.lit(c.name).alias("config"),
            F.lit(e).alias("element"),
            gate_tier(df, c, e, train_sigma).alias("tier"),
            F.col(f"{e}_pred").cast("double").alias("pred"),
            F.col(f"{e}_sigma").cast("double").alias("sigma"),
            F.col(f"{e}_truth").cast("double").alias("truth"),
        )
        for c in configs
        for e in elements
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("s")).select(*keep, "s.*")


def ablation_metrics(long: DataFrame) -> DataFrame:
    """Per configuration, element and tier (and tiers 1+2): n, rmse, bias, mae, coverage, share."""
    ok = long.where("pred is not null and truth is not null and sigma is not null")
    err = F.col("pred") - F.col("truth")
    z = F.abs(err) / F.greatest(F.col("sigma"), F.lit(1e-9))
    groups = F.when(F.col("tier") <= 2, F.array(F.concat(F.lit("tier"), F.col("tier")), F.lit("tier12"))).otherwise(
        F.array(F.concat(F.lit("tier"), F.col("tier")))
    )
    stats = (
        ok.select("config", "element", F.explode(groups).alias("group"), err.alias("e"), z.alias("z"))
        .groupBy("config", "element", "group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
            F.avg("e").alias("bias"),
            F.avg(F.abs("e")).alias("mae"),
            F.avg((F.col("z") <= 1.0).cast("double")).alias("coverage_1sigma"),
            F.avg((F.col("z") <= 2.0).cast("double")).alias("coverage_2sigma"),
        )
    )
    whole = stats.where(F.col("group") != "tier12").groupBy("config", "element").agg(F.sum("n").alias("n_ok"))
    return stats.join(whole, ["config", "element"]).withColumn("frac", F.col("n") / F.col("n_ok")).drop("n_ok")


def holdout_rmse(df: DataFrame, cell: str, pred: str, truth: str, *, ratio_limit: float = 2.0, bias_limit: float = 0.05) -> DataFrame:
    """Worst to median cell rms and worst cell bias, with the verdict; cells need two rows."""
    d = F.col(pred) - F.col(truth)
    cells = df.groupBy(cell).agg(
        F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias")
    ).where("n >= 2").withColumn("__one", F.lit(0))
    worst = cells.groupBy("__one").agg(F.max("rmse").alias("worst_rmse"), F.max(F.abs("bias")).alias("worst_bias"))
    mid = exact_quantiles(cells, ["__one"], "rmse", {"median_rmse": 0.5})
    out = join_on_keys(worst, mid, ["__one"]).drop("__one")
    out = out.withColumn("ratio", F.col("worst_rmse") / F.greatest(F.col("median_rmse"), F.lit(EPS)))
    return out.withColumn("passed", (F.col("ratio") <= ratio_limit) & (F.col("worst_bias") <= bias_limit))


def cluster_precision(df: DataFrame, cluster: str, value: str, sigma: float, *, inflation: float = 1.5, min_members: int = 3) -> DataFrame:
    """Median over clusters of the members' scatter against a limit."""
    per = df.groupBy(cluster).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s")).where(F.col("n") >= min_members)
    out = exact_quantiles(per, [], "s", {"sigma_intra": 0.5}, "n_clusters")
    return out.withColumn("passed", F.col("sigma_intra") < sigma * inflation)


def catalogue_consistency(df: DataFrame, pred: str, external: Sequence[str], sigma: float, *, bias_limit: float = 0.05, multiple: float = 2.0) -> DataFrame:
    """Bias and scatter against each external catalogue, and the worst-case verdict."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("catalogue"), (F.col(pred) - F.col(c)).alias("d")) for c in external])).alias("s")
    ).select("s.*").where("d is not null")
    per = long.groupBy("catalogue").agg(F.avg("d").alias("bias"), F.stddev_samp("d").alias("scatter"))
    return per.agg(F.max(F.abs("bias")).alias("worst_bias"), F.max("scatter").alias("worst_scatter")).withColumn(
        "passed", (F.col("worst_bias") <= bias_limit) & (F.col("worst_scatter") <= sigma * multiple)
    )


def audit_gate(
    importance: DataFrame, *, value: str, looco: str, null_ratio: Column, decorr_ratio: Column, min_informative: int = 3, min_delta: float = 0.02, null_limit: float = NULL_SKILL_LIMIT, decorr_min: float = 0.5
) -> DataFrame:
    """Informative coefficients counted, four limits combined."""
    out = importance.agg(
        F.count_if(F.col(value) > min_delta).alias("n_informative"),
        F.coalesce(F.max(F.abs(F.col(looco))) > EPS, F.lit(False)).alias("looco_nontrivial"),
    ).withColumn("null_ok", null_ratio <= null_limit).withColumn("decorr_ok", decorr_ratio >= decorr_min)
    return out.withColumn(
        "passed", (F.col("n_informative") >= min_informative) & F.col("looco_nontrivial") & F.col("null_ok") & F.col("decorr_ok")
    )


def promotion_decision(t1: Column, t2: Column, t3: Column, t4: Column, t5: Column, t6: Column, calibrated: Column) -> Column:
    """Six outcomes to a tier; the first four are hard gates."""
    hard = t1 & t2 & t3 & t4
    soft = t5 & t6
    return (
        F.when(~F.coalesce(hard, F.lit(False)), "tier_3_rejected")
        .when(~F.coalesce(soft, F.lit(False)), "tier_3_internal")
        .when(F.coalesce(calibrated, F.lit(False)), "tier_1")
        .otherwise("tier_2")
    )


def skill_ratio(null_rmse: Column, base_rmse: Column, sigma_y: Column) -> Column:
    s = F.greatest(sigma_y, F.lit(EPS))
    real, null = 1.0 - base_rmse / s, 1.0 - null_rmse / s
    return F.when(real > 0, null / real)


def classify_label(ratio: Column, joint_frac: Column) -> dict[str, Column]:
    """Verdict, tier and halt flag from the skill ratio and the spectrum's share."""
    unknown = ratio.isNull() | joint_frac.isNull()
    prior = ratio >= NULL_SKILL_LIMIT
    verdict = (
        F.when(unknown, "indeterminate")
        .when(prior & (joint_frac < PERM_MIN_FRAC), "null-prior-dominated")
        .when(prior, "prior-augmented")
        .when(joint_frac >= RICH_FRAC, "information-rich")
        .when(joint_frac >= PERM_MIN_FRAC, "information-poor")
        .otherwise("null-prior-dominated")
    )
    tier = F.when(verdict == "information-rich", "tier-1").when(verdict == "prior-augmented", "tier-1-caveat").when(
        verdict == "information-poor", "tier-2"
    ).otherwise("tier-3")
    return {"verdict": verdict, "tier": tier, "halt": tier == "tier-3"}
