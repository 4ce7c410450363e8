"""Baseline regressors, shuffles and projections on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.nulls import is_finite
from skyledger.operators.ranking import hash_rank, join_on_keys, one_row


def fit_linear(df: DataFrame, features: Sequence[str], label: str, ridge: float = 0.0) -> LinearRegressionModel:
    data = df.dropna(subset=[*features, label])
    vec = VectorAssembler(inputCols=list(features), outputCol="__f").transform(data)
    return LinearRegression(featuresCol="__f", labelCol=label, regParam=ridge, solver="normal").fit(vec)


def linear_expression(model: LinearRegressionModel, features: Sequence[str], replaced: dict[str, str] | None = None) -> Column:
    """The fitted model as an arithmetic expression; ``replaced`` swaps feature columns."""
    out = F.lit(float(model.intercept))
    for f, w in zip(features, model.coefficients):
        out = out + float(w) * F.col((replaced or {}).get(f, f))
    return out


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((pred - truth) * (pred - truth)))


def baseline_regressor(train: DataFrame, test: DataFrame, aux: Sequence[str], full: Sequence[str], label: str) -> DataFrame:
    """Held-out rms error of an auxiliary-only and of a full regression, and their ratio."""
    a, b = fit_linear(train, aux, label), fit_linear(train, full, label)
    y = F.col(label)
    out = test.dropna(subset=[*full, label]).agg(
        F.count(F.lit(1)).alias("n"),
        rmse(linear_expression(a, aux), y).alias("rmse_aux"),
        rmse(linear_expression(b, full), y).alias("rmse_full"),
    )
    return out.withColumn("ratio", F.col("rmse_full") / F.col("rmse_aux"))


def shuffle_within(df: DataFrame, cells: Sequence[str], columns: Sequence[str], ids: Sequence[str], seed: int, suffix: str = "__shuffled") -> DataFrame:
    """Exchange column values among the rows of each cell: rank r in one hash order takes the values of rank r in another."""
    to = hash_rank(df, cells, ids, f"{seed}a", "__r")
    donors = hash_rank(df.select(*cells, *ids, *columns), cells, ids, f"{seed}b", "__r")
    donors = donors.select(*cells, "__r", *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return join_on_keys(to, donors, [*cells, "__r"]).drop("__r")


def permutation_importance(df: DataFrame, model: LinearRegressionModel, features: Sequence[str], label: str, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Rise of the rms error when one feature is shuffled over all rows.

    All features are shuffled by one rank join; the errors share one aggregate.
    """
    data = df.dropna(subset=[*features, label])
    shuffled = shuffle_within(data, [], features, ids, seed)
    y = F.col(label)
    aggs = [rmse(linear_expression(model, features), y).alias("base")]
    aggs += [rmse(linear_expression(model, features, {f: f"{f}__shuffled"}), y).alias(f) for f in features]
    wide = shuffled.agg(*aggs)
    long = wide.unpivot(["base"], list(features), "feature", "permuted_rmse")
    return long.select("feature", F.col("base").alias("baseline_rmse"), "permuted_rmse", (F.col("permuted_rmse") - F.col("base")).alias("importance"))


def leave_one_out(df: DataFrame, model: LinearRegressionModel, features: Sequence[str]) -> DataFrame:
    """Change of the prediction when one feature is set to 0."""
    base = linear_expression(model, features)
    zeroed = {f: base - float(w) * F.col(f) for f, w in zip(features, model.coefficients)}
    wide = df.dropna(subset=list(features)).agg(*[rmse(c, base).alias(f) for f, c in zeroed.items()])
    return wide.unpivot([], list(features), "feature", "looco_delta_rmse")


def shuffled_null(df: DataFrame, model: LinearRegressionModel, features: Sequence[str], shuffled: Sequence[str], label: str, cells: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Error with a feature block shuffled inside cells, next to the real error and the label's spread."""
    data = shuffle_within(df.dropna(subset=[*features, label]), cells, shuffled, ids, seed)
    y = F.col(label)
    swap = {f: f"{f}__shuffled" for f in shuffled}
    return data.agg(
        rmse(linear_expression(model, features, swap), y).alias("null_rmse"),
        rmse(linear_expression(model, features), y).alias("base_rmse"),
        F.stddev_pop(label).alias("sigma_y"),
    )


def audit_report(df: DataFrame, features: Sequence[str], labels: Sequence[str], shuffled: Sequence[str], cells: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Per label and feature: baseline, permutation importance, leave-one-out change, null error.

    Labels that are missing in the same rows share the two shuffles.
    """
    kinds = dict(df.dtypes)
    missing = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("float", "double") else F.col(c).isNull() for c in labels}
    unlike = [F.count_if(missing[a] != missing[b]).alias(f"{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels[:i])]
    differ = df.dropna(subset=list(features)).agg(*unlike).first().asDict() if unlike else {}
    alike: list[list[str]] = []
    for i, label in enumerate(labels):
        home = next((g for g in alike if differ[f"{i}_{labels.index(g[0])}"] == 0), None) if alike else None
        alike.append([label]) if home is None else home.append(label)
    out = None
    for group in alike:
        part = _audit(df, features, group, shuffled, cells, ids, seed)
        out = part if out is None else out.unionByName(part)
    return out


def _audit(df: DataFrame, features: Sequence[str], labels: Sequence[str], shuffled: Sequence[str], cells: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """The audit of labels that are present in the same rows."""
    models = [fit_linear(df, features, label) for label in labels]
    rows = df.dropna(subset=[*features, *labels]).select(*dict.fromkeys([*cells, *ids, *features, *shuffled, *labels]))
    swap = lambda names: {f: f"{f}__shuffled" for f in names}
    base, perm, null, alone = [], [], [], []
    for i, (label, m) in enumerate(zip(labels, models)):
        y, pred = F.col(label), linear_expression(m, features)
        base.append(rmse(pred, y).alias(f"base{i}"))
        null.append(rmse(linear_expression(m, features, swap(shuffled)), y).alias(f"null{i}"))
        for j, (f, w) in enumerate(zip(features, m.coefficients)):
            perm.append(rmse(linear_expression(m, features, swap([f])), y).alias(f"perm{i}_{j}"))
            alone.append(rmse(pred - float(w) * F.col(f), pred).alias(f"alone{i}_{j}"))
    wide = shuffle_within(rows, [], features, ids, seed).agg(*base, *perm)
    wide = wide.withColumn("null", one_row(shuffle_within(rows, cells, shuffled, ids, seed).agg(*null)))
    wide = wide.withColumn("alone", one_row(df.dropna(subset=list(features)).agg(*alone)))
    found = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"base{i}").alias("baseline_rmse"),
            F.col(f"perm{i}_{j}").alias("permuted_rmse"),
            (F.col(f"perm{i}_{j}") - F.col(f"base{i}")).alias("importance"),
            F.col("alone")[f"alone{i}_{j}"].alias("looco_delta_rmse"),
            F.col("null")[f"null{i}"].alias("shuffled_null_rmse"),
            F.lit(label).alias("label"),
        )
        for i, label in enumerate(labels)
        for j, f in enumerate(features)
    ]
    return wide.select(F.inline(F.array(*found)))


def _vectors(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Add ``__f``: the columns, or the one array column, as an ML vector; rows with holes are left out."""
    names = [columns] if isinstance(columns, str) else list(columns)
    if isinstance(columns, str):
        values = F.col(columns).cast("array<double>")
    else:
        values = F.array(*[F.col(c).cast("double") for c in names])
    whole = df.withColumn("__a", values).where(F.col("__a").isNotNull() & F.forall("__a", lambda x: F.coalesce(is_finite(x), F.lit(False))))
    return whole.withColumn("__f", array_to_vector("__a")).drop("__a")


def pca_project(df: DataFrame, columns: str | Sequence[str], k: int, keep: Sequence[str]) -> tuple[DataFrame, float]:
    """First k principal components of centred columns (or positions of an array column) and the share of variance they keep.

    The sign of each component is fixed: its largest weight is positive.
    """
    vec = _vectors(df, columns)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__f", outputCol="__c").fit(vec).transform(vec)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    share = float(sum(model.explainedVariance.toArray()))
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    parts = vector_to_array("__p")
    return model.transform(centred).select(*keep, *[(F.get(parts, F.lit(i)) * signs[i]).alias(f"pc{i + 1}") for i in range(k)]), share


def coef_correlation(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Correlation matrix of columns (or positions of an array column) as a long table (its size is the column count squared)."""
    m = Correlation.corr(_vectors(df, columns).select("__f"), "__f").first()[0].toArray()
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, pearson double")
