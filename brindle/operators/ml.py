"""Models on pyspark.ml: point and quantile regression, reduction, clusters, what-if scenarios.

Gaps against gradient boosting libraries, stated here: MLlib has no monotone constraint (see
`monotone`: isotonic in one feature), no quantile loss (`QuantileBands`: residual quantiles by
bands of the prediction) and no Gaussian process (`mixed_effects`: shrunken group effects).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.robust import target_encode


def monotone_vector(features: Sequence[str], increasing: Sequence[str] = ("area",), decreasing: Sequence[str] = ()) -> list[int]:
    """1, -1 or 0 for each feature; one named both ways or unknown is an error."""
    if both := set(increasing) & set(decreasing):
        raise ValueError(f"both increasing and decreasing: {sorted(both)}")
    if unknown := (set(increasing) | set(decreasing)) - set(features):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return [1 if f in increasing else -1 if f in decreasing else 0 for f in features]


def point_model(features: Sequence[str], target: str, iterations: int = 20, depth: int = 5, seed: int = 42, linear: bool = False) -> Pipeline:
    """Median-imputed features into boosted trees (or an elastic net) on the target."""
    filled = [f"{f}__filled" for f in features]
    last = LinearRegression(labelCol=target, featuresCol="features", elasticNetParam=0.5, regParam=0.01) if linear else GBTRegressor(labelCol=target, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), last])


def cross_validated(df: DataFrame, make: Callable[[], Pipeline], fold: str, folds: Sequence[int]) -> DataFrame:
    """Out-of-fold predictions: each fold by a model of the others."""
    parts = [make().fit(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k)) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_search(df: DataFrame, make: Callable[..., Pipeline], grid: Sequence[Mapping], target: str, fold: str, folds: Sequence[int]) -> list[tuple[dict, float]]:
    """(parameters, mean absolute error), best first."""
    scores = []
    for params in grid:
        oof = cross_validated(df, lambda params=params: make(**params), fold, folds)
        scores.append((dict(params), oof.agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]))
    return sorted(scores, key=lambda x: x[1])


def quantile_bands(calibration: DataFrame, apply_to: DataFrame, prediction: str, target: str, levels: Sequence[float], bands: int = 10) -> DataFrame:
    """Adds `quantiles`, sorted: the prediction plus the residual quantiles of its band of predictions."""
    cuts = calibration.agg(F.percentile(prediction, [k / bands for k in range(1, bands)]).alias("__cuts"))
    at = lambda d: d.crossJoin(F.broadcast(cuts)).withColumn("__band", F.size(F.filter("__cuts", lambda c: c <= F.col(prediction)))).drop("__cuts")
    stats = at(calibration).groupBy("__band").agg(F.percentile(F.col(target) - F.col(prediction), list(levels)).alias("__q"))
    out = at(apply_to).join(F.broadcast(stats), "__band", "left")  # `bands` rows
    return out.withColumn("quantiles", F.array_sort(F.transform("__q", lambda q: q + F.col(prediction)))).drop("__band", "__q")


def mixed_effects(train: DataFrame, apply_to: DataFrame, features: Sequence[str], target: str, groups: Sequence[str], smoothing: float = 20.0) -> DataFrame:
    """Adds prediction: a linear fit plus nested group effects of its residuals, shrunken level by level."""
    model = point_model(features, target, linear=True).fit(train)
    resid = model.transform(train).withColumn("__r", F.col(target) - F.col("prediction")).select(*groups, "__r")
    fixed = model.transform(apply_to).withColumnRenamed("prediction", "__fixed").select(*apply_to.columns, "__fixed")
    out = target_encode(resid, fixed, groups, "__r", smoothing)
    return out.withColumn("prediction", F.col("__fixed") + F.col(f"te_{groups[-1]}")).select(*apply_to.columns, "prediction")


def monotone(df: DataFrame, feature: str, target: str, increasing: bool = True) -> DataFrame:
    """Adds prediction: the isotonic fit of the target on one feature."""
    rows = VectorAssembler(inputCols=[feature], outputCol="__f").transform(df.dropna(subset=[feature, target]))
    return IsotonicRegression(featuresCol="__f", labelCol=target, isotonic=increasing).fit(rows).transform(rows).drop("__f")


def reduce_embeddings(train: DataFrame, others: Sequence[DataFrame], column: str, k: int = 32) -> list[DataFrame]:
    """PCA fitted on train alone, mean-centred; adds `reduced` (array) to train and the others."""
    vec = lambda d: d.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    model = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c"), PCA(k=k, inputCol="__c", outputCol="__p")]).fit(vec(train))
    return [model.transform(vec(d)).withColumn("reduced", vector_to_array("__p")).drop("__v", "__c", "__p") for d in (train, *others)]


def geo_clusters(df: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """Adds cluster by k-means on the coordinates."""
    rows = VectorAssembler(inputCols=["east", "north"], outputCol="__v", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).drop("__v")


def what_if(df: DataFrame, id_col: str, scenarios: Mapping[str, Mapping[str, Column]], predict: Callable[[DataFrame], DataFrame], derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(id, scenario, expected, delta): one change at a time; delta is against `baseline`. predict adds `expected`."""
    parts = [predict(derive(df.withColumns(dict(change)))).select(id_col, F.lit(name).alias("scenario"), "expected") for name, change in {"baseline": {}, **scenarios}.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    base = parts[0].select(id_col, F.col("expected").alias("__b"))
    return every.join(base, id_col).select(id_col, "scenario", "expected", (F.col("expected") - F.col("__b")).alias("delta"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, seed: int = 42) -> DataFrame:
    """(feature, importance, share): rise of the mean absolute error when a feature's values are those of other rows."""
    mae = lambda d: d.agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]
    base = mae(model.transform(df))
    rows = []
    for f in features:
        donors = df.select(F.col(f).alias("__v"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("__h"))
        shuffled = donors.orderBy("__h").select("__v").rdd.zipWithIndex().map(lambda t: (t[1], t[0][0])).toDF(f"__i long, __v {dict(df.dtypes)[f]}")
        indexed = df.rdd.zipWithIndex().map(lambda t: (*t[0], t[1])).toDF(", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", __i long")
        rows.append((f, mae(model.transform(indexed.join(shuffled, "__i").withColumn(f, F.col("__v")).drop("__i", "__v"))) - base))
    total = sum(abs(v) for _, v in rows) or 1.0
    return df.sparkSession.createDataFrame([(f, float(v), abs(v) / total) for f, v in rows], "feature string, importance double, share double").orderBy(F.desc("importance"))


def top_drivers(df: DataFrame, id_col: str, contributions: str, k: int = 3) -> DataFrame:
    """(id, rank, feature, value): the k largest contributions by size from a map column of them."""
    pairs = F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("feature"), e["value"].alias("value")))
    return df.select(id_col, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("pos", "e")).select(id_col, (F.col("pos") + 1).alias("rank"), "e.feature", "e.value")


def linear_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds contributions, a map feature -> coefficient * (value - mean): exact Shapley values of a linear model."""
    coefficients = model.stages[-1].coefficients
    means = df.agg(*(F.avg(f).alias(f"__m{k}") for k, f in enumerate(features)))
    out = df.crossJoin(F.broadcast(means))
    parts = [x for k, f in enumerate(features) for x in (F.lit(f), float(coefficients[k]) * (F.coalesce(F.col(f), F.col(f"__m{k}")) - F.col(f"__m{k}")))]
    return out.withColumn("contributions", F.create_map(*parts)).drop(*(f"__m{k}" for k in range(len(features))))


def global_importance(df: DataFrame, contributions: str) -> DataFrame:
    """(feature, mean_abs, mean, share), largest first."""
    rows = df.select(F.explode(contributions).alias("feature", "value")).groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))
    total = rows.agg(F.sum("mean_abs").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("feature", "mean_abs", "mean", F.try_divide("mean_abs", "t").alias("share")).orderBy(F.desc("mean_abs"), "feature")
