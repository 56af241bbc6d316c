"""Robust statistics with a hierarchy of groups: z-scores, rates, target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.order import quantiles, settled

KAPPA = 0.6745  # of a normal: median absolute deviation / standard deviation
MEAN_KAPPA = 1.253314  # standard deviation / mean absolute deviation


def _spreads(units: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(level, unit, n, center, mad, mean_dev) by each of the groups (levels 0, 1, ...) and in all (level -1).

    An object counts once in a unit, by its median.
    """
    keys = ["level", "unit"]
    levels = [F.struct(F.lit(k).alias("level"), F.col(key).cast("string").alias("unit")) for k, key in enumerate(groups)]
    levels.append(F.struct(F.lit(-1).alias("level"), F.lit("").alias("unit")))
    rows = units.select("__object", "__x", F.explode(F.array(*levels)).alias("l")).select("__object", "__x", "l.*").where("unit is not null")
    per = settled(rows.groupBy(*keys, "__object").agg(F.median("__x").alias("v")))
    centers = quantiles(per, F.col("v"), [0.5], keys).select(*keys, F.col("q")[0].alias("center"))
    far = settled(per.join(centers, keys).select(*keys, "center", F.abs(F.col("v") - F.col("center")).alias("d")))
    mads = quantiles(far, F.col("d"), [0.5], keys).select(*keys, "n", F.col("q")[0].alias("mad"))
    return settled(far.groupBy(*keys, "center").agg(F.avg("d").alias("mean_dev")).join(mads, keys))


def price_zscores(df: DataFrame, groups: Sequence[str] = ("municipality_id", "district_id", "canton"), object_id: str | None = None, min_group: int = 10, min_scale_ratio: float = 0.5, price: str = "price", area: str = "area", id_col: str = "listing_id") -> DataFrame:
    """Adds z: the robust z-score of ln(price / area) in the finest usable group, null without a valid price and area.

    groups go from fine to coarse. Each object counts once, by its median. A level is usable with
    min_group objects and spread; its scale is at least min_scale_ratio of the next coarser usable
    one's. Without a usable level the whole table counts, by mean deviation if it has no MAD.
    """
    x = F.when((F.col(price) > 0) & (F.col(area) > 0), F.ln(F.col(price) / F.col(area)))
    obj = F.col(object_id).cast("string") if object_id else F.col(id_col).cast("string")
    rows = df.withColumn("__x", x).withColumn("__object", F.coalesce(obj, F.concat(F.lit("row "), F.col(id_col).cast("string"))))
    units = rows.where(F.col("__x").isNotNull())
    spreads = _spreads(units, groups)
    scale = F.when(F.col("mad") > 0, F.col("mad") / KAPPA).otherwise(MEAN_KAPPA * F.col("mean_dev"))
    whole = spreads.where("level = -1").agg(F.max("center").alias("__c"), F.max(scale).alias("__s"))
    out = rows.crossJoin(F.broadcast(whole))  # one row
    best_c, best_s, parent = F.col("__c"), F.col("__s"), F.col("__s")
    for k, key in reversed(list(enumerate(groups))):
        usable = spreads.where((F.col("level") == k) & (F.col("n") >= min_group) & (F.col("mad") > 0))
        stats = usable.select(F.col("unit").alias(f"__k{k}"), F.col("center").alias(f"__c{k}"), (F.col("mad") / KAPPA).alias(f"__m{k}"))
        out = out.join(stats, F.col(key).cast("string") == F.col(f"__k{k}"), "left")
        usable = F.col(f"__m{k}").isNotNull()
        floor = F.greatest(F.col(f"__m{k}"), min_scale_ratio * parent)
        parent = F.when(usable, floor).otherwise(parent)
        best_c, best_s = F.when(usable, F.col(f"__c{k}")).otherwise(best_c), parent
    z = F.when(F.col("__x").isNotNull(), F.when(best_s > 0, (F.col("__x") - best_c) / best_s).otherwise(0.0))
    return out.withColumn("z", z).select(*df.columns, "z")


def price_outliers(df: DataFrame, threshold: float = 3.5, **options) -> DataFrame:
    """Adds is_outlier: |z| above the threshold, false without a z."""
    return price_zscores(df, **options).withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False))).drop("z")


def naive_rates(train: DataFrame, apply_to: DataFrame, levels: Sequence[str] = ("municipality_id", "district_id", "canton"), min_count: int = 5, price: str = "price", area: str = "area") -> DataFrame:
    """Adds rate (median price / area of the finest level with min_count rows, else of all), rate_source and prediction."""
    rows = train.where((F.col(area) > 0) & F.col(price).isNotNull()).withColumn("__r", F.col(price) / F.col(area))
    whole = quantiles(rows, F.col("__r"), [0.5]).select(F.col("q")[0].alias("__all"))
    out, rate, source = apply_to.crossJoin(F.broadcast(whole)), [], []
    for k, key in enumerate(levels):
        stats = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{k}")).agg(F.median("__r").alias(f"__r{k}"), F.count("*").alias("n")).where(F.col("n") >= min_count).drop("n")
        out = out.join(stats, F.col(key) == F.col(f"__k{k}"), "left")
        rate.append(F.col(f"__r{k}"))
        source.append(F.when(F.col(f"__r{k}").isNotNull(), key))
    out = out.withColumn("rate", F.coalesce(*rate, F.col("__all"))).withColumn("rate_source", F.coalesce(*source, F.lit("global")))
    return out.withColumn("prediction", F.col("rate") * F.col(area)).select(*apply_to.columns, "rate", "rate_source", "prediction")


def _chain(keys: Sequence[str]) -> list[str]:
    return [f"__e{k}" for k in range(len(keys))]


def target_encode(train: DataFrame, apply_to: DataFrame, keys: Sequence[str], target: str, smoothing: float = 20.0) -> DataFrame:
    """Adds te_<key> for path keys from coarse to fine: (sum + m * parent's encoding) / (n + m); unseen and null keys take the parent's.

    Level by level, each a group-by and a join of one row a key.
    """
    rows = train.where(F.col(target).isNotNull())
    mean = rows.agg(F.avg(target).alias("__mean"))
    out, parent = apply_to.crossJoin(F.broadcast(mean)), F.col("__mean")
    seen = rows.crossJoin(F.broadcast(mean)).withColumn("__p", F.col("__mean"))
    for k, key in enumerate(keys):
        stats = seen.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{k}")).agg(F.sum(target).alias("s"), F.count("*").alias("n"), F.min("__p").alias("p"))
        stats = stats.select(f"__k{k}", ((F.col("s") + smoothing * F.col("p")) / (F.col("n") + smoothing)).alias(f"__e{k}"))
        out = out.join(stats, F.col(key) == F.col(f"__k{k}"), "left")
        parent = F.coalesce(F.col(f"__e{k}"), parent)
        out = out.withColumn(f"te_{key}", parent)
        seen = seen.join(stats, F.col(key) == F.col(f"__k{k}"), "left").withColumn("__p", F.coalesce(F.col(f"__e{k}"), F.col("__p"))).drop(f"__k{k}", f"__e{k}")
    return out.select(*apply_to.columns, *(f"te_{key}" for key in keys))


def target_encode_oof(df: DataFrame, keys: Sequence[str], target: str, fold: str, smoothing: float = 20.0) -> DataFrame:
    """Out-of-fold encodings: each row by the rows of the other folds, with their own global mean.

    Sums of all folds less those of the row's fold, so each level is two group-bys whatever the
    number of folds.
    """
    rows = df.where(F.col(target).isNotNull())
    by_fold = rows.groupBy(F.col(fold).alias("f")).agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    total = rows.agg(F.sum(target).alias("all_s"), F.count("*").alias("all_n"))
    means = by_fold.crossJoin(F.broadcast(total)).select("f", F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("__mean"))
    out = df.join(F.broadcast(means), F.col(fold) == F.col("f"), "left").drop("f")  # one row a fold
    parent = F.col("__mean")
    for k, key in enumerate(keys):
        known = rows.where(F.col(key).isNotNull())
        own = known.groupBy(F.col(key).alias("k1"), F.col(fold).alias("f1")).agg(F.sum(target).alias("s1"), F.count("*").alias("n1"))
        every = own.groupBy(F.col("k1").alias("k2")).agg(F.sum("s1").alias("s2"), F.sum("n1").alias("n2"))
        # a fold without rows of the key still meets the key's other rows
        out = out.join(every, F.col(key) == F.col("k2"), "left").join(own, (F.col(key) == F.col("k1")) & (F.col(fold) == F.col("f1")), "left")
        s, n = F.col("s2") - F.coalesce("s1", F.lit(0.0)), F.col("n2") - F.coalesce("n1", F.lit(0))
        parent_now = parent
        out = out.withColumn(f"te_{key}", F.when(n > 0, (s + smoothing * parent_now) / (n + smoothing)).otherwise(parent_now)).drop("k1", "f1", "s1", "n1", "k2", "s2", "n2")
        parent = F.col(f"te_{key}")
    return out.drop("__mean")


def winsor_bounds(df: DataFrame, columns: Sequence[str], share: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """(column, low, high): quantiles by linear interpolation, the extremes where these coincide."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    values = df.select(each.alias("x")).select("x.*")
    found = quantiles(values, F.col("v"), [*share, 0.0, 1.0], ["column"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    q = F.col("q")
    same = q[0] == q[1]
    return names.join(found, "column", "left").select("column", F.when(same, q[2]).otherwise(q[0]).alias("low"), F.when(same, q[3]).otherwise(q[1]).alias("high"))


def weighted_unit_scores(df: DataFrame, values: Sequence[str], weight: str, group: str) -> DataFrame:
    """Weighted means by group, each column over its own non-null rows; total weight and rows."""

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c)

    return df.groupBy(group).agg(*map(mean, values), F.sum(weight).alias("weight"), F.count("*").alias("units"))


def majority(df: DataFrame, group: str, category: str, weight: str) -> DataFrame:
    """(group, category) with the largest summed weight; of equals the first by name."""
    sums = df.groupBy(group, category).agg(F.sum(weight).alias("w"))
    return sums.groupBy(group).agg(F.min_by(category, F.struct(-F.col("w"), F.col(category))).alias(category))
