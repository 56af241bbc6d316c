"""Group-disjoint splits, folds and samples; every assignment is a function of keys and a seed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.order import quantiles


def group_key(group: str, row_id: str) -> Column:
    """The group as text; rows without one are groups of their own."""
    return F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("row"), F.col(row_id).cast("string")))


def make_strata(df: DataFrame, row_id: str, region: str = "canton", price: str = "price", bins: int = 4, least: int = 10) -> DataFrame:
    """Adds stratum `region|Pk`: quantile bands of the price, right-closed; PNA for a null price, NA for a null region.

    Strata under `least` rows become `ALL|Pk`; where that is still too small, the band's largest kept
    stratum (ties by label) takes it, else the largest of all, else `ALL|ALL`.
    """
    cuts = quantiles(df, F.col(price), [k / bins for k in range(1, bins)]).select(F.col("q").alias("__q"))
    rows = df.crossJoin(F.broadcast(cuts))
    distinct = F.array_distinct(F.coalesce("__q", F.array().cast("array<double>")))
    band = F.when(F.col(price).isNull(), "PNA").otherwise(F.concat(F.lit("P"), (F.size(F.filter(distinct, lambda c: F.col(price) > c)) + 1).cast("string")))
    rows = rows.withColumn("__band", band).withColumn("__s", F.concat_ws("|", F.coalesce(F.col(region).cast("string"), F.lit("NA")), "__band")).drop("__q")

    def sizes(d: DataFrame) -> DataFrame:
        return d.groupBy("__s", "__band").agg(F.count("*").alias("__n"))

    one = sizes(rows).select(F.col("__s").alias("__old"), F.when(F.col("__n") < least, F.concat(F.lit("ALL|"), F.col("__band"))).otherwise(F.col("__s")).alias("__s1"))
    rows = rows.join(one, F.col("__s") == F.col("__old")).drop("__old", "__s").withColumnRenamed("__s1", "__s")
    two = sizes(rows)
    kept = two.where(F.col("__n") >= least)
    by_band = kept.groupBy(F.col("__band").alias("b")).agg(F.min(F.struct(-F.col("__n"), F.col("__s").alias("s")))["s"].alias("take"))
    largest = kept.agg(F.min(F.struct(-F.col("__n"), F.col("__s").alias("s")))["s"].alias("any"))
    final = two.join(by_band, F.col("__band") == F.col("b"), "left").crossJoin(F.broadcast(largest))
    final = final.select(F.col("__s").alias("__old"), F.when(F.col("__n") >= least, F.col("__s")).otherwise(F.coalesce("take", "any", F.lit("ALL|ALL"))).alias("stratum"))
    return rows.join(final, F.col("__s") == F.col("__old")).select(*df.columns, "stratum")


def hash_folds(df: DataFrame, group: str, row_id: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold by a seeded hash of the group: for any size, balanced by numbers only."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group_key(group, row_id)), F.lit(n)).cast("int"))


def group_folds(df: DataFrame, group: str, row_id: str, n: int = 5, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """Adds fold: groups stay whole, and go in order of size to the fold that keeps strata most even.

    Within chunks of 20,000 groups the assignment is greedy, largest first, ties to the lower fold;
    chunks are drawn by hash and dealt independently, so no task holds all groups.
    """
    keyed = df.withColumn("__g", group_key(group, row_id)).withColumn("__st", F.col(stratum).cast("string") if stratum else F.lit("all"))
    sizes = keyed.groupBy("__g", "__st").agg(F.count("*").alias("n"))
    chunks = max(1, -(-sizes.select("__g").distinct().count() // 20_000))
    sizes = sizes.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "__g"), F.lit(chunks)))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="__g", columns="__st", values="n", aggfunc="sum", fill_value=0)
        order = np.lexsort((table.index.to_numpy().astype(str), -table.to_numpy().sum(1)))
        counts, total = table.to_numpy(float), table.to_numpy(float).sum(0)
        held, out = np.zeros((n, counts.shape[1])), np.zeros(len(table), np.int32)
        for k in order:
            after = (held + counts[k]) / np.maximum(total, 1)
            rest = held / np.maximum(total, 1)
            # spread of each stratum over folds if fold f gets the group
            cost = [np.std(np.vstack([after[f : f + 1], np.delete(rest, f, 0)]), axis=0).mean() for f in range(n)]
            f = min(range(n), key=lambda j: (round(cost[j], 12), held[j].sum(), j))
            held[f] += counts[k]
            out[k] = f
        return pd.DataFrame({"__g": table.index, "fold": out})

    folds = sizes.groupBy("chunk").applyInPandas(deal, "__g string, fold int")
    return keyed.join(folds, "__g").select(*df.columns, "fold")


def three_way_split(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Adds split by five folds: 0 test, 1 calibration, the rest train."""
    return df.withColumn("split", F.when(F.col(fold) == 0, "test").when(F.col(fold) == 1, "calibration").otherwise("train"))


def spatial_folds(df: DataFrame, place: str, group: str, row_id: str, n: int = 5) -> DataFrame:
    """Adds fold by place; places that share a group stay together, the largest such set goes to the lightest fold first."""
    from brindle.operators.resolve import components

    shared = df.where(F.col(group).isNotNull() & F.col(place).isNotNull()).select(F.col(place).alias("p"), F.col(group).alias("g")).distinct()
    first = shared.groupBy("g").agg(F.min("p").alias("left_id"))
    edges = shared.join(first, "g").where("p <> left_id").select("left_id", F.col("p").alias("right_id"))
    places = df.where(F.col(place).isNotNull()).select(F.col(place).alias("id")).distinct()
    roots = components(edges, places).select(F.col("id").alias("__place"), "root")
    sizes = df.join(roots, F.col(place) == F.col("__place")).groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root")

    def deal(batches):
        held = [0] * n
        for pdf in batches:  # a row for each set of places
            out = []
            for size in pdf["n"]:
                f = min(range(n), key=lambda j: (held[j], j))
                held[f] += size
                out.append(f)
            yield pd.DataFrame({"root": pdf["root"], "fold": out})

    kind = dict(roots.dtypes)["root"]
    folds = sizes.coalesce(1).mapInPandas(deal, f"root {kind}, fold int")
    return df.join(roots.join(folds, "root"), F.col(place) == F.col("__place")).select(*df.columns, "fold")


def temporal_split(df: DataFrame, time: str, freeze: str, group: str) -> DataFrame:
    """Adds period: pre up to the freeze instant (a whole day, if a date), post after it for groups not seen before; the rest goes.

    Rows without a time go; rows without a group are never seen before.
    """
    whole_day = len(freeze) <= 10
    cut = F.lit(freeze).cast("timestamp") + (F.expr("interval 1 day") if whole_day else F.expr("interval 1 microsecond"))
    dated = df.where(F.col(time).isNotNull())
    pre, post = dated.where(F.col(time) < cut), dated.where(F.col(time) >= cut)
    seen = pre.where(F.col(group).isNotNull()).select(group).distinct()
    return pre.withColumn("period", F.lit("pre")).unionByName(post.join(seen, group, "left_anti").withColumn("period", F.lit("post")))


def leaking_groups(df: DataFrame, split: str, group: str) -> DataFrame:
    """Groups with rows in several splits: none, if the split is sound."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assert_no_leakage(df: DataFrame, split: str, group: str) -> DataFrame:
    """df as it is; an error if a group has rows in several splits."""
    if row := leaking_groups(df, split, group).first():
        raise ValueError(f"group {row[group]!r} is in {row['splits']} splits")
    return df


def split_summary(df: DataFrame, split: str, numbers: Sequence[str], categories: Sequence[str], group: str) -> DataFrame:
    """By split and for all: rows, share, groups, mean and median of numbers, distinct values, top and its share of categories."""
    aggs = [F.count("*").alias("n"), F.count_distinct(group).alias("groups")]
    for c in numbers:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median")]
    for c in categories:
        aggs += [F.count_distinct(c).alias(f"{c}_unique")]
    both = df.select(F.explode(F.array(F.col(split).cast("string"), F.lit("all"))).alias("split"), group, *numbers, *categories)
    out = both.groupBy("split").agg(*aggs)
    for c in categories:
        counts = both.where(F.col(c).isNotNull()).groupBy("split", c).agg(F.count("*").alias("k"))
        top = counts.groupBy("split").agg(F.min(F.struct(-F.col("k"), F.col(c).alias("v"))).alias("t"))
        out = out.join(top.select("split", F.col("t.v").alias(f"{c}_top"), (-F.col("t.col1")).alias("__k")), "split", "left").withColumn(f"{c}_top_share", F.col("__k") / F.col("n")).drop("__k")
    total = df.agg(F.count("*").alias("__all"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def stratified_sample(df: DataFrame, stratum: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum, by a seeded hash of the row's id."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), row_id)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def nested_subsets(df: DataFrame, unit: str, fractions: Sequence[float], seed: int = 42) -> DataFrame:
    """(fraction, ...): for a learning curve, rows of a seeded share of units, each share within the next larger."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(unit)), F.lit(1_000_000)) / 1_000_000
    each = F.filter(F.array(*map(F.lit, map(float, fractions))), lambda f: u < f)
    return df.withColumn("fraction", F.explode(each))
