"""Aggregates on several levels that hide small groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.order import quantiles

MIN_COUNT = 20


def unit_stats(listings: DataFrame, levels: Mapping[str, str], min_count: int = MIN_COUNT, price: str = "price", area: str = "area", extra: Sequence[str] = ()) -> DataFrame:
    """(level, unit_id, n, median/p25/p75 of price per area, median price, extra medians); statistics are null under min_count.

    levels: name -> key column; rows with a null key don't count. All levels come from one scan: each
    row is taken once for each level, grouped by (level, unit).
    """
    units = F.explode(F.array(*(F.struct(F.lit(name).alias("level"), F.col(key).cast("string").alias("unit_id")) for name, key in levels.items())))
    measures = [("rate", F.col(price) / F.col(area)), ("price", F.col(price)), *((f"extra {c}", F.col(c)) for c in extra)]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), c.cast("double").alias("v")) for m, c in measures)))
    rows = listings.select(units.alias("u"), each.alias("x")).where("u.unit_id is not null").select("u.*", "x.*")
    found = quantiles(rows, F.col("v"), [0.25, 0.5, 0.75], ["level", "unit_id", "measure"])
    at = lambda m, i: F.max(F.when(F.col("measure") == m, F.col("q")[i]))
    spread = F.array(*(at("rate", i) for i in range(3)))
    parts = found.groupBy("level", "unit_id").agg(spread.alias("q"), at("price", 1).alias("median_price"), *(at(f"extra {c}", 1).alias(f"median_{c}") for c in extra))
    counts = listings.select(units.alias("u")).where("u.unit_id is not null").groupBy("u.level", "u.unit_id").agg(F.count("*").alias("n"))
    sums = counts.join(parts, ["level", "unit_id"], "left")

    def shown(c: Column) -> Column:
        return F.when(F.col("n") >= min_count, c)

    return sums.select(
        "level", "unit_id", "n", shown(F.col("q")[1]).alias("median_rate"), shown(F.col("q")[0]).alias("p25_rate"), shown(F.col("q")[2]).alias("p75_rate"),
        shown(F.col("median_price")).alias("median_price"), *(shown(F.col(f"median_{c}")).alias(f"median_{c}") for c in extra),
    )


def dissolve(units: DataFrame, parent: str, sums: Sequence[str], child: str, language: str, weight: str) -> DataFrame:
    """Units merged to their parents: sums (null only if all are), number of children, majority language by weight."""
    totals = units.groupBy(parent).agg(*(F.sum(c).alias(c) for c in sums), F.count_distinct(child).alias("children"))
    votes = units.groupBy(parent, language).agg(F.sum(weight).alias("w"))
    return totals.join(votes.groupBy(parent).agg(F.min_by(language, F.struct(-F.coalesce("w", F.lit(0.0)), F.col(language))).alias(language)), parent, "left")


def units_per(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, null keys left out, in the order of the key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def geojson(units: DataFrame, id_col: str, rings: str, properties: Sequence[str] = ()) -> DataFrame:
    """One text row: a FeatureCollection of polygons from rings (array of arrays of struct x, y), with 5 decimals.

    Meant for published units, of which there are some thousands.
    """
    point = lambda p: F.array(F.round(p["x"], 5), F.round(p["y"], 5))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, point)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(id_col).alias("id"), F.struct(*(properties or [id_col])).alias("properties"), geometry.alias("geometry"))
    rows = units.select(F.col(id_col).alias("k"), feature.alias("f"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("a"))
    return ordered.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("a", lambda x: x["f"]).alias("features"))).alias("value"))


def children(units: DataFrame, key: str, id_col: str = "key", parent: str = "parent_key") -> DataFrame:
    return units.where(F.col(parent) == key).orderBy(F.lower("name"), id_col)


def ancestors(units: DataFrame, key: str, id_col: str = "key", parent: str = "parent_key", depth: int = 3) -> DataFrame:
    """The unit's parents upwards, as (depth, key): self-joins to the hierarchy's fixed depth."""
    at = units.where(F.col(id_col) == key).select(F.col(parent).alias("k"))
    steps = []
    for d in range(1, depth + 1):
        steps.append(at.where("k is not null").select(F.lit(d).alias("depth"), F.col("k").alias("key")))
        at = at.join(units.select(F.col(id_col).alias("k"), F.col(parent).alias("up")), "k").select(F.col("up").alias("k"))
    return reduce(DataFrame.union, steps)
