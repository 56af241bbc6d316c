"""Reading listings: a database export or CSV files, one table of the canonical schema, a frozen cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.clean import conform, fix_schema
from brindle.operators.text import anonymize

REQUIRED = ("listing_id", "area_sqm", "price_cold")


class SourceUnavailable(RuntimeError):
    """The source can't be reached, as opposed to a failing query."""


def one_building(buildings: DataFrame, listing: str = "listing_id", egid: str = "egid", columns: tuple[str, ...] = ("gbauj", "ganzwhg", "garea")) -> DataFrame:
    """Of a listing's buildings, the one with the fewest nulls, then the smallest egid, nulls last."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    w = Window.partitionBy(listing).orderBy(nulls, F.col(egid).asc_nulls_last())
    return buildings.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def join_export(listings: DataFrame, details: DataFrame, places: DataFrame, links: DataFrame, buildings: DataFrame) -> DataFrame:
    """Listings with details, places and their best building, a row for each listing."""
    best = one_building(links.join(buildings, "egid", "left"))
    out = listings.withColumnRenamed("id", "listing_id") if "id" in listings.columns else listings
    for other in (details, places, best):
        clash = [c for c in other.columns if c in out.columns and c != "listing_id"]
        out = out.join(other.drop(*clash), "listing_id", "left")
    return out


def read_database(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A query over JDBC. Connection errors become SourceUnavailable without the URL, which may hold a password."""
    try:
        return spark.read.jdbc(url, f"({query}) q", properties=properties or {})
    except Exception as e:
        kind = type(e).__name__
        if any(w in str(e) for w in ("Connection", "connect", "No suitable driver", "timed out", "ClassNotFound")):
            raise SourceUnavailable(f"the database can't be reached ({kind})") from None
        raise


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """Named columns of a CSV file with a header, cast without failing; a missing column is an error."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)  # all strings: no inference
    if missing := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*(F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()))


def with_enrichment(base: DataFrame, extra: DataFrame, key: str = "listing_id", flag: str = "enriched") -> DataFrame:
    """Left join one to one, with a flag of the rows that met; duplicate keys on a side are an error."""
    for name, side in (("base", base), ("enrichment", extra)):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"duplicate keys in the {name} table")
    return base.join(extra.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def orphans(base: DataFrame, extra: DataFrame, key: str = "listing_id") -> DataFrame:
    return extra.join(base, key, "left_anti")


def load_listings(spark: SparkSession, read_db=None, read_files=None, cache: str | None = None, source: str = "auto") -> DataFrame:
    """Canonical, typed listings from the database, files, or (auto) the database unless it is out of reach.

    With a cache, the first call writes it, with masked descriptions, and later ones read it.
    """
    if cache:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(cache)
    if source not in ("auto", "db", "csv"):
        raise ValueError(f"unknown source {source!r}")
    try:
        raw = read_files() if source == "csv" else read_db()
    except SourceUnavailable:
        if source == "db":
            raise
        raw = read_files()
    out = fix_schema(conform(raw)).withColumn("description", anonymize("description"))
    if cache:
        out.write.mode("errorifexists").parquet(cache)
        return spark.read.parquet(cache)
    return out


def upsert_first(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: rows of new whose key is not there yet, the first of each key."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = new.join(table, key, "left_anti").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return table.unionByName(fresh)


def upsert_last(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: the last row of each key by order; new rows go after the table's."""
    both = table.withColumn("__t", F.lit(0)).unionByName(new.withColumn("__t", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc(order))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__t")


def lookup_addresses(listings: DataFrame, address: str, gazetteer: DataFrame) -> DataFrame:
    """Distinct normalised addresses joined with landed geocodes (key, ...), and back to the listings."""
    from brindle.operators.resolve import normalize_text

    keyed = listings.withColumn("__key", normalize_text(address))
    found = keyed.select("__key").distinct().join(gazetteer.withColumnRenamed("key", "__key"), "__key", "left")
    return keyed.join(found, "__key").drop("__key")


def sdmx_latest(table: DataFrame, filters: dict[str, str], key: str, value: str, period: str) -> DataFrame:
    """(key, value, period) of an SDMX table (`code: label` cells): filtered by codes, the latest period, numeric keys only."""
    from brindle.functions.scalars import sdmx_code

    rows = table
    for c, code in filters.items():
        rows = rows.where(sdmx_code(F.col(f"`{c}`")) == code)
    rows = rows.select(sdmx_code(F.col(f"`{key}`")).alias("key"), F.col(f"`{value}`").try_cast("double").alias("value"), F.col(f"`{period}`").try_cast("int").alias("period"))
    last = rows.agg(F.max("period").alias("p"))
    return rows.join(F.broadcast(last), F.col("period") == F.col("p")).where(F.col("key").rlike(r"^\d+$")).select(F.col("key").cast("long").alias("key"), "value", "period")


def latest_by(table: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, order) of the latest non-null value of each key."""
    return table.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(F.when(F.col(value).isNotNull(), F.col(order))).alias(order))


def latest_wide(table: DataFrame, key: str, variable: str, value: str, year: str, variables: list[str]) -> DataFrame:
    """A row a key: each variable's latest non-null value, and its year as <variable>_year; null where there is none."""
    rows = latest_by(table.where(F.col(variable).isin(variables)), [key, variable], value, year)
    at = lambda v, c: F.max(F.when(F.col(variable) == v, F.col(c)))
    return rows.groupBy(key).agg(*(at(v, value).alias(v) for v in variables), *(at(v, year).alias(f"{v}_year") for v in variables))
