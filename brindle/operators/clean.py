"""Schema repair, audits, filters with reasons, and logs of cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brindle.functions import fixed
from brindle.functions import scalars as S

LISTING = T.StructType(
    [T.StructField("listing_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("source", "slug", "address")]
    + [T.StructField(c, T.DoubleType()) for c in ("area", "rooms", "price", "aux_costs", "deposit")]
    + [T.StructField("available_from", T.TimestampType()), T.StructField("description", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("population", "oev", "solar", "elevation", "east", "north")]
    + [T.StructField("egid", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("year_built", "apartments", "land_area")]
    + [T.StructField("observed_at", T.TimestampType())]
)
# names of raw columns -> names here
RENAMES = {
    "area_sqm": "area", "price_cold": "price", "auxiliary_costs": "aux_costs", "kaution": "deposit", "oev_score": "oev",
    "solar_class": "solar", "elevation_m": "elevation", "lv95_east": "east", "lv95_north": "north", "gbauj": "year_built",
    "ganzwhg": "apartments", "garea": "land_area",
}


def conform(df: DataFrame, schema: T.StructType = LISTING, renames: Mapping[str, str] = RENAMES) -> DataFrame:
    """Renamed, missing columns added as nulls of their type, the schema's columns first and in order, extras after.

    Types are left to `fix_schema`. Two columns that get the same name are an error.
    """
    names = [renames.get(c, c) for c in df.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"duplicate columns after renaming: {sorted(twice)}")
    df = df.toDF(*names)
    own = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *(n for n in names if n not in schema.fieldNames()))


def fix_schema(df: DataFrame, rooms_min: float = 1.0, rooms_max: float = 15.0) -> DataFrame:
    """Typed columns; rooms out of range become null with a flag; rooms_is_integer and log_price are added.

    Applied twice it changes nothing: an earlier flag stays set.
    """
    out = []
    for f in LISTING:
        c = F.col(f.name)
        if f.name == "listing_id":
            out.append(c.cast("long").alias(f.name))
        elif f.name == "egid":
            out.append(F.round(S.coerce_numeric(c)).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(S.coerce_numeric(c).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append((c if dict(df.dtypes).get(f.name, "").startswith("timestamp") else S.parse_date(c.cast("string"))).alias(f.name))
        else:
            out.append(S.clean_text(c).alias(f.name))
    derived = {"rooms_invalid", "rooms_is_integer", "log_price"}
    extra = [c for c in df.columns if c not in LISTING.fieldNames() and c not in derived]
    before = F.coalesce(F.col("rooms_invalid"), F.lit(False)) if "rooms_invalid" in df.columns else F.lit(False)
    typed = df.select(*out, *extra, before.alias("__before"))
    bad = F.coalesce(~F.col("rooms").between(rooms_min, rooms_max), F.lit(False))
    typed = typed.withColumn("rooms_invalid", bad | F.col("__before")).withColumn("rooms", F.when(~bad, F.col("rooms"))).drop("__before")
    whole = F.coalesce(F.abs(F.col("rooms") - F.round("rooms")) < 1e-9, F.lit(False))
    return typed.withColumn("rooms_is_integer", whole).withColumn("log_price", F.when(F.col("price") > 0, F.ln("price")))


def audit_table(df: DataFrame) -> DataFrame:
    """(column, dtype, missing, missing_pct, distinct) in one pass over the table."""
    sums = [F.count("*").alias("n")]
    for k, c in enumerate(df.columns):
        sums += [F.count_if(F.col(c).isNull()).alias(f"m{k}"), F.count_distinct(c).alias(f"d{k}")]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"m{k}").alias("missing"), F.try_divide(100.0 * F.col(f"m{k}"), F.col("n")).alias("missing_pct"), F.col(f"d{k}").alias("distinct")) for k, (c, t) in enumerate(df.dtypes)]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def text_coverage(df: DataFrame, text: str = "description", lang: str | None = None, min_chars: int = 50) -> DataFrame:
    """Rows, rows with text, share, share of at least min_chars, median length; by language if asked for."""
    n = F.char_length(F.col(text))
    groups = [lang] if lang else []
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(n > 0).alias("with_text"), F.avg((F.coalesce(n, F.lit(0)) > 0).cast("double")).alias("text_share"),
        F.avg((F.coalesce(n, F.lit(0)) >= min_chars).cast("double")).alias("long_share"), F.median(F.when(n > 0, n)).alias("median_chars"),
    )


def domain_reason(area: str = "area", price: str = "price", min_area: float = 10.0, min_price: float = 300.0, max_area: float = 500.0, max_price: float = 15000.0) -> Column:
    """The first rule that a row breaks, null if none; limits are allowed values, a null breaks nothing."""
    a, p = F.col(area), F.col(price)
    return F.when(a < min_area, f"{area}_below_min").when(p < min_price, f"{price}_below_min").when(a > max_area, f"{area}_above_max").when(p > max_price, f"{price}_above_max")


def domain_filter(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with a reason)."""
    marked = df.withColumn("reason", domain_reason(**limits))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def regime_split(df: DataFrame, regime: str = "rent_regime", market: Sequence[str] = ("market", "unknown"), other: Sequence[str] = ("cooperative", "cost_based_or_subsidised", "shared_flat")) -> tuple[DataFrame, DataFrame]:
    """(market rows, the rest) by normalised label; null counts as market, a label of neither list is an error."""
    label = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(F.col(regime))), r"[\s-]+", "_"), F.lit("")), F.lit("market"))
    known = F.when(label.isin(*market, *other), label).otherwise(F.raise_error(F.concat(F.lit("unknown regime: "), label)).cast("string"))
    marked = df.withColumn(regime, known)
    return marked.where(F.col(regime).isin(*market)), marked.where(F.col(regime).isin(*other))


def recover_rooms(rooms: str, from_text: str, max_diff: float = 0.5, low: float = 1.0, high: float = 15.0) -> tuple[Column, Column]:
    """(rooms, where from): a count in the text replaces a null, or a count within max_diff, if it is a half step in range."""
    r, t = F.col(rooms), F.col(from_text)
    good = t.between(low, high) & (F.abs(2 * t - F.round(2 * t)) < 1e-9)
    use = good & (r.isNull() | (F.abs(r - t) <= max_diff + 1e-9))
    source = F.when(use & r.isNull(), "text_filled").when(use & (r != t), "text_corrected").when(r.isNotNull(), "stored").otherwise("missing")
    return F.when(use, t).otherwise(r), source


def engineered_features(df: DataFrame, year: int = fixed.REFERENCE_YEAR, angles: Sequence[float] = (45.0,)) -> DataFrame:
    """area_per_room, rooms_is_integer, building_age, land_per_apartment and rotated coordinates."""
    out = df.withColumn("area_per_room", F.when(F.col("rooms") > 0, F.col("area") / F.col("rooms")))
    out = out.withColumn("building_age", F.greatest(F.lit(0.0), year - F.col("year_built")) + 0 * F.col("year_built"))
    out = out.withColumn("land_per_apartment", F.when(F.col("apartments") > 0, F.col("land_area") / F.col("apartments")))
    for a in angles:
        x, y = S.rotated("east", "north", a)
        out = out.withColumn(f"east_rot{a:g}", x).withColumn(f"north_rot{a:g}", y)
    return out


def completeness_funnel(df: DataFrame, id_col: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, n): distinct ids that meet the first conditions together, one pass for all steps."""
    growing = [reduce(lambda a, b: a & b, [c for _, c in steps[: k + 1]]) for k in range(len(steps))]
    counts = df.agg(F.count_distinct(id_col).alias("c0"), *(F.count_distinct(F.when(c, F.col(id_col))).alias(f"c{k + 1}") for k, c in enumerate(growing)))
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.col(f"c{k}").alias("n")) for k, name in enumerate(["all", *(n for n, _ in steps)])]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def first_missing(columns: Sequence[str], done: str = "usable") -> Column:
    """`missing_<column>` of the first null column, else `done`."""
    return F.coalesce(*(F.when(F.col(c).isNull(), f"missing_{c}") for c in columns), F.lit(done))


def cleaning_log(steps: DataFrame, order: str = "step", rows: str = "rows") -> DataFrame:
    """Adds removed, removed_pct (of the step before) and retained_pct (of the first step) to a table of steps."""
    w = Window.orderBy(order)  # a row for each cleaning step
    before, first = F.lag(rows).over(w), F.first(rows).over(w)
    removed = F.coalesce(before - F.col(rows), F.lit(0))
    return steps.withColumn("removed", removed).withColumn("removed_pct", F.coalesce(F.try_divide(100.0 * removed, before), F.lit(0.0))).withColumn("retained_pct", F.try_divide(100.0 * F.col(rows), first))


def exact_duplicate(df: DataFrame, subset: Sequence[str], id_col: str) -> DataFrame:
    """Adds is_duplicate: not the first row by id among rows equal in subset; nulls are equal."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*subset).orderBy(id_col)) > 1)


def source_table(specs: Mapping[str, Mapping[str, str]], keys: Sequence[str] | None, spark: SparkSession) -> DataFrame:
    """A registry of sources as a table; an unknown key is an error."""
    keys = list(specs) if keys is None else list(keys)
    if unknown := [k for k in keys if k not in specs]:
        raise KeyError(f"unknown sources: {unknown}")
    names = sorted({n for k in specs for n in specs[k]})
    return spark.createDataFrame([(k, *(specs[k].get(n) for n in names)) for k in keys], ", ".join(f"{n} string" for n in ["key", *names]))


def outside_domain(area: str, rooms: str) -> Column:
    """What lies outside the range of the training data: area, else rooms, else null; null and NaN are outside."""
    def inside(c: str, low: float, high: float) -> Column:
        return F.coalesce(F.col(c).between(low, high), F.lit(False))

    return F.when(~inside(area, *fixed.AREA_RANGE), "area").when(~inside(rooms, *fixed.ROOMS_RANGE), "rooms")
