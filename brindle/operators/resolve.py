"""Entity resolution: rules give edges between listings, components are objects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import fixed
from brindle.functions.scalars import once
from brindle.operators import spatial

RULES = ("listing_id", "slug", "description", "egid", "coords", "address", "coords_exact")


def normalize_text(c: str | Column) -> Column:
    """Tags out, lower case, ß and umlauts spelled out, accents off, other characters than a-z and 0-9 to one space."""
    s = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "<[^>]+>", " "))
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("æ", "ae"), ("œ", "oe")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.translate(s, "àáâãåāçćčèéêëēęìíîïīñńòóôõøōùúûūýÿšśžźżłđ", "aaaaaaccceeeeeeiiiiinnoooooouuuuyysszzzld")
    return F.coalesce(F.trim(F.regexp_replace(s, "[^0-9a-z]+", " ")), F.lit(""))


def description_hash(c: str | Column, min_chars: int = 1) -> Column:
    """SHA-256 of the normalised text; null if that is shorter than min_chars."""
    return once(normalize_text(c), lambda n: F.when(F.length(n) >= min_chars, F.sha2(n, 256)))


def address_key(postcode: str | Column, street: str | Column) -> Column:
    """`postcode|street` without house number, abbreviations written out; null if a part is empty."""
    s = F.regexp_replace(normalize_text(street), r"(\s\d+[a-z]?)+(\s[a-z])?$", "")
    for pattern, new in fixed.STREET_WORDS.items():
        s = F.regexp_replace(s, pattern, new)
    s, p = F.replace(s, F.lit(" "), F.lit("")), F.replace(normalize_text(postcode), F.lit(" "), F.lit(""))
    return F.when((F.length(s) > 0) & (F.length(p) > 0), F.concat(p, F.lit("|"), s))


def components(edges: DataFrame, nodes: DataFrame, checkpoint: bool = True) -> DataFrame:
    """(id, root) for each id of nodes; root is the smallest id of its component.

    Each round gives every node the smallest label of its neighbours and then its label's label
    (pointer jumping), so long chains halve; it ends when no label moves. Labels are checkpointed when the session has a
    checkpoint folder, cached otherwise.
    """
    both = edges.select("left_id", "right_id").union(edges.select("right_id", "left_id")).distinct().toDF("id", "other")
    has_dir = checkpoint and edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    keep = (lambda d: d.checkpoint()) if has_dir else (lambda d: d.cache())
    both = keep(both)
    labels = keep(both.groupBy("id").agg(F.min(F.least("id", "other")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.least("root", "near").alias("root"))
        up = low.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = keep(low.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        moved = after.join(labels.select("id", F.col("root").alias("old")), "id").where("root <> old").isEmpty()
        labels = after
        if moved:
            break
    return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _star(df: DataFrame, key: Column) -> DataFrame:
    keyed = df.select(F.col("listing_id").alias("right_id"), key.alias("k")).where("k is not null")
    first = keyed.groupBy("k").agg(F.min("right_id").alias("left_id"))
    return keyed.join(first, "k").where("left_id <> right_id").select("left_id", "right_id")


def _match(area_tol: float, rel_tol: float, exact_only: bool = False) -> Column:
    """Whether the rows a and b of a pair agree: tolerantly, or exactly."""
    a = lambda c: F.col(f"a.{c}")
    b = lambda c: F.col(f"b.{c}")
    rooms = a("rooms").isNull() | b("rooms").isNull() | (F.abs(a("rooms") - b("rooms")) <= 0.05)
    area, price = F.abs(a("area") - b("area")), F.abs(a("price") - b("price"))
    exact = (area <= 0.5 + 1e-9) & (price <= 1 + 1e-6)
    tolerant = rooms & (area <= area_tol + 1e-9) & (price <= rel_tol * F.greatest(a("price"), b("price")) + 1e-6)
    return (exact & rooms) if exact_only else (tolerant | exact)


def object_edges(df: DataFrame, area_tol: float = 3.0, price_rel_tol: float = 0.1, coord_round: float = 5.0, exact_radius: float = 30.0, desc_min_chars: int = 30, desc_max_group: int = 10) -> dict[str, DataFrame]:
    """rule -> (left_id, right_id). df: listing_id and what it has of slug, source, description, egid, east, north, postcode, street, area, rooms, price.

    Rules on the building need the egids not both known and different; the address rule also
    coordinates not both known. Blocks are equi-joins with area buckets, or grid cells.
    """
    have, edges = set(df.columns), {}
    info = df.select("listing_id", *(F.col(c).cast("double") for c in ("area", "rooms", "price")), *(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in ("egid", "east", "north")))
    if "slug" in have:
        slug = F.nullif(F.lower(F.trim("slug")), F.lit(""))
        source = F.coalesce(F.lower(F.trim("source")), F.lit("")) if "source" in have else F.lit("")
        edges["slug"] = _star(df, F.concat(source, F.lit("|"), slug))
    if "description" in have:
        hashed = df.select("listing_id", description_hash("description", desc_min_chars).alias("h")).where("h is not null")
        real = hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= desc_max_group).select("h")
        edges["description"] = _star(hashed.join(real, "h"), F.col("h"))

    def checked(pairs: DataFrame, rule: str) -> DataFrame:
        rows = pairs.join(info.alias("a"), F.col("left_id") == F.col("a.listing_id")).join(info.alias("b"), F.col("right_id") == F.col("b.listing_id"))
        rows = rows.where(_match(area_tol, price_rel_tol, rule == "coords_exact"))
        if rule != "egid":
            rows = rows.where(F.col("a.egid").isNull() | F.col("b.egid").isNull())
        if rule == "address":
            rows = rows.where(F.col("a.east").isNull() | F.col("b.east").isNull() | F.col("a.north").isNull() | F.col("b.north").isNull())
        return rows.select("left_id", "right_id")

    window = max(area_tol, 0.5)
    if "egid" in have:
        edges["egid"] = checked(spatial.band_pairs(df, "listing_id", "egid", "area", window), "egid")
    if {"east", "north"} <= have:
        edges["coords"] = checked(spatial.radius_pairs(df, "listing_id", coord_round), "coords")
        edges["coords_exact"] = checked(spatial.radius_pairs(df, "listing_id", exact_radius), "coords_exact")
    if {"postcode", "street"} <= have:
        keyed = df.withColumn("__k", address_key(F.col("postcode").cast("string"), "street"))
        edges["address"] = checked(spatial.band_pairs(keyed, "listing_id", "__k", "area", window), "address")
    return {r: edges[r] for r in RULES if r in edges}


def assign_object_ids(df: DataFrame, **tolerances) -> DataFrame:
    """Adds object_id: obj_000001, ... by the smallest listing_id of each component."""
    edges = object_edges(df, **tolerances)
    every = reduce(DataFrame.union, edges.values())
    roots = components(every, df.select(F.col("listing_id").alias("id")))
    # ranks of the roots without one task for all rows: counts of ranges, then ranks inside each
    firsts = roots.where("id = root").select("root").distinct()
    spread = firsts.repartitionByRange("root").withColumn("part", F.spark_partition_id()).cache()
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = spread.join(F.broadcast(before), "part").select("root", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("root"))).alias("k"))
    named = roots.join(ranked, "root").select(F.col("id").alias("listing_id"), F.format_string("obj_%06d", "k").alias("object_id"))
    return df.join(named, "listing_id")


def dedup_report(df: DataFrame, object_id: str = "object_id", price: str = "price") -> DataFrame:
    """(key, value): rows, objects, duplicates, group sizes, median relative price range of groups."""
    groups = df.groupBy(object_id).agg(F.count("*").alias("n"), ((F.max(price) - F.min(price)) / F.max(price)).alias("r"))
    n = F.col("n")
    t = groups.agg(
        F.sum(n).cast("double").alias("rows"), F.count("*").cast("double").alias("unique_objects"), F.count_if(n > 1).cast("double").alias("objects_with_duplicates"),
        F.count_if(n == 2).cast("double").alias("objects_size_2"), F.count_if(n == 3).cast("double").alias("objects_size_3"), F.count_if(n >= 4).cast("double").alias("objects_size_4plus"),
        F.max(n).cast("double").alias("max_group_size"), F.avg(n).alias("mean_group_size"), F.median(F.when(n > 1, F.col("r"))).alias("median_rel_price_range_dup_objects"),
    )
    t = t.withColumn("duplicate_rows", F.col("rows") - F.col("unique_objects")).withColumn("duplicate_share_pct", F.try_divide(100 * F.col("duplicate_rows"), F.col("rows")))
    return t.unpivot([], t.columns, "key", "value")


def collapse_objects(df: DataFrame, object_id: str = "object_id", how: str = "first", median_cols: Sequence[str] = ("price",)) -> DataFrame:
    """One row for each object, that of the smallest listing_id, with n_listings; how='median' puts the group's medians in."""
    w = Window.partitionBy(object_id)
    out = df.withColumn("n_listings", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy("listing_id")))
    if how == "median":
        for c in median_cols:
            out = out.withColumn(c, F.median(c).over(w))
        if "price" in median_cols and "log_price" in df.columns:
            out = out.withColumn("log_price", F.when(F.col("price") > 0, F.ln("price")))
    return out.where("__k = 1").drop("__k")
