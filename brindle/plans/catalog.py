"""The queries of the reference's operators over the driver's tables, with the same in DuckDB SQL.

Line items stand for listings: price and quantity for rent and area, region > nation > supplier for
canton > district > municipality, the order for the object. Computed doubles are rounded here, and
only here, as the two engines' last bits differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import clean, composite, conformal, metrics, publish, resolve, robust, spatial, splits, text
from brindle.session import ship
from brindle.sources import listings as source
from brindle.sources import pages as web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LISTINGS = """
    listings as (
        select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as listing_id, l_extendedprice as price,
               l_quantity as area, l_suppkey as municipality_id, s_nationkey as district_id, r_name as canton, l_orderkey as object_id,
               l_partkey as part_id, l_shipdate as observed_at, l_discount as discount, l_tax as tax, l_returnflag as flag
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{LISTINGS}", LISTINGS)
        return f

    return add


def listings(t) -> DataFrame:
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return rows.select(
        key.alias("listing_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("area"), F.col("l_suppkey").alias("municipality_id"),
        F.col("s_nationkey").alias("district_id"), F.col("r_name").alias("canton"), F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_shipdate").alias("observed_at"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


def r(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 10.0 ** -(digits + 3), digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def R(expression: str, digits: int = 6) -> str:
    return f"round({expression} + 1e-{digits + 3}, {digits})"


# --- cleaning ---

LIMITS = {"min_area": 2.0, "max_area": 45.0, "min_price": 2000.0, "max_price": 60000.0}
_REASON = "case when area < 2 then 'area_below_min' when price < 2000 then 'price_below_min' when area > 45 then 'area_above_max' when price > 60000 then 'price_above_max' end"


@query(f"with {{LISTINGS}} select reason, count(*) as n, min(price) as lowest, max(price) as highest from (select *, {_REASON} as reason from listings) group by reason")
def domain_filter_reasons(t, spark):
    return listings(t).withColumn("reason", clean.domain_reason(**LIMITS)).groupBy("reason").agg(F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query(f"with {{LISTINGS}} select listing_id, price, area from listings where {_REASON} is null")
def domain_filter_kept(t, spark):
    return clean.domain_filter(listings(t), **LIMITS)[0].select("listing_id", "price", "area")


@query("""select * from (
    select 'c_acctbal' as "column", 'double' as dtype, count(*) filter (where c_acctbal is null) as missing, round(100.0 * count(*) filter (where c_acctbal is null) / count(*), 6) as missing_pct, count(distinct c_acctbal) as "distinct" from c
    union all select 'c_custkey', 'bigint', count(*) filter (where c_custkey is null), round(100.0 * count(*) filter (where c_custkey is null) / count(*), 6), count(distinct c_custkey) from c
    union all select 'c_mktsegment', 'string', count(*) filter (where c_mktsegment is null), round(100.0 * count(*) filter (where c_mktsegment is null) / count(*), 6), count(distinct c_mktsegment) from c)
    """.replace(" from c", " from (select c_custkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer) c"))
def audit_table(t, spark):
    rows = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return clean.audit_table(rows).withColumn("missing_pct", F.round("missing_pct", 6))


@query("select lang, count(*) as n, count(*) filter (where length(text) > 0) as with_text, round(avg(case when length(text) > 0 then 1.0 else 0.0 end), 6) as text_share, round(avg(case when length(text) >= 500 then 1.0 else 0.0 end), 6) as long_share, median(length(text)) as median_chars from documents group by lang")
def text_coverage(t, spark):
    return rounded(clean.text_coverage(t("documents"), "text", "lang", 500).withColumn("median_chars", F.col("median_chars").cast("double")), "text_share", "long_share")


_SWISS = ["'CHF ' || cast(p_size as varchar) || '''' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') || '.-'", "cast(p_size as varchar) || ',5'", "cast(p_size as varchar) || '½'", "'about ' || p_name"]


@query("""select p_partkey, cast(p_size * 1000 + p_partkey % 1000 as double) as a, p_size + 0.5 as b, p_size + 0.5 as c, cast(null as double) as d from part""")
def coerce_swiss_numbers(t, spark):
    p, n = F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    forms = {"a": F.concat(F.lit("CHF "), p, F.lit("'"), n, F.lit(".-")), "b": F.concat(p, F.lit(",5")), "c": F.concat(p, F.lit("½")), "d": F.concat(F.lit("about "), F.col("p_name"))}
    return t("part").select("p_partkey", *(S.coerce_numeric(c).alias(k) for k, c in forms.items()))


@query("select o_orderkey, o_orderdate as iso, o_orderdate as swiss, cast(null as timestamp) as bad from orders")
def parse_dates(t, spark):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", S.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"), S.parse_date(F.date_format(d, "dd.MM.yyyy")).alias("swiss"), S.parse_date(F.lit("sofort")).alias("bad"))


@query("""select cast(p_partkey as bigint) as listing_id, cast(p_size as double) as area, case when p_size % 16 between 1 and 15 then cast(p_size % 16 as double) end as rooms,
    p_retailprice as price, p_size % 16 not between 1 and 15 as rooms_invalid, p_size % 16 between 1 and 15 as rooms_is_integer, round(ln(p_retailprice), 8) as log_price from part""")
def fix_schema(t, spark):
    raw = t("part").select(F.col("p_partkey").alias("listing_id"), F.col("p_size").cast("string").alias("area_sqm"), (F.col("p_size") % 16).cast("string").alias("rooms"), F.col("p_retailprice").alias("price_cold"))
    out = clean.fix_schema(clean.conform(raw))
    return out.select("listing_id", "area", "rooms", "price", "rooms_invalid", "rooms_is_integer", F.round("log_price", 8).alias("log_price"))


_STEPS = [("discounted", "discount > 0.02"), ("taxed", "tax > 0.03"), ("large", "area > 10"), ("flagged", "flag <> 'N'")]


@query("with {LISTINGS} " + " union all ".join(
    ["select 0 as step, 'all' as name, count(distinct object_id) as n from listings"] + [f"select {k + 1}, '{name}', count(distinct object_id) from listings where " + " and ".join(c for _, c in _STEPS[: k + 1]) for k, (name, _) in enumerate(_STEPS)]))
def completeness_funnel(t, spark):
    return clean.completeness_funnel(listings(t), "object_id", [(n, F.expr(c)) for n, c in _STEPS])


@query("""select status, count(*) as n from (select case when nullif(c_mktsegment, 'BUILDING') is null then 'missing_segment' when case when c_acctbal >= 0 then c_acctbal end is null then 'missing_balance' else 'usable' end as status from customer) group by status""")
def first_missing_status(t, spark):
    rows = t("customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return rows.groupBy(clean.first_missing(["segment", "balance"]).alias("status")).agg(F.count("*").alias("n"))


@query("""with s as (select cast(extract(year from o_orderdate) as bigint) as step, count(*) as rows from orders group by 1)
    select step, rows, coalesce(lag(rows) over (order by step) - rows, 0) as removed, round(coalesce(100.0 * coalesce(lag(rows) over (order by step) - rows, 0) / lag(rows) over (order by step), 0), 6) as removed_pct,
    round(100.0 * rows / first_value(rows) over (order by step), 6) as retained_pct from s""")
def cleaning_log(t, spark):
    steps = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("step")).agg(F.count("*").alias("rows"))
    return rounded(clean.cleaning_log(steps), "removed_pct", "retained_pct")


@query("""select o_orderkey, regime, is_market from (select o_orderkey, case o_orderstatus when 'O' then 'market' when 'F' then 'cooperative' else 'unknown' end as regime, o_orderstatus <> 'F' as is_market from orders)""")
def regime_split(t, spark):
    label = F.when(F.col("o_orderstatus") == "O", " Market").when(F.col("o_orderstatus") == "F", "COOPERATIVE").otherwise("unknown")
    market, rest = clean.regime_split(t("orders").select("o_orderkey", label.alias("regime")), "regime")
    return market.withColumn("is_market", F.lit(True)).unionByName(rest.withColumn("is_market", F.lit(False)))


@query("""with p as (select p_partkey, case when p_partkey % 5 = 0 then null else p_size % 20 / 2.0 + 0.5 end as r, case when p_partkey % 3 = 0 then null else p_size % 30 / 2.0 + 0.5 end as t from part),
    u as (select *, t between 1 and 15 and (r is null or abs(r - t) <= 0.5 + 1e-9) as use_ from p)
    select p_partkey, case when coalesce(use_, false) then t else r end as rooms, case when coalesce(use_, false) and r is null then 'text_filled' when coalesce(use_, false) and r <> t then 'text_corrected' when r is not null then 'stored' else 'missing' end as origin from u""")
def recover_half_units(t, spark):
    k = F.col("p_partkey")
    rows = t("part").select("p_partkey", F.when(k % 5 != 0, F.col("p_size") % 20 / 2.0 + 0.5).alias("r"), F.when(k % 3 != 0, F.col("p_size") % 30 / 2.0 + 0.5).alias("t"))
    rooms, origin = clean.recover_rooms("r", "t")
    return rows.select("p_partkey", rooms.alias("rooms"), origin.alias("origin"))


@query(f"""select p_partkey, {R("case when p_size % 7 > 0 then p_retailprice / (p_size % 7) end")} as area_per_room, case when p_size % 9 = 0 then null else cast(greatest(0, 2026 - (1980 + p_size)) as double) end as building_age,
    {R("p_partkey * sqrt(0.5) + p_size * sqrt(0.5)")} as east_rot45, {R("p_size * sqrt(0.5) - p_partkey * sqrt(0.5)")} as north_rot45 from part""")
def engineered_features(t, spark):
    rows = t("part").select(
        "p_partkey", F.col("p_retailprice").alias("area"), (F.col("p_size") % 7).alias("rooms"), F.when(F.col("p_size") % 9 != 0, (1980 + F.col("p_size")).cast("double")).alias("year_built"),
        F.lit(4.0).alias("apartments"), F.lit(1.0).alias("land_area"), (F.col("p_partkey") + 2_600_000.0).alias("east"), (F.col("p_size") + 1_200_000.0).alias("north"),
    )
    return rounded(clean.engineered_features(rows).select("p_partkey", "area_per_room", "building_age", "east_rot45", "north_rot45"), "area_per_room", "east_rot45", "north_rot45")


@query("""select bucket, count(*) as units from (select case when n < 5 then '<5' when n <= 20 then '5-20' else '>20' end as bucket from (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey)) group by bucket""")
def count_buckets(t, spark):
    n = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.groupBy(S.count_bucket("n").alias("bucket")).agg(F.count("*").alias("units"))


@query("select n_nationkey, case when n_regionkey = 2 then null else r_name end as k1, case when n_regionkey = 2 then null else r_name || '/' || n_name end as k2 from nation join region on n_regionkey = r_regionkey")
def nested_keys(t, spark):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("r_name", F.when(F.col("n_regionkey") != 2, F.col("r_name")))
    a, b = S.nested_keys("r_name", "n_name")
    return rows.select("n_nationkey", a.alias("k1"), b.alias("k2"))


# --- joins ---


@query("""select l_orderkey as listing_id, l_partkey as building, l_quantity as size from (select *, row_number() over (partition by l_orderkey order by case when l_quantity > 40 then 1 else 0 end, l_partkey, l_suppkey, l_linenumber) as k from lineitem) where k = 1""")
def best_building(t, spark):
    rows = t("lineitem").select(F.col("l_orderkey").alias("listing_id"), (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("egid"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("size"), F.col("l_partkey").alias("building"), F.col("l_quantity").alias("q"))
    return source.one_building(rows, columns=("size",)).select("listing_id", "building", F.col("q").alias("size"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def orphan_anti(t, spark):
    return source.orphans(t("orders").withColumnRenamed("o_custkey", "c_custkey"), t("customer"), "c_custkey").select("c_custkey", "c_name")


@query("""with e as (select o_orderkey, o_custkey, o_orderdate >= timestamp '1999-07-01 00:00:00' as late from orders), s as (select distinct o_custkey from e where not late)
    select o_orderkey, 'pre' as period from e where not late union all select o_orderkey, 'post' from e where late and o_custkey not in (select o_custkey from s)""")
def temporal_split(t, spark):
    return splits.temporal_split(t("orders"), "o_orderdate", "1999-06-30", "o_custkey").select("o_orderkey", "period")


@query("""with s as (select s_suppkey as id, s_nationkey as b, s_acctbal as v from supplier) select a.id as left_id, c.id as right_id from s a join s c on a.b = c.b and a.id < c.id and abs(a.v - c.v) <= 300 + 1e-9""")
def band_self_join(t, spark):
    return spatial.band_pairs(t("supplier"), "s_suppkey", "s_nationkey", "s_acctbal", 300.0)


_POINTS = "select s_suppkey as id, cast(s_suppkey * 7919 % 1000 as double) as east, cast(s_suppkey * 104729 % 1000 as double) as north, s_acctbal as v from supplier"


def points(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("id"), (k * 7919 % 1000).cast("double").alias("east"), (k * 104729 % 1000).cast("double").alias("north"), F.col("s_acctbal").alias("v"))


@query(f"with p as ({_POINTS}) select a.id as left_id, b.id as right_id from p a join p b on a.id < b.id and sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2) <= 60")
def radius_self_join(t, spark):
    return spatial.radius_pairs(points(t), "id", 60.0)


@query(f"""with p as ({_POINTS}), d as (select a.id, b.id as other, b.v, row_number() over (partition by a.id order by sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2), b.id) as k from p a join p b on a.id <> b.id)
    select id, {R("avg(v)", 4)} as knn_mean, {R("median(v)", 4)} as knn_median from d where k <= 5 group by id""")
def knn_mean_median_loo(t, spark):
    p = points(t)
    near = spatial.knn_join(p, p, 5, "id", "id", 100.0, exclude_self=True)
    return rounded(near.groupBy("id").agg(F.avg("r_v").alias("knn_mean"), F.median("r_v").alias("knn_median")), "knn_mean", "knn_median", digits=4)


@query(f"""with p as ({_POINTS}), c as (select c_custkey as cid, cast(c_custkey * 31 % 1000 as double) as east, cast(c_custkey * 17 % 1000 as double) as north from customer),
    d as (select cid, id, sqrt((c.east - p.east) ** 2 + (c.north - p.north) ** 2) as distance from c join p on sqrt((c.east - p.east) ** 2 + (c.north - p.north) ** 2) <= 25),
    b as (select *, row_number() over (partition by cid order by distance, id) as k from d)
    select c.cid, b.id, {R("b.distance")} as distance from c left join b on c.cid = b.cid and k = 1""")
def nearest_within(t, spark):
    k = F.col("c_custkey")
    c = t("customer").select(k.alias("cid"), (k * 31 % 1000).cast("double").alias("east"), (k * 17 % 1000).cast("double").alias("north"))
    return rounded(spatial.nearest_within(c, points(t), "cid", "id", 25.0), "distance")


@query(f"""with p as ({_POINTS}) select id, case when floor((east + 0.5) / 250) = 3 and floor((north + 0.5) / 250) = 3 then null else cast(floor((east + 0.5) / 250) * 4 + floor((north + 0.5) / 250) as bigint) end as unit from p""")
def point_in_polygon(t, spark):
    cells = spark.range(15).select(F.col("id").alias("unit"), F.floor(F.col("id") / 4).alias("i"), (F.col("id") % 4).alias("j"))
    corner = lambda a, b: F.struct(((F.col("i") + a) * 250.0 - 0.5).alias("x"), ((F.col("j") + b) * 250.0 - 0.5).alias("y"))
    polygons = cells.select("unit", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    return spatial.locate(points(t), polygons, "id", "unit", max_snap=0.0, cell=250.0).select("id", "unit")


@query(f"""with p as ({_POINTS}), a as (select c_custkey as aid, case when c_custkey % 4 = 0 then 'market' else 'food' end as category, cast(c_custkey * 31 % 1000 as double) as east, cast(c_custkey * 17 % 1000 as double) as north from customer),
    d as (select p.id, category, aid, sqrt((a.east - p.east) ** 2 + (a.north - p.north) ** 2) as d from p join a on sqrt((a.east - p.east) ** 2 + (a.north - p.north) ** 2) <= 120),
    k as (select *, row_number() over (partition by id, category order by d, aid) as k from d),
    s as (select id, category, sum((case when category = 'market' then 3.0 when k = 1 then 0.75 else 0.25 end) * 0.5 * (1 + cos(pi() * greatest(0, least(1, (d - 20) / 100))))) as s from k where (category = 'market' and k <= 1) or (category = 'food' and k <= 2) group by id, category),
    w as (select p.id, coalesce(max(s) filter (where category = 'market'), 0) as m, coalesce(max(s) filter (where category = 'food'), 0) as f from p left join s on p.id = s.id group by p.id)
    select id, {R("100 * m / 3.0")} as acc_market, {R("100 * f / 1.0")} as acc_food, {R("100 * (m + f) / 4.0")} as acc_total from w""")
def accessibility(t, spark):
    k = F.col("c_custkey")
    a = t("customer").select(k.alias("amenity_id"), F.when(k % 4 == 0, "market").otherwise("food").alias("category"), (k * 31 % 1000).cast("double").alias("east"), (k * 17 % 1000).cast("double").alias("north"))
    return rounded(spatial.accessibility(points(t), a, "id", {"market": [3.0], "food": [0.75, 0.25]}, 20.0, 120.0), "acc_market", "acc_food", "acc_total")


@query(f"with p as ({_POINTS}), a as (select c_custkey % 17 as class, cast(c_custkey * 31 % 1000 as double) as east, cast(c_custkey * 17 % 1000 as double) as north from customer) select p.id, {R('avg(case when class in (5, 10, 11, 12) then 1.0 when class is not null then 0.0 end)')} as green_share from p left join a on sqrt((a.east - p.east) ** 2 + (a.north - p.north) ** 2) <= 50 group by p.id")
def green_share(t, spark):
    k = F.col("c_custkey")
    land = t("customer").select((k % 17).alias("class"), (k * 31 % 1000).cast("double").alias("east"), (k * 17 % 1000).cast("double").alias("north"))
    return rounded(spatial.green_share(points(t), land, "id", 50.0), "green_share")


@query(f"""with p as ({_POINTS}), g as (select cast(p_partkey % 100 as bigint) as col, cast(p_partkey * 7 % 100 as bigint) as row, max(p_retailprice) as value from part group by 1, 2),
    w as (select unnest([0.0, 10.0, 20.0, 50.0]) as h),
    f as (select p.id, h, max(value) as level from p cross join w join g on col between floor((east - h) / 10) and floor((east + h) / 10) and row between floor((1000 - north - h) / 10) and floor((1000 - north + h) / 10) group by p.id, h),
    b as (select id, min(h) as h, arg_min(level, h) as level from f group by id)
    select p.id, b.level, case when b.h = 0 then 'point' when b.h <= 20 then 'facade' when b.h is not null then 'fallback' else 'quiet' end as source from p left join b on p.id = b.id""")
def noise_levels(t, spark):
    k = F.col("p_partkey")
    raster = t("part").groupBy((k % 100).alias("col"), (k * 7 % 100).alias("row")).agg(F.max("p_retailprice").alias("value"))
    return spatial.noise_levels(points(t), raster, "id", (0.0, 10.0, 20.0, 50.0), cell=10.0, north_edge=1000.0)


@query(f"select n_regionkey as terminal_id, {R('avg(s_acctbal)', 4)} as mean from supplier join nation on s_nationkey = n_nationkey group by n_regionkey")
def remap_mean(t, spark):
    values = t("supplier").select(F.col("s_nationkey").alias("initial_id"), F.col("s_acctbal").alias("mean"))
    return rounded(spatial.remap_mean(values, t("nation").select(F.col("n_nationkey").alias("initial_id"), F.col("n_regionkey").alias("terminal_id")), "mean"), "mean", digits=4)


@query("""with p as (select event_id, user_id, ts, value from events), a as (select *, event_type = 'signup' as s from events) select e.event_id, (select max(event_id) from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.ts <= e.ts) as last_signup from events e""")
def asof_last(t, spark):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


# --- entity resolution ---


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) > 1 as is_duplicate from lineitem")
def exact_duplicates(t, spark):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("k"))
    return clean.exact_duplicate(rows, ["l_orderkey", "l_linenumber"], "k").drop("k")


_NORMAL = "trim(regexp_replace(translate(replace(replace(replace(replace(replace(replace(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'æ', 'ae'), 'œ', 'oe'), 'àáâãåāçćčèéêëēęìíîïīñńòóôõøōùúûūýÿšśžźżłđ', 'aaaaaaccceeeeeeiiiiinnoooooouuuuyysszzzld'), '[^0-9a-z]+', ' ', 'g'))"


@query(f"select h, count(*) as n, min(doc_id) as first_id from (select doc_id, case when length({_NORMAL}) >= 30 then sha256({_NORMAL}) end as h from documents) where h is not null group by h having count(*) <= 10")
def text_hash_groups(t, spark):
    rows = t("documents").select("doc_id", resolve.description_hash("text", 30).alias("h")).where("h is not null")
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n <= 10")


def objects(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(
        k.alias("listing_id"), (k % 40 + 50).cast("double").alias("area"), F.when(k % 9 != 0, k % 3 + 2.5).alias("rooms"), (F.floor(k / 3) % 50 * 40 + 1000).cast("double").alias("price"),
        F.when(k % 4 != 0, F.floor(k / 6)).cast("double").alias("egid"), (F.floor(k / 2) * 11 % 1000).cast("double").alias("east"), (F.floor(k / 2) * 37 % 1000).cast("double").alias("north"),
    )


_OBJECTS = """o as (select c_custkey as listing_id, cast(c_custkey % 40 + 50 as double) as area, case when c_custkey % 9 <> 0 then c_custkey % 3 + 2.5 end as rooms, cast(c_custkey // 3 % 50 * 40 + 1000 as double) as price,
    case when c_custkey % 4 <> 0 then cast(c_custkey // 6 as double) end as egid, cast(c_custkey // 2 * 11 % 1000 as double) as east, cast(c_custkey // 2 * 37 % 1000 as double) as north from customer)"""
_EDGES = """e as (select a.listing_id as l, b.listing_id as r from o a join o b on a.listing_id < b.listing_id
    and ((a.egid = b.egid) or ((a.egid is null or b.egid is null) and sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2) <= 30))
    where case when coalesce(a.egid = b.egid, false) or sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2) <= 5 then
        ((a.rooms is null or b.rooms is null or abs(a.rooms - b.rooms) <= 0.05) and abs(a.area - b.area) <= 3 + 1e-9 and abs(a.price - b.price) <= 0.1 * greatest(a.price, b.price) + 1e-6) or (abs(a.area - b.area) <= 0.5 + 1e-9 and abs(a.price - b.price) <= 1 + 1e-6)
      else (a.rooms is null or b.rooms is null or abs(a.rooms - b.rooms) <= 0.05) and abs(a.area - b.area) <= 0.5 + 1e-9 and abs(a.price - b.price) <= 1 + 1e-6 end),
    g as (select l, r from e union all select r, l from e), reach(id, root) as (select listing_id, listing_id from o union select g.r, reach.root from reach join g on g.l = reach.id),
    c as (select id as listing_id, min(root) as root from reach group by id)"""


@query(f"with recursive {_OBJECTS}, {_EDGES} select listing_id, 'obj_' || lpad(cast(dense_rank() over (order by root) as varchar), 6, '0') as object_id from c")
def object_ids(t, spark):
    return resolve.assign_object_ids(objects(t)).select("listing_id", "object_id")


@query(f"with recursive {_OBJECTS}, {_EDGES}, j as (select o.*, root, count(*) over (partition by root) as n_listings, row_number() over (partition by root order by o.listing_id) as k, median(price) over (partition by root) as m from o join c on o.listing_id = c.listing_id) select listing_id, m as price, n_listings from j where k = 1")
def collapse_median(t, spark):
    return resolve.collapse_objects(resolve.assign_object_ids(objects(t)), how="median").select("listing_id", "price", "n_listings")


@query("""with g as (select l_orderkey, count(*) as n, (max(l_extendedprice) - min(l_extendedprice)) / max(l_extendedprice) as r from lineitem group by l_orderkey),
    t as (select cast(sum(n) as double) as rows, cast(count(*) as double) as unique_objects, cast(count(*) filter (where n > 1) as double) as objects_with_duplicates, cast(count(*) filter (where n = 2) as double) as objects_size_2,
    cast(count(*) filter (where n = 3) as double) as objects_size_3, cast(count(*) filter (where n >= 4) as double) as objects_size_4plus, cast(max(n) as double) as max_group_size, avg(n) as mean_group_size, median(case when n > 1 then r end) as median_rel_price_range_dup_objects,
    cast(sum(n) - count(*) as double) as duplicate_rows, 100.0 * (sum(n) - count(*)) / sum(n) as duplicate_share_pct from g)
    select key, round(value + 1e-9, 6) as value from (unpivot t on * into name key value value)""")
def dedup_report(t, spark):
    return rounded(resolve.dedup_report(t("lineitem"), "l_orderkey", "l_extendedprice"), "value")


# --- robust statistics, publishing ---


def _levels_sql(k: int, key: str) -> str:
    return f"""u{k} as (select {key} as g, object_id, median(x) as v from x where {key} is not null group by all), c{k} as (select g, median(v) as center, count(*) as n from u{k} group by g),
        m{k} as (select u{k}.g, center, median(abs(v - center)) as mad from u{k} join c{k} using (g) where n >= 10 group by u{k}.g, center having median(abs(v - center)) > 0)"""


_Z = f"""with {{LISTINGS}}, x as (select *, ln(price / area) as x from listings), w as (select object_id, median(x) as v from x group by object_id), wc as (select median(v) as c from w), ws as (select c, median(abs(v - c)) / 0.6745 as s from w, wc group by c),
    {_levels_sql(0, "municipality_id")}, {_levels_sql(1, "district_id")}, {_levels_sql(2, "canton")},
    s as (select x.*, ws.c as gc, m2.center as c2, case when m2.g is null then ws.s else greatest(m2.mad / 0.6745, 0.5 * ws.s) end as s2, m1.center as c1, m1.mad as a1, m0.center as c0, m0.mad as a0, m2.g as g2, m1.g as g1, m0.g as g0
        from x cross join ws left join m2 on x.canton = m2.g left join m1 on x.district_id = m1.g left join m0 on x.municipality_id = m0.g),
    s1 as (select *, case when g1 is null then s2 else greatest(a1 / 0.6745, 0.5 * s2) end as t1 from s), s0 as (select *, case when g0 is null then t1 else greatest(a0 / 0.6745, 0.5 * t1) end as t0 from s1),
    z as (select listing_id, (x - coalesce(c0, c1, c2, gc)) / t0 as z from s0)"""


@query(_Z + " select listing_id, round(z + 1e-8, 5) as z from z")
def price_zscores(t, spark):
    return robust.price_zscores(listings(t), object_id="object_id").select("listing_id", r("z", 5).alias("z"))


@query(_Z + " select listing_id from z where abs(z) > 3.5")
def price_outliers(t, spark):
    return robust.price_outliers(listings(t), object_id="object_id").where("is_outlier").select("listing_id")


@query("""with {LISTINGS}, x as (select *, price / area as r from listings where object_id % 5 <> 0), p as (select part_id as g, median(r) as m from x group by 1 having count(*) >= 25), s as (select municipality_id as g, median(r) as m from x group by 1 having count(*) >= 25), a as (select median(r) as m from x)
    select listing_id, round(coalesce(p.m, s.m, a.m) + 1e-9, 6) as rate, case when p.m is not null then 'part_id' when s.m is not null then 'municipality_id' else 'global' end as rate_source from listings cross join a left join p on part_id = p.g left join s on municipality_id = s.g where object_id % 5 = 0""")
def naive_rate_fallback(t, spark):
    rows = listings(t)
    return rounded(robust.naive_rates(rows.where("object_id % 5 <> 0"), rows.where("object_id % 5 = 0"), ("part_id", "municipality_id"), 25).select("listing_id", "rate", "rate_source"), "rate")


@query("""with {LISTINGS}, u as (select 'canton' as level, canton as unit_id, * from listings union all select 'district', cast(district_id as varchar), * from listings union all select 'municipality', cast(municipality_id as varchar), * from listings union all select 'part', cast(part_id as varchar), * from listings)
    select level, unit_id, count(*) as n, case when count(*) >= 30 then round(median(price / area) + 1e-7, 4) end as median_rate, case when count(*) >= 30 then round(quantile_cont(price / area, 0.25) + 1e-7, 4) end as p25_rate,
    case when count(*) >= 30 then round(quantile_cont(price / area, 0.75) + 1e-7, 4) end as p75_rate, case when count(*) >= 30 then round(median(price) + 1e-7, 4) end as median_price from u group by level, unit_id""")
def unit_stats_3_levels(t, spark):
    levels = {"canton": "canton", "district": "district_id", "municipality": "municipality_id", "part": "part_id"}
    return rounded(publish.unit_stats(listings(t), levels, min_count=30), "median_rate", "p25_rate", "p75_rate", "median_price", digits=4)


@query("""with v as (select c_nationkey, c_mktsegment, sum(greatest(c_acctbal, 0)) as w from customer group by all) select c_nationkey, c_mktsegment from (select *, row_number() over (partition by c_nationkey order by w desc, c_mktsegment) as k from v) where k = 1""")
def majority_category(t, spark):
    return robust.majority(t("customer").withColumn("w", F.greatest("c_acctbal", F.lit(0.0))), "c_nationkey", "c_mktsegment", "w")


@query(f"""with c as (select *, greatest(c_acctbal, 0) as w, case when c_custkey % 3 > 0 then c_custkey % 100 end as x from customer) select c_nationkey, {R("sum(x * w) / sum(w) filter (where x is not null)")} as x, {R("sum(w)", 4)} as weight, count(*) as units from c group by c_nationkey""")
def weighted_unit_scores(t, spark):
    rows = t("customer").withColumn("w", F.greatest("c_acctbal", F.lit(0.0))).withColumn("x", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 100))
    return rounded(rounded(robust.weighted_unit_scores(rows, ["x"], "w", "c_nationkey"), "x"), "weight", digits=4)


@query(f"""with v as (select c_mktsegment as k, cast(c_custkey % 100 as double) as v, sum(greatest(c_acctbal, 0)) as w from customer where c_acctbal > 0 group by 1, 2), d as (select *, (sum(w) over (partition by k order by v) - w / 2) / sum(w) over (partition by k) as cdf from v),
    l as (select *, lag(cdf) over (partition by k order by v) as c0, lag(v) over (partition by k order by v) as v0 from d)
    select k as c_mktsegment, {R("coalesce(arg_min(coalesce(v0 + (v - v0) * (0.3 - c0) / (cdf - c0), v), cdf) filter (where cdf >= 0.3), max(v))")} as q from l group by k""")
def weighted_quantile(t, spark):
    rows = t("customer").select("c_mktsegment", (F.col("c_custkey") % 100).cast("double").alias("v"), F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    return rounded(composite.weighted_quantile(rows, "v", "w", 0.3, ["c_mktsegment"]), "q")


# --- encoding, splits ---

_TE = """with {LISTINGS}, y as (select *, ln(price) as y, canton || '/' || district_id || '/' || municipality_id as k2, canton || '/' || district_id as k1 from listings), g as (select avg(y) as m from y),
    e0 as (select canton as k, (sum(y) + 20 * m) / (count(*) + 20) as e from y, g group by canton, m), e1 as (select k1 as k, (sum(y) + 20 * e) / (count(*) + 20) as e from y join e0 on canton = k group by k1, e),
    e2 as (select k2 as k, (sum(y) + 20 * e) / (count(*) + 20) as e from y join e1 on k1 = k group by k2, e)"""


@query(_TE + " select e2.k, round(e2.e + 1e-9, 6) as te from e2")
def target_encode_full(t, spark):
    rows = listings(t).withColumn("y", F.ln("price"))
    k0, k1, k2 = S.nested_keys("canton", "district_id", "municipality_id")
    rows = rows.withColumns({"k0": k0, "k1": k1, "k2": k2})
    return robust.target_encode(rows, rows.select("k0", "k1", "k2").distinct(), ["k0", "k1", "k2"], "y").select(F.col("k2").alias("k"), r("te_k2").alias("te"))


@query("""with {LISTINGS}, y as (select *, ln(price) as y, object_id % 5 as f from listings), t as (select sum(y) as s, count(*) as n from y), tf as (select f, sum(y) as s, count(*) as n from y group by f), m as (select f, (t.s - tf.s) / (t.n - tf.n) as m from tf, t),
    a as (select canton, sum(y) as s, count(*) as n from y group by canton), b as (select canton, f, sum(y) as s, count(*) as n from y group by canton, f)
    select y.canton, y.f as fold, round((a.s - b.s + 20 * m) / (a.n - b.n + 20) + 1e-9, 6) as te, count(*) as rows from y join m using (f) join a on y.canton = a.canton join b on y.canton = b.canton and y.f = b.f group by 1, 2, 3""")
def target_encode_oof(t, spark):
    rows = listings(t).withColumn("y", F.ln("price")).withColumn("fold", F.col("object_id") % 5)
    return robust.target_encode_oof(rows, ["canton"], "y", "fold").groupBy("canton", "fold", r("te_canton").alias("te")).agg(F.count("*").alias("rows"))


@query("""with {LISTINGS}, c as (select quantile_cont(price, [0.25, 0.5, 0.75]) as q from listings), b as (select canton, 'P' || (1 + cast(price > q[1] as int) + cast(price > q[2] as int) + cast(price > q[3] as int)) as band from listings, c) select canton || '|' || band as stratum, count(*) as n from b group by 1""")
def strata(t, spark):
    return splits.make_strata(listings(t), "listing_id").groupBy("stratum").agg(F.count("*").alias("n"))


@query()
def group_folds(t, spark):
    rows = splits.group_folds(t("orders"), "o_custkey", "o_orderkey", stratum="o_orderpriority")
    return rows.groupBy("fold", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query("select 'clean' as state, 0 as leaking")
def leakage_check(t, spark):
    leaking = splits.leaking_groups(splits.three_way_split(splits.hash_folds(t("orders"), "o_custkey", "o_orderkey")), "split", "o_custkey")
    return leaking.agg(F.count("*").cast("int").alias("leaking")).select(F.when(F.col("leaking") == 0, "clean").otherwise("leaking").alias("state"), "leaking")


@query("""with s as (select o_orderstatus as split, * from orders union all select 'all', * from orders), n as (select count(*) as total from orders), p as (select split, o_orderpriority, count(*) as k from s group by all), top as (select split, o_orderpriority as v, k from (select *, row_number() over (partition by split order by k desc, o_orderpriority) as r from p) where r = 1)
    select s.split, count(*) as n, count(distinct o_custkey) as groups, round(avg(o_totalprice) + 1e-7, 4) as o_totalprice_mean, round(median(o_totalprice) + 1e-7, 4) as o_totalprice_median, count(distinct o_orderpriority) as o_orderpriority_unique, any_value(top.v) as o_orderpriority_top, round(any_value(top.k) / count(*) + 1e-9, 6) as o_orderpriority_top_share, round(count(*) / any_value(total) + 1e-9, 6) as share from s join top on s.split = top.split, n group by s.split""")
def split_summary(t, spark):
    out = splits.split_summary(t("orders"), "o_orderstatus", ["o_totalprice"], ["o_orderpriority"], "o_custkey")
    return rounded(rounded(out, "o_totalprice_mean", "o_totalprice_median", digits=4), "o_orderpriority_top_share", "share")


# --- metrics, calibration ---

_PRED = "p as (select o_orderkey as id, o_orderpriority as g, o_orderstatus as s, o_totalprice as y, avg(o_totalprice) over (partition by o_orderpriority) + o_orderkey % 1000 as p, o_totalprice * 0.7 + o_orderkey % 90000 as lo, o_totalprice * 0.9 + o_orderkey % 110000 as hi from orders)"


def predictions(t) -> DataFrame:
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    return t("orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("y"), (F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority")) + k % 1000).alias("p"),
        (F.col("o_totalprice") * 0.7 + k % 90000).alias("lo"), (F.col("o_totalprice") * 0.9 + k % 110000).alias("hi"),
    )


@query(f"with {_PRED} select round(avg(abs(p - y)) + 1e-6, 3) as mae, round(sqrt(avg((p - y) ** 2)) + 1e-6, 3) as rmse, round(median(abs(p - y)) + 1e-6, 3) as medae, {R('100 * avg(abs((p - y) / y))', 4)} as mape, {R('1 - sum((p - y) ** 2) / (var_pop(y) * count(*))')} as r2 from p")
def regression_metrics(t, spark):
    return rounded(rounded(rounded(metrics.regression_metrics(predictions(t), "y", "p"), "mae", "rmse", "medae", digits=3), "mape", digits=4), "r2")


@query(f"with {_PRED} select s, count(*) as n, round(avg(abs(p - y)) + 1e-6, 3) as mae, round(sqrt(avg((p - y) ** 2)) + 1e-6, 3) as rmse, {R('100 * avg(abs((p - y) / y))', 4)} as mape, round(avg(p - y) + 1e-6, 3) as bias from p group by s")
def segment_metrics(t, spark):
    return rounded(rounded(metrics.segment_metrics(predictions(t), "y", "p", "s"), "mae", "rmse", "bias", digits=3), "mape", digits=4)


@query(f"with {_PRED}, a as (select s as segment, * from p union all select 'all', * from p) select segment, count(*) as n, {R('avg(case when y between lo and hi then 1.0 else 0.0 end)')} as coverage, {R('avg(case when y < lo then 1.0 else 0.0 end)')} as below, {R('avg(case when y > hi then 1.0 else 0.0 end)')} as above, round(avg(hi - lo) + 1e-6, 3) as mean_width, round(median(hi - lo) + 1e-6, 3) as median_width from a group by segment")
def coverage_report(t, spark):
    return rounded(rounded(metrics.coverage_report(predictions(t), "y", "lo", "hi", "s"), "coverage", "below", "above"), "mean_width", "median_width", digits=3)


@query(f"with {_PRED} select s, round(avg((hi - lo) + 10 * greatest(lo - y, 0) + 10 * greatest(y - hi, 0)) + 1e-6, 3) as score from p group by s")
def interval_score(t, spark):
    return predictions(t).groupBy("s").agg(r(metrics.interval_score("y", "lo", "hi", 0.2), 3).alias("score"))


@query(f"with {_PRED}, e as (select abs(y - p) as e, row_number() over (order by abs(y - p)) as k, count(*) over () as n from p) select round(e + 1e-6, 3) as q from e where k = greatest(ceil(n * 0.8 - 1e-9), 1)")
def constant_band(t, spark):
    return rounded(metrics.constant_band(predictions(t), "y", "p", 0.8), "q", digits=3)


_QUANT = "q as (select p_partkey as id, p_brand as b, p_retailprice + p_size * 3 as y, list_transform([0.8, 0.95, 1.0, 1.1, 1.3], lambda f: p_retailprice * f + p_partkey % 13) as q from part)"
_LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9]


def quantiles(t) -> DataFrame:
    q = F.array(*(F.col("p_retailprice") * f + F.col("p_partkey") % 13 for f in (0.8, 0.95, 1.0, 1.1, 1.3)))
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("b"), (F.col("p_retailprice") + F.col("p_size") * 3).alias("y"), q.alias("q"))


@query(f"with {_QUANT}, u as (select y, unnest(q) as q, unnest({_LEVELS}) as level from q) select level, {R('avg(case when y <= q then 1.0 else 0.0 end)')} as share, {R('avg(case when y <= q then 1.0 else 0.0 end) - level')} as deviation, round(avg(greatest(level * (y - q), (level - 1) * (y - q))) + 1e-7, 4) as pinball, count(*) as n from u group by level")
def pinball_table(t, spark):
    return rounded(rounded(metrics.quantile_calibration(quantiles(t), "y", "q", _LEVELS), "share", "deviation"), "pinball", digits=4)


@query(f"with {_QUANT}, x as (select id, [q[1], q[3] + id % 300, q[2], q[4], q[5]] as q from q) select {R('avg(case when q[2] < q[1] or q[3] < q[2] or q[4] < q[3] or q[5] < q[4] then 1.0 else 0.0 end)')} as rate from x")
def crossing_rate(t, spark):
    rows = quantiles(t).withColumn("q", F.array(F.col("q")[0], F.col("q")[2] + F.col("id") % 300, F.col("q")[1], F.col("q")[3], F.col("q")[4]))
    return rows.agg(r(metrics.crossing_rate("q")).alias("rate"))


@query(f"""with {_QUANT}, u as (select id, y, q, len(list_filter(q, lambda x: x <= y)) as nb from q), s as (select *, least(greatest(nb - 1, 0), 3) + 1 as k, {_LEVELS} as a from u)
    select id, {R('greatest(0.01, least(0.99, a[k] + (a[k + 1] - a[k]) * (y - q[k]) / (q[k + 1] - q[k])))')} as pct from s""")
def market_percentile(t, spark):
    return quantiles(t).select("id", r(metrics.market_percentile("q", _LEVELS, "y")).alias("pct"))


_CQR = f"with {_PRED}, c as (select greatest(lo - y, y - hi) as v from p where id % 3 = 0), k as (select v, row_number() over (order by v) as k, count(*) over () as n from c), q as (select v as q from k where k = ceil((n + 1) * 0.8 - 1e-9)), w as (select id, lo - q as a, hi + q as b from p, q where id % 3 <> 0)"


@query(_CQR + " select id, round((case when a > b then (a + b) / 2 else a end) + 1e-6, 3) as lo_cal, round((case when a > b then (a + b) / 2 else b end) + 1e-6, 3) as hi_cal from w")
def cqr(t, spark):
    p = predictions(t)
    return rounded(conformal.calibrated(p.where("id % 3 = 0"), p.where("id % 3 <> 0"), "lo", "hi", "y", 0.2).select("id", "lo_cal", "hi_cal"), "lo_cal", "hi_cal", digits=3)


@query(f"with {_PRED}, c as (select abs(y - p) / (1 + id % 7) as v from p where id % 3 = 0), k as (select v, row_number() over (order by v) as k, count(*) over () as n from c), q as (select v as q from k where k = ceil((n + 1) * 0.8 - 1e-9)) select id, round(p - q * (1 + id % 7) + 1e-5, 2) as lo_cal, round(p + q * (1 + id % 7) + 1e-5, 2) as hi_cal from p, q where id % 3 <> 0")
def normalized_conformal(t, spark):
    p = predictions(t).withColumn("sigma", (1 + F.col("id") % 7).cast("double"))
    return rounded(conformal.normalized(p.where("id % 3 = 0"), p.where("id % 3 <> 0"), "p", "sigma", "y", 0.2).select("id", "lo_cal", "hi_cal"), "lo_cal", "hi_cal", digits=2)


@query(f"""with {_PRED}, c as (select s, g, greatest(lo - y, y - hi) as v from p where id % 3 = 0), l as (select 2 as depth, s, g, v from c union all select 1, s, null, v from c union all select 0, null, null, v from c),
    k as (select *, row_number() over (partition by depth, s, g order by v) as k, count(*) over (partition by depth, s, g) as n from l) select depth, s, g, n, round(v + 1e-6, 3) as q from k where k = ceil((n + 1) * 0.8 - 1e-9) and (n >= 100 or depth = 0)""")
def mondrian_cells(t, spark):
    return rounded(conformal.mondrian_cells(predictions(t).where("id % 3 = 0"), "lo", "hi", "y", ["s", "g"], 0.2, 100), "q", digits=3)


@query(f"with {_PRED}, c as (select quantile_cont(p, [0.25, 0.5, 0.75]) as q from p) select 'B' || (1 + cast(q[1] <= p as int) + cast(q[2] <= p as int) + cast(q[3] <= p as int)) as band, count(*) as n from p, c group by 1")
def band_cutpoints(t, spark):
    p = predictions(t)
    return p.crossJoin(F.broadcast(conformal.band_cutpoints(p, "p"))).groupBy(conformal.band("p").alias("band")).agg(F.count("*").alias("n"))


@query(f"with {_PRED} select case when y < lo then 'below' when y > hi then 'above' else 'within' end as verdict, count(*) as n from p where lo <= hi group by 1")
def verdicts(t, spark):
    return predictions(t).where("lo <= hi").groupBy(S.verdict("y", "lo", "hi").alias("verdict")).agg(F.count("*").alias("n"))


@query("with p as (select o_orderkey as id, o_totalprice * 1.0 as e, o_totalprice * 1.1 as e1, o_totalprice + 500 as e2 from orders) select id, scenario, round(x + 1e-7, 4) as expected, round(x - e + 1e-7, 4) as delta from (select id, 'baseline' as scenario, e as x, e from p union all select id, 'more', e1, e from p union all select id, 'extra', e2, e from p)")
def what_if(t, spark):
    from brindle.operators import ml

    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.lit(0.0).alias("b"))
    out = ml.what_if(rows, "id", {"more": {"a": F.col("a") * 1.1}, "extra": {"b": F.lit(500.0)}}, lambda d: d.withColumn("expected", F.col("a") + F.col("b")))
    return rounded(out, "expected", "delta", digits=4)


# --- composite index ---

_IND = "i as (select c_custkey as id, c_acctbal as a, cast(c_custkey % 97 as double) as b, cast(c_nationkey as double) as c from customer)"


def indicators(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"), F.col("c_nationkey").cast("double").alias("c"))


_SCORES = f"""{_IND}, w as (select quantile_cont(a, 0.01) as a0, quantile_cont(a, 0.99) as a1, quantile_cont(ln(1 + b), 0.01) as b0, quantile_cont(ln(1 + b), 0.99) as b1, quantile_cont(c, 0.01) as c0, quantile_cont(c, 0.99) as c1 from i),
    n as (select id, 100 * (greatest(a0, least(a1, a)) - a0) / (a1 - a0) as a, 100 - 100 * (greatest(b0, least(b1, ln(1 + b))) - b0) / (b1 - b0) as b, 100 * (greatest(c0, least(c1, c)) - c0) / (c1 - c0) as c from i, w)"""
_SPEC = [composite.Indicator("a", "x"), composite.Indicator("b", "y", higher_is_better=False, log=True), composite.Indicator("c", "y")]


@query(f"with {_IND} select 'a' as \"column\", {R('quantile_cont(a, 0.01)', 4)} as low, {R('quantile_cont(a, 0.99)', 4)} as high from i union all select 'b', {R('quantile_cont(b, 0.01)', 4)}, {R('quantile_cont(b, 0.99)', 4)} from i")
def winsor_bounds(t, spark):
    return rounded(robust.winsor_bounds(indicators(t), ["a", "b"]), "low", "high", digits=4)


@query(f"with {_SCORES} select id, {R('a', 5)} as a, {R('b', 5)} as b, {R('c', 5)} as c, {R('a', 5)} as dim_x, {R('(b + c) / 2', 5)} as dim_y, {R('0.5 * a + 0.5 * (b + c) / 2', 5)} as index from n")
def minmax_index(t, spark):
    return rounded(composite.aggregate_index(composite.minmax(indicators(t), _SPEC), _SPEC), "a", "b", "c", "dim_x", "dim_y", "index", digits=5)


@query(f"with {_SCORES} select id, {R('exp((ln(greatest(a, 1)) + ln(greatest(b, 1)) + ln(greatest(c, 1))) / 3)', 5)} as g, {R('(b + c) / 2', 5)} as without_a from n")
def geometric_index(t, spark):
    n = composite.minmax(indicators(t), _SPEC)
    return n.select("id", r(composite.geometric(["a", "b", "c"]), 5).alias("g"), r(composite.leave_one_out(["a", "b", "c"])["a"], 5).alias("without_a"))


@query(f"with {_IND}, f as (select * from i where id % 2 = 0) select i.id, {R('100 * ((select count(*) from f where f.b < i.b) + 0.5 * (select count(*) from f where f.b = i.b)) / (select count(*) from f)')} as pct from i")
def percentile_normalize(t, spark):
    i = indicators(t)
    return composite.reference_percentile(i, i.where("id % 2 = 0"), "b", "pct").select("id", r("pct").alias("pct"))


_RANKS = "k as (select id, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as rc, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, count(*) over () as n from i)"


@query(f"with {_IND}, {_RANKS} select id, {R('0.5 * (rb - 1) / (n - 1) * 100 + 0.5 * (100 - (rc - 1) / (n - 1) * 100)')} as value_score from k")
def value_score(t, spark):
    return composite.value_score(indicators(t), "b", "c").select("id", r("value_score").alias("value_score"))


@query(f"with {_IND}, {_RANKS}, s as (select count(*) as n, corr(rb, rc) as rho from k) select n, round(rho, 8) as rho, {R('tanh(atanh(rho) - 1.959963984540054 * sqrt((1 + rho * rho / 2) / (n - 3)))')} as low, {R('tanh(atanh(rho) + 1.959963984540054 * sqrt((1 + rho * rho / 2) / (n - 3)))')} as high from s")
def spearman_ci(t, spark):
    return rounded(composite.convergent_validity(indicators(t), "b", "c").withColumn("rho", F.round("rho", 8)), "low", "high")


@query(f"with {_IND}, {_RANKS}, d as (select *, abs(ra - rb) / (n - 1) * 100 as shift, row_number() over (order by a desc, id) as oa, row_number() over (order by b desc, id) as ob from k join i using (id)) select any_value(n) as n, round(corr(ra, rb), 8) as spearman, {R('avg(shift)')} as mean_shift, {R('quantile_cont(shift, 0.9)')} as p90_shift, {R('count(*) filter (where oa <= ceil(0.1 * n) and ob <= ceil(0.1 * n)) / max(ceil(0.1 * n))')} as top_decile from d")
def rank_comparison(t, spark):
    return rounded(composite.rank_comparison(indicators(t), "a", "b", "id").withColumn("spearman", F.round("spearman", 8)), "mean_shift", "p90_shift", "top_decile")


@query("with d as (select l_quantity as a, l_extendedprice / 1000 as b, l_quantity + l_discount * 100 as c from lineitem) select count(*) as n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 8) as alpha from d")
def cronbach(t, spark):
    d = t("lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("c"))
    return composite.cronbach(d, ["a", "b", "c"]).withColumn("alpha", F.round("alpha", 8))


@query(f"""with s as (select p_partkey, case when p_size % 5 > 0 then cast(30 + p_size as double) end as d, case when p_size % 3 > 0 then cast(25 + p_size as double) end as n from part)
    select p_partkey, {R("10 * log10(coalesce(10 ** (d / 10), 0) + coalesce(10 ** (n / 10), 0))")} as total, {R("10 * log10((12 * 10 ** (d / 10) + 4 * 10 ** ((d + 5) / 10) + 8 * 10 ** ((n + 10) / 10)) / 24)")} as lden, greatest(d - 60, 0) + 0 * d as day_excess, d > 60 or n > 50 as any_over from s where d is not null or n is not null""")
def noise_sums(t, spark):
    s = t("part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, (30 + F.col("p_size")).cast("double")).alias("d"), F.when(F.col("p_size") % 3 > 0, (25 + F.col("p_size")).cast("double")).alias("n")).where("d is not null or n is not null")
    over = S.exceedance("d", "n")
    return s.select("p_partkey", r(S.energetic_sum("d", "n")).alias("total"), r(S.lden("d", "n")).alias("lden"), over["day_excess"].alias("day_excess"), over["any_over"].alias("any_over"))


@query(f"select p_partkey, {R('0.5 * (1 + cos(pi() * greatest(0, least(1, (p_retailprice - 400) / 2000))))')} as decay from part")
def distance_decay(t, spark):
    return t("part").select("p_partkey", r(S.distance_decay("p_retailprice")).alias("decay"))


# --- text ---


@query(f"select doc_id, sha256({_NORMAL}) as h from documents")
def normalize_text(t, spark):
    return t("documents").select("doc_id", F.sha2(resolve.normalize_text("text"), 256).alias("h"))


_WORDS = {"de": ["der", "die", "und", "das", "ist", "von"], "en": ["the", "and", "of", "is", "to", "that"], "fr": ["le", "la", "les", "et", "une", "des"], "es": ["el", "los", "por", "que", "una", "del"]}
_HITS = ", ".join(f"len(list_filter(w, lambda t: list_contains({v}, t))) as {k}" for k, v in _WORDS.items())


@query(f"""with h as (select doc_id, {_HITS} from (select doc_id, regexp_extract_all(lower(text), '[a-zäöüàâçéèêëîïôûùìíòóú]+') as w from documents)), b as (select doc_id, list_reverse(list_sort([{", ".join(f"{{'n': {k}, 'lang': '{k}'}}" for k in _WORDS)}])) as s from h)
    select doc_id, case when s[1].n < 1 or s[1].n = s[2].n then 'unknown' else s[1].lang end as lang from b""")
def detect_language(t, spark):
    return t("documents").select("doc_id", text.detect_language("text", words=_WORDS).alias("lang"))


@query("select doc_id, cast(regexp_matches(lower(text), 'licen[cs]e|copyright') as int) as kw_licence, cast(regexp_matches(lower(text), '[0-9]{4,}') as int) as kw_number from documents")
def keyword_flags(t, spark):
    return text.keyword_flags(t("documents").select("doc_id", "text"), "text", {"licence": "licen[cs]e|copyright", "number": "[0-9]{4,}"}).drop("text")


@query()
def keyword_flags_all(t, spark):
    return text.keyword_flags(t("documents").select("doc_id", "text"), "text").drop("text")


@query()
def anonymize(t, spark):
    return t("documents").select("doc_id", text.anonymize("text").alias("masked"))


@query()
def price_leak(t, spark):
    return t("documents").select("doc_id", text.price_leak("text", F.lit(2000.0)).alias("leak"))


@query()
def rule_attributes(t, spark):
    return text.attributes(t("documents"), "doc_id", "text")


@query()
def tfidf(t, spark):
    return text.tfidf(t("documents").select("doc_id", "text"), "doc_id", "text", n=1)


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as title, regexp_extract(html, '(?is)<html\\s[^>]*?\\blang="([^"]*)"', 1) as lang, len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)) as links from pages""")
def html_fields(t, spark):
    n = web.links(t("pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("links"))
    own = t("pages").select("page_id", web.tag_text("html", "title").alias("title"), web.attribute("html", "html", "lang").alias("lang"))
    return own.join(n, "page_id", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""with m as (select doc_id, lang as gold, case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then 'en' else lang end as pred from documents)
    select 'lang' as field, count(*) as support, count(*) filter (where pred = gold) as tp, count(*) filter (where pred is not null and pred <> gold) as fp, count(*) filter (where coalesce(pred <> gold, true)) as fn,
    round(count(*) filter (where pred = gold) / count(pred) + 1e-9, 6) as precision, round(count(*) filter (where pred = gold) / count(*) + 1e-9, 6) as recall from m""")
def extraction_eval(t, spark):
    gold = t("documents").select("doc_id", "lang")
    pred = gold.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang")))
    return rounded(metrics.extraction_scores(pred, gold, "doc_id", ["lang"]).drop("f1", "accuracy"), "precision", "recall")


@query(f"""with {_SCORES}, s as (select id, 'a|b|c' as x, a, b, c from n), k as (select b, c, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as rc from s)
    select 'x' as dimension, cast(1 as bigint) as n_indicators, cast(null as double) as cronbach_alpha, cast(null as double) as mean_spearman
    union all select 'y', 2, (select {R('2 * (1 - (var_samp(b) + var_samp(c)) / var_samp(b + c))')} from k), (select {R('corr(rb, rc)')} from k)""")
def dimension_consistency(t, spark):
    out = composite.dimension_consistency(composite.minmax(indicators(t), _SPEC), _SPEC)
    return rounded(out, "cronbach_alpha", "mean_spearman")


@query("""select c_custkey as id, case when c_custkey % 3 = 0 then 100.0 else c_acctbal end as noise_day_db, case when c_custkey % 4 = 1 and c_custkey % 8 <> 5 then 100.0 when c_custkey % 5 > 0 then cast(c_nationkey as double) end as noise_night_db from customer""")
def quiet_noise(t, spark):
    k = F.col("c_custkey")
    rows = t("customer").select(
        k.alias("id"), F.col("c_acctbal").alias("noise_day_db"), F.when(k % 5 > 0, F.col("c_nationkey").cast("double")).alias("noise_night_db"),
        (k % 3 == 0).alias("noise_quiet_day"), F.when(k % 4 == 1, k % 8 != 5).alias("noise_quiet_night"),
    )
    return composite.quiet_noise(rows).drop("noise_quiet_day", "noise_quiet_night")


@query("""with k as (select o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) as v, max(o_orderkey) as y from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1, 2)
    select o_custkey as unit, max(case when o_orderpriority = '1-URGENT' then v end) as "1-URGENT", max(case when o_orderpriority = '5-LOW' then v end) as "5-LOW",
        max(case when o_orderpriority = '1-URGENT' then y end) as "1-URGENT_year", max(case when o_orderpriority = '5-LOW' then y end) as "5-LOW_year" from k group by 1""")
def latest_pivot(t, spark):
    rows = t("orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("variable"), F.col("o_orderkey").alias("year"), F.col("o_totalprice").alias("value"))
    return source.latest_wide(rows, "unit", "variable", "value", "year", ["1-URGENT", "5-LOW"])


@query("""select p_partkey as id, cast(p_size as double) as area, cast(p_partkey % 19 as double) as rooms, case when p_size < 10 or p_size > 500 then 'area' when p_partkey % 19 < 1 or p_partkey % 19 > 15 then 'rooms' end as outside from part""")
def apartment_domain(t, spark):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("area"), (F.col("p_partkey") % 19).cast("double").alias("rooms"))
    return rows.withColumn("outside", clean.outside_domain("area", "rooms"))


@query(f"""with p as ({_POINTS}), k as (select id, cast(floor((east + 0.5) / 250) as int) as i, cast(floor((north + 0.5) / 250) as int) as j, east, north from p),
    s as (select c_custkey as stop, cast(c_custkey * 31 % 1000 as double) as east, cast(c_custkey * 17 % 1000 as double) as north from customer where c_custkey % 9 between 1 and 5),
    d as (select k.id, min(sqrt((k.east - s.east) ** 2 + (k.north - s.north) ** 2)) as d from k, s group by 1)
    select k.id, cast(case when i >= 2 and j >= 2 then 3 when i >= 1 then 1 else 0 end as int) as transit_class, {R('d')} as stop_distance from k left join d using (id)""")
def transit_indicators(t, spark):
    def box(name, x0, y0, x1, y1):
        return F.struct(F.lit(name).alias("class"), F.array(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))).alias("rings"))

    classes = spark.range(1).select(F.inline(F.array(box("D", 249.5, -0.5, 1100.0, 1100.0), box("B", 499.5, 499.5, 1100.0, 1100.0), box("C", 499.5, 499.5, 1100.0, 1100.0))))
    k = F.col("c_custkey")
    stops = t("customer").select(k.alias("stop"), (k % 9).alias("category"), (k * 31 % 1000).cast("double").alias("east"), (k * 17 % 1000).cast("double").alias("north"))
    return rounded(spatial.transit_indicators(points(t), classes, stops, "id", "stop", cell=250.0), "stop_distance")


# --- inference ---


@query("""with d as (select o_orderpriority || '/' || o_custkey as g, avg(abs(o_totalprice - 150000) - abs(o_totalprice - 140000 - o_orderkey % 7)) as d from orders group by 1), r as (select round(d, 6) as d from d where round(d, 6) <> 0),
    k as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r, count(*) over (partition by abs(d)) as t from r), s as (select count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus, sum(t * t - 1.0) as ties from k)
    select n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 8) as z from s""")
def wilcoxon(t, spark):
    from brindle.operators import inference

    rows = t("orders").select(
        F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string")).alias("g"), F.col("o_totalprice").alias("y"),
        F.lit(150000.0).alias("a"), (140000.0 + F.col("o_orderkey") % 7).alias("b"),
    )
    return inference.wilcoxon(rows, "y", "a", "b", "g", digits=6).select("n", "w_plus", "w_minus", F.round("z", 8).alias("z"))


@query("""with p as (select p_partkey, case when p_partkey % 10 > 0 then (p_partkey * 7919 % 1000 + 1) / 100000.0 end as p from part), s as (select *, (count(*) over () - row_number() over (order by p, p_partkey) + 1) * p as s from p where p is not null), m as (select p_partkey, least(1, max(s) over (order by p, p_partkey)) as h from s)
    select p.p_partkey, round(h + 1e-12, 9) as p_holm from p left join m on p.p_partkey = m.p_partkey""")
def holm(t, spark):
    k = F.col("p_partkey")
    rows = t("part").select("p_partkey", F.when(k % 10 > 0, (k * 7919 % 1000 + 1) / 100000.0).alias("p"))
    return metrics.holm(rows, "p").select("p_partkey", F.round(F.col("p_holm") + 1e-12, 9).alias("p_holm"))


@query()
def cluster_bootstrap(t, spark):
    from brindle.operators import inference

    p = predictions(t)
    return inference.bootstrap_ci(p, F.abs(F.col("p") - F.col("y")), "g")


@query()
def paired_bootstrap(t, spark):
    from brindle.operators import inference

    return inference.paired_bootstrap(predictions(t), "y", "p", "lo", "id")


@query(f"""with p as ({_POINTS}), d as (select a.id as i, b.id as j, row_number() over (partition by a.id order by sqrt((a.east - b.east) ** 2 + (a.north - b.north) ** 2), b.id) as k from p a join p b on a.id <> b.id),
    m as (select avg(v) as m, count(*) as n, var_pop(v) as var from p) select any_value(n) as n, round(sum((a.v - m) * (b.v - m) / 8) / count(*) * 8 / any_value(var), 8) as moran_i, round(-1 / (any_value(n) - 1), 8) as expected from d join p a on d.i = a.id join p b on d.j = b.id, m where k <= 8""")
def moran_i(t, spark):
    from brindle.operators import inference

    out = inference.morans_i(points(t), "id", "v", k=8, cell=100.0)
    return out.select("n", F.round("moran_i", 8).alias("moran_i"), F.round("expected", 8).alias("expected"))


@query()
def power_grid(t, spark):
    from brindle.operators import inference

    return inference.power_grid(predictions(t).select((F.col("p") - F.col("y")).alias("e")), "e", [500, 1000], [0.02, 0.05, 0.1])


# --- streaming, logs ---

_LAST = "with v as (select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id)"


@query("with a as (select * from events where event_id % 2 = 0), b as (select * from events where event_id % 2 = 1), f as (select user_id, min(event_id) as event_id from a group by user_id), n as (select user_id, min(event_id) as event_id from b where user_id not in (select user_id from f) group by user_id) select user_id, event_id from f union all select user_id, event_id from n")
def upsert_first_wins(t, spark):
    e = t("events").select("user_id", "event_id")
    empty = e.limit(0)
    return source.upsert_first(source.upsert_first(empty, e.where("event_id % 2 = 0"), "user_id", "event_id"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query(_LAST + " select user_id, event_id, event_type from v")
def upsert_last_wins(t, spark):
    e = t("events").select("user_id", "event_id", "event_type")
    half = e.agg(F.max("event_id")).first()[0] // 2
    return source.upsert_last(source.upsert_last(e.limit(0), e.where(F.col("event_id") <= half), "user_id", "event_id"), e.where(F.col("event_id") > half), "user_id", "event_id")


@query("select user_id as run_id, event_type as name, arg_max(value, event_id) as value from events group by 1, 2")
def run_log_fold(t, spark):
    from brindle.sources import bundle

    e = t("events").select(F.col("user_id").alias("run_id"), F.lit("r").alias("run_name"), F.lit("s").alias("stage"), F.lit("FINISHED").alias("status"), F.col("event_id").alias("seq"), F.create_map("event_type", "value").alias("metrics"), F.create_map("event_type", F.lit(0)).alias("steps"))
    return bundle.runs(e).select("run_id", F.explode("metrics").alias("name", "value"))


@query("select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as \"end\", event_type, count(*) as n, round(sum(value) + 1e-7, 4) as total from events group by all")
def windowed_events(t, spark):
    from brindle.streaming import streams

    return rounded(streams.windowed_counts(t("events"), "ts", ["event_type"], value="value"), "total", digits=4)


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '6 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k""")
def sessions(t, spark):
    from brindle.streaming import streams

    return streams.sessions(t("events"), "ts", "user_id", "6 hours")


# --- models ---


@query()
def point_model(t, spark):
    from brindle.operators import ml

    rows = listings(t).select("listing_id", "area", "discount", "tax", F.ln("price").alias("y"), (F.col("object_id") % 5).alias("fold"))
    model = ml.point_model(["area", "discount", "tax"], "y", iterations=5).fit(rows.where("fold <> 0"))
    return model.transform(rows.where("fold = 0")).select("listing_id", "prediction")


@query()
def pca_embeddings(t, spark):
    from brindle.operators import ml

    e = t("embeddings")
    return ml.reduce_embeddings(e.where("vec_id % 5 <> 0"), [e.where("vec_id % 5 = 0")], "embedding", 8)[1].select("vec_id", "reduced")


@query()
def geo_clusters(t, spark):
    from brindle.operators import ml

    return ml.geo_clusters(points(t), 8).select("id", "cluster")


@query()
def mixed_effects(t, spark):
    from brindle.operators import ml

    rows = listings(t).withColumn("y", F.ln("price")).select("listing_id", "area", "discount", "canton", "municipality_id", "y", "object_id")
    return ml.mixed_effects(rows.where("object_id % 5 <> 0"), rows.where("object_id % 5 = 0"), ["area", "discount"], "y", ["canton", "municipality_id"]).select("listing_id", "prediction")


@query()
def weight_sensitivity(t, spark):
    return composite.weight_sensitivity(composite.minmax(indicators(t), _SPEC), ["a", "b", "c"], "id")
