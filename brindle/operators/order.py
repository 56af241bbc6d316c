"""Ranks and quantiles over a whole order, without gathering an order in one task.

Equal values are counted first. The values' range is then cut into runs by their size alone, so that
every plan and every rerun cuts alike: into equal steps between the smallest and the largest value,
and into steps of a power of two by the distance from zero and from both ends. A window holds one
run; only one sum a run is brought together. Values whose runs stay large are those packed into one
step in 4096 of the range and one in 256 of every power of two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = 4096  # most equal steps of the range
FINE = 256  # most steps of a power of two
ROWS = 1024  # distinct values of a key for each step


KEY = ["__h", "__k"]  # the hash of a key goes first: it is what sorts compare
RUN = ["__hr", "__k", "__r"]


def settled(df: DataFrame) -> DataFrame:
    """The rows, worked out once: checkpointed if the session has a checkpoint folder, else cached.

    For tables that a plan uses many times over.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def _log_step(distance: Column, fine: Column) -> Column:
    """A step that grows with the size of a distance, negative ones turned round; 0 at 0."""
    size = F.greatest(F.abs(distance), F.lit(1e-300))
    return (F.signum(distance) * F.floor(fine * (F.log2(size) + 1000))).cast("long")


def _runs(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds __r, which never falls while __v grows within __k; NaN, the largest, has a run to itself.

    The fewer values a key has, the coarser its steps; one with less than ROWS is one run.
    """
    v = F.col("__v")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    ends = counts.groupBy(*KEY).agg(F.min(finite).alias("__low"), F.max(finite).alias("__high"), F.floor(F.count("*") / ROWS).alias("__d"))
    half = F.col("__high") / 2 - F.col("__low") / 2  # the range itself may overflow
    steps, fine = F.least(F.lit(STEPS), F.col("__d")), F.least(F.lit(FINE), F.col("__d"))
    even = F.when(half > 0, F.floor(steps * ((v / 2 - F.col("__low") / 2) / half)))
    parts = [even, _log_step(v / 2, fine), _log_step(v / 2 - F.col("__low") / 2, fine), _log_step(v / 2 - F.col("__high") / 2, fine)]
    # infinities and NaN lie outside all steps
    outer = F.when(F.isnan(v), 2).when(v == float("inf"), 1).when(v == float("-inf"), -1).otherwise(0)
    cut = F.struct(outer.alias("o"), *(F.when((outer == 0) & (F.col("__d") > 0), F.coalesce(p, F.lit(0))).otherwise(0).cast("long").alias(f"s{i}") for i, p in enumerate(parts)))
    # a row a key; one in all without keys
    runs = counts.join(ends if keys else F.broadcast(ends), KEY).withColumn("__r", cut).drop("__low", "__high", "__d")
    return runs.withColumn("__hr", F.xxhash64("__h", "__r"))


def _counted(df: DataFrame, value: Column, weight: Column | None, keys: Sequence[str]) -> DataFrame:
    """(__k, __v, __w): a row for each key and value that isn't null, with its rows or their weight."""
    rows = df.select((F.struct(*keys) if keys else F.struct(F.lit(0))).alias("__k"), value.cast("double").alias("__v"), *([weight.alias("__x")] if weight is not None else []))
    return rows.where("__v is not null").withColumn("__h", F.xxhash64("__k")).groupBy(*KEY, "__v").agg((F.count("*") if weight is None else F.sum("__x")).alias("__w"))


def _offsets(runs: DataFrame) -> DataFrame:
    """(__k, __r, __offset, __size, __n): the sum before each run, its own, and that of the key."""
    totals = runs.groupBy(*RUN, "__h").agg(F.sum("__w").alias("__size"))
    before = Window.partitionBy(*KEY).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*RUN, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"), "__size", F.sum("__size").over(Window.partitionBy(*KEY)).alias("__n"))


def _placed(runs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds __before, the sum over smaller values of the key, to the rows of the runs in offsets."""
    own = F.sum("__w").over(Window.partitionBy(*RUN).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1))
    return runs.join(offsets, RUN).withColumn("__before", F.col("__offset") + F.coalesce(own, F.lit(0)))


def positions(df: DataFrame, value: Column, weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(__k, __v, __w, __before, __n) for each key (a struct of keys, null ones too) and distinct value.

    __w is the number of rows with the value (or their summed weight), __before that of all smaller
    values of the key, __n that of the whole key. Null values have no row; NaN is the largest value.
    """
    runs = _runs(_counted(df, value, weight, keys), keys)
    return _placed(runs, _offsets(runs)).select("__k", "__v", "__w", "__before", "__n")


def order_statistics(df: DataFrame, value: Column, ranks: Callable[[Column], Sequence[Column]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, at): for each rank (from 0, given the key's number of values) the value there, null if there is none.

    Only runs that hold a wanted rank are sorted. Without keys there is one row, of nulls for no values.
    """
    runs = _runs(_counted(df, value, None, keys), keys)
    low, size, n = F.col("__offset"), F.col("__size"), F.col("__n")
    holds = reduce(Column.__or__, [(k >= low) & (k < low + size) for k in ranks(n)], low == 0)  # the first run carries n
    rows = _placed(runs, _offsets(runs).where(holds))
    first, last = F.col("__before"), F.col("__before") + F.col("__w")
    found = F.array(*(F.max(F.when((k >= first) & (k < last), F.col("__v"))) for k in ranks(n)))
    grouped = rows.groupBy(*KEY) if keys else rows
    out = grouped.agg(F.max("__n").alias("n"), found.alias("at"))
    return out.select("__k.*", "n", "at") if keys else out


def even_quantiles(df: DataFrame, value: Column, steps: int) -> DataFrame:
    """(n, q): one row, the array of `quantiles` at 0, 1 / steps, ..., 1; null without values.

    For many of them: the wanted ranks are looked up by arithmetic, not by an expression for each.
    """
    runs = _runs(_counted(df, value, None, ()), ())
    last = F.col("__n") - 1

    def place(k: Column) -> Column:
        return last * (k / steps)

    def wanted(low: Column, size: Column) -> Column:
        """The steps with a rank in [low, low + size) at either end."""
        near = F.sequence(F.greatest(F.lit(0), F.floor(low * steps / F.greatest(last, F.lit(1))) - 2).cast("int"), F.least(F.lit(steps), F.ceil((low + size) * steps / F.greatest(last, F.lit(1))) + 2).cast("int"))
        inside = lambda rank: (rank >= low) & (rank < low + size)
        return F.filter(near, lambda k: inside(F.floor(place(k))) | inside(F.ceil(place(k))))

    offsets = _offsets(runs).where(F.size(wanted(F.col("__offset"), F.col("__size"))) > 0)
    first, w, k = F.col("__before"), F.col("__w"), F.col("__step")
    found = _placed(runs, offsets).select("__v", "__n", "__before", "__w", F.explode(wanted(first, w)).alias("__step"))
    at = lambda rank: F.max(F.when((rank >= first) & (rank < first + w), F.col("__v")))
    ends = found.groupBy("__step", "__n").agg(at(F.floor(place(k))).alias("a"), at(F.ceil(place(k))).alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(place(k)) - place(k)) * F.col("a") + (place(k) - F.floor(place(k))) * F.col("b"))
    rows = ends.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n"), F.sort_array(F.collect_list(F.struct("__step", q.alias("q")))).alias("rows"))  # steps + 1 rows
    return rows.select("n", F.when(F.col("n") > 0, F.col("rows")["q"]).alias("q"))


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, q): the array of quantiles by linear interpolation at (n - 1) * share; null without values."""
    places = lambda n: [(n - 1) * F.lit(float(s)) for s in shares]
    ends = order_statistics(df, value, lambda n: [f(p) for p in places(n) for f in (F.floor, F.ceil)], keys)

    def at(i: int, place: Column) -> Column:
        a, b = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        return F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    q = F.array(*(at(i, p) for i, p in enumerate(places(F.col("n")))))
    return ends.select(*keys, "n", F.when(F.col("n") > 0, q).alias("q"))
