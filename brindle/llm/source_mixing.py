"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Each source gets its weight's share of `epochs` times all words, at most `most` times its
own size; what that frees is shared out anew by weight until no source exceeds its cap.

Schedule. Slot i has the point frac((i + 1/2) * golden ratio). The sources' shares cut the unit
interval, and the source on whose piece the point falls has the slot; after any number of slots
each source's count is within a few of its share. A source's slots are ranked in order. Its
documents, shuffled by a seeded hash, form one stream of words (repeated up to `most` times), cut
into blocks of the same number of words for all sources; the slot of rank r takes block r. So the
points decide how many words a source brings: its slots' blocks, the last trimmed where its stream
ends. A source whose piece no point hits gets one slot more, after all others, trimmed to its target.

Every step is a join, aggregate or prefix sum over ranges; a source may hold any share of the rows.
The table of sources is joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.common import WORD, Scratch, n_words

GOLDEN = 0.6180339887498949
BLOCK = 8192  # words of a slot
SLOTS = 1 << 17  # slots at least, with smaller blocks if need be: a source's count is off its share by a few of them


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, scratch: Scratch, name: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one in the global order.

    Rows are range-partitioned, so a part is a run of the order; only one sum a part is brought
    together. No group of rows goes to one task. `order` must tell rows apart for a fixed result.
    """
    parts = scratch.table(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    totals = parts.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__offset") + F.col("__own"))
        .drop("__part", "__own", "__offset")
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float, most: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, source_size).

    Sources take the weights in turn, by code point with null last. Sorted by cap / weight, the
    capped sources are a prefix: a source is capped if, all before it capped, its share of the rest
    exceeds its cap. The prefix sums give each source's share at once, without rounds.
    """
    ranked = prefix_sums(sizes.withColumn("__one", F.lit(1).cast("long")).withColumn("__null", F.col("source").isNull()), ["__null", "source"], "__one", "__rank", scratch, "ranks")
    picked = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = ranked.select("source", "source_size", picked.alias("weight"), "__rank")
    rows = rows.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    sums = prefix_sums(rows, ["ratio", "__rank"], "cap", "caps_before", scratch, "caps")
    sums = prefix_sums(sums, ["ratio", "__rank"], "weight", "weight_before", scratch, "weights")
    total = rows.agg(F.sum(F.col("source_size")).alias("all_size"), F.sum("weight").alias("all_weight"))
    sums = sums.crossJoin(F.broadcast(total))  # one row
    # the level (target / weight) of all from this source on, if those before it are capped
    level = (F.col("all_size") * float(epochs) - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    sums = sums.withColumn("level", level).withColumn("free", F.col("ratio") >= F.col("level"))
    lowest = sums.where("free").agg(F.max("level").alias("final"))
    # from the first free source on, all are free and levels only fall: the first has the largest
    out = sums.crossJoin(F.broadcast(lowest))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return out.select("source", "source_size", "weight", target.alias("target"), F.col("__rank").alias("source_rank"))


def schedule(goals: DataFrame, slots: int, scratch: Scratch, spark: SparkSession) -> DataFrame:
    """(slot, source_rank, rank): the sources' slots in order; rank counts a source's own from 0."""
    goals = scratch.table(goals.where("target > 0"), "goals")
    cumulative = prefix_sums(goals, ["source_rank"], "target", "low", scratch, "cumulative")
    total = goals.agg(F.sum("target").alias("all"))
    pieces = cumulative.crossJoin(F.broadcast(total)).select("source_rank", (F.col("low") / F.col("all")).alias("low"), ((F.col("low") + F.col("target")) / F.col("all")).alias("high"))
    cells = max(64, goals.count())
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("long")
    pieces = pieces.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    at = (F.col("slot") + 0.5) * GOLDEN
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", at - F.floor(at)).withColumn("cell", cell(F.col("point")))
    # rounding may leave the last end below 1; the last piece then takes those points
    last = pieces.agg(F.max("source_rank").alias("last"))
    hit = points.join(pieces.crossJoin(F.broadcast(last)), "cell").where("point >= low and (point < high or source_rank = last)").select("slot", "source_rank")
    missed = goals.join(hit.select("source_rank").distinct(), "source_rank", "left_anti").select((F.lit(slots) + F.col("source_rank")).alias("slot"), "source_rank")
    every = scratch.table(hit.union(missed).withColumn("__one", F.lit(1).cast("long")), "slots")
    ordered = scratch.table(prefix_sums(every, ["source_rank", "slot"], "__one", "position", scratch, "positions"), "ranked")
    first = ordered.groupBy("source_rank").agg(F.min("position").alias("first"), F.count("*").alias("n_slots"))
    return ordered.join(F.broadcast(first) if cells <= 100_000 else first, "source_rank").select("slot", "source_rank", (F.col("position") - F.col("first")).alias("rank"), "n_slots")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    epochs: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 42,
    scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, slices).

    documents: row, id, source, shuffle, size, source_size, target, for each row of docs; row tells rows
    apart. slices: row, slot, epoch, start, words: the mix takes `words` words from word `start` of
    the document in that slot; in order of slot, epoch and position they are the mix. The slices of
    a source add up to its slots' blocks; those of a document to `most` times its size at most.

    A null text has size 0; rows with a null source form a source, the last in order. Repeated ids
    are separate documents. Sources without words have target 0. An empty table gives empty ones.
    The result depends on the rows and the seed alone.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("shuffle"))
    # equal rows may follow in any order: they are the same
    rows = scratch.table(rows, "rows")
    sizes = scratch.table(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goals = scratch.table(targets(sizes, weights, epochs, most, scratch), "targets")
    few = goals.count() <= 100_000  # a source is some 100 bytes: beyond, a shuffle join
    hint = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    known = rows.join(hint(goals.withColumnRenamed("source", "s")), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    placed = prefix_sums(known, ["source_rank", "shuffle", "id"], "size", "position", scratch, "placed")
    placed = placed.withColumn("row", F.monotonically_increasing_id())
    placed = scratch.table(placed, "documents")
    begin = placed.groupBy("source_rank").agg(F.min("position").alias("begin"))
    streams = placed.join(hint(begin), "source_rank").withColumn("from", F.col("position") - F.col("begin"))
    words = goals.agg(F.sum("target")).first()[0] or 0
    block = max(1, min(BLOCK, int(words // SLOTS)))
    slots = max(1, round(words / block))
    plan = scratch.table(schedule(goals, slots, scratch, spark), "plan")
    counts = plan.groupBy("source_rank").agg(F.max("n_slots").alias("n_slots"), F.min("slot").alias("first_slot"))
    # block r of a source is the words [r * block, (r + 1) * block) of its repeated stream
    missed = F.when(F.col("first_slot") >= slots, F.greatest(F.round("target"), F.lit(1))).otherwise(F.lit(float(block)) * F.col("n_slots"))
    whole = F.least(F.lit(block) * F.col("n_slots"), missed.cast("long"), F.lit(int(most)) * F.col("source_size"))
    streams = streams.where("size > 0").join(hint(counts), "source_rank").withColumn("take", whole)
    streams = streams.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1)))).withColumn("a", F.col("from") + F.col("epoch") * F.col("source_size"))
    streams = streams.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take"))).where("a < b")
    streams = streams.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    streams = streams.withColumn("lo", F.greatest("a", F.expr(f"rank * {block}"))).withColumn("hi", F.least("b", F.expr(f"(rank + 1) * {block}")))
    joined = streams.select("row", "source_rank", "rank", "epoch", "a", "lo", "hi").join(plan.select("source_rank", "rank", "slot"), ["source_rank", "rank"])
    slices = joined.select("row", "slot", "epoch", (F.col("lo") - F.col("a")).alias("start"), (F.col("hi") - F.col("lo")).alias("words"))
    documents = placed.select("row", F.col("id").alias(id_col), "source", "shuffle", "size", "source_size", "target")
    return documents, slices


def taken(documents: DataFrame, slices: DataFrame) -> DataFrame:
    """documents with `taken`: the words that the mix takes of each, repeats counted."""
    sums = slices.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("row")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix's documents, with all columns of docs: a row for each pass over a document.

    A document that the mix takes twice comes twice, one it takes in part with that part of its
    words (joined by one space), one it doesn't take not at all. The order of slots isn't kept: rows
    are as many as the mix's, in any order. Rows without words have no part in a mix and go.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    seed = options.get("seed", 42)
    documents, slices = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, scratch=scratch, **options)
    passes = slices.groupBy("row", "epoch").agg(F.min("start").alias("start"), F.sum("words").alias("words"))
    passes = passes.join(documents.select("row", F.col(id_col).alias("__id"), F.col("shuffle").alias("__key"), F.col("size").alias("__size")), "row")
    passes = passes.groupBy("__id", "__key", "__size").agg(F.collect_list(F.struct("start", "words")).alias("__passes"))
    keyed = docs.withColumn("__own", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    # equal rows are one here; what the mix takes of each is in the list
    rows = keyed.join(passes, (F.col("__own") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))).dropDuplicates(["__id", "__key"])
    rows = rows.withColumn("__pass", F.explode("__passes"))
    part = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), (F.col("__pass.start") + 1).cast("int"), F.col("__pass.words").cast("int")), " ")
    return rows.withColumn(text_col, F.when(F.col("__pass.words") == F.col("__size"), F.col(text_col)).otherwise(part)).select(*docs.columns)
