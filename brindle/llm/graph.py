"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch


def _rank(c: str):
    """Nodes in a fixed random order: contraction then takes few rounds on long paths too."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of edges (a, b); label is the component's smallest node.

    In each round every node hooks onto its neighbour (or itself) of lowest random rank, and edges
    are redrawn between the hooks; the number of edges falls by a constant factor a round. Edges
    and hooks are tables in the scratch folder. All steps are joins and aggregates with partial
    sums, so a node with very many edges is no bottleneck. Self-loops and nulls are ignored.
    """
    edge = scratch.table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0"
    )
    hooks: list[DataFrame] = []
    while not edge.isEmpty():
        k = len(hooks)
        both = edge.union(edge.select("b", "a"))
        hook = scratch.table(
            both.groupBy("a").agg(F.min(_rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", _rank("a"))["id"].alias("to")),
            f"{name}-h{k}",
        )
        hooks.append(hook)
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edge = scratch.table(
            edge.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            f"{name}-e{k + 1}",
        )
        scratch.drop(f"{name}-e{k}")
    if not hooks:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(so_far: DataFrame, hook: DataFrame) -> DataFrame:
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        return so_far.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))

    roots = reduce(follow, hooks[1:], hooks[0])
    least = roots.groupBy("to").agg(F.min("node").alias("label"))
    return scratch.table(roots.join(least, "to").select("node", "label"), f"{name}-labels")
