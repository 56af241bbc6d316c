"""Nearest neighbours by a forest of random-projection trees, with exact scores at the end.

A tree splits vectors by random hyperplanes (through the midpoint of two drawn vectors) until a
leaf holds few of the sample it is grown on. Every row of the table is then put into its leaf of
each tree. A query searches all trees through one priority queue: of the subtrees not yet
entered, that comes first whose hyperplanes the query misses by the least sum of squares, whichever
tree it is in, until the leaves found hold enough of the sample. Leaves are joined with their rows, and candidates are scored exactly, in double precision,
leaf by leaf; each leaf passes on its best, and a query keeps the best of all.

Bounds. The forest is grown on SAMPLE rows at most, so it is of fixed size and can be sent to all
tasks. A leaf's rows are dealt into chunks of CHUNK rows, and queries go to all chunks, so a leaf
that holds any share of the rows (equal vectors can't be split) is work for many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 20_000
TREES = 16
LEAF = 200  # sample rows
SEARCH = 0.06  # share of the sample that a query's leaves hold in each tree, on average
LEAST = 8000  # or so many of its rows in all trees together, if that is more
CHUNK = 4096


@dataclass
class Tree:
    """Node k splits by normals[k] . x > offsets[k] into children[k]; a child below 0 is leaf -child - 1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaf_sizes: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
        normals, offsets, children, sizes = [], [], [], []

        def split(at: np.ndarray) -> int:
            left = None
            if len(at) > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(at, 2, replace=False)]
                    normal = a - b
                    if not (length := np.linalg.norm(normal)):
                        continue
                    normal = normal / length
                    side = sample[at] @ normal
                    offset = float(np.median(side)) if rng.random() < 0.5 else float(normal @ (a + b) / 2)
                    left = side > offset
                    if 0.1 < left.mean() < 0.9:
                        break
                if left is not None and not 0 < left.mean() < 1:
                    left = None
            if left is None:
                sizes.append(len(at))
                return -len(sizes)
            k = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            children[k] = [split(at[~left]), split(at[left])]
            return k

        split(np.arange(len(sample)))
        dim = sample.shape[1]
        return cls(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's leaf."""
        node = np.zeros(len(vectors), np.int64) if len(self.normals) else np.full(len(vectors), -1)
        while (on := np.flatnonzero(node >= 0)).size:
            k = node[on]
            side = (vectors[on] * self.normals[k]).sum(1) > self.offsets[k]
            node[on] = self.children[k, side.astype(np.int64)]
        return -node - 1


class Forest:
    def __init__(self, trees: list[Tree], wanted: int):
        self.trees, self.wanted = trees, wanted

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, search: float = SEARCH, least: int = LEAST, seed: int = 1) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([Tree.grow(sample, leaf, rng) for _ in range(trees)], max(least, int(search * len(sample) * trees)))

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(tree, leaf) by one queue over all trees, until the leaves hold `wanted` sample rows, with repeats."""
        margins = [t.normals @ query - t.offsets for t in self.trees]
        queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < self.wanted:
            priority, k, node = heapq.heappop(queue)
            tree = self.trees[k]
            while node >= 0:
                m = margins[k][node]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (priority + m * m, k, int(tree.children[node, far])))
                node = int(tree.children[node, near])
            found.append((k, -node - 1))
            held += int(tree.leaf_sizes[-node - 1])
        return found


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: no nulls, no non-finite components, not all zero; ids not null."""
    v = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] != "array<float>":  # floats are sent as they are, and widened where they are used
        v = v.cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(F.coalesce(x.cast("double"), F.lit(0.0))) < float("inf")) & ~F.isnan(F.coalesce(x.cast("double"), F.lit(0.0)))) & F.exists(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE, trees: int = TREES, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all rows but its own, by inner product.

    is_query: a column of vec_id. Ties go to the smaller vec_id. Rows that don't take part (see
    `usable`) are neither queries nor candidates, and vectors of another length than most are left
    out. Rows that repeat an id are one candidate each, told apart by their score. With fewer than
    k candidates found near, the query's leaves grow until all are searched. Empty tables give
    empty results.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    share = min(1.0, sample_rows / max(1, vectors.count()))
    drawn = rows.sample(False, share, seed).select("vector").toPandas()["vector"]  # about sample_rows, of all parts of the table
    lengths = drawn.map(len)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(drawn):
        drawn = rows.limit(sample_rows).select("vector").toPandas()["vector"]  # a small table, or a rare draw
        lengths = drawn.map(len)
        if not len(drawn):
            return spark.createDataFrame([], schema)
    dim = int(lengths.mode()[0])
    forest = Forest.grow(np.stack([np.asarray(v, np.float64) for v in drawn if len(v) == dim]), trees, seed=seed)
    rows = rows.where(F.size("vector") == dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            n = len(x)
            leaf = np.concatenate([t.leaves(x) for t in forest.trees])
            tree = np.repeat(np.arange(len(forest.trees)), n)
            again = pa.array(np.tile(np.arange(n), len(forest.trees)))
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), batch.column("vec_id").take(again), batch.column("vector").take(again)], names=["tree", "leaf", "vec_id", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for a in range(0, len(x), 200):
                hits = [forest.search(q) for q in x[a : a + 200]]
                row = pa.array(np.repeat(np.arange(a, a + len(hits)), [len(h) for h in hits]))
                tree, leaf = zip(*(p for h in hits for p in h)) if hits else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), batch.column("vec_id").take(row), batch.column("vector").take(row)], names=["tree", "leaf", "vec_id", "vector"])

    kinds = f"tree int, leaf int, vec_id long, vector {dict(rows.dtypes)['vector']}"
    members = rows.mapInArrow(place, kinds)
    # chunks: a leaf's rows are spread over as many as it needs
    counts = members.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = members.join(F.broadcast(counts), ["tree", "leaf"])  # as many rows as the forest has leaves
    members = members.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
    queries = rows.where(is_query).mapInArrow(visit, kinds)
    queries = queries.join(F.broadcast(counts), ["tree", "leaf"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def best(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((3, 0))]
        if len(queries) and len(members):
            ids, x = members["vec_id"].to_numpy(), np.stack(members["vector"]).astype(np.float64)
            for a in range(0, len(queries), 200):
                part = queries.iloc[a : a + 200]
                own, q = part["vec_id"].to_numpy(), np.stack(part["vector"]).astype(np.float64)
                # rough products choose with room to spare, exact ones decide
                rough = q @ x.T
                rough[own[:, None] == ids[None, :]] = -np.inf
                top = min(k, len(ids))
                edge = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top]
                with np.errstate(invalid="ignore"):
                    r, c = np.nonzero((rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (rough > -np.inf))
                score = np.concatenate([np.empty(0), *((q[r[i : i + 20_000]] * x[c[i : i + 20_000]]).sum(1) for i in range(0, len(r), 20_000))])
                # equal vectors tie in great numbers: of these, too, only k can be needed
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                first = np.searchsorted(r, r)
                keep = np.arange(len(r)) - first < k
                out.append(np.stack([own[r[keep]].view(np.float64), ids[c[keep]].view(np.float64), score[keep]]))
        q_ids, v_ids, score = np.concatenate(out, 1)
        return pd.DataFrame({"query_id": q_ids.view(np.int64), "vec_id": v_ids.view(np.int64), "score": score})

    found = queries.groupBy("tree", "leaf", "chunk").cogroup(members.groupBy("tree", "leaf", "chunk")).applyInPandas(best, "query_id long, vec_id long, score double")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
