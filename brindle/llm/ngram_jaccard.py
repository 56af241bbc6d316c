"""N-gram Jaccard self-join with count vectors: exact, without comparing all pairs.

Words are hashed into n-word shingles; a document's set holds its distinct ones. Two documents link
when their sets' Jaccard similarity reaches a threshold; `jaccard_components` labels each document
with the smallest doc_id that it can reach by links.

Method. Shingles are hashed into groups, and a document is a point of group counts. The overlap of
two sets is at most the summed minima of their points, so an R-tree whose nodes hold the largest
count of each group (`CountTree`) finds all partners whose bound suffices. Over a whole table this
alone prunes little: random points differ by about the square root of the counts, which for long
texts is less than the threshold lets pass unless the groups are many, and then a node's largest
counts say little. So the tree searches inside blocks that lose no link:
sets of at least the threshold's similarity differ in at most d shingles, so of more than d groups
at least one is the same in both, and a block is one group's content.

1. Documents with equal sets become one node, before anything is dealt out.
2. In each block every node is compared with the block's first; the links give components.
3. Blocks that still hold several components are searched with the tree for pairs across
   components; those that pass the bound are verified on their shingles, and components follow
   from all links. So no link between different components is lost, and a large group of similar
   documents is never expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import U64, Scratch, Words, mix, sieved, text_slices, tidy
from brindle.llm.graph import components

GROUPS = 64  # coordinates of a small set's point; larger sets have more, about twice their size
BAND = 1.5  # ratio of the set sizes at which the number of block groups changes
CHUNK = 2048  # nodes of a block that are compared at a time
_MASK = (1 << 64) - 1


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles (all its words, if fewer).

    A-Z is lower-cased. The sets stand for the shingles themselves: two different shingles of a
    pair of texts share a hash with probability below 1e-12 for texts of a thousand words.
    """
    words = Words(texts, lower=True)
    windows, out = words.windows(n), []
    for k in range(len(texts)):
        a, b = words.first[k], words.first[k + 1]
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            whole = int(b - a)  # fewer words: the sequence as one, apart from n-word shingles
            for h in words.hashes[a:b]:
                whole = (whole * 0x9E3779B97F4A7C15 + int(h)) & _MASK
            out.append(mix(np.array([whole], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


class Bands:
    """For pairs whose smaller set has low..high shingles: how many differences, so how many groups."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * BAND)))
        #: |A - B| + |B - A| <= (100 - percent) / percent * |A| if J(A, B) >= percent / 100 and |A| <= |B|
        self.differ = [(100 - percent) * (high - 1) // percent for high in self.low[1:]]

    def of(self, size: int) -> range:
        """The bands in which a set of this size may meet another: as the smaller, or as the larger."""
        least = -(-self.percent * size // 100)
        return range(int(np.searchsorted(self.low, least, "right")) - 1, int(np.searchsorted(self.low, size, "right")))


def block_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """One key for each group of a set: equal groups give equal keys. Sets that must be equal to link give none."""
    keys = []
    if not len(shingles):
        return np.empty(0, U64)
    scrambled = np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles ^ U64(0x5851F42D4C957F2D)))])
    for band in bands.of(len(shingles)):
        d = bands.differ[band]
        if d == 0:
            continue
        m = math.ceil(1.15 * (d + 1)) + 2
        # groups are ranges of the hash, so they lie together in the sorted set
        group = (shingles >> U64(32)) * U64(m) >> U64(32)
        at = np.searchsorted(group, np.arange(m + 1, dtype=U64))
        content = scrambled[at[1:]] - scrambled[at[:-1]]
        kept = at[1:] > at[:-1]
        if kept.sum() <= d:  # too few groups with content: only with the empty ones is one of them equal
            kept[:] = True
        label = np.flatnonzero(kept).astype(U64) + U64(band << 40)
        keys.append(mix(content[kept] ^ mix(label)))
    return np.concatenate(keys) if keys else np.empty(0, U64)


def _groups(size: int) -> int:
    return max(GROUPS, 1 << (3 * size // 2).bit_length())


def points(shingles: np.ndarray) -> bytes:
    """Counts of the shingles' groups, packed: two bits a count, then (group, count) of those above 3.

    Groups are by low bits, apart from those of the blocks. With more groups for larger sets the
    counts stay small, and the bound tight. The number is a power of two, so a point with twice as
    many folds to one with fewer.
    """
    groups = _groups(len(shingles))
    counts = np.bincount((shingles & U64(groups - 1)).astype(np.int64), minlength=groups)
    low = np.minimum(counts, 3).astype(np.uint8)
    above = np.flatnonzero(counts > 3)
    return np.packbits(low & 1).tobytes() + np.packbits(low >> 1).tobytes() + np.stack([above, counts[above]]).astype(np.uint32).tobytes()


def unpacked(point: bytes, size: int) -> np.ndarray:
    groups = _groups(size)
    low, high = np.unpackbits(np.frombuffer(point, np.uint8, groups // 4)).reshape(2, groups)
    counts = (low + 2 * high).astype(np.int32)
    above, real = np.frombuffer(point, np.uint32, offset=groups // 4).reshape(2, -1)
    counts[above] = real
    return counts


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of the same, namely the least, number of groups."""
    groups = min(map(len, points))
    return np.stack([p.reshape(-1, groups).sum(0) for p in points])


class CountTree:
    """R-tree over points of counts, bulk-loaded by sort-tile; a node holds its points' largest counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, fanout: int = 16):
        self.counts, self.sizes, self.labels, self.fanout = counts, sizes, labels, fanout
        self.order = np.lexsort((counts[:, 0], labels, sizes))
        tops, least, first = [counts[self.order]], [sizes[self.order]], [labels[self.order]]
        same = [labels[self.order]]
        while len(tops[-1]) > fanout:
            cut = np.arange(0, len(tops[-1]), fanout)
            tops.append(np.maximum.reduceat(tops[-1], cut))
            least.append(np.minimum.reduceat(least[-1], cut))
            first.append(np.minimum.reduceat(first[-1], cut))
            same.append(np.maximum.reduceat(same[-1], cut))
        self.tops, self.least, self.first, self.same = tops, least, first, same

    def search(self, point: np.ndarray, size: int, label: int, percent: int) -> np.ndarray:
        """Rows of other labels whose overlap with the point may reach the threshold."""
        nodes = np.arange(len(self.tops[-1]))
        for level in range(len(self.tops) - 1, -1, -1):
            own = (self.first[level][nodes] == label) & (self.same[level][nodes] == label)
            nodes = nodes[~own]
            bound = np.minimum(self.tops[level][nodes], point).sum(1)
            # J >= t exactly if (100 + percent) * overlap >= percent * (size + other size)
            nodes = nodes[(100 + percent) * bound >= percent * (size + self.least[level][nodes])]
            if level:
                nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = nodes[nodes < len(self.tops[level - 1])]
        return self.order[nodes]


def _features(n: int, percent: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                rows = []
                for s in shingle_sets([t or b"" for t in texts], n):
                    both = mix(s), mix(s ^ U64(0xA0761D6478BD642F))
                    ids = [int(x.sum(dtype=U64)) - (1 << 63) for x in both]
                    rows.append((len(s), *ids, points(s) if len(s) else b"", block_keys(s, bands).view(np.int64)))
                size, s1, s2, point, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col)[a:b].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(point, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "s1", "s2", "point", "keys"],
                )
        tidy()

    return run


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(s) + len(t)
    if (100 + percent) * min(len(s), len(t)) < percent * both:
        return False
    together = np.concatenate([s, t])
    together.sort()
    return (100 + percent) * int((together[1:] == together[:-1]).sum()) >= percent * both


def _verified(n: int, percent: int):
    """For rows (b, part, own, a, text) sorted so that b's own row comes first in its part: the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            b_s, parts, own, a_s = (batch.column(c).to_pylist() for c in ("b", "part", "own", "a"))
            for lo, _, texts in text_slices(batch, "text"):
                left, right = [], []
                for k, s in enumerate(shingle_sets([t or b"" for t in texts], n), lo):
                    if at != (b_s[k], parts[k]):
                        at, centres = (b_s[k], parts[k]), []
                    if own[k]:
                        centres.append(s)  # rows that share the id each bring their set
                    elif any(_linked(s, c, percent) for c in centres):
                        left.append(a_s[k])
                        right.append(b_s[k])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        tidy()

    return run


def verify_pairs(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose documents link. docs: (id, text) with distinct ids.

    Each document goes to its partners b; a b with many partners is dealt to parts of about
    5,000 of them, each with a copy of b.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 5000).cast("long").alias("parts"))
    dealt = pairs.join(counts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(False).alias("own"), F.col("a").alias("id"))
    centres = counts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"), F.col("b").alias("id"))
    roles = dealt.union(centres)
    rows = sieved(docs, "id", roles.select("id")).join(roles, "id").select("b", "part", "own", F.col("id").alias("a"), "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("own"))
    return rows.mapInArrow(_verified(n, percent), "a long, b long")


def _search_blocks(percent: int):
    """For rows (key, i, j, chunk, id, label, size, point) sorted by key, i, j: pairs that pass the bound."""

    def found(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        target = [r for r in rows if r[3] == i]
        at = folded([unpacked(r[7], r[6]) for r in rows])
        counts = at[[k for k, r in enumerate(rows) if r[3] == i]]
        sizes, labels = np.array([r[6] for r in target]), np.array([r[5] for r in target])
        tree = CountTree(counts, sizes, labels) if len(target) else None
        for point, r in zip(at, rows):
            if r[3] == j and tree:
                for k in tree.search(point, r[6], r[5], percent):
                    a, b = target[k][4], r[4]
                    if i != j or a > b:
                        yield max(a, b), min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pairs: set) -> pa.RecordBatch:
            left, right = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        group, pairs = [], set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:3] != row[:3]:
                    pairs.update(found(group) if len(group) > 1 else ())
                    group = []
                group.append(row)
            if len(pairs) > 50_000:
                yield emit(pairs)
                pairs = set()
        if len(group) > 1:
            pairs.update(found(group))
        yield emit(pairs)

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs, in place of other columns.

    Documents link if 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles; see
    `shingle_sets`. Null and empty texts have no shingles, link with nothing and are their own
    component. Rows that share a doc_id count as one document (of all their sets). A null doc_id
    links nothing and stays null. Ties and repeated rows need no rule: components don't depend on
    order. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = scratch.table(
        base.mapInArrow(_features(n, percent, "doc_id", "text"), "doc_id long, n_shingles long, s1 long, s2 long, point binary, keys array<long>"), "features"
    )
    real = features.where("n_shingles > 0 and doc_id is not null")
    # 1. equal sets: one node each; partial sums collapse a large group before it is dealt out
    nodes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("point").alias("point"), F.first("keys").alias("keys"))
    blocks = nodes.select("id", "size", F.explode("keys").alias("key"))
    own = F.count("*").over(_by("key")), F.min("id").over(_by("key"))
    blocks = blocks.select("id", "key", own[0].alias("members"), own[1].alias("first")).where("members > 1")
    blocks = scratch.table(blocks, "blocks")
    equal = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("b"))
    copies = real.join(equal, ["s1", "s2"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    copies = scratch.table(copies, "copies")
    sizes = scratch.table(features.select("doc_id", "n_shingles"), "sizes")
    # 2. each node with the first of its blocks
    distinct_docs = base.where("doc_id is not null").withColumnRenamed("doc_id", "id")
    stars = blocks.where("id <> first").groupBy("id").agg(F.min("first").alias("b")).select(F.col("id").alias("a"), "b")
    links = scratch.table(verify_pairs(distinct_docs, stars, n, percent), "links")
    labels = components(links, scratch, "stars")
    # 3. pairs across the components of a block
    def labelled(df):
        return df.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    mixed = labelled(blocks).select("id", "key", "label", "members")
    spread = mixed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
    rows = mixed.join(spread, "key").withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("long"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    kept_points = real.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "point")
    rows = rows.join(kept_points, "id").select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "label", F.col("size").cast("long"), "point")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = rows.mapInArrow(_search_blocks(percent), "a long, b long").distinct()
    across = scratch.table(across.join(stars, ["a", "b"], "left_anti"), "across")
    scratch.drop("features")
    more = scratch.table(verify_pairs(distinct_docs, across, n, percent), "more")
    final = components(links.union(more).union(copies), scratch, "all")
    out = sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def near_duplicates_removed(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each component keeps that with the smallest id.

    Rows that repeat the kept document's id stay as they are; rows with a null id stay.
    """
    found = jaccard_components(docs, n, percent, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
