"""Removal of long word sequences that occur in an earlier document, by super-k-mers.

A window is `width` consecutive words of a document. A window of which the same word sequence also
starts in a document with a smaller id is removed: each word that such a window covers goes.

Method. A window's minimiser is the sub-sequence of SUB words with the lowest hash. Consecutive
windows mostly share it, so they travel as one packed string of words (a super-k-mer) to the bucket
of the minimiser's hash. All occurrences of a sequence have the same minimiser, so they meet in one
bucket, where windows are sorted by hash. Windows are equal if the 64-bit hashes of all their words are.

Skew. Before strings are sent, a map task settles repeats among the documents it holds: only the
occurrence in the smallest document is sent, all others are known to be repeats. So however often a
passage occurs, a bucket gets it once per batch of about 8 MB of text. Sub-sequences that would be the
minimiser of over a hundredth of a sample's windows come last in the order of minimisers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import U64, Words, text_slices, tidy

SUB = 3
BATCH = 8_000_000
SAMPLE = 5000  # rows in which common minimisers are sought
HEAVY = 0.01
_SPANS = "bucket int, doc_id long, packed binary, spans binary"


def _repeated(words: Words, at: np.ndarray, hashes: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """For each window (word index `at`): is there an equal one in a document with a smaller id?

    Sorts by hash; windows that share a hash are compared word by word.
    """
    order = np.argsort(hashes)
    h = hashes[order]
    out = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    if not same.any():
        return out
    # only windows whose hash occurs twice go on
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, h = order[twice], h[twice]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(begin, len(h)))
    d, w = docs[order], at[order]
    head = np.repeat(w[begin], size)
    differ = np.zeros(len(h), bool)
    for j in range(width):
        differ |= words.hashes[w + j] != words.hashes[head + j]
    out[order] = d > np.repeat(np.minimum.reduceat(d, begin), size)
    run = np.repeat(np.arange(len(begin)), size)
    for r in np.unique(run[differ]):  # different sequences of one hash: hardly ever
        first: dict[bytes, int] = {}
        for k in np.flatnonzero(run == r):
            key = words.hashes[w[k] : w[k] + width].tobytes()
            first[key] = min(first.get(key, d[k]), d[k])
        for k in np.flatnonzero(run == r):
            out[order[k]] = first[words.hashes[w[k] : w[k] + width].tobytes()] < d[k]
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covering(valid: np.ndarray, hashes: np.ndarray, width: int, common: np.ndarray) -> np.ndarray:
    """For each window: the position of its minimiser (of the last, if several are equally low), a common one only if it must be."""
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = np.where(common[at] == hashes, hashes | U64(1 << 63), hashes >> U64(1))
    else:
        hashes = hashes >> U64(1)
    n = len(valid)
    subs = width - SUB + 1
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, subs):
        lower = hashes[j : n + j] <= best
        best[lower] = hashes[j : n + j][lower]
        at[lower] = j
    return at + np.arange(n)


def _heavy(width: int):
    """Rows (hash, windows, of): a batch's minimisers that a thousandth of its windows have, and how many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch, "text", BATCH):
                words = Words([t or b"" for t in texts])
                sub = words.windows(SUB, seed=7)
                n = len(words.hashes) - width + 1
                if n <= 0:
                    continue
                found, counts = np.unique(sub[_covering(np.ones(n, bool), sub, width, np.empty(0, U64))], return_counts=True)
                often = counts * 1000 >= n
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often])], names=["hash", "windows"])

    return run


def common_minimisers(docs: DataFrame, width: int, text_col: str, sample_rows: int = SAMPLE) -> np.ndarray:
    """Sorted hashes that would be the minimiser of over HEAVY of a sample's windows: a thousand at most.

    They serve as minimisers only of windows that hold no other, so no bucket gathers a constant
    share of the corpus. Any choice gives the same result, as all tasks make the same.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    found = docs.select(F.col(text_col).alias("text")).sample(share, 5).mapInArrow(_heavy(width), "hash long, windows long")
    sums = found.groupBy("hash").agg(F.sum("windows").alias("windows")).toPandas()  # a thousand for each batch of BATCH bytes of the sample
    heavy = sums["hash"][sums["windows"] > HEAVY * max(1, sums["windows"].sum())]
    return np.sort(heavy.to_numpy(np.int64).view(U64))


def _route(width: int, buckets: int, most: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            ids = np.array([r[0] for r in rows], np.int64)
            words = Words([r[1] for r in rows])
            hashes = words.windows(width)
            if not len(hashes):
                return
            doc = np.repeat(np.arange(len(rows)), np.diff(words.first))
            valid = doc[: len(hashes)] == doc[width - 1 :]
            repeated = np.zeros(len(hashes), bool)
            at = np.flatnonzero(valid)
            repeated[at] = _repeated(words, at, hashes[at], ids[doc[at]], width)
            # runs cross into the next document only over invalid windows, which aren't repeated
            starts, ends = _runs(repeated)
            own = doc[starts]
            local = np.stack([starts - words.first[own], ends - words.first[own] + width - 1], 1)
            sub = words.windows(SUB, seed=7)
            sent = valid & ~repeated
            minimiser = _covering(valid, sub, width, common)
            # a super-k-mer: consecutive sent windows of a document with one minimiser
            breaks = np.concatenate([[True], (minimiser[1:] != minimiser[:-1]) | ~sent[:-1]]) & sent
            first = np.flatnonzero(breaks)
            stop = sent & np.concatenate([breaks[1:] | ~sent[1:], [True]])
            last = np.flatnonzero(stop)
            bucket = (sub[minimiser[first]] % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            plain = words.data.translate(_TO_SPACE)
            wide = np.concatenate([[0], np.cumsum(words.starts[1:] - words.ends[:-1] != 1), [0]])  # gaps of more than one byte so far
            out = []
            for part in np.split(order, cut) if len(order) else []:
                a, b = first[part], last[part] + width
                head = np.stack([ids[doc[a]], a - words.first[doc[a]], b - a]).astype(np.int64)
                tight = wide[b - 1] == wide[a]
                spans = zip(words.starts[a].tolist(), words.ends[b - 1].tolist(), tight.tolist(), a.tolist(), b.tolist())
                texts = [plain[lo:hi] if one else b" ".join(plain[words.starts[k] : words.ends[k]] for k in range(x, y)) for lo, hi, one, x, y in spans]
                blob = len(part).to_bytes(8, "little") + head.tobytes() + b"\n".join(texts)
                out.append((int(bucket[part[0]]), None, packer.compress(blob), None))
            for k, spans in _by_document(own, local):
                out.append((int(ids[k]) % buckets, int(ids[k]), None, spans.tobytes()))
            for a in range(0, len(out), 500):
                b_, d_, p_, s_ = zip(*out[a : a + 500])
                yield pa.RecordBatch.from_arrays([pa.array(b_, pa.int32()), pa.array(d_, pa.int64()), pa.array(p_, pa.binary()), pa.array(s_, pa.binary())], names=["bucket", "doc_id", "packed", "spans"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch, batch.schema.names[1]):
                for doc_id, text in zip(ids[a:b], texts):
                    if doc_id is not None and text:
                        if held and size + len(text) > most:
                            yield from settle(held)
                            held, size = [], 0
                        held.append((doc_id, text))
                        size += len(text)
        if held:
            yield from settle(held)
        tidy()

    return run


def _by_document(docs: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(docs, kind="stable")
    cut = np.flatnonzero(np.diff(docs[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(docs[part[0]]), spans[part].astype(np.int64)


_TO_SPACE = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def _settle_bucket(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        heads, texts, spans, owners = [], [], [], []
        for doc_id, packed, own in zip(pdf["doc_id"], pdf["packed"], pdf["spans"]):
            if packed is None:
                spans.append(np.frombuffer(own, np.int64).reshape(-1, 2))
                owners.append(np.full(len(spans[-1]), int(doc_id)))
                continue
            blob = unpack.decompress(packed)
            n = int.from_bytes(blob[:8], "little")
            heads.append(np.frombuffer(blob, np.int64, 3 * n, 8).reshape(3, n))
            texts.extend(blob[8 + 24 * n :].split(b"\n"))
        if heads:
            doc_ids, begin, length = np.concatenate(heads, 1)
            words = Words(texts)
            hashes = words.windows(width)
            item = np.repeat(np.arange(len(texts)), length)
            at = np.flatnonzero(item[: len(hashes)] == item[width - 1 :]) if len(hashes) else np.empty(0, np.int64)
            at = at[_repeated(words, at, hashes[at], doc_ids[item[at]], width)]
            start = begin[item[at]] + at - words.first[item[at]]
            owners.append(doc_ids[item[at]])
            spans.append(np.stack([start, start + width], 1))
        if not spans:
            return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "spans": pd.Series(dtype="object")})
        found = _by_document(np.concatenate(owners), np.concatenate(spans))
        rows = [(doc_id, _merged(s).tobytes()) for doc_id, s in found]
        return pd.DataFrame(rows, columns=["doc_id", "spans"])

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans without overlaps."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    stops = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[stops]], 1).astype(np.int64)


def repeated_spans(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, batch: int = BATCH) -> DataFrame:
    """(doc_id, spans): each document's word spans [from, to) covered by repeated windows; spans is packed int64.

    Rows come from several buckets, so a document may have several. The number of buckets follows
    spark.sql.shuffle.partitions, which is set by the size of the input, so a bucket stays small.
    """
    buckets = buckets or 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_route(width, buckets, batch, common_minimisers(docs, width, text_col)), _SPANS)
    return sent.groupBy("bucket").applyInPandas(_settle_bucket(width), "doc_id long, spans binary")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, spans = batch.column("doc_id"), batch.column("spans").to_pylist()
        for a, b, texts in text_slices(batch, "text", 4_000_000):
            words = Words([t or b"" for t in texts], hashes=False)
            total, removed, kept = [], [], []
            for k in range(b - a):
                lo, hi = int(words.first[k]), int(words.first[k + 1])
                keep = np.ones(hi - lo, bool)
                for s in spans[a + k] or ():
                    for x, y in np.frombuffer(s, np.int64).reshape(-1, 2):
                        keep[x:y] = False
                at = np.flatnonzero(keep) + lo
                total.append(hi - lo)
                removed.append(hi - lo - len(at))
                starts, ends = words.starts[at].tolist(), words.ends[at].tolist()
                kept.append(b" ".join([words.data[x:y] for x, y in zip(starts, ends)]))
            yield pa.RecordBatch.from_arrays(
                [ids[a:b], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in kept])],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def strip_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", text: bool = True, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256), a row for each row of docs.

    kept_text: the words left, joined by one space; without `text` it is left out. Null and empty
    texts have no words. Windows are judged on the input, not on what is left; repeats inside one
    document stay. Rows that share a doc_id are judged each against smaller ids only, and the spans
    found in any of them are removed from all. Rows with a null doc_id stay whole.
    """
    spans = repeated_spans(docs, width, id_col, text_col, batch=batch).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id", "left")
    out = rows.select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string")
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8")) if text else out.drop("kept_text")
