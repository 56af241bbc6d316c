"""Shared pieces of the training-data operators: scratch tables and a vectorised word scanner.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR. In UTF-8 these six
are single bytes that occur in no other character, so words can be found on bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15  # odd
_LETTERS = np.random.default_rng(20240613).integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def n_words(text):
    """Column: number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # at exit the JVM may be gone; what is left lies in the scratch folder
        pass


class Scratch:
    """Written tables that cut lineage; they outlive lost executors as they lie in the shared folder.

    `table` writes a frame and returns it as read back; `drop` deletes one that is no longer needed.
    What is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/brindle-{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}  # catalog names of bucketed tables
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.option("compression", compression).parquet(self.path(name))
        # the JVM's next collection lets Spark's cleaner delete the finished step's shuffle files
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def buckets(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """`table`, bucketed by a key: joins and aggregates on the key then move none of its rows."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"brindle_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(n, key).options(path=self.path(name), compression="zstd").saveAsTable(table)
        self.tables[name] = table
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.table(table)

    def clean(self) -> None:
        """Lets Spark delete the shuffle files of finished steps whose frames are gone."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
            _remove(self.spark, self.path(name))


SIEVE = 1 << 18  # rows of a sieve, 64 bits each


def sieved(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """df with all rows whose key is in `wanted` (one column), and only some of the others, before they are shuffled.

    A Bloom filter of one hash as a table: SIEVE rows of 64 bits at most, some 4 MB, so it is
    broadcast whatever the number of keys. With more keys it lets more through; a join must follow.
    """
    h = F.xxhash64(F.lit(17), wanted.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))
    sieve = wanted.select(F.pmod(h, F.lit(SIEVE)).alias("__cell"), bit.alias("__bit")).groupBy("__cell").agg(F.bit_or("__bit").alias("__bits"))
    own = F.xxhash64(F.lit(17), column)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(own, 32), F.lit(64)).cast("int"))
    rows = df.join(F.broadcast(sieve), F.pmod(own, F.lit(SIEVE)) == F.col("__cell"))
    return rows.where(F.col("__bits").bitwiseAND(mask) != 0).drop("__cell", "__bits")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def tidy() -> None:
    """Gives memory that a task held back to the system: workers live on, beside those of the next stages."""
    if len(_powers[0]) > 1 << 21:
        _powers[:] = [x[: 1 << 20].copy() for x in _powers]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and those of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = pow(_BASE, -1, 2**64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, U64(base))
            steps[0] = U64(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of several texts: byte offsets into `data`, 64-bit hashes, and each text's range.

    Text k has the words first[k]:first[k + 1]. Hashes are polynomial in the bytes, then mixed;
    where a decision needs equality of words, compare `data` slices.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True):
        self.data = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(self.data, np.uint8)
        if lower:
            codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
        space = _SPACE[codes]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hashes(codes) if hashes else None

    def _hashes(self, codes: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """By pieces of about 1 MB that end where a text does, so that the sums stay in the cache."""
        out = np.empty(len(self.starts), U64)
        cut = np.unique(np.searchsorted(self.offsets, np.arange(0, self.offsets[-1], most)))
        cut = np.append(cut[cut < len(self.offsets) - 1], len(self.offsets) - 1)
        for k, j in zip(cut, cut[1:]):
            lo, hi = self.offsets[k], self.offsets[j]
            a, b = self.first[k], self.first[j]
            up, down = power_tables(int(hi - lo) + 1)
            sums = np.empty(hi - lo + 1, U64)
            sums[0] = 0
            part = _LETTERS[codes[lo:hi]]
            part *= up[: hi - lo]
            np.cumsum(part, out=sums[1:])
            starts, ends = self.starts[a:b] - lo, self.ends[a:b] - lo
            h = sums[ends]
            h -= sums[starts]
            h *= down[starts]
            h += (ends - starts).astype(U64)
            out[a:b] = mix(h)
        return out

    def windows(self, width: int, seed: int = 1) -> np.ndarray:
        """Hash of the `width` words from each word on; those that run over a text's end are invalid."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.empty(0, U64)
        out = np.zeros(n, U64)
        for j in range(width):
            out = out * U64(_BASE) + self.hashes[j : j + n]
        return mix(out ^ U64(seed * 0xD6E8FEB86659FD93 % 2**64))


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000):
    """(from, to, texts): a batch's rows in slices of about `most` bytes, one row at least; texts as bytes or None.

    Only one slice at a time is turned into Python objects, whatever the batch holds.
    """
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        before = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, before + most, "right")))
        yield a, b, texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()
        a = b
