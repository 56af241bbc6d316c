"""Byte-level BPE over whole texts: pre-tokens by vectorised scans, then cached pair merging.

Pre-tokenisation finds where the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

begins a match, without a regular expression. Code points become classes (letter, number, other,
space that the next token takes along, other white space, apostrophe that may open a contraction).
A class is a function from the scanner's state to the next; functions compose associatively, so all
states come from one scan: rows of the array are composed column by column, all rows at once, then
the rows among themselves. A token begins where (state, class) says so.

Slices between such places go through a cache of merged pairs. `encode` returns ids and each
token's offset in bytes; `decode` joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import text_slices, tidy

CACHE = 300_000  # pre-tokens whose ids a worker remembers
CACHE_BYTES = 8_000_000  # and the characters in them, about; a pre-token may be a whole text

# fixed values: what the pattern's contractions have after the apostrophe
ONE = "stmd"
TWO = ("re", "ve", "ll")

# classes
LETTER, NUMBER, OTHER, TAKEN, WHITE, RUN, SHORT, LONG, END = range(9)
# TAKEN: a space right before a token, RUN: white space that another follows, or none but the end,
# WHITE: white space right before a token that isn't a space; SHORT, LONG: apostrophe with one or
# two contraction letters; END: the separator between texts
# states
IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, PREFIX, FRESH, NEED_ONE, NEED_TWO = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) for each class and state."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
        step[kind] = run
        begins[kind, [run, PREFIX]] = False
    # a contraction opens only where a token may begin
    for kind, need in ((SHORT, NEED_ONE), (LONG, NEED_TWO)):
        step[kind, [s for s in range(8) if s not in (IN_OTHER, PREFIX)]] = need
    step[LETTER, NEED_ONE], step[LETTER, NEED_TWO] = FRESH, NEED_ONE
    begins[LETTER, [NEED_ONE, NEED_TWO]] = False
    step[TAKEN], step[END] = PREFIX, FRESH
    step[RUN] = IN_WHITE
    begins[RUN, IN_WHITE] = False
    step[WHITE] = FRESH  # a single other white space; a run's last goes by itself too
    return step, begins


_STEP, _BEGINS = _machine()


def _closure() -> tuple[np.ndarray, np.ndarray]:
    """All functions that the classes' functions compose to: (each one's values, composition with a class).

    Function k < 9 is class k's; the last is the identity. There are few, so a scan needs one
    look-up an element instead of one a state.
    """
    found = {tuple(f): k for k, f in enumerate(_STEP)} if len({*map(tuple, _STEP)}) == len(_STEP) else {}
    values: list[tuple[int, ...]] = [tuple(f) for f in _STEP]
    for k, f in enumerate(values):
        found.setdefault(f, k)
    after: list[list[int]] = []
    k = 0
    identity = tuple(range(8))
    if identity not in found:
        found[identity] = len(values)
        values.append(identity)
    while k < len(values):
        row = []
        for g in _STEP:
            h = tuple(int(g[x]) for x in values[k])
            if h not in found:
                found[h] = len(values)
                values.append(h)
            row.append(found[h])
        after.append(row)
        k += 1
    return np.array(values, np.uint8), np.array(after, np.uint8)


_VALUES, _AFTER = _closure()
_IDENTITY = [k for k, v in enumerate(_VALUES) if tuple(v) == tuple(range(8))][0]


@functools.cache
def kinds() -> np.ndarray:
    """For each code point 0: letter, 1: number, 2: other, 3: white space.

    By the Unicode tables of the tokenizer library whose results are to be matched: newer tables
    know more letters.
    """
    import tiktoken

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, 2, np.uint8)
    for k, pattern in ((0, r"\p{L}"), (1, r"\p{N}"), (3, r"\s")):
        finder = tiktoken.Encoding(f"kind{k}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for a in range(0, len(every), 20_000):
            matched = bytes(finder.encode_ordinary("".join(map(chr, every[a : a + 20_000])))).decode()
            out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = k
    return out


def scan(classes: np.ndarray, start: int = FRESH) -> np.ndarray:
    """The state before each element, by composing the classes' transition functions.

    The array is cut into rows. All rows are composed at once, element by element; the rows' whole
    functions then give the state in which each row begins.
    """
    n = len(classes)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    before = np.empty((width, rows), np.uint8)
    flat, classes_n = _AFTER.ravel(), _AFTER.shape[1]
    function = np.full(rows, _IDENTITY, np.uint8)
    for k in range(width):
        before[k] = function
        function = flat[function.astype(np.intp) * classes_n + columns[k]]
    entry = np.empty(rows, np.uint8)
    at = start
    for k, f in enumerate(function):
        entry[k], at = at, _VALUES[f, at]
    return _VALUES.ravel()[before.astype(np.intp) * 8 + entry].T.ravel()[:n]


class Pairs:
    """Rank of each adjacent pair of ids that merges, by two hash tables; arrays in, arrays out."""

    NEVER = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.tables = []
        seed = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(12, int(np.ceil(np.log2(8 * len(keys)))))
            slot = (keys * np.uint64(seed)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, self.NEVER, np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], values[first]
            self.tables.append((np.uint64(seed), np.uint64(64 - bits), held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, seed = keys[rest], values[rest], (seed * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), self.NEVER, np.int32)
        for seed, shift, held, rank in self.tables:
            slot = (keys * seed) >> shift
            hit = held[slot] == keys
            out[hit] = rank[slot[hit]]
        return out


class Tokenizer:
    """Ids by merge ranks; `ranks` maps bytes to ids, lower merges first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held = 0  # characters in the cache
        self.pairs = Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Each piece's ids: repeatedly joins the adjacent pair of lowest rank, the leftmost of equals.

        Pieces of about the same length are merged together, a pair of each at a time.
        """
        out: list[tuple[int, ...]] = [()] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((1, 8), (9, 12), (13, 20), (21, 40), (41, 100)):
            own = np.flatnonzero((length >= low) & (length <= high))
            if len(own):
                for k, ids in zip(own.tolist(), self._merge_rows([pieces[k] for k in own], length[own], high)):
                    out[k] = ids
        for k in np.flatnonzero(length > 100).tolist():
            out[k] = self._merge_long(pieces[k])
        return out

    def _merge_rows(self, pieces: list[bytes], length: np.ndarray, width: int) -> list[tuple[int, ...]]:
        n, never = len(pieces), Pairs.NEVER
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.single[raw]
        rank = np.full((n, width), never, np.int32)
        there = np.arange(width - 1) < (length - 1)[:, None]
        rank[:, :-1][there] = self.pairs.ranks(ids[:, :-1][there], ids[:, 1:][there])
        size = length.copy()
        columns = np.arange(width)
        active = np.arange(n)
        while len(active):
            part = rank[active]
            best = part.argmin(1)
            lowest = part[np.arange(len(active)), best]
            go = lowest != never
            active, best, lowest = active[go], best[go], lowest[go]
            if not len(active):
                break
            # close the gap of the right half
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids[active] = np.take_along_axis(ids[active], source, 1)
            rank[active] = np.take_along_axis(rank[active], source, 1)
            rank[active, -1] = never
            ids[active, best] = lowest  # a token's id is its rank
            size[active] -= 1
            rank[active, best] = never
            right = best + 1 < size[active]
            rows, at = active[right], best[right]
            rank[rows, at] = self.pairs.ranks(ids[rows, at], ids[rows, at + 1])
            left = best > 0
            rows, at = active[left], best[left]
            rank[rows, at - 1] = self.pairs.ranks(ids[rows, at - 1], ids[rows, at])
        return [tuple(row[:k]) for row, k in zip(ids.tolist(), size.tolist())]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for pieces of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Each text's pre-tokens."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        # the scan runs over all texts at once, with a separator after each that resets its state
        at = _separated(points, ends)
        stops = np.append(at[1:], len(points))
        flat = [joined[a:b] for a, b in zip(at.tolist(), stops.tolist())]
        cut = np.searchsorted(at, np.concatenate([[0], ends])).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cache, split = self.cache, self.pieces(texts)
        missing = list({p for pieces in split for p in pieces if p not in cache})
        self.held += sum(map(len, missing))
        if len(cache) + len(missing) > CACHE or self.held > CACHE_BYTES:
            cache.clear()
            missing = list({p for pieces in split for p in pieces})
            self.held = sum(map(len, missing))
        cache.update(zip(missing, self.merge([p.encode("utf-8") for p in missing])))
        return [list(chain.from_iterable(map(cache.__getitem__, pieces))) for pieces in split]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and the offset in bytes at which each token's bytes begin."""
        ids = self.encode_batch([text])[0]
        lengths = [len(self.bytes[i]) for i in ids]
        return ids, [0, *np.cumsum(lengths).tolist()][: len(ids)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _separated(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Match begins, with a separator scanned after each text."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = kinds()[points]
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    following = np.full(n, 3, np.uint8)
    following[:-1] = kind[1:]
    following[last] = 3
    classes = kind.copy()
    white = kind == 3
    classes[white] = RUN
    before_token = white & (following != 3)
    classes[before_token] = WHITE
    classes[before_token & (points == 32)] = TAKEN
    marks = np.flatnonzero(points == 39)
    if len(marks):
        limit = ends[np.searchsorted(ends, marks, "right")]
        padded = np.append(points, np.zeros(2, np.uint32))
        one = np.where(marks + 1 < limit, padded[marks + 1], 0)
        two = np.where(marks + 2 < limit, padded[marks + 2], 0)
        classes[marks[np.isin(one, [ord(c) for c in ONE])]] = SHORT
        for a, b in TWO:
            classes[marks[(one == ord(a)) & (two == ord(b))]] = LONG
    stops = np.unique(ends[(ends > 0) & (ends < n)])
    spaced = np.insert(classes, stops, END)
    begins = _BEGINS[spaced, scan(spaced)]
    own = np.ones(len(spaced), bool)
    own[stops + np.arange(len(stops))] = False
    return np.flatnonzero(begins[own])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _run(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                coded = tok.encode_batch([(t or b"").decode() for t in texts])
                if full:
                    columns = [pa.array(coded, pa.list_(pa.int32())), pa.array([_offsets(tok, ids) for ids in coded], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], names=["id", "ids", "offsets"])
                else:
                    digest = [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in coded]
                    back = [hashlib.sha256(tok.decode(ids)).hexdigest() for ids in coded]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b], pa.array([len(x) for x in coded], pa.int64()), pa.array(digest), pa.array(back)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    )
        if tok.held > CACHE_BYTES // 4:
            tok.cache.clear()
            tok.held = 0
        tidy()

    return run


def _offsets(tok: Tokenizer, ids: list[int]) -> list[int]:
    lengths = np.fromiter((len(tok.bytes[i]) for i in ids), np.int64, len(ids))
    return (np.cumsum(lengths) - lengths).tolist()


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, offsets), a row for each row of docs: token ids, and where each token's bytes begin in the UTF-8 text.

    A null text counts as empty and gives empty arrays. Special tokens' strings are ordinary text.
    Extra columns are left out; repeated rows are encoded alike; an empty table gives an empty one.
    ranks_path must exist on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(ranks_path, True), f"id {kind}, ids array<int>, offsets array<long>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): `encode`, then `decode` of the ids, as digests."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(ranks_path, False), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from rows with `ids`; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""

    def run(batches):
        tok = tokenizer(ranks_path)
        for batch in batches:
            texts = [tok.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
