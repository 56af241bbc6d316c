"""Quality rules as a short-circuit cascade, ordered by what a sample shows.

Each rule rejects or passes a document; a document is kept if no rule rejects it, so the order of
the rules changes the cost and never the verdict. On a sample every rule is run on every document
and timed; the cascade then runs the rules by rejections per second, and a rule sees only documents
that all before it passed.

The sample is SAMPLE_ROWS rows, drawn from the whole table by Bernoulli sampling; only sums for
each rule reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Words, text_slices, tidy

SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_CASE = np.zeros(0x10000, np.int8)  # 1: lower case, 2: upper case
_CASE[[c for c in range(0x10000) if chr(c).islower()]] = 1
_CASE[[c for c in range(0x10000) if chr(c).isupper()]] = 2


@dataclass(frozen=True)
class Rule:
    """`rejects` takes a Batch and the positions of its undecided documents, and returns a mask over these."""

    name: str
    rejects: Callable[[Batch, np.ndarray], np.ndarray]


class Batch:
    """Some texts, with the base figures of each."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        words = self.words = Words(texts)
        codes = np.frombuffer(words.data, np.uint8)
        edges = words.offsets[:-1]
        length = words.ends - words.starts
        self.n_words = np.diff(words.first)
        if not texts:
            self.word_chars = self.n_symbols = self.n_dup_lines = self.n_repeat_words = self.n_lines = self.n_words
            return
        tail = np.concatenate([[0], np.cumsum((codes & 0xC0) == 0x80)])
        chars = np.concatenate([[0], np.cumsum(length - (tail[words.ends] - tail[words.starts]))])
        self.word_chars = chars[words.first[1:]] - chars[words.first[:-1]]
        self.n_symbols = np.add.reduceat(_IS_SYMBOL[codes], edges, dtype=np.int64)
        self.n_lines, self.n_dup_lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2).T
        self.n_repeat_words = self._repeats(8)
        few = (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)
        self.base_failed = few

    def _repeats(self, width: int) -> np.ndarray:
        """Words in windows of `width` words that the text holds twice or more."""
        words = self.words
        windows = words.windows(width)
        doc = np.repeat(np.arange(len(self.texts)), self.n_words)
        if not len(windows):
            return np.zeros(len(self.texts), np.int64)
        at = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :])
        order = at[np.lexsort((windows[at], doc[at]))]
        same = (windows[order[1:]] == windows[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        twice = np.zeros(len(windows) + width, np.int32)
        found = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        twice[found] += 1
        twice[found + width] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(twice)[: len(doc)] > 0)])
        return covered[words.first[1:]] - covered[words.first[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of these equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _too_many_symbols(b: Batch, at: np.ndarray) -> np.ndarray:
    return 100 * b.n_symbols[at] > 25 * b.n_words[at]


def _word_length(b: Batch, at: np.ndarray) -> np.ndarray:
    mean = b.word_chars[at] / np.maximum(b.n_words[at], 1)
    return (mean < 2) | (mean > 15)


def _repeated_lines(b: Batch, at: np.ndarray) -> np.ndarray:
    return 100 * b.n_dup_lines[at] > 50 * np.maximum(b.n_lines[at], 1)


def _stutter(b: Batch, at: np.ndarray) -> np.ndarray:
    """Over 30 % of the words equal the word before them."""
    h = b.words.hashes
    same = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, np.int64)
    lo, hi = b.words.first[at], b.words.first[at + 1]
    return 100 * (same[hi] - same[np.minimum(lo + 1, hi)]) > 30 * np.maximum(b.n_words[at], 1)


def _capitals(b: Batch, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at):
        points = _code_points(b.texts[i])
        case = np.bincount(_CASE[points[points < 0x10000]], minlength=3)
        out[k] = 100 * case[2] > 30 * (case[1] + case[2])
    return out


def _few_letters(b: Batch, at: np.ndarray) -> np.ndarray:
    """Fewer than 60 % of the words hold a letter (any byte above ASCII counts as one)."""
    words = b.words
    codes = np.frombuffer(words.data, np.uint8)
    letter = np.concatenate([[0], np.cumsum((codes >= 128) | ((codes | 32) >= 97) & ((codes | 32) <= 122))])
    has = np.concatenate([[0], np.cumsum(letter[words.ends] > letter[words.starts])])
    return 100 * (has[words.first[at + 1]] - has[words.first[at]]) < 60 * b.n_words[at]


def _shouting(b: Batch, at: np.ndarray) -> np.ndarray:
    return np.array([5 * b.texts[i].count(b"!") > b.n_words[i] for i in at], bool)


def _list_lines(b: Batch, at: np.ndarray) -> np.ndarray:
    """Over 90 % of the lines start as list items do."""
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at):
        starts = [x.lstrip()[:1] for x in b.texts[i].split(b"\n") if x.strip()]
        out[k] = 10 * sum(s in (b"-", b"*", b"+") for s in starts) > 9 * max(len(starts), 1)
    return out


def _broken_lines(b: Batch, at: np.ndarray) -> np.ndarray:
    """Over 30 % of the lines end in an ellipsis."""
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at):
        lines = [x for x in b.texts[i].split(b"\n") if x.strip()]
        out[k] = 10 * sum(x.rstrip().endswith((b"...", "…".encode())) for x in lines) > 3 * max(len(lines), 1)
    return out


RULES = (
    Rule("symbols", _too_many_symbols),
    Rule("word_length", _word_length),
    Rule("repeated_lines", _repeated_lines),
    Rule("stutter", _stutter),
    Rule("capitals", _capitals),
    Rule("few_letters", _few_letters),
    Rule("shouting", _shouting),
    Rule("list_lines", _list_lines),
    Rule("broken_lines", _broken_lines),
)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in batches:
        for a, b, texts in text_slices(batch, "text"):
            yield batch.slice(a, b - a), Batch([t or b"" for t in texts])
    tidy()


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Each rule's share of rejections and seconds a document, on a sample of about `sample_rows` rows."""

    def run(batches):
        sums = {r.name: [0, 0, 0] for r in rules}
        for _, batch in _batches(batches):
            at = np.flatnonzero(~batch.base_failed)
            for r in rules:
                began = time.perf_counter_ns()
                rejected = int(r.rejects(batch, at).sum()) if len(at) else 0
                sums[r.name] = [x + y for x, y in zip(sums[r.name], (len(at), rejected, time.perf_counter_ns() - began))]
        names, rows = list(sums), list(zip(*sums.values()))
        yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x, pa.int64()) for x in rows)], names=["rule", "seen", "rejected", "nanos"])

    texts = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, texts.count()))
    found = texts.sample(False, share, seed).mapInArrow(run, "rule string, seen long, rejected long, nanos long")
    sums = found.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seen", "rejected", "nanos"))).collect()
    return {r.rule: (r.rejected / max(1, r.seen), r.nanos / 1e9 / max(1, r.seen)) for r in sums}


def ordered(rules: Sequence[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per second, ties and rules that reject nothing by lower cost, then by name."""

    def key(r: Rule):
        share, cost = estimates.get(r.name, (0.0, 0.0))
        return -share / max(cost, 1e-12), cost, r.name

    return sorted(rules, key=key)


def score(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The id, the base figures, base_failed, kept and rejected_by, a row for each row of docs.

    n_words, word_chars (code points in words), n_symbols (characters of #*$%&|<>), n_dup_lines
    (lines with a word that equal an earlier line) and n_repeat_words (words in 8-word windows found
    twice or more) are of the whole text, 0 for a null. base_failed: under 20 words or over 30 % of
    them repeated. kept: neither base_failed nor rejected by a rule. rejected_by: the first rule to
    reject in the order used, which may differ between runs; 'base' if base_failed; null if kept.
    Nulls in the id stay null; repeated rows are judged alike; an empty table gives an empty one.
    """
    cascade = ordered(rules, estimate(docs, rules, text_col, sample_rows))

    def run(batches):
        for rows, batch in _batches(batches):
            by = np.full(rows.num_rows, None, object)
            by[batch.base_failed] = "base"
            open_ = np.flatnonzero(~batch.base_failed)
            for r in cascade:
                if not len(open_):
                    break
                rejected = r.rejects(batch, open_)
                by[open_[rejected]] = r.name
                open_ = open_[~rejected]
            kept = np.zeros(rows.num_rows, bool)
            kept[open_] = True
            figures = (batch.n_words, batch.word_chars, batch.n_symbols, batch.n_dup_lines, batch.n_repeat_words)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(x, pa.int64()) for x in figures), pa.array(batch.base_failed), pa.array(kept), pa.array(by.tolist(), pa.string())],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all columns as they are, whose text passes; see `score`.

    Rows are filtered where they are read, so neither ids nor order matter and nothing is shuffled.
    """
    cascade = ordered(rules, estimate(docs, rules, text_col, sample_rows))

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                figures = Batch([t or b"" for t in texts])
                open_ = np.flatnonzero(~figures.base_failed)
                for r in cascade:
                    if len(open_):
                        open_ = open_[~r.rejects(figures, open_)]
                yield batch.slice(a, b - a).take(pa.array(open_, pa.int64()))
        tidy()

    return docs.mapInArrow(run, docs.schema)
