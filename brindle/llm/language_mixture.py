"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

A language's model is the smoothed frequency of letter trigrams (a letter with its neighbours, word
ends included), hashed to 2**15 buckets; counts come from all training documents. A word's
likelihood under a language is the product over its letters. For a document, EM estimates the
proportions of the languages from its words' likelihoods. Sets of the m languages of largest
proportion, m = 1, 2, ..., compete by likelihood less half of `penalty` * m * log(words); the
winner's proportions are the result, and the prediction is the largest.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
STEPS = 8


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Letters:
    """Trigram bucket of each letter of some texts, and where words and documents begin in them."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        lowered = joined.lower()
        if len(lowered) != len(joined):  # some letters lower to several code points
            texts = [t.lower() for t in texts]
            lowered = "\n".join(texts) + "\n"
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        at = np.flatnonzero(letter)
        padded = np.zeros(len(points) + 2, np.uint32)
        padded[1:-1] = points * letter
        code = padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        self.buckets = (code >> np.uint32(17)).astype(np.int32)
        self.words = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1])) if len(at) else np.empty(0, np.int64)
        edges = np.cumsum([len(t) + 1 for t in texts])
        self.doc_of_letter = np.searchsorted(edges, at, "right")
        self.doc_of_word = self.doc_of_letter[self.words]
        self.n = len(texts)


@dataclass
class Models:
    languages: list[str]
    logs: np.ndarray  # buckets x languages, float32

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, smoothing: float = 0.2) -> Models:
        p = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BUCKETS)
        return cls(languages, np.ascontiguousarray(np.log(p).T.astype(np.float32)))

    def proportions(self, texts: list[str], penalty: float = 2.0) -> np.ndarray:
        """Each text's language proportions; all 0 if it has no letter."""
        parts = Letters(texts)
        k = len(self.languages)
        out = np.zeros((parts.n, k))
        if not len(parts.words) or not k:
            return out
        words = np.add.reduceat(self.logs[parts.buckets], parts.words, axis=0)
        docs, first = np.unique(parts.doc_of_word, return_index=True)
        size = np.diff(np.append(first, len(words)))
        top = words.max(1, keepdims=True)
        likely = np.exp(np.maximum(words - top, -60))
        row = np.repeat(np.arange(len(docs)), size)

        def em(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                joint = likely * share[row]
                joint /= joint.sum(1, keepdims=True) + np.float32(1e-30)
                share = np.add.reduceat(joint, first, axis=0) / size[:, None]
                share = share.astype(np.float32)
            fit = np.add.reduceat(np.log((likely * share[row]).sum(1) + 1e-30), first)
            return share, fit

        full, _ = em(np.full((len(docs), k), 1 / k, np.float32), STEPS)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        best, value = np.zeros_like(full), np.full(len(docs), -np.inf)
        for m in range(1, k + 1):
            share = full * (rank < m) + np.float32(1e-9) * (rank < m)
            share, fit = em(share / share.sum(1, keepdims=True), 1 if m == 1 else 4)
            fit = fit - penalty / 2 * m * np.log(size)
            better = fit > value
            best[better], value[better] = share[better], fit[better]
        out[docs] = best
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of all languages in docs, from all its rows with a text and a language.

    Tasks send sums by language and bucket; what reaches the driver is at most BUCKETS sums a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 200):
                own = langs[a : a + 200]
                names = sorted(set(own))
                code = {x: k for k, x in enumerate(names)}
                parts = Letters(texts[a : a + 200])
                which = np.array([code[x] for x in own])[parts.doc_of_letter]
                found = np.bincount(which * BUCKETS + parts.buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for x, row in zip(names, found):
                    sums[x] = sums.get(x, 0) + row
        for x, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map({x: k for k, x in enumerate(languages)}), found["bucket"]] = found["n"]
    return Models.of(languages, counts)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", penalty: float = 2.0) -> DataFrame:
    """(id, lang_pred, score, mixture), a row for each row of docs.

    mixture: JSON of the chosen languages' proportions; lang_pred the largest (of equals, the first
    by name), score its proportion. A text that is null or has no letter is `und` with score 0, and
    so is every text if no language was learned. Whole texts are used, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 500_000):
                    size += len(texts[b])
                    b += 1
                shares = models.proportions(texts[a:b], penalty)
                lang, score, mixture = [], [], []
                for row in shares:
                    total = row.sum()
                    k = int(row.argmax()) if total > 0 else -1
                    lang.append(models.languages[k] if k >= 0 else "und")
                    score.append(min(1.0, float(row[k])) if k >= 0 else 0.0)
                    mixture.append(json.dumps({models.languages[x]: round(float(row[x]), 4) for x in np.flatnonzero(row)}))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], names=["id", "lang_pred", "score", "mixture"])
                a = b

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, mixture string").withColumnRenamed("id", id_col)
