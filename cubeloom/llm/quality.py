"""Quality classifier: hashed word n-gram logistic regression, learned with
follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of letters or digits and runs of one other visible sign, so
punctuation habits and letter case count. A text's vector holds its hashed
unigrams and bigrams: the square root of their counts, scaled to length 1. A
score is the logistic function of one sparse dot product. The fit uses at most
``per_class`` labelled rows of each class, of texts of at most ``most_chars``
characters; every document is scored, over its whole text.

Null and empty texts score as the intercept alone. With no labelled rows of one
class, the intercept follows the rows there are. Repeated rows are scored each;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cubeloom.llm._common import cache, claim, held_out_column, labelled_sample, sent, trim

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Hashes(dict):
    """token -> 32-bit hash; emptied when it grows past a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(token) <= 64:
            self[token] = h
        return h


_HASHES = _Hashes()
cache("quality", _HASHES.clear)


def vector(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature ids and their values."""
    claim("quality")
    tokens = TOKENS.findall(text or "")
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    mask = np.uint64((1 << bits) - 1)
    two = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)) if len(h) > 1 else h[:0]
    if len(two):
        two = np.where(h[:-1] == h[1:], np.uint64(1), two)  # a word said twice is one feature, whatever the word
    ids, counts = np.unique(np.concatenate([(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits), two]) & mask, return_counts=True)
    values = np.sqrt(counts)
    return ids.astype(np.int64), values / max(np.sqrt((values * values).sum()), 1e-12)


@dataclass
class QualityModel:
    bits: int
    intercept: float
    weight: np.ndarray

    def score(self, text: str | None) -> float:
        ids, values = vector(text, self.bits)
        z = self.intercept + float(self.weight[ids] @ values)
        return 1.0 / (1.0 + float(np.exp(-min(max(z, -60.0), 60.0))))


def fit(texts: list[str], y: np.ndarray, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> QualityModel:
    """One FTRL-proximal step per row and epoch; coordinate 1 << bits is the intercept."""
    n, z = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    if not len(y):
        return QualityModel(bits, 0.0, np.zeros(1 << bits, np.float32))
    rows = [vector(t, bits) for t in texts]
    rows = [(np.append(i, 1 << bits), np.append(v, 1.0)) for i, v in rows]

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    draw = np.random.default_rng(5)
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            ids, values = rows[k]
            w = weights(ids)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - y[k]) * values
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(np.arange((1 << bits) + 1))
    return QualityModel(bits, float(w[-1]), w[:-1].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_chars: int = 50_000) -> QualityModel:
    """The classes are drawn evenly; the intercept then returns half-way to the
    odds of all labelled rows, which keeps short texts of the common class."""
    texts, y = labelled_sample(docs, labels, "quality", per_class, 5, most_chars)
    model = fit(texts, y)
    seen = labels.where(~held_out_column() & F.col("quality").isin(0, 1)).agg(F.sum("quality").alias("one"), F.count("*").alias("n")).first()
    if 0 < (seen["one"] or 0) < seen["n"] and 0 < y.sum() < len(y):
        model.intercept += 0.5 * float(np.log(seen["one"] / (seen["n"] - seen["one"])) - np.log(y.sum() / (len(y) - y.sum())))
    trim()
    return model


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = sent(docs.sparkSession, train(docs, labels, per_class))
    base = docs.select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [m.score(t) for t in pdf["text"]]})

    scored = base.mapInPandas(run, StructType([base.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
