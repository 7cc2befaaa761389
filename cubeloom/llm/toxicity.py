"""Toxicity: character n-gram linear classifier with naive Bayes feature scaling.

A text's features are the distinct character n-grams inside its lower-cased
words, word edges marked. Each feature is scaled by the naive Bayes log-count
ratio of the two classes, and a logistic regression is fitted on the scaled
features. The fit uses at most ``per_class`` labelled rows of each class, of texts of
at most ``most_chars`` characters; every document is scored, over its whole text.

Null and empty texts, and texts without letters, get the score of the intercept.
With no labelled rows of one class, every text gets that class's prior.
Repeated rows are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm._common import cache, claim, held_out_column, labelled_sample, sent, trim, trim_driver

WORD = re.compile(r"[^\W\d_]+")
_SEEN: dict[str, tuple[int, ...]] = {}  # word -> its features that carry weight in the model _SEEN_BY
_SEEN_BY = [""]
cache("toxicity", _SEEN.clear)


def ngrams(word: str, bits: int, low: int = 3, high: int = 6) -> list[int]:
    """Hashed n-grams of one word with its edges marked, whole word included."""
    w, mask = f"<{word}>".encode(), (1 << bits) - 1
    out = [zlib.crc32(w[i : i + n], n) & mask for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    out.append(zlib.crc32(w, 99) & mask)
    return out


@dataclass
class ToxicityModel:
    bits: int
    intercept: float
    weight: dict[int, float]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def features(self, text: str) -> set[int]:
        """Distinct features of a text that carry weight."""
        claim("toxicity")
        if _SEEN_BY[0] != self.token:
            _SEEN_BY[0] = self.token
            _SEEN.clear()
        seen, got, weight = _SEEN, set(), self.weight
        for w in set(WORD.findall(text.lower())):
            f = seen.get(w)
            if f is None:
                f = tuple({g for g in ngrams(w, self.bits) if g in weight})
                if len(seen) > 300_000:
                    seen.clear()
                if len(w) <= 64:
                    seen[w] = f
            if f:
                got.update(f)
        return got

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weight[f] for f in sorted(self.features(text or "")))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], y: np.ndarray, bits: int = 20, alpha: float = 1.0, l2: float = 0.01, rounds: int = 150, min_df: int = 3, keep: float = 0.7) -> ToxicityModel:
    """keep: features whose absolute log-count ratio is below it are left out."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return ToxicityModel(bits, float(np.log((p + 1e-6) / (1 - p + 1e-6))), {})
    # The sample as numbers: each text's distinct words, and each word's features, end to end.
    number: dict[str, int] = {}
    held, ends, docs = array("i"), array("q", [0]), []
    for t in texts:
        mine = []
        for w in set(WORD.findall(t.lower())):
            k = number.get(w)
            if k is None:
                k = number[w] = len(number)
                held.extend(ngrams(w, bits))
                ends.append(len(held))
            mine.append(k)
        docs.append(np.array(sorted(mine), np.int32))
    del number
    every, stop = np.frombuffer(held, np.int32) if held else np.empty(0, np.int32), np.frombuffer(ends, np.int64)

    def of_text(words: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([every[stop[k] : stop[k + 1]] for k in words])) if len(words) else every[:0]

    count = np.zeros((2, 1 << bits), np.float32)
    for words, label in zip(docs, y, strict=True):
        count[int(label), of_text(words)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    ratio = np.log((count[1] + alpha) / (n[1] + 2 * alpha)) - np.log((count[0] + alpha) / (n[0] + 2 * alpha))
    chosen = (count.sum(0) >= min(min_df, max(1, len(y) // 20))) & (np.abs(ratio) >= keep)
    index = np.full(1 << bits, -1, np.int32)
    index[chosen] = np.arange(chosen.sum())
    r = ratio[chosen].astype(np.float64)
    cols, ptr = [], [0]
    for words in docs:
        f = index[of_text(words)]
        f = f[f >= 0]
        cols.append(f)
        ptr.append(ptr[-1] + len(f))
    col = np.concatenate(cols)
    del docs, cols, every, held, count
    # Row blocks of about 200,000 features, so that nothing as long as col is made beside it.
    ptr, cuts = np.array(ptr), [0]
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ptr, ptr[cuts[-1]] + 200_000, "right")) - 1))
    blocks = [(i, j, col[ptr[i] : ptr[j]], np.repeat(np.arange(j - i), np.diff(ptr[i : j + 1]))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def by_row(of_feature: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, of_feature[c], j - i) for i, j, c, row in blocks])

    def by_feature(of_row: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, of_row[i:j][row], len(r)) for i, j, c, row in blocks)

    w, b = np.zeros(len(r)), 0.0
    step = len(y) ** 0.5 / (0.25 * np.percentile(by_row(r * r), 95) + l2 + 1.0)  # longer than the bound for dense rows: these are sparse
    wv, bv, k = w.copy(), b, 1.0
    for _ in range(rounds):  # accelerated gradient descent on the regularised log loss
        z = by_row(r * wv) + bv
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        gw, gb = r * by_feature(g) + l2 / len(y) * wv, g.sum()
        w2, b2 = wv - step * gw, bv - step * gb
        k2 = (1 + (1 + 4 * k * k) ** 0.5) / 2
        wv, bv = w2 + (k - 1) / k2 * (w2 - w), b2 + (k - 1) / k2 * (b2 - b)
        w, b, k = w2, b2, k2
    coef = w * r
    ids = np.flatnonzero(chosen)
    live = np.abs(coef) > 1e-4
    return ToxicityModel(bits, float(b), dict(zip(ids[live].tolist(), coef[live].tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_chars: int = 50_000) -> ToxicityModel:
    model = fit(*labelled_sample(docs, labels, "toxic", per_class, 8, most_chars))
    trim()
    trim_driver(docs.sparkSession)
    return model


def scorer(spark: SparkSession, model: ToxicityModel):
    """A column function from text to score; null texts count as empty."""
    shared = sent(spark, model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in text], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, train(docs, labels, per_class))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
