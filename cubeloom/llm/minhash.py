"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A text's words are runs of ASCII letters and digits and non-ASCII characters,
A-Z lower-cased. Its features are shingles of five words (all its words if it has
fewer), weighted by their number in the text times the square root of the inverse
document frequency. Document frequencies are counted over all texts, in 2^20 counters that
shingles share by hash: a table of fixed size whatever the corpus.

Each text gets ``bands * rows`` samples; two texts share a sample with the
probability of their weighted Jaccard similarity. Texts that share a whole band
are candidates. They are compared in two rounds, neither of which makes all pairs
of a bucket: first each member with its bucket's smallest member; then, in buckets
that the links of the first round leave in several components, members of
different components whose samples agree often enough, block by block. Candidates
are verified by exact weighted Jaccard similarity, and classes are the connected
components of the links. Texts with equal words are one text from the start.

At similarity 0.8 a pair shares a band with probability 0.9998 (12 bands of 3), and 20
of its 36 samples agree with probability 0.9997.

Null texts are empty; texts without words are copies of each other if they are
equal. A class is named by its smallest doc_id. Rows that repeat a doc_id are
texts of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import mix, sent, written
from cubeloom.llm.counters import MASK, document_frequencies, word_hashes
from cubeloom.llm.licenses import words
from cubeloom.llm.lsh import Kind, as_signs, linked_components, share

WIDTH = 5
BANDS, ROWS = 12, 3
AGREE = 20 / 36
_DRAW = np.random.default_rng(7)
_STEP = [np.uint64(int(x) | 1) for x in _DRAW.integers(0, 1 << 64, WIDTH, dtype=np.uint64)]
_TURN = _DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_GAMMA = _DRAW.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_DRAW.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _DRAW.random(1 << 16).astype(np.float32)


def shingles(text: bytes | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct 32-bit shingles in order, their numbers, and a 63-bit name of the word sequence.

    A text without words has none, and is named by its bytes.
    """
    ws = words(text)
    h = word_hashes(ws)
    if not len(h):
        return np.empty(0, np.uint32), np.empty(0, np.uint32), xxhash.xxh64_intdigest(text or b"", 1) >> 1
    n = max(1, len(h) - width + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        s += h[j : j + n] * _STEP[j]
    ids, counts = np.unique(mix(s).astype(np.uint32), return_counts=True)
    return ids, counts.astype(np.uint32), xxhash.xxh64_intdigest(h.tobytes()) >> 1


def inverse_frequencies(frequency: np.ndarray, docs: int) -> np.ndarray:
    """The square root of the inverse document frequency: what a large group of near copies
    shares is common, and would otherwise weigh little against the few shingles that differ."""
    return np.sqrt(np.log((1.0 + docs) / (1.0 + np.minimum(frequency, docs))) + 1.0).astype(np.float32)


def samples(ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ICWS: for each sample 16 bits of the hash of (feature, quantised weight) of least ln a."""
    best, out = np.full(len(_TURN), np.inf, np.float32), np.zeros(len(_TURN), np.uint16)
    at = np.arange(len(_TURN))
    for c in range(0, len(ids), 8192):
        h, log_w = mix(ids[c : c + 8192].astype(np.uint64) + np.uint64(1)), np.log(weight[c : c + 8192])
        draw = (h[None, :] * _TURN[:, None]).view(np.uint16).reshape(len(_TURN), -1, 4)
        r, beta = _GAMMA[draw[:, :, 3]], _BETA[draw[:, :, 1]]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[draw[:, :, 2]] - r * (t - beta + 1)
        k = a.argmin(1)
        low = a[at, k]
        better = low < best
        best[better] = low[better]
        found = mix(h[k] + t[at, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)
        out[better] = found[better]
    return out


def features(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-th occurrence of a shingle is a feature of its own, so that weights
    depend on features alone: sums over shared features are sums of smaller weights."""
    n = counts.astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    all_ids = np.repeat(ids, n)
    both = (nth.astype(np.uint64) << np.uint64(32)) | all_ids.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    return both[order], idf[all_ids[order] & MASK]


def near_duplicates(docs: DataFrame, similarity: float = 0.8, most_broadcast: int = 300_000) -> DataFrame:
    """One row per document: doc_id, class_id, kept (its class's smallest doc_id)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    frequency, total = document_frequencies(base.select("text"), lambda t: shingles(t)[0])
    idf = sent(spark, inverse_frequencies(frequency, total))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ks, sigs = [], []
            for t in pdf["text"]:
                ids, counts, k = shingles(t)
                ks.append(k)
                sigs.append(samples(ids, counts * idf.value[ids & MASK]).tobytes() if len(ids) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "k": ks, "sig": sigs})

    of_doc = written(base.mapInPandas(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, sig binary"), "samples")
    texts = written(of_doc.where("sig is not null").groupBy("k").agg(F.any_value("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "texts")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ks, vecs = [], []
            for k, t in zip(pdf["k"].tolist(), pdf["text"], strict=True):
                ids, counts, own = shingles(t)
                if own == k:
                    ks.append(k)
                    vecs.append(ids.tobytes() + counts.tobytes())
            yield pd.DataFrame({"k": np.array(ks, np.int64), "vec": vecs})

    def vectors_of(names: DataFrame) -> DataFrame:
        wanted = texts.select("k", F.col("doc_id").alias("_doc")).join(names, "k")
        if names.count() <= most_broadcast:  # as many rows of two numbers
            wanted = F.broadcast(wanted)
        found = base.join(wanted, base["doc_id"].eqNullSafe(wanted["_doc"])).select("k", "text")
        return found.mapInPandas(vectors, "k long, vec binary")

    def unpack(vec: bytes) -> tuple[np.ndarray, np.ndarray]:
        return features(*np.frombuffer(vec, np.uint32).reshape(2, -1), idf.value)

    def shares(left: list[bytes], right: list[bytes]) -> np.ndarray:
        return np.array([share(unpack(x), unpack(y)) for x, y in zip(left, right, strict=True)])

    kind = Kind(BANDS, ROWS, AGREE, similarity, as_signs, shares, unpack, vectors_of)
    roots = linked_components(texts.select("k", "sig", F.col("sig").alias("body")), kind)
    rooted = of_doc.select("doc_id", "k").join(roots, "k", "left").select("doc_id", F.coalesce("root", "k").alias("root"))
    # A table of its own: a class of very many documents is then split between tasks by the join.
    classes = written(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("root", "class_id", F.lit(True).alias("several")), "classes")
    class_id = F.when(F.col("several"), F.col("class_id")).otherwise(F.col("doc_id"))
    out = rooted.join(classes, "root", "left").select("doc_id", class_id.alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))
