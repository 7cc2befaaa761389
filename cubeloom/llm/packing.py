"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made from the histogram of piece lengths alone, so its cost does not
depend on the number of documents:

1. patterns of one to three lengths that fill a sequence exactly are enumerated;
2. their repeat counts are fitted to the histogram by non-negative least squares;
3. counts are rounded down, never above what the histogram still holds;
4. what is left is packed best-fit decreasing, on runs of equal lengths.

The plan says for the k-th piece of each length which sequence and offset it
takes; pieces are numbered within their length in salted groups, so a length
that a third of all documents share is not gathered in one task.

Null and empty texts are documents of the closing id alone. Repeated rows are
packed each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import cache, claim, sent, stored, trim

TOKENIZER = "word_bpe_49k.json"
_ENCODERS: dict[str, "_WordIds"] = {}


# ASCII signs that always stand apart from letters before them (an apostrophe may not).
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _WordIds:
    """Ids of words (bytes without ASCII white space) as little-endian uint32 bytes.

    The tokenizer drops white space and no token crosses it, so a document's ids
    are the ids of its words in turn. Letters and signs are never in one token
    either, so a word of letters with signs after them is looked up in two parts.
    New runs of letters are encoded together: each ends with the one token that
    closes a word. Both tables are emptied when they grow past a bound.
    """

    def __init__(self, path: str, most: int = 350_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.most = most

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_letters(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(new):  # some letters part after all: one by one
            self.letters.update((c, self.encode(c)) for c in new)
            return
        raw, cut = ids.tobytes(), (4 * ends).tolist()
        self.letters.update(zip(new, (raw[i:j] for i, j in zip([0, *cut], cut)), strict=False))

    def learn(self, missing: set[bytes]) -> None:
        parts, whole, new = [], [], set()
        letters = self.letters
        for w in missing:
            s = w.decode("utf-8")
            core = s.rstrip(_TAIL)
            if not (core.isalpha() and (core.isascii() or core.lower().isalpha())):
                whole.append((w, s))
                continue
            tail = s[len(core) :]
            if core.isascii():
                core = core.lower()
            parts.append((w, core, tail))
            if core not in letters:
                new.add(core)
        if new:
            self._learn_letters(list(new))
        words = self.words
        for w, s in whole:
            words[w] = self.encode(s)
        for w, core, tail in parts:
            if tail and tail not in letters:
                letters[tail] = self.encode(tail)
            words[w] = letters[core] + letters[tail] if tail else letters[core]

    def document(self, text: bytes | None) -> bytes:
        """Ids of one text and the closing id 0."""
        ws = (text or b"").split()
        missing = set(ws).difference(self.words)
        if missing:
            if len(self.words) > self.most:
                self.words.clear()
                missing = set(ws)
            if len(self.letters) > self.most:
                self.letters.clear()
            self.learn(missing)
        return b"".join(map(self.words.__getitem__, ws)) + b"\0\0\0\0"


def _clear() -> None:
    for e in _ENCODERS.values():
        e.words.clear()
        e.letters.clear()


cache("packing", _clear)


def encoder(name: str = TOKENIZER) -> _WordIds:
    claim("packing")
    if name not in _ENCODERS:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = _WordIds(path)
    return _ENCODERS[name]


def pieces(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", key.dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, step = encoder(tokenizer), 4 * length
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = enc.document(text)
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((doc_id, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)


def fit_patterns(hist: np.ndarray, length: int, rounds: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, times it is used), from a non-negative least squares
    fit of the repeat counts by multiplicative updates."""
    have = np.flatnonzero(hist[: length + 1])
    have = have[have > 0]
    out: list[tuple[tuple[int, ...], int]] = [((length,), int(hist[length]))] if length in have else []
    left = hist.astype(np.float64).copy()
    left[length] = 0
    have = have[have < length]
    if not len(have):
        return out
    found = []  # by first length: a table of all pairs would take more than all patterns do
    for a in have:
        b = have[: np.searchsorted(have, a, "right")]
        c = length - a - b
        ok = (c >= 0) & (c <= b)
        ok[ok] &= (c[ok] == 0) | (hist[c[ok]] > 0)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))  # a third length of 0 is none
    pattern = np.concatenate(found)
    if not len(pattern):
        return out
    target = left.copy()
    target[0] = 0
    x = np.full(len(pattern), max(left.sum() / 3 / len(pattern), 1e-9))
    up = np.maximum(target[pattern].sum(1), 1e-12)
    for _ in range(rounds):
        made = np.bincount(pattern.ravel(), np.repeat(x, 3), len(target))
        made[0] = 0
        x *= up / np.maximum(made[pattern].sum(1), 1e-12)
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 1e-9)
        if n < 1:
            break
        parts = tuple(int(v) for v in pattern[i] if v)
        for v in set(parts):
            n = min(n, int(left[v]) // parts.count(v))
        if n > 0:
            for v in parts:
                left[v] -= n
            out.append((parts, n))
    return out


def plan(hist: np.ndarray, length: int) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), by length and rank.

    The fitted counts are used whole and in lesser shares, down to none; the plan
    with the fewest sequences stands. Lesser shares leave more short pieces to fill
    the gaps of the long ones, which pays where lengths are few.
    """
    fitted = fit_patterns(hist, length)
    plans = (_packed(hist, length, [(p, int(n * share)) for p, n in fitted]) for share in (1.0, 0.75, 0.5, 0.25, 0.0))
    return min(plans, key=lambda p: p[0])[1]


def _packed(hist: np.ndarray, length: int, patterns: list[tuple[tuple[int, ...], int]]) -> tuple[int, np.ndarray]:
    """Number of sequences and plan rows of the patterns, and of the rest best-fit decreasing."""
    rank, rows, seqs = defaultdict(int), [], 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        rows.append((size, rank[size], n, first, offset))
        rank[size] += n

    for parts, n in patterns:
        if not n:
            continue
        offset = 0
        for size in parts:
            put(size, n, seqs, offset)
            offset += size
        seqs += n
    room: dict[int, deque] = defaultdict(deque)
    levels: list[int] = []

    def leave(first: int, n: int, used: int) -> None:
        free = length - used
        if n and free:
            if not room[free]:
                insort(levels, free)
            room[free].append((first, n, used))

    for size in range(length, 0, -1):
        n = int(hist[size]) - rank[size]
        while n > 0:
            at = bisect_left(levels, size)
            if at < len(levels):
                free = levels[at]
                first, have, used = room[free].popleft()
                if not room[free]:
                    levels.pop(at)
                take = min(n, have)
                put(size, take, first, used)
                leave(first + take, have - take, used)
                leave(first, take, used + size)
                n -= take
                continue
            each = length // size
            bins, rest = divmod(n, each)
            for k in range(each if bins else 0):
                put(size, bins, seqs, k * size)
            leave(seqs, bins, each * size)
            seqs += bins
            for k in range(rest):
                put(size, 1, seqs, k * size)
            if rest:
                leave(seqs, 1, rest * size)
                seqs += 1
            n = 0
    return seqs, np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = stored(pieces(docs, length, tokenizer), "pieces")
    found = cut.groupBy("length").count().collect()  # at most `length` rows
    hist = np.zeros(length + 1, np.int64)
    for r in found:
        hist[r["length"]] = r["count"]
    spark = docs.sparkSession
    shared = sent(spark, plan(hist, length))
    trim()
    groups = int(min(max(hist.sum() // 100_000, 64), 8192))

    salted = cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_g").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "_g").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_r", F.row_number().over(inside)).join(base, ["length", "_g"]).withColumn("rank", F.col("_base") + F.col("_r") - 1)
    ranked = ranked.select(*cut.columns, "rank")
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        keys = (p[:, 0] << 44) + p[:, 1]
        for pdf in batches:
            rank = pdf.pop("rank").to_numpy()
            at = np.searchsorted(keys, (pdf["length"].to_numpy() << 44) + rank, "right") - 1
            pdf["sequence_id"], pdf["offset"] = p[at, 3] + rank - p[at, 1], p[at, 4]
            yield pdf

    return ranked.mapInPandas(place, schema)
