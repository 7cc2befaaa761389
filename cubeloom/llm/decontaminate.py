"""Benchmark decontamination by latent semantic retrieval.

Documents are turned into word hashes once; passages are windows of 32 words, 16
apart, over whole documents; items are the benchmark's texts. Words are weighted by
the square root of their number times the inverse document frequency over all
documents, in 2^20 features.

The matrix A holds the passages that features of the items make up half of the length
of (others cannot have a cosine of a half with an item), in the columns of the items'
features. A distributed randomised SVD of A (a block of random vectors sent through
A'A, a power step, an orthonormal basis Q, then the eigenvectors of Q'A'AQ) gives its
leading RANK directions, the latent space. Passages and items that are close there
are candidates. So are those of an index from each item's rarest words to the item
(``Held``), which finds every stretch that holds enough of an item's words, whether
or not the latent space has a direction for it: no copy is lost to the truncation.

Candidates are compared word by word. A stretch is a copy if its longest common
subsequence with the item covers enough of the item, and enough of its answer, which
is its last sentence. It is a paraphrase if passage and item are close in the latent
space, it holds most of the item's weight in any order, some of it in order, and most
of the answer's words.

Items are taken in blocks of bounded size, each against all documents. Beyond a count
of candidates, they meet the words of documents in a shuffled join, which a filter of
fixed size spares most documents without candidates. Null texts
are empty; items without words match nothing; equal items are reported each. Rows
that repeat a doc_id are one document to the result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import sent, stored, trimmed, written
from cubeloom.llm.counters import BITS, MASK, document_frequencies, word_hashes
from cubeloom.llm.licenses import words

WINDOW, STRIDE = 32, 16
LEAST_SHARE = 0.5
LEAST_COSINE = 0.5
#: Least latent cosine, weight of the item in any order, share of it in order, and share of the answer's words.
PARAPHRASE = 0.7, 0.7, 0.3, 0.6
#: Share of the words a match needs that must be among the item's rarest; any value loses nothing.
RARE = 0.3
RANK, OVER = 96, 16
BLOCK_ITEMS, BLOCK_WORDS = 512, 40_000
#: Row ranges of a dense matrix that are added up apart.
PARTS = 64
#: Bits of the filter of documents with candidates, in bitmaps of 2^15: at most 8 MB (17 MB as a broadcast table), whatever the number of documents.
FILTER_BITS = 26
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def features(ws: list[bytes]) -> np.ndarray:
    return (word_hashes(ws) >> np.uint64(20)).astype(np.uint32)


def answer_length(text: str, total: int) -> int:
    """Words of the last sentence; of the last third if there is one sentence only."""
    parts = [p for p in _SENTENCE.split(text.strip()) if words(p.encode())]
    return len(words(parts[-1].encode())) if len(parts) > 1 else max(1, total // 3)


def common_subsequence(masks: dict, other: list, size: int) -> int:
    """Length of the longest common subsequence; masks: word -> bits of its places in the item."""
    v = (1 << size) - 1
    full = v
    for w in other:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(ws: list[bytes]) -> dict:
    out: dict[bytes, int] = {}
    for i, w in enumerate(ws):
        out[w] = out.get(w, 0) | 1 << i
    return out


def reach_of(m: int) -> int:
    """Words of a stretch that is compared with an item of m words."""
    return m + m // 4 + 4


def least_share(m: int, need: float) -> float:
    return need if m >= 10 else max(need, 0.9)


def match(item: list[bytes], answer: int, doc: list[bytes], lo: int, hi: int, need: float, need_answer: float) -> tuple[float, float]:
    """Best share of the item, and of its answer there, found in doc[lo:hi], in any
    stretch a quarter longer than the item. Stretches begin with a word of the item,
    and those without enough of its words are passed over."""
    m = len(item)
    masks, tail = _masks(item), _masks(item[m - answer :])
    reach, times = reach_of(m), {w: b.bit_count() for w, b in masks.items()}
    places = [p for p in range(lo, hi) if doc[p] in masks]
    other = [doc[p] for p in places]
    best, held, end = (0.0, 0.0), 0, 0
    left = times.copy()  # of each word, how many more would count
    for k, at in enumerate(places):
        while end < len(places) and places[end] < at + reach:
            held += left[other[end]] > 0
            left[other[end]] -= 1
            end += 1
        bar = max(need, best[0] if best[1] >= need_answer else 0.0)
        if held / m >= bar:
            share = common_subsequence(masks, other[k:end], m) / m
            if share >= bar:
                got = common_subsequence(tail, other[k:end], answer) / answer
                if (got >= need_answer, share, got) > (best[1] >= need_answer, *best):
                    best = share, got
        left[other[k]] += 1
        held -= left[other[k]] > 0
    return best


def paraphrase(item: list, answer: int, doc: list, lo: int, hi: int, weight: dict) -> tuple[float, float, float]:
    """Of the stretch of doc[lo:hi] that holds most of the item's weight, in any order:
    that share, the share of the item in order, and the share of the answer's words."""
    m = len(item)
    left = dict.fromkeys(item, 0)
    for w in item:
        left[w] += 1
    total = sum(weight[w] for w in item)
    places = [p for p in range(lo, hi) if doc[p] in left]
    other = [doc[p] for p in places]
    held, best, at, end, reach = 0.0, (0.0, 0, 0), 0, 0, reach_of(m)
    for k, p in enumerate(places):
        while end < len(places) and places[end] < p + reach:
            held += weight[other[end]] if left[other[end]] > 0 else 0.0
            left[other[end]] -= 1
            end += 1
        if held > best[0] + 1e-9:
            best = held, k, end
        left[other[k]] += 1
        held -= weight[other[k]] if left[other[k]] > 0 else 0.0
    held, at, end = best
    some = other[at:end]
    tail, there = item[m - answer :], {}
    for w in some:
        there[w] = there.get(w, 0) + 1
    got = 0
    for w in tail:
        if there.get(w, 0) > 0:
            there[w] -= 1
            got += 1
    return held / max(total, 1e-12), common_subsequence(_masks(item), some, m) / m, got / answer


class Held:
    """Index from the rarest words of items to the items.

    A match needs `least` of the m words of an item in a stretch. All but least - k
    of these are among any m - least + k of its words, so a stretch with fewer than
    k of the rarest holds no match. Where there are k, all words are counted.
    """

    def __init__(self, slots: list[np.ndarray], idf: np.ndarray, need: float) -> None:
        sizes = [len(s) for s in slots]
        least = [max(1, math.ceil(least_share(m, need) * m - 1e-9)) for m in sizes]
        some = [max(1, round(RARE * n)) for n in least]
        rare = [np.unique(s[np.lexsort((s, -idf[s]))][: m - n + k]) for s, m, n, k in zip(slots, sizes, least, some, strict=True)]
        self.least, self.some, self.reach = np.array(least), np.array(some), np.array([reach_of(m) for m in sizes])
        word, item = np.concatenate(rare), np.repeat(np.arange(len(slots)), [len(r) for r in rare])
        order = np.argsort(word, kind="stable")
        self.item = item[order]
        self.words, self.first, self.times = np.unique(word[order], return_index=True, return_counts=True)
        self.at = np.full(1 << BITS, -1, np.int32)
        self.at[self.words] = np.arange(len(self.words))
        self.every = np.unique(np.concatenate(slots))
        self.has = np.zeros((len(slots), len(self.every) + 1), bool)
        for i, s in enumerate(slots):
            self.has[i, np.searchsorted(self.every, s)] = True
        self.column = np.full(1 << BITS, -1, np.int32)
        self.column[self.every] = np.arange(len(self.every))

    def find(self, slot: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a word, item) of all stretches that may match, a place every few words;
        slot: the words of documents that begin at first and have size words."""
        at = self.at[slot]
        places = np.flatnonzero(at >= 0)
        at = at[places]
        n = self.times[at]
        item = self.item[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        place = np.repeat(places, n)
        doc = np.searchsorted(first, place, "right") - 1
        key = doc * len(self.some) + item
        order = np.argsort(key, kind="stable")
        key, place, item, doc = key[order], place[order], item[order], doc[order]
        far = np.arange(len(key)) + self.some[item] - 1
        inside = far < len(key)
        far = np.where(inside, far, 0)
        hit = np.flatnonzero(inside & (key[far] == key) & (place[far] - place < self.reach[item]))
        if not len(hit):
            return place[:0], item[:0]
        cell = key[hit], (place[hit] - first[doc[hit]]) // STRIDE
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(cell[0]) != 0) | (np.diff(cell[1]) != 0)]))
        last = np.append(edge[1:], len(hit)) - 1
        column, keep = self.column[slot], []
        for a, b in zip(hit[edge].tolist(), hit[last].tolist(), strict=True):
            i, begin = item[a], first[doc[a]]
            reach = self.reach[i]
            lo, hi = max(begin, place[far[a]] - reach + 1), min(begin + size[doc[a]], place[b] + reach)
            count = np.cumsum(self.has[i, column[lo:hi]])
            most = count[-1] if hi - lo <= reach else max(count[reach - 1], (count[reach:] - count[:-reach]).max())
            if most >= self.least[i]:
                keep.append(a)
        return place[keep], item[keep]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Basis of the columns' span; directions that add nothing are left out."""
    q, r = np.linalg.qr(x)
    size = np.abs(np.diag(r))
    return q[:, size > 1e-8 * max(size.max(initial=0.0), 1e-300)]


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = pdf["ids"].map(len).to_numpy()
    ids = np.concatenate(pdf["ids"].to_list()).astype(np.int64)
    weight = np.concatenate(pdf["weights"].to_list()).astype(np.float64)
    return ids, weight, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pdf)), sizes)


def _parts(total: np.ndarray, salt: int) -> pd.DataFrame:
    """A dense matrix in row ranges."""
    cuts = np.linspace(0, len(total), min(PARTS, len(total)) + 1).astype(int)
    n = len(cuts) - 1
    return pd.DataFrame({"part": np.arange(n, dtype=np.int32), "salt": np.full(n, salt, np.int32), "body": [total[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]})


def gram_product(passages: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'A block, for a block of as many rows as there are features."""
    shared = sent(passages.sparkSession, block.astype(np.float32))
    shape = block.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, salt = np.zeros(shape), 0
        for whole in batches:
            for c in range(0, len(whole), 1000):
                ids, weight, starts, row = _rows(whole.iloc[c : c + 1000])
                weight = weight.astype(np.float32)[:, None]
                through = np.add.reduceat(shared.value[ids] * weight, starts)[row] * weight
                order = np.argsort(ids, kind="stable")
                uniq, first = np.unique(ids[order], return_index=True)
                total[uniq] += np.add.reduceat(through[order], first)
                salt = (salt * 31 + len(ids)) % 61
        if total.any():
            yield _parts(total, salt)

    return _added_up(passages, run, shape)


def projected_gram(passages: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(A basis)'(A basis)."""
    shared = sent(passages.sparkSession, basis.astype(np.float32))
    width = basis.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, salt = np.zeros((width, width)), 0
        for whole in batches:
            for c in range(0, len(whole), 1000):
                ids, weight, starts, _ = _rows(whole.iloc[c : c + 1000])
                through = np.add.reduceat(shared.value[ids] * weight[:, None].astype(np.float32), starts)
                total += through.T @ through
                salt = (salt * 31 + len(ids)) % 61
        if total.any():
            yield _parts(total, salt)

    return _added_up(passages, run, (width, width))


def _added_up(passages: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices that run() makes of the passages: row range by row range, in
    two steps, so that no task holds more than a 64th of what a 61st of all tasks made."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["body"].iloc[0]).copy()
        for b in pdf["body"].iloc[1:]:
            total += np.frombuffer(b)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "salt": np.zeros(1, np.int32), "body": [total.tobytes()]})

    kind = "part int, salt int, body binary"
    found = passages.select("ids", "weights").mapInPandas(run, kind).groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind).collect()
    out = np.zeros(shape)
    cuts = np.linspace(0, shape[0], min(PARTS, shape[0]) + 1).astype(int)
    for r in found:
        i, j = cuts[r["part"]], cuts[r["part"] + 1]
        out[i:j] = np.frombuffer(r["body"]).reshape(j - i, shape[1])
    return out


def latent_basis(passages: DataFrame, features: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of the passages: features x at most rank."""
    q = np.random.default_rng(9).standard_normal((features, min(rank + OVER, features)))
    for _ in range(2):
        q = _orthonormal(gram_product(passages, q))
        if not q.shape[1]:
            return q
    values, vectors = np.linalg.eigh(projected_gram(passages, q))
    lead = np.argsort(-values)[:rank]
    return q @ vectors[:, lead[values[lead] > 1e-9 * values.max()]]


def _blocks(items: Iterator) -> Iterator[list]:
    block, size = [], 0
    for it in items:
        if block and (len(block) >= BLOCK_ITEMS or size + len(it[1]) > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append(it)
        size += len(it[1])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, need: float = 0.6, need_answer: float = 0.5, most_broadcast: int = 300_000) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine
    (latent), overlap (share of the item's words in order), answer (share of its
    answer's), cover (share of its weight in any order; null for copies)."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": [features(words(t)).tobytes() for t in pdf["text"]]})

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    base = written(base.mapInPandas(trimmed(tokens), f"doc_id {id_type}, words binary"), "words").where(F.length("words") > 0)
    frequency, total = document_frequencies(base.select("words"), lambda t: np.unique(np.frombuffer(t, np.uint32) & MASK))
    total = max(total, 1)
    idf = np.log((1.0 + total) / (1.0 + np.minimum(frequency, total))).astype(np.float32)
    shared_idf = sent(spark, idf)
    schema = f"doc_id {id_type}, item_id {item_type}, cosine double, overlap double, answer double, cover double"
    out = spark.createDataFrame([], schema)
    read = ((r["item_id"], words((r["text"] or "").encode()), r["text"] or "") for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator())
    for block in _blocks(it for it in read if it[1]):
        out = out.unionByName(_block_leaks(base, block, idf, shared_idf, schema, id_type, need, need_answer, most_broadcast))
    best = F.struct(F.col("cover").isNull().alias("copy"), "overlap", "answer", "cosine", "cover")
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", *[f"b.{c}" for c in ("cosine", "overlap", "answer", "cover")])


def _marked(base: DataFrame, found: DataFrame) -> DataFrame:
    """base without most of the documents that found does not name: one bit a hash of
    doc_id, so that some others stay, but all that are named do."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bucket, bit = F.shiftright(place, 15).cast("int"), place.bitwiseAND(F.lit((1 << 15) - 1))
    # dealt before they are made: a bitmap has its full size however few bits are set
    bits = found.select(bucket.alias("_bucket"), bit.alias("_bit")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return base.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket").where(is_set).select(base.columns)


def _block_leaks(base: DataFrame, block: list, idf: np.ndarray, shared_idf, schema: str, id_type: str, need: float, need_answer: float, most_broadcast: int) -> DataFrame:
    spark = base.sparkSession
    slots = np.unique(np.concatenate([features(ws) & MASK for _, ws, _ in block]))
    column = np.full(1 << BITS, -1, np.int32)
    column[slots] = np.arange(len(slots))
    items = np.zeros((len(block), len(slots)))
    for i, (_, ws, _) in enumerate(block):
        c = column[features(ws) & MASK]
        np.add.at(items[i], c[c >= 0], 1.0)
    items = np.sqrt(items) * idf[slots]
    lengths = np.sqrt((items * items).sum(1))
    items /= np.maximum(lengths, 1e-12)[:, None]
    shared_column = sent(spark, column)
    shared_held = sent(spark, Held([features(ws) & MASK for _, ws, _ in block], idf, need))

    def some(docs: list[tuple], weights: np.ndarray, squares: np.ndarray, shared: np.ndarray) -> list[tuple]:
        columns = shared_column.value
        size = np.array([len(s) for _, s in docs])
        first = np.cumsum(size) - size
        slot = np.concatenate([s for _, s in docs])
        held, every = np.zeros(len(slot) + 1), np.zeros(len(slot) + 1)
        np.cumsum(shared[slot], out=held[1:])
        np.cumsum(squares[slot], out=every[1:])
        windows = -(-np.maximum(1, size - WINDOW + STRIDE) // STRIDE)
        before = np.cumsum(windows) - windows
        doc = np.repeat(np.arange(len(docs)), windows)
        at = (np.arange(len(doc)) - before[doc]) * STRIDE
        start = first[doc] + at
        end = np.minimum(start + WINDOW, first[doc] + size[doc])
        mine, norm = held[end] - held[start], every[end] - every[start]
        wanted: dict[int, set[int]] = {int(k): set() for k in np.flatnonzero((mine > 1e-9) & (mine >= LEAST_SHARE**2 * norm))}
        place, item = shared_held.value.find(slot, first, size)
        of = np.searchsorted(first, place, "right") - 1
        for k, i in zip((before[of] + np.minimum((place - first[of]) // STRIDE, windows[of] - 1)).tolist(), item.tolist(), strict=True):
            wanted.setdefault(k, set()).add(i)
        rows = []
        for k, items_held in wanted.items():
            part = columns[slot[start[k] : end[k]]]
            ids, n = np.unique(part[part >= 0], return_counts=True)
            size_k = float(np.sqrt(max(norm[k], 1e-12)))
            w = np.sqrt(n) * weights[slots[ids]] / size_k
            rows.append((docs[doc[k]][0], int(at[k]), size_k, ids.astype(np.int32), w.astype(np.float32), sorted(items_held)))
        return rows

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, columns = shared_idf.value, shared_column.value
        squares = weights.astype(np.float64) ** 2
        shared = np.where(columns >= 0, squares, 0.0)
        for pdf in batches:
            rows, docs, n = [], [], 0
            for doc_id, body in zip(pdf["doc_id"], pdf["words"], strict=True):
                slot = np.frombuffer(body, np.uint32) & MASK
                docs.append((doc_id, slot))
                n += len(slot)
                if n > 100_000:
                    rows += some(docs, weights, squares, shared)
                    docs, n = [], 0
            if docs:
                rows += some(docs, weights, squares, shared)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "norm", "ids", "weights", "held"])

    passages = written(base.mapInPandas(trimmed(reduce), f"doc_id {id_type}, start int, norm double, ids array<int>, weights array<float>, held array<int>"), "passages")
    basis = latent_basis(passages.where("norm > 0"), len(slots))
    latent = items @ basis
    # a passage is at most WINDOW / m of an item of m words: the bar of long items falls with that
    part = np.minimum(1.0, 2 * WINDOW / np.array([len(ws) for _, ws, _ in block]))
    latent /= np.maximum(np.sqrt((latent * latent).sum(1)), 0.1)[:, None]  # an item that is hardly in the space is close to nothing
    shared = sent(spark, (basis.astype(np.float32), latent.astype(np.float32), (LEAST_COSINE * np.sqrt(part)).astype(np.float32)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, q, least_cosine = shared.value
        for whole in batches:
            for c in range(0, len(whole), 1000):
                pdf = whole.iloc[c : c + 1000]
                ids, weight, starts, _ = _rows(pdf)
                p = np.add.reduceat(v[ids] * weight[:, None].astype(np.float32), starts)
                # the length over all of a passage's words, not those of items alone
                cosine = p @ q.T / np.maximum(np.sqrt((p * p).sum(1)), 0.5)[:, None]
                close = cosine >= least_cosine
                for r, held in enumerate(pdf["held"]):
                    if len(held):
                        close[r, held] = True
                i, j = np.nonzero(close)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i], "start": pdf["start"].to_numpy()[i], "item": j.astype(np.int32), "cosine": cosine[i, j].astype(np.float64)})

    found = stored(passages.mapInPandas(search, f"doc_id {id_type}, start int, item int, cosine double"), "candidates")
    wanted = found.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("start", "item", "cosine")])
    if found.count() <= most_broadcast:  # three numbers each
        wanted = F.broadcast(wanted)
    else:  # few documents have candidates: only their words are shuffled
        base = _marked(base, found)
    known = [(item_id, f := features(ws).tolist(), answer_length(text, len(ws)), {w: float(idf[w & int(MASK)]) for w in f}) for item_id, ws, text in block]
    texts = sent(spark, known)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, body, starts, which, cosines in zip(pdf["doc_id"], pdf["words"], pdf["starts"], pdf["items"], pdf["cosines"], strict=True):
                doc = np.frombuffer(body, np.uint32).tolist()
                spans: dict[int, list] = {}
                for i, start, cosine in sorted(zip(which, starts, cosines, strict=True)):
                    reach = reach_of(len(texts.value[i][1]))
                    lo, hi = max(0, start - reach), min(len(doc), start + WINDOW + reach)
                    found = spans.setdefault(i, [])
                    if found and lo <= found[-1][1]:  # stretches of neighbours are compared once
                        found[-1][1:] = max(hi, found[-1][1]), max(cosine, found[-1][2])
                    else:
                        found.append([lo, hi, cosine])
                for i, found in spans.items():
                    item_id, ws, answer, weight = texts.value[i]
                    bar = least_share(len(ws), need)
                    for lo, hi, cosine in found:
                        got = match(ws, answer, doc, lo, hi, bar, need_answer)
                        if got[0] >= bar and got[1] >= need_answer:
                            rows.append((doc_id, item_id, cosine, *got, None))
                        elif cosine >= PARAPHRASE[0] and len(ws) >= 10:
                            cover, order, ending = paraphrase(ws, answer, doc, lo, hi, weight)
                            if cover >= PARAPHRASE[1] and order >= PARAPHRASE[2] and ending >= PARAPHRASE[3]:
                                rows.append((doc_id, item_id, cosine, order, ending, cover))
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "overlap", "answer", "cover"])
            yield out.astype({"cover": "float64"})

    named = wanted.withColumnRenamed("doc_id", "_doc")
    return base.join(named, base["doc_id"].eqNullSafe(named["_doc"])).select("doc_id", "words", "starts", "items", "cosines").mapInPandas(verify, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")
