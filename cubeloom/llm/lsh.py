"""Banded candidates and their exact verification, without the pairs of a bucket.

Items have an integer name k and a signature of ``bands * rows`` 16-bit samples.
Items that share a whole band are candidates, in rounds:

1. each member of a bucket with the bucket's smallest member, a number of pairs
   that grows with the items; these are verified and their components found;
2. in buckets that still hold several components, members of different components
   whose samples agree often enough: in small buckets all of them (where a
   verification is dear, each member's closest few first), in large ones each
   member's closest few;
3. in large buckets that hold several components yet, all members of different
   components, by products of their feature matrices, block by block, from which
   only spanning stars of the links come back.

Buckets are found by packed rows of entries, not by a row for each item and band.

What shares a bucket and a component needs no pair, so a group of copies, however
large, costs its own size. Two things can lose a link: its ends share no band, or
fewer than ``agree`` of their samples are equal where that is asked (round 2, and
round 1 if a verification is dear). The callers state both probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import mix, spanning_stars, stored, trimmed, written
from cubeloom.llm.components import components

BLOCK = 4000
EXACT_BLOCK = 500
SMALL = 64
FIRST = 3
PARTS = 4096
ENTRIES = 1 << 19
HOT = 64
Vector = tuple[np.ndarray, np.ndarray | None]


@dataclass(frozen=True)
class Kind:
    """What is compared, and how.

    signs: payloads of items to a matrix of samples. shares: similarities of payload
    or vector pairs. unpack: features and weights of one. vectors_of: from distinct k
    to k, vec, which may come several times; without it the payload is the vector.
    """

    bands: int
    rows: int
    agree: float
    similarity: float
    signs: Callable[[list[bytes]], np.ndarray]
    shares: Callable[[list[bytes], list[bytes]], np.ndarray]
    unpack: Callable[[bytes], Vector]
    vectors_of: Callable[[DataFrame], DataFrame] | None = None


def band_buckets(sigs: np.ndarray, bands: int) -> np.ndarray:
    """The bucket of each signature (a row of samples) in each band."""
    samples = sigs.reshape(len(sigs), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), samples.shape[:2])
    for s in range(samples.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + samples[:, :, s])
    return out


def _dealt(bands: int):
    """Entries (bucket, k) of items as packed rows, one of each part of the buckets. Of a bucket
    with many members here one goes on as "seed", the others as "member": they are known to share it."""

    def packed(role: str, bucket: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        # members need no meeting: they are dealt by place
        part = np.arange(len(k)) * PARTS // max(len(k), 1) if role == "member" else bucket >> np.uint64(52)
        cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(k)]), len(k)).astype(np.int32)
        blobs = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut * np.int32(8)), pa.py_buffer(x)]) for x in (bucket, k)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array([role] * (len(cut) - 1), pa.string()), *blobs], ["part", "role", "buckets", "ks"])

    def rows_of(sigs: list[np.ndarray], ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, at = np.unique(np.concatenate(ks), return_index=True)
        bucket, k = band_buckets(np.concatenate(sigs)[at], bands).ravel(), np.repeat(k, bands)
        order = np.argsort(bucket)
        bucket, k = bucket[order], k[order]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        n = np.diff(np.append(start, len(bucket)))
        hot = np.repeat(n >= HOT, n)
        yield packed("", bucket[~hot], k[~hot])
        if hot.any():
            bucket, k = bucket[hot], k[hot]
            order = np.lexsort((k, bucket))
            bucket, k = bucket[order], k[order]
            seed = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            yield packed("seed", bucket[seed], k[seed])
            yield packed("member", bucket[~seed], k[~seed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ks, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                sigs.append(as_signs(batch.column("sig").to_pylist()))
                ks.append(batch.column("k").to_numpy())
                size += batch.num_rows * bands
            if size >= ENTRIES:
                yield from rows_of(sigs, ks)
                sigs, ks, size = [], [], 0
        if size:
            yield from rows_of(sigs, ks)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows in the order of their parts, the entries of buckets that several items share,
    with the smallest; hot buckets, of which members are known elsewhere, are marked, and such members have no first."""

    def batch_of(bucket: np.ndarray, first: np.ndarray | None, k: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        firsts = pa.nulls(len(k), pa.int64()) if first is None else pa.array(first)
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), firsts, pa.array(k), pa.array(hot)], ["bucket", "first", "k", "hot"])

    def met(rows: list[tuple[bytes, bytes, bool]]) -> pa.RecordBatch:
        bucket, k = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in ((0, np.uint64), (1, np.int64)))
        seed = np.repeat([r[2] for r in rows], [len(r[0]) // 8 for r in rows])
        order = np.argsort(bucket)
        b = bucket[order]
        same = np.concatenate([[False], b[1:] == b[:-1], [False]])
        order = order[same[:-1] | same[1:] | seed[order]]  # few of many
        order = order[np.lexsort((k[order], bucket[order]))]
        bucket, k, seed = bucket[order], k[order], seed[order]
        start = np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(k)]
        of = np.cumsum(start) - 1
        hot = np.bincount(of, weights=seed).astype(bool)[of]
        once = start | np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        keep = once & ((np.bincount(of, weights=once)[of] > 1) | hot)
        return batch_of(bucket[keep], k[start][of][keep], k[keep], hot[keep])

    rows, size, last = [], 0, None
    for batch in batches:
        for part, role, buckets, ks in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "buckets", "ks")), strict=True):
            if role == "member":
                own = np.frombuffer(ks, np.int64)
                yield batch_of(np.frombuffer(buckets, np.uint64), None, own, np.ones(len(own), bool))
                continue
            if part != last and size >= ENTRIES:
                yield met(rows)
                rows, size = [], 0
            rows.append((buckets, ks, role == "seed"))
            size += len(ks) // 8
            last = part
    if rows:
        yield met(rows)


def shared_buckets(items: DataFrame, bands: int) -> DataFrame:
    """bucket, first (its smallest k) and k of items (k, sig) that share a band with another, each once.

    Entries are shuffled and met in packed rows: few of many share a bucket. A task holds one part of
    the buckets at a time, and few members of a bucket from each that deals them, however large it is.
    """
    dealt = items.select("k", "sig").mapInArrow(trimmed(_dealt(bands)), "part int, role string, buckets binary, ks binary")
    met = written(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(_met), "bucket long, first long, k long, hot boolean"), "shared")
    hot = met.where("hot")
    if hot.isEmpty():
        return met.select("bucket", "first", "k")
    firsts = hot.where("first is not null").select("bucket", "first").distinct()
    return written(met.where("not hot").select("bucket", "first", "k").union(hot.select("bucket", "k").distinct().join(firsts, "bucket").select("bucket", "first", "k")), "shared")


def _differing(x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray, least: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures in different components that agree enough; with
    ``most``, for each x the closest few only."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for s in range(x.shape[1]):
        same += x[:, s, None] == y[None, :, s]
    fit = (same >= least * x.shape[1]) & (xc[:, None] != yc[None, :])
    if most is not None and len(y) > most:
        rank = np.where(fit, same, 0)
        best = np.argpartition(-rank.astype(np.int16), most - 1, axis=1)[:, :most]
        i = np.repeat(np.arange(len(x)), most)
        j = best.ravel()
        keep = fit[i, j]
        return i[keep], j[keep]
    return np.nonzero(fit)


def _pairs(xk: np.ndarray, yk: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(xk[i], yk[j]), "b": np.maximum(xk[i], yk[j])})


def as_signs(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)


def _blockwise(kind: Kind, most: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        if len(left) and len(right):
            x, y = kind.signs(left["body"].tolist()), kind.signs(right["body"].tolist())
            xk, yk, xc, yc = (d[c].to_numpy() for c in ("k", "root") for d in (left, right))
            roots, n = np.unique(np.concatenate([xc, yc]), return_counts=True)
            top = roots[n.argmax()]  # its members need not be compared with each other
            for rows, cols in ((np.flatnonzero(xc != top), np.arange(len(y))), (np.flatnonzero(xc == top), np.flatnonzero(yc != top))):
                for at in range(0, len(rows) if len(cols) else 0, 256):
                    r = rows[at : at + 256]
                    i, j = _differing(x[r], y[cols], xc[r], yc[cols], kind.agree, most)
                    out.append(_pairs(xk[r], yk[cols], i, j))
        return pd.concat(out).drop_duplicates()

    return run


def _rowwise(kind: Kind, most: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sizes = pdf["ks"].map(len).to_numpy()
            every = kind.signs([x for body in pdf["bodys"] for x in body]) if len(pdf) else None
            at = 0
            for n, ks, roots in zip(sizes.tolist(), pdf["ks"], pdf["roots"], strict=True):
                x, k, c = every[at : at + n], np.asarray(ks), np.asarray(roots)
                at += n
                i, j = _differing(x, x, c, c, kind.agree, most)
                a.append(np.minimum(k[i], k[j]))
                b.append(np.maximum(k[i], k[j]))
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def share(x: Vector, y: Vector) -> float:
    """Weighted Jaccard similarity of two vectors: sorted features, and their weights
    (1 each for None), which depend on the feature alone."""
    wx, wy = (len(v[0]) if v[1] is None else float(v[1].sum(dtype=np.float64)) for v in (x, y))
    _, i, _ = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = len(i) if x[1] is None else float(x[1][i].sum(dtype=np.float64))
    return both / max(wx + wy - both, 1e-12)


def _dense(vectors: list[Vector], features: np.ndarray, weighted: bool) -> np.ndarray:
    out = np.zeros((len(vectors), len(features)), np.float32)
    for r, (ids, w) in enumerate(vectors):
        at = np.searchsorted(features, ids)
        at[at == len(features)] = 0
        hit = features[at] == ids
        out[r, at[hit]] = w[hit] if weighted and w is not None else 1.0
    return out


def link_matrix(left: list[Vector], right: list[Vector], apart: np.ndarray, similarity: float) -> np.ndarray:
    """True where a pair that is apart reaches the similarity."""
    known = np.unique(np.concatenate([v[0] for v in right]))
    weight = [np.array([len(v[0]) if v[1] is None else v[1].sum(dtype=np.float64) for v in side]) for side in (left, right)]
    out = np.zeros(apart.shape, bool)
    for a in range(0, len(left), 128):
        some = left[a : a + 128]
        features = np.intersect1d(np.concatenate([v[0] for v in some]), known)
        if not len(features):
            continue
        x, step = _dense(some, features, True), max(16, 8_000_000 // len(features))
        for b in range(0, len(right), step):
            both = (x @ _dense(right[b : b + step], features, False).T).astype(np.float64)
            j = both / np.maximum(weight[0][a : a + 128, None] + weight[1][None, b : b + step] - both, 1e-12)
            open_ = apart[a : a + 128, b : b + step]
            out[a : a + 128, b : b + step] = open_ & (j >= similarity + 1e-4)
            for r, c in zip(*np.nonzero(open_ & (np.abs(j - similarity) < 1e-4)), strict=True):  # too close for single precision
                out[a + r, b + c] = share(left[a + r], right[b + c]) >= similarity
    return out


def _exact(unpack: Callable[[bytes], Vector], similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        lk, rk, lc, rc = (d[c].to_numpy() for c in ("k", "root") for d in (left, right))
        x, y, apart = [unpack(v) for v in left["vec"]], [unpack(v) for v in right["vec"]], lc[:, None] != rc[None, :]
        # pairs within the commonest component need no product: often most of a block
        roots, n = np.unique(np.concatenate([lc, rc]), return_counts=True)
        top = roots[n.argmax()]
        linked = np.zeros(apart.shape, bool)
        for rows, cols in ((np.flatnonzero(lc != top), np.arange(len(y))), (np.flatnonzero(lc == top), np.flatnonzero(rc != top))):
            if len(rows) and len(cols):
                at = np.ix_(rows, cols)
                linked[at] = link_matrix([x[i] for i in rows], [y[j] for j in cols], apart[at], similarity)
        row, col = spanning_stars(linked)
        r, c = row >= 0, col >= 0
        return pd.DataFrame({"a": np.concatenate([lk[r], rk[c]]), "b": np.concatenate([rk[row[r]], rk[col[c]]])})

    return run


def _blocked(rows: DataFrame, payload: str, size: int) -> DataFrame:
    """Rows of each pair of blocks of a bucket: bucket, i, j, side, k, root, payload."""
    cut = rows.withColumn("nb", F.ceil(F.col("n") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    spread = cut.select("bucket", "k", payload, "root", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    left = spread.where("own <= other").select("bucket", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "k", payload, "root")
    return left.unionByName(spread.where("other <= own").select("bucket", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "k", payload, "root"))


def linked_components(items: DataFrame, kind: Kind) -> DataFrame:
    """k, root of every item with a link. items: k, sig and body, the payload; an item
    may come several times, with the same sig and body."""
    kind, vectors_of = replace(kind, vectors_of=None), kind.vectors_of  # what goes to executors holds no table
    shared = shared_buckets(items, kind.bands)
    live = written(items.select("k", "body").join(shared.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]), "live")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kind.shares(pdf["xa"].tolist(), pdf["xb"].tolist()) >= kind.similarity][["a", "b"]]

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = kind.signs(pdf["xa"].tolist()), kind.signs(pdf["xb"].tolist())
                yield pdf[(x == y).mean(1) >= kind.agree][["a", "b"]]

    def with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        of = of.toDF("k", "x")
        return pairs.join(of.select(F.col("k").alias("a"), F.col("x").alias("xa")), "a").join(of.select(F.col("k").alias("b"), F.col("x").alias("xb")), "b").select("a", "b", "xa", "xb")

    def verified(pairs: DataFrame) -> DataFrame:
        vectors = live
        if vectors_of:
            vectors = stored(vectors_of(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()), "vectors")
        found = written(with_both(pairs, vectors).mapInPandas(check, "a long, b long"), "links")
        if vectors_of:
            vectors.unpersist()
        return found

    def mixed(links: DataFrame) -> DataFrame:
        """Members of buckets of three or more that hold several components."""
        roots = components(links).select(F.col("node").alias("k"), "root")
        member = shared.join(roots, "k", "left").select("bucket", "first", "k", F.coalesce("root", "k").alias("root"))
        several = member.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 and n > 2").select("bucket", "n")
        return written(member.join(several, "bucket"), "mixed")

    def small_pairs(rows: DataFrame, most: int | None) -> DataFrame:
        """Pairs in the small buckets; those of one first member, at most one a band, are taken together."""
        once = rows.where(F.col("n") <= SMALL).select("first", "k", "root").distinct()
        listed = once.join(live, "k").groupBy("first").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("k", "root", "body")])
        return listed.mapInPandas(_rowwise(kind, most), "a long, b long")

    def large_pairs(rows: DataFrame) -> DataFrame:
        return _blocked(rows.where(F.col("n") > SMALL).join(live, "k"), "body", BLOCK).groupBy("bucket", "i", "j").applyInPandas(_blockwise(kind, FIRST), "a long, b long")

    def fresh(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        return written(pairs.where("a <> b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")

    dear = vectors_of is not None
    tried = shared.where(F.col("k") != F.col("first")).select(F.col("first").alias("a"), F.col("k").alias("b")).distinct()
    if dear:
        tried = written(with_both(tried, live).mapInPandas(agreeing, "a long, b long"), "pairs")
    links = verified(tried)

    rest = mixed(links)
    near = fresh(small_pairs(rest, FIRST if dear else None).union(large_pairs(rest)), tried)
    if not near.isEmpty():
        links = links.union(verified(near))
        if dear:
            tried, rest = tried.union(near), mixed(links)
            few = fresh(small_pairs(rest, None), tried)
            links = links.union(verified(few))
    many = rest.where(F.col("n") > SMALL)
    if not many.isEmpty():
        many = mixed(links).where(F.col("n") > SMALL)
        vectors = stored(vectors_of(many.select("k").distinct()), "vectors") if vectors_of else live.toDF("k", "vec")
        exact = _blocked(many.join(vectors, "k"), "vec", EXACT_BLOCK).groupBy("bucket", "i", "j").applyInPandas(_exact(kind.unpack, kind.similarity), "a long, b long")
        links = links.union(written(exact.where("a <> b").distinct(), "links"))
    return components(links).select(F.col("node").alias("k"), "root")
