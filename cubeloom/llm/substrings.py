"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``n`` bytes covers it that also starts anywhere else.
As in bucket-pointer refinement, positions start in buckets of equal q-grams and
buckets are split by the bucket identifiers of later offsets: the identifier of
2q bytes at i combines those of q bytes at i and i + q, so each level reuses the
one before (64, 128 and 256 bytes, then any length up to 768). Identifiers are
fingerprints of content, so every task gives the same ones without exchange.

Only sampled positions enter the buckets: each window of n bytes is filed under
its smallest q-gram identifier, leftmost first. Equal windows choose equal
q-grams at equal offsets, so nothing is missed, and one position stands for up
to n - q + 1 windows. Buckets of one member end there. The others are refined:

* all windows of a position at once, if another has the same bytes around it;
* else in blocks of 32 windows: equal unions repeat, cores met once do not;
* else window by window.

After each step one member stands for all that are equal, with their number, so
a passage in a third of all documents is counted by sums and never gathered.
Equal texts are treated once. Identifiers have 64 bits.

Null texts are empty. Repeated rows repeat each other, so they are removed. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import claim, stored, written

Q = 64
STEP = 32
CHUNK = 1 << 18
_BYTES = np.random.default_rng(10).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(11).integers(0, 1 << 64, 64, dtype=np.uint64)]
_S = np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a * _ODD[2 * level]
    x ^= x >> _S
    x += b
    x *= _ODD[2 * level + 1]
    x ^= x >> _S
    return x


def identifiers(raw: np.ndarray, size: int) -> np.ndarray:
    """Bucket identifier of the `size` bytes (a power of two) at each position."""
    h, at, level = _BYTES[raw], 1, 0
    while at < size:
        h = _mix(h[:-at], h[at:], level)
        at, level = 2 * at, level + 1
    return h


def stretch(h: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Identifier of `length` bytes at `start`, size <= length <= 3 * size, from those of `size` bytes."""
    last = start + length - size
    x = _mix(h[start], h[np.minimum(start + size, last)], 20)
    return _mix(_mix(x, h[last], 21), length.astype(np.uint64), 22)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    pad = -len(h) % width
    blocks = np.concatenate([h, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, n: int, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(position, first window, last window, identifier): the windows of n bytes
    that start from first to last are filed under the q-gram at position."""
    out, width, total = [], n - q + 1, len(text) - n + 1
    for c in range(0, total, CHUNK):
        raw = np.frombuffer(text[c : min(len(text), c + CHUNK + n - 1)], np.uint8)
        h = identifiers(raw, q)
        low = _sliding_min(h, width)
        edges = np.flatnonzero(low[1:] != low[:-1]) + 1
        starts, ends = [0, *edges.tolist()], [*(edges - 1).tolist(), len(low) - 1]
        for s0, s1, v in zip(starts, ends, low[starts].tolist(), strict=True):
            before = s0
            for p in (np.flatnonzero(h[s0 : s1 + width] == v) + s0).tolist():
                hi = min(s1, p)
                if before <= hi:
                    out.append((c + p, c + before, c + hi, v))
                    before = hi + 1
                if before > s1:
                    break
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _each(h: bytes, n: int) -> np.ndarray:
    """h n times, as an object: numpy's own byte strings lose their last zeros."""
    out = np.empty(n, object)
    out[:] = [h] * n
    return out


def _file(n: int):
    """One row per distinct anchor of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("substrings")
        for pdf in batches:
            hs, ids, rows, sizes = [], [], [], []
            for h, doc, text in zip(pdf["h"], pdf["doc_id"], pdf["text"], strict=True):
                found = anchors(text, n)
                hs.append(h)
                ids.append(doc)
                rows += found
                sizes.append(len(found))
            p, lo, hi, key = (np.array(x, np.uint64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.uint64),) * 4
            yield pd.DataFrame({"h": np.repeat(np.array(hs, object), sizes), "rep": np.repeat(np.array(ids, np.int64), sizes), "p": p.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "key": _signed(key)})

    return run


class _Rows:
    """Gathers rows as columns and hands them on in frames of a bounded size."""

    def __init__(self, *names: str) -> None:
        self.names, self.held, self.size = names, [], 0

    def add(self, size: int, *values) -> Iterator[pd.DataFrame]:
        self.held.append(values)
        self.size += size
        if self.size > 8_000_000:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.held:
            columns = zip(*self.held, strict=True)
            yield pd.DataFrame({k: np.concatenate(v) if isinstance(v[0], np.ndarray) and k not in _LISTS else list(v) for k, v in zip(self.names, columns, strict=True)})
        self.held, self.size = [], 0


_LISTS = ("ps", "los", "his", "cs", "keys", "wholes")


def _regions(n: int):
    """Bytes around neighbouring anchors, with the identifier of each anchor's whole reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows("h", "base", "body", *_LISTS)
        for pdf in batches:
            for h, text, *lists in zip(pdf["h"], pdf["text"], *(pdf[c] for c in _LISTS[:5]), strict=True):
                ps, los, his, cs, keys = (np.asarray(x) for x in lists)
                order = np.argsort(los, kind="stable")
                ps, los, his, cs, keys = (x[order] for x in (ps, los, his, cs, keys))
                at = 0
                while at < len(ps):
                    end = at + 1
                    while end < len(ps) and los[end] < his[end - 1] + n and his[end] + n - los[at] <= CHUNK:
                        end += 1
                    base = int(los[at])
                    p, lo, hi = (x[at:end].astype(np.int64) for x in (ps, los, his))
                    body = text[base : int(hi.max()) + n]
                    ids = identifiers(np.frombuffer(body, np.uint8), 256)
                    whole = _mix(_mix(stretch(ids, lo - base, hi - lo + n, 256), (p - lo).astype(np.uint64), 23), (p - hi + n).astype(np.uint64), 24)
                    yield from rows.add(len(body) + 60 * len(p), h, base, body, ps[at:end], los[at:end], his[at:end], cs[at:end], keys[at:end], _signed(whole))
                    at = end
        yield from rows.flush()

    return run


def _blocks(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows("h", "base", "lo", "hi", "t", "u", "core")
        for pdf in batches:
            for h, base, body, *lists in zip(pdf["h"], pdf["base"], pdf["body"], *(pdf[c] for c in ("ps", "los", "his", "ts")), strict=True):
                ids = identifiers(np.frombuffer(body, np.uint8), 256)
                p, lo, hi, t = (np.asarray(x, np.int64) for x in lists)
                first = (p - hi) // STEP
                many = (p - lo) // STEP - first + 1
                g = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                p, lo, hi, t = (np.repeat(x, many) for x in (p, lo, hi, t))
                last = p - STEP * g
                lo, hi = np.maximum(lo, last - STEP + 1), np.minimum(hi, last)
                u = _mix(_mix(stretch(ids, lo - base, hi - lo + n, 256), (p - lo).astype(np.uint64), 25), (p - hi + n).astype(np.uint64), 26)
                c = _mix(stretch(ids, last - base, np.full(len(p), n - STEP + 1), 256), g.astype(np.uint64), 27)
                yield from rows.add(50 * len(p), _each(h, len(p)), np.full(len(p), base, np.int32), lo.astype(np.int32), hi.astype(np.int32), t, _signed(u), _signed(c))
        yield from rows.flush()

    return run


def _windows(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows("h", "lo", "t", "w")
        for pdf in batches:
            for h, base, body, *lists in zip(pdf["h"], pdf["base"], pdf["body"], *(pdf[c] for c in ("los", "his", "ts")), strict=True):
                ids = identifiers(np.frombuffer(body, np.uint8), 256)
                lo, hi, t = (np.asarray(x, np.int64) for x in lists)
                many = hi - lo + 1
                s = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                w = stretch(ids, s - base, np.full(len(s), n), 256)
                yield from rows.add(30 * len(s), _each(h, len(s)), s.astype(np.int32), np.repeat(t, many), _signed(w))
        yield from rows.flush()

    return run


def repeated_spans(docs: DataFrame, n: int = 400) -> DataFrame:
    """h (md5 of a text's bytes), spans: array of (lo, hi), the first and last start
    of runs of repeated windows. docs: doc_id, text as bytes, h."""
    if not 256 + STEP <= n <= 768 - Q:
        raise ValueError("n must lie between 288 and 704")
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.coalesce(F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id"), F.lit(-(1 << 63)))
    long_enough = docs.where(F.length("text") >= n).withColumn("doc_id", number)
    filed = long_enough.select("h", "doc_id", "text").mapInPandas(_file(n), "h binary, rep long, p int, lo int, hi int, key long")
    filed = written(filed.groupBy("h", "p", "lo", "hi", "key").agg(F.count("*").alias("c"), F.min("rep").alias("rep")), "anchors")
    # A table of its own: a key of very many anchors is then split between tasks by the join.
    shared = written(filed.groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key"), "keys")
    live = filed.join(shared, "key", "left_semi")
    lists = live.groupBy("h").agg(F.min("rep").alias("doc_id"), *[F.collect_list(c).alias(f"{c}s") for c in ("p", "lo", "hi", "c", "key")])
    region = "h binary, base int, body binary, ps array<int>, los array<int>, his array<int>, cs array<long>, keys array<long>, wholes array<long>"
    regions = written(long_enough.select("h", "doc_id", "text").join(lists, ["h", "doc_id"]).mapInPandas(_regions(n), region), "regions")

    each = regions.select("h", "base", F.explode(F.arrays_zip(*_LISTS)).alias("a")).select("h", "base", *[F.col(f"a.{c}").alias(c[:-1]) for c in _LISTS])
    place = F.struct("h", "base", "p", "lo", "hi")
    kinds = stored(each.groupBy("whole").agg(F.sum("c").alias("t"), F.min(place).alias("at"), F.min("key").alias("key")), "kinds")
    several = lambda df, name: written(df.where("t > 1").select(name), name)  # noqa: E731  split where one is hot, as above
    done = each.join(several(kinds, "whole"), "whole", "left_semi").select("h", "lo", "hi")

    open_keys = kinds.where("t = 1").select("key").distinct()
    todo = kinds.join(open_keys, "key", "left_semi").select("at.*", "t").groupBy("h", "base").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("p", "lo", "hi", "t")])
    bodies = regions.select("h", "base", "body")
    blocks = bodies.join(todo, ["h", "base"]).mapInPandas(_blocks(n), "h binary, base int, lo int, hi int, t long, u long, core long")
    part = F.struct("h", "base", "lo", "hi")
    blocks = stored(blocks, "blocks")
    parts = stored(blocks.groupBy("u").agg(F.sum("t").alias("t"), F.min(part).alias("at"), F.min("core").alias("core")), "parts")
    done = done.unionByName(blocks.where("t = 1").join(several(parts, "u"), "u", "left_semi").select("h", "lo", "hi"))

    open_cores = parts.groupBy("core").agg(F.sum("t").alias("all"), F.max(F.col("t") == 1).alias("open")).where("all > 1 and open").select("core")
    todo = parts.join(open_cores, "core", "left_semi").select("at.*", "t").groupBy("h", "base").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("lo", "hi", "t")])
    windows = stored(bodies.join(todo, ["h", "base"]).mapInPandas(_windows(n), "h binary, lo int, t long, w long"), "windows")
    again = windows.groupBy("w").agg(F.sum("t").alias("t"))
    done = done.unionByName(windows.where("t = 1").join(several(again, "w"), "w", "left_semi").select("h", "lo", F.col("lo").alias("hi")))
    return done.groupBy("h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(n: int, names: list[str], keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                runs: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"] + n) for s in spans) if spans is not None else ():
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                kept, at = hashlib.sha256(), 0
                rest = []
                for lo, hi in runs:
                    rest.append(text[at:lo])
                    at = hi
                rest.append(text[at:])
                body = b"".join(rest)
                kept.update(body)
                out.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), body))
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            got.insert(0, "doc_id", pdf["doc_id"])
            yield got[names]

    return run


def remove_repeats(docs: DataFrame, n: int = 400, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    with keep_text, kept: the bytes that stay."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if keep_text else [])])
    joined = base.join(repeated_spans(base, n), "h", "left")
    return joined.select("doc_id", "text", "spans").mapInPandas(_cut(n, schema.names, keep_text), schema)
