"""Near-duplicate lines by MinHash of character shingles.

A line is what stands between line feeds; white space is levelled and letters are
lower-cased before lines are compared, and lines of white space only take no part.
Features are the distinct runs of 8 bytes (the whole line if it is shorter).
Signatures of 27 minima (16 bits of each) in 9 bands of 3 make candidates, exact Jaccard similarity
decides, and of each connected component the first line stays: the one with the
smallest doc_id and line number. Two lines of similarity 0.8 share a band with
probability 0.998; where a bucket holds several components yet, 15 of 27 samples
must agree as well, as they do with probability 0.999. Equal lines are one line from
the start.

Null texts are empty. Rows that repeat a doc_id are compared like others; of their
equal lines one stays, if their texts are equal both rows keep it. Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import claim, mix, trimmed, written
from cubeloom.llm.lsh import Kind, as_signs, linked_components

WIDTH = 8
BANDS, ROWS = 9, 3
AGREE = 15 / 27
_DRAW = np.random.default_rng(1)
_TIMES = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FOLD = [np.uint64(int(x) | 1) for x in _DRAW.integers(0, 1 << 64, 3, dtype=np.uint64)]


def level(line: str) -> bytes:
    if line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]:  # a space is the only white space that is printable
        return line.lower().encode()
    return " ".join(line.lower().split()).encode()


def shingle_hashes(raw: np.ndarray) -> np.ndarray:
    """32-bit hash of the 8 bytes at each position."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for at, odd in zip((1, 2, 4), _FOLD, strict=True):
        h = h[:-at] * odd + h[at:]
        h ^= h >> np.uint64(31)
    return mix(h).astype(np.uint32)


def shingle_set(line: bytes) -> np.ndarray:
    """Distinct shingles of a levelled line, in order."""
    if len(line) < WIDTH:
        return np.array([xxhash.xxh32_intdigest(line)], np.uint32)
    return np.unique(shingle_hashes(np.frombuffer(line, np.uint8)))


def signatures(lines: list[bytes]) -> list[bytes]:
    """MinHash signatures, about 64 thousand positions at a time."""
    out: list[bytes] = []
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size == 0 or size + len(lines[end]) < 65_536):
            size += max(WIDTH, len(lines[end]))
            end += 1
        group = lines[at:end]
        sizes = np.array([max(1, len(x) - WIDTH + 1) for x in group])
        parts = [x if len(x) >= WIDTH else b"\0" * WIDTH for x in group]
        h = shingle_hashes(np.frombuffer(b"".join(parts), np.uint8))
        starts = np.cumsum([0, *(len(x) for x in parts[:-1])])
        inside = np.ones(len(h), bool)
        for k in range(1, WIDTH):  # positions that run into the next line
            inside[(starts[1:] - k)] = False
        h = h[inside]
        first = np.cumsum(sizes) - sizes
        for i, x in enumerate(group):
            if len(x) < WIDTH:
                h[first[i]] = xxhash.xxh32_intdigest(x)
        sig = np.empty((len(group), len(_TIMES)), np.uint16)
        turned = np.empty_like(h)
        for k in range(len(_TIMES)):
            np.multiply(h, _TIMES[k], out=turned)
            np.add(turned, _PLUS[k], out=turned)
            sig[:, k] = np.minimum.reduceat(turned, first) & np.uint32(0xFFFF)
        out += [row.tobytes() for row in sig]
        at = end
    return out


def _keys(lines: list[bytes]) -> np.ndarray:
    """(row << 32 | shingle) of all lines, each once, in order."""
    sizes = np.array([max(WIDTH, len(x)) for x in lines])
    first = np.cumsum(sizes) - sizes
    h = shingle_hashes(np.frombuffer(b"".join(x.ljust(WIDTH, b"\0") for x in lines), np.uint8))
    inside = np.ones(len(h), bool)
    for k in range(1, WIDTH):  # positions that run into the next line
        inside[first[1:] - k] = False
    for i, x in enumerate(lines):
        if len(x) < WIDTH:
            h[first[i]] = xxhash.xxh32_intdigest(x)
    row = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes - WIDTH + 1)
    keys = np.sort(row << np.uint64(32) | h[inside])
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def shares(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Jaccard similarities of pairs of lines, about a quarter of a million positions at a time."""
    out, at = [np.empty(0)], 0
    while at < len(left):
        end, size = at, 0
        while end < len(left) and (size == 0 or size + len(left[end]) + len(right[end]) < 1 << 18):
            size += len(left[end]) + len(right[end]) + 2 * WIDTH
            end += 1
        x, y = _keys(left[at:end]), _keys(right[at:end])
        both = np.sort(np.concatenate([x, y]))
        shift, n = np.uint64(32), end - at
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> shift).astype(np.int64), minlength=n)
        every = np.bincount((x >> shift).astype(np.int64), minlength=n) + np.bincount((y >> shift).astype(np.int64), minlength=n) - common
        out.append(common / every)
        at = end
    return np.concatenate(out)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line (its number from 0), k (its name), and sig and body, its signature
    and levelled text, null where the batch had it before."""
    extra = [T.StructField("line", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("body", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lines")
        for pdf in batches:
            for c in range(0, len(pdf), 500):
                ids, numbers, ks, new, at = [], [], [], [], []
                known: set[int] = set()
                for doc_id, text in zip(pdf["doc_id"].iloc[c : c + 500], pdf["text"].iloc[c : c + 500], strict=True):
                    for number, line in enumerate(text.split("\n")):
                        flat = level(line)
                        if flat:
                            k = xxhash.xxh64_intdigest(flat) >> 1
                            if k not in known:
                                known.add(k)
                                new.append(flat)
                                at.append(len(ks))
                            ids.append(doc_id)
                            numbers.append(number)
                            ks.append(k)
                sig, body = np.full(len(ks), None, object), np.full(len(ks), None, object)
                sig[at] = signatures(new)
                body[at] = new
                yield pd.DataFrame({"doc_id": ids, "line": np.array(numbers, np.int32), "k": np.array(ks, np.int64), "sig": sig, "body": body})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(trimmed(run), schema)


def near_duplicate_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per line that is not blank: doc_id, line, class_doc_id, class_line, kept."""
    table = written(line_table(docs), "lines")
    kind = Kind(BANDS, ROWS, AGREE, similarity, lambda x: as_signs(signatures(x)), shares, lambda x: (shingle_set(x), None))
    roots = linked_components(table.where("sig is not null").select("k", "sig", "body"), kind)
    place = F.struct("doc_id", "line")
    rooted = written(table.select("doc_id", "line", "k").join(roots, "k", "left").select("doc_id", "line", F.coalesce("root", "k").alias("root")), "rooted")
    # A table of its own: a class of very many lines is then split between tasks by the join.
    classes = written(rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"), "classes")
    first = lambda c: F.when(F.col("first").isNull(), F.col(c)).otherwise(F.col(f"first.{c}"))
    out = rooted.join(classes, "root", "left").select("doc_id", "line", first("doc_id").alias("class_doc_id"), first("line").alias("class_line"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line") == F.col("class_line")))
