"""Document frequencies in a table of fixed size, and words as hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from cubeloom.llm._common import cache, claim

BITS = 20
MASK = np.uint32((1 << BITS) - 1)
PARTS = 64
_SLOT = (1 << BITS) // PARTS


class _Hashes(dict):
    """word -> 64-bit hash; emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _Hashes()
cache("words", _HASHES.clear)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    claim("words")
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def document_frequencies(texts: DataFrame, ids_of: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, int]:
    """Number of texts per slot, and number of texts. texts has one column, of bytes;
    ids_of gives the distinct 32-bit ids of one, whose low 20 bits are the slot.

    Each task adds up its own table; the tables are added in two steps, part by
    part, so no task gets more than a fixed share of them.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size, docs, salt = np.zeros(1 << BITS, np.int64), [], 0, 0, 0
        for pdf in batches:
            for t in pdf[pdf.columns[0]]:
                ids = ids_of(t)
                held.append(ids)
                size += len(ids)
                docs += 1
                salt = (salt * 31 + len(ids)) % 61
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held) & MASK, minlength=1 << BITS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held) & MASK, minlength=1 << BITS)
        if docs:
            yield pd.DataFrame({"part": np.arange(PARTS, dtype=np.int32), "salt": np.full(PARTS, salt, np.int32), "docs": docs, "body": [total[i * _SLOT : (i + 1) * _SLOT].astype(np.uint32).tobytes() if docs < 1 << 32 else b"" for i in range(PARTS)]})

    def add(dtype):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            body = np.zeros(_SLOT, np.int64)
            for b in pdf["body"]:
                body += np.frombuffer(b, dtype).astype(np.int64)
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "docs": [pdf["docs"].sum()], "body": [body.tobytes()]})

        return run

    schema = "part int, docs long, body binary"
    tables = texts.mapInPandas(count, "part int, salt int, docs long, body binary")
    once = tables.groupBy("part", "salt").applyInPandas(add(np.uint32), schema)
    out, n = np.zeros(1 << BITS, np.int64), 0
    for r in once.groupBy("part").applyInPandas(add(np.int64), schema).collect():
        out[r["part"] * _SLOT : (r["part"] + 1) * _SLOT] = np.frombuffer(r["body"], np.int64)
        n = r["docs"]
    return out, n
