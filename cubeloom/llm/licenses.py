"""Licence scan: exact set-similarity join of text blocks with licence templates.

Template tokens are ordered by how many documents hold them, rarest first. A
block can hold ``need`` of a template's tokens only if it holds one of the
template's first ``size - need + 1`` tokens in that order (prefix filter), if it
has ``need`` words at all (length filter), and if the tokens from the first
match on are still enough (positional filter). What passes is counted exactly.

Phrases are templates that need all their tokens, with the whole text as the
block; a match is then checked for places where the words follow each other.
Other templates are compared with each line, and with windows of words that run
over the line feeds of a paragraph (lines up to a blank one), as notices are often
wrapped. Such a window is as long as the template and a quarter.

Null and empty texts have no words and no labels. Repeated rows are reported
each. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import claim, sent

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening sentences of public licences, and the notices that name them.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc"],
    "cc-by-sa": ["licensed under cc by sa"],
    "gpl-notice": ["this work is licensed under the gnu general public license version"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "no-warranty": ["the software is provided as is without warranty of any kind express or implied"],
}
# Word bytes stay (A-Z lower-cased); every other ASCII byte becomes a space, line feeds stay apart.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LINES = _WORDS[:10] + b"\n" + _WORDS[11:]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def template_counts(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each template token, over all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("licenses")
        count = dict.fromkeys(tokens, 0)
        for pdf in batches:
            for t in pdf["text"]:
                for w in tokens.intersection(words(t)):
                    count[w] += 1
        yield pd.DataFrame({"token": list(count), "n": list(count.values())})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


class Index:
    """Templates by their prefix tokens under a global token order."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], threshold: float, count: dict[bytes, int]) -> None:
        def rank(w: bytes) -> tuple[int, bytes]:
            return count.get(w, 0), w

        self.phrases: dict[bytes, list] = {}
        for p, label in phrases.items():
            seq = p.encode().split()
            self.phrases.setdefault(min(seq, key=rank), []).append((seq, label))
        self.prefix: dict[bytes, list] = {}
        for label, texts in templates.items():
            for t in texts:
                seq = t.encode().split()
                order = sorted(set(seq), key=rank)
                need = max(1, math.ceil(threshold * len(order) - 1e-9))
                for at, w in enumerate(order[: len(order) - need + 1]):
                    self.prefix.setdefault(w, []).append((label, order, need, at, len(seq) + len(seq) // 4))
        self.keys = frozenset(self.phrases) | frozenset(self.prefix)

    def scan(self, text: bytes | None) -> tuple:
        ws = words(text)
        hit = self.keys.intersection(ws)
        if not hit:
            return len(ws), 0, None, None, "", "", 0.0
        places, base, more, score = [], set(), set(), 0.0
        for rare in hit & self.phrases.keys():
            held = None
            for seq, label in self.phrases[rare]:
                held = held or set(ws)
                if not held.issuperset(seq):
                    continue
                k = seq.index(rare)
                at = -1
                while True:
                    try:
                        at = ws.index(rare, at + 1)
                    except ValueError:
                        break
                    if at >= k and ws[at - k : at - k + len(seq)] == seq:
                        places.append(at - k)
                        base.add(label)
        if hit & self.prefix.keys():
            lines = [line.split() for line in text.translate(_LINES).split(b"\n")]
            got = self._wrapped(lines, text, hit)
            more.update(label for label, _ in got)
            score = max((share for _, share in got), default=0.0)
            for line in lines:
                block = set(line)
                for w in block & self.prefix.keys():
                    for label, order, need, at, _ in self.prefix[w]:
                        if len(block) < need or len(order) - at < need - sum(o in block for o in order[:at]):
                            continue
                        got = sum(o in block for o in order)
                        if got >= need:
                            more.add(label)
                            score = max(score, got / len(order))
        if base:
            score = 1.0
        return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


    def _wrapped(self, lines: list[list[bytes]], text: bytes, hit: frozenset[bytes]) -> list[tuple[str, float]]:
        """(label, share) of templates in windows of words across line feeds."""
        if len(lines) < 2:
            return []
        found, held = [], None
        for w in hit & self.prefix.keys():
            for label, order, need, at, reach in self.prefix[w]:
                held = held or {x for line in lines for x in line}
                if sum(o in held for o in order) < need or sum(o in held for o in order[:at]) + len(order) - at < need:
                    continue
                found.append((label, order, need, reach))
        if not found:
            return []
        out, paragraph = [], []
        for line, raw in [*zip(lines, text.split(b"\n"), strict=True), ([], b"")]:
            if raw.strip():
                paragraph += line
                continue
            for label, order, need, reach in found if paragraph else ():
                wanted, count, most = set(order), {}, 0
                places = [p for p, x in enumerate(paragraph) if x in wanted]
                begin = 0
                for p in places:
                    count[paragraph[p]] = count.get(paragraph[p], 0) + 1
                    while places[begin] <= p - reach:
                        old = paragraph[places[begin]]
                        count[old] -= 1
                        if not count[old]:
                            del count[old]
                        begin += 1
                    most = max(most, len(count))
                if most >= need:
                    out.append((label, most / len(order)))
            paragraph = []
        return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    tokens = {w for t in [*phrases, *(x for v in templates.values() for x in v)] for w in t.encode().split()}
    index = sent(docs.sparkSession, Index(phrases, templates, threshold, template_counts(docs, tokens)))
    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for pdf in batches:
            out = pd.DataFrame([ix.scan(t) for t in pdf["text"]], columns=schema.names[1:])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)
