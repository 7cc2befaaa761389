import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cubeloom.llm import packing
from cubeloom.llm._common import read

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbZéÉßİıΣσς  \n\t'’.,!?<|endoftext|>-_12½²日한́̇e—s\xa0　ʰ😀")))
def test_words_give_the_tokenizers_ids(text):
    got = np.frombuffer(packing.encoder().document(text.encode()), "<u4").tolist()
    assert got == ids(text)


def check_places(rows, length):
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(taken)


def test_pack_round_trip(spark, small):
    docs = read(spark, small, "documents")
    rows = packing.pack(docs).collect()
    want = {}
    for d in docs.collect():
        tokens = ids(d["text"])
        for p in range(0, len(tokens), 2048):
            part = tokens[p : p + 2048]
            want[d["doc_id"], p // 2048] = (p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    used = check_places(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert used <= -(-total // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    hist = np.zeros(129, np.int64)
    hist[draw.integers(1, 129, 40)] = draw.integers(1, 3000, 40)
    plan = packing.plan(hist, 128)
    rows = []
    for size in range(1, 129):
        mine = plan[plan[:, 0] == size]
        assert mine[:, 2].sum() == hist[size]
        assert (mine[:, 1] == np.cumsum(mine[:, 2]) - mine[:, 2]).all()
        rows += [{"sequence_id": s + i, "offset": o, "length": size} for _, _, n, s, o in mine.tolist() for i in range(n)]
    used = check_places(rows, 128)
    assert used <= packing._packed(hist, 128, [])[0]  # best-fit decreasing alone


def test_patterns_of_all_lengths_take_little_memory():
    hist = np.ones(2049, np.int64)
    hist[0] = 0
    tracemalloc.start()
    fitted = packing.fit_patterns(hist, 2048, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fitted[0] == ((2048,), 1) and all(sum(p) == 2048 for p, _ in fitted)
    assert peak < 80e6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "", 9), (3, "a " * 5000, 9)], "doc_id long, text string, length int")
    rows = packing.pack(docs).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 1, 905, 2048, 2048]
    assert check_places(rows, 2048) == 3
    assert packing.pack(docs.limit(0)).count() == 0
