import gc
import weakref

from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import _common, decontaminate, lines, minhash, toxicity
from cubeloom.llm._common import read


def test_names_and_columns(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]


def test_stages_take_effect(spark, small):
    docs = read(spark, small, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small).persist()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids, kept = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (before, after))
        assert kept <= ids and after.count() == len(kept)
        if name == "toxicity":
            model = toxicity.train(before, read(spark, small, "labels"))
            assert kept == {r["doc_id"] for r in before.collect() if model.score(r["text"]) < corpus_pipeline.TOXIC}
        if name == "line dedup":
            gone = {}
            for r in lines.near_duplicate_lines(before).where(~F.col("kept")).collect():
                gone.setdefault(r["doc_id"], set()).add(r["line"])
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in after.collect():
                want = "\n".join(x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone.get(r["doc_id"], ()))
                assert r["text"] == want and r["n_chars"] == (len(want) if r["doc_id"] in gone else r["n_chars"])
        if name == "near-duplicates":
            assert kept == {r["doc_id"] for r in minhash.near_duplicates(before).where("kept").collect()}
        if name == "decontamination":
            assert kept == ids - {r["doc_id"] for r in decontaminate.leaks(before, read(spark, small, "benchmark")).collect()}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in before.collect()}


def test_odd_documents(spark, small):
    rows = [(1, None, "en", "s", None, 5), (2, "", "en", "s", 0, 5), (3, "one\n\ntwo\none", None, None, 12, 5), (3, "one\n\ntwo\none", None, None, 12, 5), (None, "x y z", "de", "s", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "line"]
    got = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert (3, "one\n\ntwo") in got and (None, "x y z") in got and len(got) == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_rows_with_one_id_or_none(spark, small):
    say = lambda name: " ".join(f"{name}{i}" for i in range(12))
    item = read(spark, small, "benchmark").where("item_id = 0").first()["text"]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda stage, rows: sorted((str(r["doc_id"]), r["text"]) for r in stage(spark, docs(rows), small).collect())
    rows = [(None, say("a")), (None, say("b")), (None, say("b")), (1, say("a")), (3, say("c")), (3, say("d")), (-2, say("d"))]
    assert texts(corpus_pipeline.drop_near_duplicates, rows) == sorted([("None", say("b")), ("1", say("a")), ("3", say("c")), ("-2", say("d"))])
    assert texts(corpus_pipeline.drop_leaks, [(None, item), (None, say("a")), (3, item), (3, say("c"))]) == [("3", say("c")), ("None", say("a"))]
    got = texts(corpus_pipeline.drop_repeated_lines, [(3, say("a") + "\n" + say("b")), (3, say("b") + "\n" + say("c"))])
    assert sorted("\n".join(t for _, t in got).split("\n")) == [say("a"), say("b"), say("c")]


def test_very_long_texts(spark, small):
    long = "\n".join(f"line {i} says word{i * 7} and thing{i * 13}" for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a short text of its own")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).persist()
    assert {r["doc_id"]: len(r["text"]) for r in docs.collect()}[1] == len(long)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).agg({"length": "max"}).first()[0] == 2048


def test_driver_keeps_nothing_of_results_that_are_gone(spark, small):
    docs = read(spark, small, "documents")
    first = len(_common._SENT)
    kept = corpus_pipeline.drop_toxic(spark, docs, small)
    model = weakref.ref(_common.sent(spark, "a model"))
    gc.collect()
    assert model() is None and not any(isinstance(b, weakref.ref) and b() for b in _common._SENT[first:])
    assert 0 < kept.count() < docs.count()  # its plan still has the model
    with _common.scope():
        inside = weakref.ref(_common.sent(spark, "a model"))
        gc.collect()
        assert inside() is not None
    spark.catalog.clearCache()
    before = len(_common._HELD)
    _common.stored(docs)
    assert not any(_common._HELD[:before])
