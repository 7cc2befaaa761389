import json

from pyspark.sql import functions as F

from cubeloom.operators import cube, dedup
from cubeloom.plans import query as q
from cubeloom.plans.spec import CubeSpec
from cubeloom.streaming import cube as stream_cube
from cubeloom.streaming import dedup as stream_dedup

SPEC = CubeSpec.from_json({"keys": [{"name": "k", "type": "string"}], "values": [{"name": "n", "type": "long", "aggregators": ["SUM", "COUNT"]}], "timeBuckets": ["1m"], "dimensions": [{"combination": ["k"]}]})


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n long, time long")


def test_windows_merge_and_replay_counts_once(spark, tmp_path):
    store = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC)
    store.apply(batch(spark, ("a", 10, 60_000), ("a", 10, 61_000)), 0)
    assert store.cube().first()["n_sum"] == 20
    store.apply(batch(spark, ("a", 10, 60_500)), 1)
    store.apply(batch(spark, ("a", 10, 60_500)), 1)
    assert store.cube().first()["n_sum"] == 30
    again = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC)  # a restart that has lost its place
    again.apply(batch(spark, ("a", 10, 60_500)), 1)
    assert again.cube().first()["n_sum"] == 30
    assert again.compact().count() == 1


def test_continuous_queries_count_down(spark, tmp_path):
    store, got = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC), []
    store.on_result = lambda i, text: got.append((i, json.loads(text)))
    text = {"id": "5", "type": "dataQuery", "data": {"time": {"bucket": "1m", "latestNumBuckets": 1}, "keys": {"k": []}, "fields": ["time", "n:SUM"]}}
    store.register(q.parse(json.dumps({**text, "countdown": 2}), SPEC))
    store.register(q.parse(json.dumps({**text, "id": "6"}), SPEC))
    for epoch in range(4):
        store.apply(batch(spark, ("a", 1, 60_000)), epoch)
    assert [(i, m["data"][0]["n:SUM"]) for i, m in got] == [("5", "1"), ("6", "1"), ("5", "2")]


def test_stream_equals_batch(spark, tmp_path, small):
    from cubeloom.queries import HOURLY, events

    src = tmp_path / "in"
    events(spark, small).repartition(5).write.parquet(str(src))
    frame = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    store = stream_cube.CubeStore(spark, str(tmp_path / "c"), HOURLY, time="t", order="event_id")
    stream_cube.start(frame, store, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert store.committed >= 4
    want = cube.compute(events(spark, small), HOURLY, time="t", order="event_id")
    assert store.cube().exceptAll(want).count() == 0 and want.exceptAll(store.cube()).count() == 0


def deduplicated(spark, tmp_path, rows, keys, rule, parts):
    """Dispositions by seq of rows that come in several micro-batches."""
    n = rows.count()
    size = -(-n // parts)
    for i in range(parts):
        rows.where((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    sink = lambda out, epoch: got.update({r["seq"]: r["disposition"] for r in out.collect()})
    store = stream_dedup.DedupStore(spark, str(tmp_path / "state"), keys, "seq", rule, sink, groups=4, compact_every=2)
    frame.writeStream.foreachBatch(store.apply).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len(got) == n
    return got


def dispositions(df):
    return {r["seq"]: r["disposition"] for r in df.collect()}


def test_stream_dedup_equals_batch(spark, tmp_path):
    # Twenty values ten apart, ten of them again, ten behind the point of expiry.
    keys = [*range(1000, 1200, 10), *range(1050, 1150, 10), *range(50, 150, 10)]
    rows = spark.createDataFrame(list(enumerate(keys)), "seq long, k long")
    got = deduplicated(spark, tmp_path, rows, ["k"], stream_dedup.Rule("ordered", "k", 1000, 10), 3)
    assert got == dispositions(dedup.ordered_expiry(rows, ["k"], "k", "seq", 1000, 10))


def test_stream_dedup_keeps_types_and_nulls(spark, tmp_path):
    big = (1 << 60) + 1
    data = [(0, 5, 100, "a"), (1, None, 101, "a"), (2, 5, 102, "a"), (3, None, 103, "a"), (4, 7, None, "a"), (5, big, 104, "a\x1eb"), (6, big - 1, 104, "a\x1eb"), (7, big, 105, "a\x1eb"), (8, 5, 106, "a"), (9, None, 10, "a"), (10, 5, 300, None), (11, 5, 301, None)]
    rows = spark.createDataFrame(data, "seq long, id long, at long, name string")
    got = deduplicated(spark, tmp_path, rows, ["id", "name"], stream_dedup.Rule("ordered", "at", 50, 50), 4)
    u, d, e = "unique", "duplicate", "error"
    assert got == {0: u, 1: u, 2: d, 3: d, 4: e, 5: u, 6: u, 7: d, 8: d, 9: "expired", 10: u, 11: d}
    assert got == dispositions(dedup.ordered_expiry(rows, ["id", "name"], "at", "seq", 50, 50))


def test_stream_dedup_by_clock_jump_and_category(spark, tmp_path):
    data = [(i, i % 3, v, c) for i, (v, c) in enumerate([(100, "x"), (101, "x"), (100, "x"), (140, "y"), (105, "x"), (106, "y"), (90, "z"), (107, "x"), (108, "z"), (None, None)])]
    rows = spark.createDataFrame(data, "seq long, id long, at long, cat string")
    clock = deduplicated(spark, tmp_path / "1", rows, ["id"], stream_dedup.Rule("clock", "at", 10, 5, clock=lambda: 110), 3)
    late = [s for s, _, v, _ in data if v is not None and v < 101]
    assert sorted(s for s, d in clock.items() if d == "expired") == late and clock[9] == "error"
    jump = deduplicated(spark, tmp_path / "2", rows, ["id"], stream_dedup.Rule("jump", "at", 50, 5, max_jump=20), 3)
    assert jump == dispositions(dedup.jump_expiry(rows, ["id"], "at", "seq", 50, 5, 20)) and jump[3] == "error"
    cats = deduplicated(spark, tmp_path / "3", rows, ["id"], stream_dedup.Rule("categorical", "cat", live=2), 3)
    assert cats == dispositions(dedup.categorical_expiry(rows, ["id"], "cat", "seq", 2)) and cats[7] == "expired"


def test_bucket_rule_of_ones_own(spark):
    rows = spark.createDataFrame([(0, 1, 10), (1, 1, 11), (2, 1, 12)], "seq long, id long, at long")
    got = dispositions(dedup.ordered_expiry(rows, ["id"], "at", "seq", 100, 1, bucket=lambda c: c % 2))
    assert got == {0: "unique", 1: "unique", 2: "duplicate"}


def test_store_by_group_updates_and_compaction(spark, tmp_path):
    store, changed = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC, by_group=True), []
    store.on_update = lambda rows, epoch: changed.append(sorted((r["k"], r["n_sum"]) for r in rows.collect()))
    store.apply(batch(spark, ("a", 1, 60_000), ("b", 2, 60_000)), 0)
    store.apply(batch(spark, ("a", 5, 60_000)), 1)
    assert changed == [[("a", 1), ("b", 2)], [("a", 6)]]
    before = sorted(tuple(r) for r in store.cube().collect())
    store.compact()
    assert sorted(tuple(r) for r in store.cube().collect()) == before
    assert [p.name for p in (tmp_path / "c/parts").iterdir()] == ["base=1"]
    again = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC, by_group=True)
    assert again.committed == 1
    again.apply(batch(spark, ("b", 1, 60_000)), 2)
    assert {r["k"]: r["n_sum"] for r in again.cube().collect()} == {"a": 6, "b": 3}


def test_registered_queries_outlive_a_restart(spark, tmp_path):
    text = {"id": "5", "type": "dataQuery", "data": {"time": {"bucket": "1m", "latestNumBuckets": 1}, "keys": {"k": []}, "fields": ["time", "n:SUM"]}, "countdown": 2}
    store = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC)
    store.register(q.parse(json.dumps(text), SPEC))
    store.apply(batch(spark, ("a", 1, 60_000)), 0)
    again, got = stream_cube.CubeStore(spark, str(tmp_path / "c"), SPEC), []
    again.on_result = lambda i, _: got.append(i)
    for epoch in (1, 2):
        again.apply(batch(spark, ("a", 1, 60_000)), epoch)
    assert got == ["5"]
