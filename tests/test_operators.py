import math

import pytest
from pyspark.sql import functions as F

from cubeloom.functions import bloom, delimited
from cubeloom.operators import cube, dedup, enrich, kvstore, lateness, ranges, results
from cubeloom.sources import events as sources
from cubeloom.sources.lookup import json_lines, keyed_bytes


def numbered(spark, keys, *more):
    return spark.createDataFrame([(i, k, *(m[i] for m in more)) for i, k in enumerate(keys)], "seq long, k long" + "".join(f", m{i} string" for i in range(len(more))))


def counts(df):
    return {r["disposition"]: r["n"] for r in dedup.counters(df).collect()}


# Twenty values ten apart, ten of them again, ten behind the point of expiry.
ORDERED = [*range(1000, 1200, 10), *range(1050, 1150, 10), *range(50, 150, 10)]


@pytest.mark.parametrize("groups", [1, 7])
def test_ordered_expiry(spark, groups):
    got = counts(dedup.ordered_expiry(numbered(spark, ORDERED), ["k"], "k", "seq", 1000, 10, groups))
    assert got == {"unique": 20, "duplicate": 10, "expired": 10, "error": 0}


def test_time_expiry(spark):
    millis = [*range(1_000_000, 3_000_000, 100_000), *range(1_000_000, 2_000_000, 100_000), *range(50_000, 150_000, 10_000)]
    got = counts(dedup.time_expiry(numbered(spark, millis), ["k"], "k", "seq", 2000, 10))
    assert got == {"unique": 20, "duplicate": 10, "expired": 10, "error": 0}


def test_categorical_expiry(spark):
    rows = numbered(spark, [1, 2, 3, 4, 5], ["f1", "f2", "f3", "f1", None])
    assert [r["disposition"] for r in dedup.categorical_expiry(rows, ["k"], "m0", "seq", 2).orderBy("seq").collect()] == ["unique", "unique", "unique", "expired", "error"]
    rows = numbered(spark, [1, 2, 3, 4, 5], ["f1", "f2", "f3", "f4", "f5"])
    assert counts(dedup.categorical_expiry(rows, ["k"], "m0", "seq", 2))["unique"] == 5


def test_plain_dedup_in_rounds(spark):
    keys = [*range(10), 5]
    assert counts(dedup.by_key(numbered(spark, keys), ["k"], "seq"))["unique"] == 10
    assert counts(dedup.by_key(numbered(spark, keys * 2 + [*range(10, 15)]), ["k"], "seq"))["unique"] == 15


def test_jump_rule_against_a_loop(spark):
    ks = [5, 6, None, 5000, 7, 8, 4000, 9, 1005, 3, 2003, 2003, 1004, 1500]
    period, span, jump = 1000, 10, 1000
    end, seen, want = None, set(), []
    for k in ks:
        if k is None:
            want.append("error")
        elif end is not None and k < end - period + 1:
            want.append("expired")
        elif end is not None and end - period + 1 > 0 and k - end > jump:
            want.append("error")
        else:
            end = k if end is None else max(end, k)
            want.append("duplicate" if (k, k // span) in seen else "unique")
            seen.add((k, k // span))
    got = dedup.jump_expiry(numbered(spark, ks), ["k"], "k", "seq", period, span, jump).orderBy("seq").collect()
    assert [r["disposition"] for r in got] == want


def test_dedup_of_nothing(spark):
    assert counts(dedup.by_key(spark.createDataFrame([], "seq long, k long"), ["k"], "seq")) == {"unique": 0, "duplicate": 0, "expired": 0, "error": 0}


def test_lateness_boundaries(spark):
    ref = 1_234_567_000
    times = [1_234_567, 1_231_200, 1_231_199, 1_227_600, 1_227_599, 1_234_567 + 59, 1_234_567 + 61, None]
    rows = spark.createDataFrame([(i, None if t is None else t * 1000) for i, t in enumerate(times)], "i int, t long")
    got = [r["c"] for r in rows.select("i", lateness.classify(F.col("t"), ref).alias("c")).orderBy("i").collect()]
    assert got == ["normal", "normal", "laggard", "laggard", "late", "normal", "early", "early"]


def test_map_enrichment(spark):
    df = spark.createDataFrame([("Value1", "Value2"), ("x", "y")], "In1 string, In2 string")
    lookup = spark.createDataFrame([("Value1", "Val_A", "Val_B", "Val_C", "Value3")], "key string, A string, B string, C string, In1 string")
    some = [r.asDict() for r in enrich.enrich_map(df, lookup, {"In1": "key"}, ["A", "B"]).orderBy("In2").collect()]
    assert some == [{"In1": "Value1", "In2": "Value2", "A": "Val_A", "B": "Val_B"}, {"In1": "x", "In2": "y", "A": None, "B": None}]
    every = enrich.enrich_map(df, lookup, {"In1": "key"}, ["A", "B", "C", "In1"]).orderBy("In2").first().asDict()
    assert every == {"In1": "Value3", "In2": "Value2", "A": "Val_A", "B": "Val_B", "C": "Val_C"}
    shuffled = enrich.enrich_map(df, lookup, {"In1": "key"}, ["A"], most_broadcast=0).orderBy("In2").first()["A"]
    assert shuffled == "Val_A"


def test_typed_enrichment(spark):
    orders = spark.createDataFrame([(3, 4, 700.0), (4, 9, 1.0)], "OID int, ID int, amount double")
    people = spark.createDataFrame([(4, "Mark", 25, "Rich-Mond", 65000.0)], "EID int, NAME string, AGE int, ADDRESS string, SALARY double")
    copy, add = enrich.mapping("OID,ID,amount"), enrich.mapping("NAME,AGE,ADDRESS,SALARY:PAY", reverse=True)
    got = [tuple(r) for r in enrich.enrich_typed(orders, people, enrich.mapping("ID:EID"), copy, add).orderBy("OID").collect()]
    assert got == [(3, 4, 700.0, "Mark", 25, "Rich-Mond", 65000.0), (4, 9, 1.0, None, 0, None, 0.0)]


def test_json_lines_lookup(spark, tmp_path):
    (tmp_path / "m.txt").write_text('{"c": 5, "p": 0}\nbroken\n{"c": 4, "p": 1}\n{"c": 9, "p": 0}\n[1]\n\n')
    got = json_lines(spark, str(tmp_path / "m.txt"), "c int, p int", ["p"]).orderBy("p").collect()
    assert [tuple(r) for r in got] == [(9, 0), (4, 1)]


def test_keyed_bytes(spark):
    df = spark.createDataFrame([("row1", {"name": b"raju"})], "row string, personal map<string,binary>")
    assert keyed_bytes(df, "row", {"NAME": ("personal", "name"), "X": ("personal", "no")}).first().asDict() == {"row": "row1", "NAME": bytearray(b"raju"), "X": None}


@pytest.mark.parametrize("added,want", [([(1, 10), (11, 20), (1, 5)], [(1, 10), (11, 20)]), ([(1, 10), (11, 20), (1, 5), (5, 12)], [(1, 20)]), ([], [])])
def test_range_merge(spark, added, want):
    got = ranges.merge_ranges(spark.createDataFrame(added, "start long, end long"))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("probe,want", [((0, 3), [(1, 5)]), ((0, 25), [(1, 5), (11, 20)]), ((15, 25), [(11, 20)]), ((6, 29), [(11, 20)]), ((6, 15), [(11, 20)]), ((6, 10), [])])
def test_range_overlap(spark, probe, want):
    rs = spark.createDataFrame([(1, 5), (11, 20), (30, 60)], "start long, end long")
    got = ranges.overlapping(rs, spark.createDataFrame([probe], "probe_start long, probe_end long"))
    assert sorted((r["start"], r["end"]) for r in got.collect()) == want


def test_store_purge_delete_and_tombstones(spark):
    log = [(i, 0, "PUT", i, None, f"v{i}") for i in range(10)] + [(10, 0, "PURGE", 2, 5, None), (11, 0, "PUT", 3, None, "new"), (12, 0, "DELETE", 9, None, None), (13, 1, "PUT", 4, None, "other")]
    df = spark.createDataFrame(log, "seq long, bucket long, op string, key long, end_key long, value string")
    got = sorted((r["bucket"], r["key"], r["value"]) for r in kvstore.compact(df).collect())
    assert got == sorted([(0, k, f"v{k}") for k in (0, 1, 6, 7, 8)] + [(0, 3, "new"), (1, 4, "other")])


def test_store_files_and_replay(spark, tmp_path):
    state = spark.createDataFrame([(k % 2, k, f"v{k}") for k in range(20)], "bucket long, key long, value string")
    kvstore.write_store(state, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("bucket = 1 and key between 3 and 7").count() == 3
    log = spark.createDataFrame([(b, w) for b in (0, 1, 2) for w in range(5)], "bucket long, window_id long")
    done = spark.createDataFrame([(0, 2), (1, 4)], "bucket long, window_id long")
    assert sorted(tuple(r) for r in kvstore.committed_only(log, done).collect()) == [(0, 3), (0, 4), *[(2, w) for w in range(5)]]


def test_result_unifiers(spark):
    rows = [(1, "1", "dataResult", [], 0), (1, "1", "dataResult", [5], 1), (1, "1", "dataResult", [6], 2), (1, "2", "dataResult", [], 3), (1, "2", "dataResult", [], 4), (1, "3", "schemaResult", [], 5), (1, "3", "schemaResult", [], 6)]
    df = spark.createDataFrame(rows, "window_id long, id string, type string, data array<int>, seq long")
    assert sorted(r["seq"] for r in results.merge_results(df).collect()) == [1, 3, 5, 6]
    assert sorted(r["seq"] for r in results.non_empty(df).collect()) == [1, 2, 5, 6]


PICKS = [(b"", b"\1\1\1"), (b"\2", b"\1\1\1"), (b"First", b"\1\1\1"), (b"\2First", b"First\1\1\1"), (b"First\1", b"\1\1\1"), (b"First\2Second\2", b"Second\1\1\1"), (b"First\2\2Second", b"\1Second\1\1"), (b"First\2\2Second\2\2\2", b"\1Second\1\1"), (None, None)]


@pytest.mark.parametrize("body,want", PICKS)
def test_pick_columns(spark, body, want):
    df = spark.createDataFrame([(body,)], "b binary")
    got = df.select(delimited.pick(F.col("b"), [1, 2, 3])).first()[0]
    assert (None if got is None else bytes(got)) == want


@pytest.mark.parametrize("template,body,want", [("\1{1}\1{2}\1{3}\1", b"First\2\2Second\2\2\2", b"\1\1Second\1\1"), ("a{1}bc{2}def{3}ghi", b"First\2\2Second\2\2\2", b"abcSeconddefghi"), ("a{1}bc{2}def{3}", b"First\2\2Second\2\2\2", b"abcSeconddef"), ("{0}\1", b"", b"\1"), ("{0}\1", b"First", b"First\1"), ("{0}\1", b"\2First", b"\1")])
def test_fill_template(spark, template, body, want):
    assert bytes(spark.createDataFrame([(body,)], "b binary").select(delimited.fill(F.col("b"), template)).first()[0]) == want


def test_raw_event_and_masked_json(spark):
    df = spark.createDataFrame([(b"g\x022024-01-02 03:04:05",), (b"g\x02nope",), (b'{"a": 1}',), (b"{",)], "b binary")
    got = df.select(delimited.raw_event(F.col("b"))["time"].isNotNull(), sources.masked_json(F.col("b"), "a int")["a"]).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, None), (False, 1), (False, None)]


def test_bloom_filter(spark):
    shape = bloom.BloomShape(2000, 0.01)
    assert shape.hashes == 7 and shape.bits == math.ceil(2000 * 7 / math.log(2))
    built = bloom.build(spark.range(1000), "id", shape)
    hit = bloom.probe(spark.range(0, 4000), "id", built, shape).groupBy((F.col("id") < 1000).alias("inside")).agg(F.avg(F.col("might_contain").cast("int")).alias("rate")).collect()
    rate = {r["inside"]: r["rate"] for r in hit}
    assert rate[True] == 1.0 and rate[False] <= 0.01


def test_log_and_gz_and_replay(spark, tmp_path):
    import gzip

    (tmp_path / "in/deep").mkdir(parents=True)
    for name in ("in/a.gz", "in/deep/b.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("one\ntwo\n")
    (tmp_path / "in/c.txt").write_text("no\n")
    lines = sources.gz_lines(spark, str(tmp_path / "in"))
    assert lines.count() == 4 and lines.select("file").distinct().count() == 2
    rows = spark.createDataFrame([(0, b"x"), (1, b"y")], "line long, body binary")
    played = sources.replay(rows, 1_000_000_000_000, 100, 0.3, 5)
    old = played.where("time < 1000000000000").count()
    assert played.count() == 100 and 10 <= old <= 50
    sources.append_log(played.select("headers", "body"), str(tmp_path / "log"))
    sources.append_log(played.select("headers", "body"), str(tmp_path / "log"))
    log = sources.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 200 and log.select("file", "offset").distinct().count() == 200


def test_jdbc_first_row_of_a_key(spark):
    from cubeloom.sources.lookup import jdbc

    url, driver = "jdbc:derby:memory:lookup;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    people = [(1, "Paul", 32), (2, "Allen", 25), (2, "Alan", 26), (4, "Mark", 25)]
    spark.createDataFrame(people, "ID int, NAME string, AGE int").coalesce(1).write.format("jdbc").options(url=url, dbtable="COMPANY", driver=driver).mode("overwrite").save()
    whole = jdbc(spark, url, table="COMPANY", driver=driver)
    assert whole.count() == 4
    one = jdbc(spark, url, query="select ID, NAME, AGE from COMPANY where AGE < 30", keys=["ID"], order="AGE", driver=driver)
    assert sorted(tuple(r) for r in one.collect()) == [(2, "Allen", 25), (4, "Mark", 25)]
    with pytest.raises(ValueError):
        jdbc(spark, url)


def test_ranges_of_any_width_meet(spark):
    import random

    draw = random.Random(3)
    span = lambda: (lambda a, n: (a, a + n))(draw.randrange(-(1 << 40), 1 << 40), draw.choice([0, 1, 7, 1000, 1 << 20, 1 << 41]))
    left, right = [(*span(), i) for i in range(60)] + [(5, 1, 99), (None, 3, 98), (-(1 << 60), 1 << 60, 97)], [(*span(), i) for i in range(60)]
    got = ranges.overlapping(spark.createDataFrame(left, "start long, end long, i int"), spark.createDataFrame(right, "probe_start long, probe_end long, j int"))
    want = sorted((i, j) for a, b, i in left for c, d, j in right if a is not None and a <= b and a <= d and b >= c)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_bloom_surface(spark):
    shape = bloom.BloomShape(1000, 0.01)
    one, two = (bloom.build(spark.range(a, b), "id", shape) for a, b in ((0, 300), (300, 600)))
    both = bloom.merge(one, two)
    assert bloom.contains_all(spark.range(600), "id", both, shape) and not bloom.contains_all(spark.range(600), "id", one, shape)
    est = bloom.estimate(both, shape).first()
    assert abs(est["n"] - 600) < 30 and 0 < est["rate"] < 0.01
    nothing = bloom.empty(spark)
    assert bloom.estimate(nothing, shape).first()["n"] == 0
    assert bloom.probe(spark.range(5), "id", nothing, shape).where("might_contain").count() == 0
    null = spark.createDataFrame([(None,)], "id long")
    assert bloom.build(null, "id", shape).count() == 0 and not bloom.probe(null, "id", both, shape).first()["might_contain"]


def test_log_addresses_and_clean(spark, tmp_path):
    log = sources.Log(spark, str(tmp_path / "log"), "x long")
    assert log.retrieve().count() == 0
    for k in range(3):
        assert log.store(spark.range(k * 10, k * 10 + 10).withColumnRenamed("id", "x"), "x") == k
    log.store(spark.range(10, 20).withColumnRenamed("id", "x"), "x", flush=1)  # again after a failure
    assert sorted(r["x"] for r in log.retrieve(1, 7).collect()) == [17, 18, 19, *range(20, 30)]
    log.clean(2)
    assert sorted(r["x"] for r in log.retrieve(2).collect()) == list(range(20, 30))
    with pytest.raises(ValueError):
        log.retrieve(1, 9)
    log.clean(9)  # not beyond what was flushed
    assert log.cleaned() == 3 and log.store(spark.range(1).withColumnRenamed("id", "x"), "x") == 3


def test_store_reads_and_codec(spark, tmp_path):
    state = spark.createDataFrame([(k % 2, bytes([k]), f"v{k}") for k in (1, 3, 129, 255, 7)], "bucket long, key binary, value string")
    kvstore.write_store(state, str(tmp_path / "s"), files=2)
    assert sorted(r["value"] for r in kvstore.scan(spark, str(tmp_path / "s"), 1, bytes([3]), bytes([200])).collect()) == ["v129", "v3", "v7"]
    assert [r["value"] for r in kvstore.get(spark, str(tmp_path / "s"), 1, bytes([255])).collect()] == ["v255"]
    puts = kvstore.encoded(spark.range(100).withColumn("at", F.col("id")), F.col("id"), F.col("id") * 2, 5, "at")
    assert puts.select("bucket").distinct().count() == 8 and puts.where("op <> 'PUT' or value <> key * 2").count() == 0


def test_large_grid_is_dealt(spark):
    times, values = spark.range(5).withColumnRenamed("id", "time"), spark.range(40).select(F.col("id").cast("string").alias("v"))
    got = cube.every_pair(times, values, most=10)
    assert got.count() == 200 and got.distinct().count() == 200


def test_bloom_rows_meet_one_block(spark):
    shape = bloom.BloomShape(3_000_000, 0.01)
    built = bloom.build(spark.range(0, 2000, 2), "id", shape)
    probed = bloom.probe(spark.range(2000), "id", built, shape)
    plan = probed._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan  # rows never carry the whole filter
    assert probed.columns == ["id", "might_contain"]
    assert probed.where("id % 2 = 0 and not might_contain").count() == 0 and probed.where("id % 2 = 1 and might_contain").count() == 0


def test_bloom_filter_too_large_to_broadcast(spark):
    shape = bloom.BloomShape(20_000, 0.01)
    built = bloom.build(spark.range(20_000), "id", shape)
    rows = spark.range(-20_000, 20_000).union(spark.createDataFrame([(None,)], "id long"))
    small, large = (bloom.probe(rows, "id", built, shape, most_broadcast=n) for n in (1 << 20, 0))
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0 and large.count() == 40_001
    assert large.where("id >= 0 and not might_contain").count() == 0 and large.where("id is null and might_contain").count() == 0
    assert large.where("id < 0 and might_contain").count() <= 0.01 * 20_000  # all blocks full, at the filter's design


def _merged(rows):
    out = []
    for name, a, b in sorted((r for r in rows if None not in r[1:] and r[1] <= r[2]), key=lambda r: (str(r[0]), r[1])):
        if out and out[-1][0] == name and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([name, a, b])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("most", [8, 40, 200_000])
def test_large_sets_are_merged_in_stretches(spark, most):
    import random

    draw = random.Random(5)
    rows = [(name, a := draw.randrange(20 * n), a + draw.choice([0, 3, 9, 9, 30])) for name, n in (("a", 300), ("b", 90), (None, 60), ("c", 5)) for _ in range(n)]
    rows += [("a", 3000, 3000 + k % 7) for k in range(200)]  # one start fills stretches
    rows += [("b", 100, 1200), (None, -5, -1), ("d", 4, 4), ("d", 9, 2), ("d", None, 3)]  # one range over many stretches
    df = spark.createDataFrame(rows, "name string, start long, end long")
    assert sorted((tuple(r) for r in ranges.merge_ranges(df, ["name"], most).collect()), key=str) == _merged(rows)
    alone = [("a", r[1], r[2]) for r in rows]
    assert sorted((("a", *r) for r in ranges.merge_ranges(df.drop("name"), None, most).collect()), key=str) == _merged(alone)


@pytest.mark.parametrize("sets,most", [(500, 1000), (3, 1000)])
def test_tasks_of_range_merge_do_not_grow(spark, sets, most):
    rows = spark.range(20_000).select((F.col("id") % sets).alias("name"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    got = ranges.merge_ranges(rows, ["name"], most).groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    assert got[0] == 20_000 and got[1] <= 3 * most  # before, all in as many tasks as shuffles have


def test_more_sets_take_more_tasks(spark):
    rows = spark.range(2_400_000).select((F.col("id") % 2400).alias("name"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    got = ranges.merge_ranges(rows, ["name"]).groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    assert got[0] == 2_400_000 and got[1] <= 400_000  # of 200,000 on average; four shuffle partitions would hold 600,000
