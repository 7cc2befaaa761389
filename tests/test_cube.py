import json

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import cube
from cubeloom.plans import query as q
from cubeloom.plans.spec import Composite, CubeSpec, TimeBucket

KEYS = [{"name": k, "type": "string"} for k in ("publisher", "advertiser", "location")]
# Three advertising events whose cubes have known sizes and sums.
ROWS = [
    ("google", "starbucks", "SKY", 5.5, 10.0, 1000, 100, 300),
    ("google", "safeway", "N", 3.5, 5.0, 100, 150, 300),
    ("google", "safeway", "SKY", 3.55, 5.5, 105, 155, 305),
]
SCHEMA = "publisher string, advertiser string, location string, cost double, revenue double, impressions long, clicks long, time long"
ALL = [[], ["location"], ["advertiser"], ["publisher"], ["location", "advertiser"], ["location", "publisher"], ["advertiser", "publisher"], ["location", "advertiser", "publisher"]]


def values(*aggregators):
    return [{"name": n, "type": t, "aggregators": list(aggregators)} for n, t in (("impressions", "long"), ("clicks", "long"), ("cost", "double"), ("revenue", "double"))]


def events(spark, n=3):
    return spark.createDataFrame(ROWS[:n], SCHEMA)


def aggregates(spec, rows):
    """Aggregates as the spec counts them: one per group and aggregator."""
    total = 0
    kinds = {d.dd_id: {a for _, a in d.aggregates if isinstance(a, str)} for d in spec.descriptors()}
    for r in rows:
        parts = {p for a in kinds[r["dd_id"]] for p in (("SUM", "COUNT") if a == "AVG" else (a,))}
        total += len(parts)
    return total


def test_one_combination_sums(spark):
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM"), "timeBuckets": ["1m"], "dimensions": [{"combination": ["publisher"]}]})
    out = cube.compute(events(spark, 2), spec).collect()
    assert len(out) == 1
    assert (out[0]["publisher"], out[0]["time"], out[0]["clicks_sum"], out[0]["cost_sum"]) == ("google", 0, 250, 9.0)


@pytest.mark.parametrize("n,count", [(1, 60), (3, 114)])
def test_additional_values_count(spark, n, count):
    dims = [{"combination": c} for c in ALL]
    dims[0]["additionalValues"] = ["impressions:MIN", "clicks:MIN", "cost:MIN", "revenue:MIN", "impressions:MAX", "clicks:MAX", "cost:MAX", "revenue:MAX"]
    dims[1]["additionalValues"] = dims[0]["additionalValues"]
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM", "COUNT"), "timeBuckets": ["1m", "1h", "1d"], "dimensions": dims})
    rows = cube.compute(events(spark, n), spec).collect()
    assert aggregates(spec, rows) == count
    assert len(spec.descriptors()) == 24


def test_grand_total_without_keys(spark):
    spec = CubeSpec.from_json({"values": values("SUM", "AVG"), "timeBuckets": ["1m", "1h", "1d"]})
    rows = cube.compute(events(spark, 2), spec).collect()
    assert aggregates(spec, rows) == 6
    assert rows[0]["cost_avg"] == 4.5


def test_custom_bucket_ids():
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM"), "timeBuckets": ["1m", "1h", "1d", "5m", "3h"], "dimensions": [{"combination": []}]})
    assert [spec.bucket_ids[d.bucket.label] for d in spec.descriptors()] == [2, 3, 4, 256, 257]


def test_no_time_collapses(spark):
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM"), "dimensions": [{"combination": c} for c in ALL]})
    rows = cube.compute(events(spark, 1), spec).collect()
    assert len(rows) == 8 and {r["time"] for r in rows} == {None}


def test_all_combinations_is_a_cube():
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM"), "dimensions": "ALL_COMBINATIONS"})
    assert {frozenset(c.keys) for c in spec.combinations} == {frozenset(c) for c in ALL}


def test_value_without_aggregators_only_where_added(spark):
    spec = CubeSpec.from_json(
        {
            "keys": KEYS,
            "values": [*values("SUM")[:3], {"name": "revenue", "type": "double"}],
            "timeBuckets": ["1m"],
            "dimensions": [{"combination": []}, {"combination": ["publisher"], "additionalValues": ["revenue:SUM"]}],
        }
    )
    rows = sorted(cube.compute(events(spark, 1), spec).collect(), key=lambda r: r["dd_id"])
    assert [r["revenue_sum"] for r in rows] == [None, 10.0]


def test_dimension_time_buckets_are_united(spark):
    dims = [{"combination": ["publisher"], "timeBuckets": ["1d", "1h", "5m"]}, {"combination": []}, {"combination": ["location"], "timeBuckets": ["1d", "1h", "5m", "3d"]}]
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM"), "timeBuckets": ["1m", "30s"], "dimensions": dims})
    assert [len(c.buckets) for c in spec.combinations] == [5, 2, 6]
    assert len(cube.compute(events(spark, 1), spec).collect()) == 13


def test_composites_imply_combinations():
    comp = {"aggregator": "TOPN", "count": 10, "embededAggregator": "AVG", "subCombinations": ["publisher", "location"]}
    spec = CubeSpec.from_json({"keys": KEYS, "values": values(), "timeBuckets": ["1m", "1h"], "dimensions": [{"combination": ["advertiser"], "additionalValues": [{"cost": comp}]}]})
    assert spec.combinations[0].aggregates[0][1].name == "TOPN-AVG-10_location_publisher"
    extra = spec.combinations[1]
    assert extra.implicit and set(extra.keys) == {"advertiser", "publisher", "location"} and {a for _, a in extra.aggregates} == {"SUM", "COUNT"}
    assert len(spec.descriptors()) == 4


def test_top_map_and_ties(spark):
    rows = [("p", loc, 100, 0) for loc in "ba"] + [("p", "c", 50, 0)]
    comp = {"aggregator": "TOPN", "count": 2, "embeddedAggregator": "SUM", "subCombinations": ["location"]}
    spec = CubeSpec.from_json({"keys": KEYS[::2], "values": [{"name": "n", "type": "long"}], "timeBuckets": ["1m"], "dimensions": [{"combination": ["publisher"], "additionalValues": [{"n": comp}]}]})
    c = cube.compute(spark.createDataFrame(rows, "publisher string, location string, n long, time long"), spec)
    at = spec.find({"publisher"}, "1m")
    agg = at.aggregates[0][1]
    assert isinstance(agg, Composite)
    top = cube.ranked(c, spec, at, "n", agg)
    assert [(r["rank"], r["location"]) for r in top.orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert cube.ranked_map(top, at, agg).first()[agg.name] == {"a": 100, "b": 100}


def test_custom_aggregator(spark):
    cube.register("SQUARES", cube.Aggregator({"sq": lambda v, o: F.sum(v * v)}, {"sq": F.sum}, lambda p: p["sq"]))
    spec = CubeSpec.from_json({"keys": KEYS, "values": [{"name": "clicks", "type": "long", "aggregators": ["SQUARES"]}]})
    assert cube.compute(events(spark), spec).first()["clicks_squares"] == 100**2 + 150**2 + 155**2


def test_expressions_aliases_and_missing_fields(spark):
    spec = CubeSpec.from_json({"keys": [{"name": "who", "type": "string", "expression": "upper(publisher)"}, {"name": "place", "type": "string"}, {"name": "none", "type": "string"}], "values": [{"name": "n", "type": "long", "aggregators": ["SUM"]}], "dimensions": [{"combination": ["who", "place", "none"]}]})
    out = cube.compute(events(spark), spec, aliases={"place": "location", "n": "clicks"}).orderBy("place").collect()
    assert [(r["who"], r["place"], r["none"], r["n_sum"]) for r in out] == [("GOOGLE", "N", None, 150), ("GOOGLE", "SKY", None, 255)]
    again = cube.compute(events(spark), spec, aliases={"place": "location", "n": "clicks"}, expressions={"who": "'x'"}).first()
    assert again["who"] == "x"


def test_nulls_empty_and_old_times(spark):
    spec = CubeSpec.from_json({"keys": KEYS, "values": values("SUM", "COUNT"), "timeBuckets": ["1m"], "dimensions": [{"combination": ["publisher"]}]})
    assert cube.compute(spark.createDataFrame([], SCHEMA), spec).count() == 0
    rows = [(None, "a", "l", None, 1.0, 1, None, -1), (None, "a", "l", 2.0, 1.0, 1, 3, -60_000)]
    out = cube.compute(spark.createDataFrame(rows, SCHEMA), spec).collect()
    assert [(r["publisher"], r["time"], r["cost_sum"], r["cost_count"], r["clicks_sum"]) for r in out] == [(None, -60_000, 2.0, 1, 3)]


@pytest.mark.parametrize("bad", [{"values": [{"name": "v", "type": "nope"}]}, {"values": values("MEDIAN")}, {"values": values("SUM"), "timeBuckets": ["0m"]}, {"keys": KEYS, "values": values("SUM"), "dimensions": [{"combination": ["x"]}]}])
def test_malformed_schemas_fail(bad):
    with pytest.raises((ValueError, KeyError)):
        CubeSpec.from_json(bad)


# ---- queries

SPEC = CubeSpec.from_json({"keys": [{"name": "publisher", "type": "string"}, {"name": "size", "type": "byte"}], "values": [{"name": "n", "type": "long", "aggregators": ["SUM", "COUNT"]}], "timeBuckets": ["1m"], "dimensions": [{"combination": ["publisher"]}, {"combination": ["publisher", "size"]}]})


def message(keys, time, fields=("time", "publisher", "region", "n:SUM"), **more):
    return json.dumps({"id": "7", "type": "dataQuery", "data": {"time": time, "keys": keys, "fields": list(fields)}, **more})


def small_cube(spark):
    rows = [(p, 1, n, t * 60_000) for p, n, t in [("a", 1, 0), ("a", 2, 1), ("a", 4, 2), ("a", 8, 4), ("b", 16, 1), ("b", 32, 2), ("c", 64, 2)]]
    return cube.compute(spark.createDataFrame(rows, "publisher string, size byte, n long, time long"), SPEC)


def run(spark, *a, **k):
    query = q.parse(message(*a, **k), SPEC)
    return sorted((r["time"] // 60_000, r["publisher"], r["n:SUM"]) for r in q.execute(small_cube(spark), SPEC, query).collect())


def test_latest_buckets_count_back_from_the_newest(spark):
    assert run(spark, {"publisher": ["a"]}, {"bucket": "1m", "latestNumBuckets": 3}) == [(2, "a", 4), (4, "a", 8)]


def test_from_to_is_inclusive_and_rounded(spark):
    assert run(spark, {"publisher": []}, {"bucket": "1m", "from": "61000", "to": "120001"}) == [(1, "a", 2), (1, "b", 16), (2, "a", 4), (2, "b", 32), (2, "c", 64)]


def test_in_list(spark):
    assert run(spark, {"publisher": ["b", "c"]}, {"bucket": "1m", "from": "120000", "to": "120000"}) == [(2, "b", 32), (2, "c", 64)]


def test_sliding_needs_every_bucket_of_its_frame(spark):
    assert run(spark, {"publisher": []}, {"bucket": "1m", "latestNumBuckets": 4, "slidingAggregateSize": "2"}) == [(1, "a", 3), (2, "a", 6), (2, "b", 48)]


def test_unknown_combination_has_no_query():
    assert q.parse(message({"size": [1]}, {"bucket": "1m", "latestNumBuckets": 1}), SPEC) is None
    assert q.parse(message({"publisher": []}, {"bucket": "1h", "latestNumBuckets": 1}), SPEC) is None


@pytest.mark.parametrize("keys", [{"publisher": [], "size": [128]}, {"publisher": [{"x": 1}]}, {"nope": []}])
def test_bad_key_values_fail(keys):
    with pytest.raises(ValueError):
        q.parse(message(keys, {"bucket": "1m", "latestNumBuckets": 1}), SPEC)


def test_expand_stars_and_prune():
    query = q.parse(message({"publisher": [], "size": [1, 2]}, {"bucket": "1m", "latestNumBuckets": 1}), SPEC)
    seen = {"publisher": ["b", "a", "c"]}
    assert len(q.expand(query, seen)) == 6
    assert len(q.expand(query, seen, valid=lambda so_far, k, v: v != "a")) == 4
    assert len(q.expand(query, seen, keep=lambda m: {**m, "size": [1]})) == 3
    with pytest.raises(ValueError):
        q.single(query)


def test_json_answer(spark):
    query = q.parse(message({"publisher": ["b"]}, {"bucket": "1m", "from": 0, "to": 120000}, countdown=299), SPEC)
    got = json.loads(q.to_json(q.execute(small_cube(spark), SPEC, query), query, SPEC).first()["message"])
    assert got == {"id": "7", "type": "dataResult", "data": [{"time": 60000, "publisher": "b", "region": "ALL", "n:SUM": "16"}, {"time": 120000, "publisher": "b", "region": "ALL", "n:SUM": "32"}], "countdown": 299}
    assert json.loads(q.answer(spark, small_cube(spark), SPEC, '{"id": 1, "type": "schemaQuery"}'))["data"][0]["time"]["to"] == 240000


def test_value_alone_means_all_its_aggregators():
    query = q.parse(message({"publisher": []}, {"bucket": "1m", "latestNumBuckets": 1}, fields=["n", "time"]), SPEC)
    assert q.wanted(query, SPEC, SPEC.find({"publisher"}, "1m")) == (["time"], [("n", "SUM"), ("n", "COUNT")])


def test_time_bucket():
    assert TimeBucket("3h").millis == 10_800_000 and TimeBucket("ALL").millis is None


def test_query_of_a_composite(spark):
    comp = [{"aggregator": k, "count": 2, "embeddedAggregator": a, "subCombinations": ["location"]} for k, a in (("TOPN", "SUM"), ("BOTTOMN", "AVG"))]
    spec = CubeSpec.from_json(
        {
            "keys": KEYS[::2],
            "values": [{"name": "n", "type": "long", "aggregators": ["SUM"]}],
            "timeBuckets": ["1m"],
            "dimensions": [{"combination": ["publisher"], "additionalValues": [{"n": comp[0]}, {"n": comp[1]}]}],
        }
    )
    rows = [("p", "CA", 50, 0), ("p", "WA", 51, 0), ("p", "ON", 52, 0), ("p", "ON", 2, 0), ("q", "CA", 1, 0)]
    c = cube.compute(spark.createDataFrame(rows, "publisher string, location string, n long, time long"), spec)
    text = {"id": "1", "type": "dataQuery", "data": {"time": {"bucket": "1m", "latestNumBuckets": 1}, "keys": {"publisher": ["p"]}, "fields": ["time", "n:SUM", "n:TOPN-SUM-2_location", "n:BOTTOMN-AVG-2_location"]}}
    query = q.parse(json.dumps(text), spec)
    got = q.execute(c, spec, query).collect()
    assert len(got) == 1 and got[0]["n:SUM"] == 155
    assert got[0]["n:TOPN-SUM-2_location"] == {"ON": 54, "WA": 51} and got[0]["n:BOTTOMN-AVG-2_location"] == {"ON": 27.0, "CA": 50.0}
    message = json.loads(q.to_json(q.execute(c, spec, query), query, spec).first()["message"])
    assert message["data"][0]["n:TOPN-SUM-2_location"] == "[{ON:54},{WA:51}]"
