"""The engine's operators as queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import bloom, delimited
from cubeloom.functions.timebucket import epoch_millis
from cubeloom.operators import cube, dedup, enrich, kvstore, lateness, partitioning, ranges, results
from cubeloom.plans import query as q
from cubeloom.plans.spec import CubeSpec
from cubeloom.sources import lookup as lookups
from cubeloom.sources.events import Log, convert, rate_windows
from cubeloom.streaming import cube as stream_cube
from cubeloom.streaming import dedup as stream_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EV = "(select *, cast(round(value * 100) as bigint) as v, (epoch_us(ts) // 1000) as t from events) e"
HOUR, DAY = 3_600_000, 86_400_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("t", epoch_millis(F.col("ts")))


def event_spec(dims: list | str, buckets: list[str], aggregators: list, **more) -> CubeSpec:
    return CubeSpec.from_json(
        {
            "keys": [{"name": "event_type", "type": "string"}, {"name": "user_id", "type": "long"}],
            "values": [{"name": "value", "type": "double", "scale": 2, "aggregators": aggregators}],
            "timeBuckets": buckets,
            "dimensions": dims,
            **more,
        }
    )


def event_cube(spark: SparkSession, sf_dir: str, spec: CubeSpec) -> DataFrame:
    return cube.compute(events(spark, sf_dir), spec, time="t", order="event_id")


def per_bucket(buckets: list[str], select: str, group: str, source: str = EV) -> str:
    """One SELECT per time bucket. {t}: start of the bucket; {b}: its label."""
    units = {"m": 60_000, "h": HOUR, "d": DAY}
    parts = []
    for b in buckets:
        t = f"(t - t % {int(b[:-1]) * units[b[-1]]})"
        parts.append(f"select {select} from {source} group by {group}".replace("{t}", t).replace("{b}", f"'{b}'"))
    return " union all ".join(parts)


# ---- cube ----------------------------------------------------------------------------

HOURLY = event_spec([{"combination": ["event_type"]}], ["1h", "1d"], ["SUM", "COUNT"])
SUM, CNT = "cast(sum(v) as double) / 100.0", "count(v)"


@query(per_bucket(["1h", "1d"], f"{{b}} as time_bucket, {{t}} as time, event_type, {SUM} as value_sum, {CNT} as value_count", "{t}, event_type"))
def cube_sum_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cube(spark, sf_dir, HOURLY).select("time_bucket", "time", "event_type", "value_sum", "value_count")


@query(per_bucket(["1m", "1h", "1d", "5m", "3h"], f"{{b}} as time_bucket, {{t}} as time, {SUM} as value_sum, {CNT} as value_count", "{t}"))
def cube_multi_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec([{"combination": []}], ["1m", "1h", "1d", "5m", "3h"], ["SUM", "COUNT"])
    return event_cube(spark, sf_dir, spec).select("time_bucket", "time", "value_sum", "value_count")


def line_spec(dims: list | str, quantity: list, price: list, buckets: list[str]) -> CubeSpec:
    return CubeSpec.from_json(
        {
            "keys": [{"name": "flag", "type": "char", "expression": "l_returnflag"}, {"name": "status", "type": "char", "expression": "l_linestatus"}],
            "values": [
                {"name": "quantity", "type": "double", "scale": 0, "expression": "l_quantity", "aggregators": quantity},
                {"name": "price", "type": "double", "scale": 2, "expression": "l_extendedprice", "aggregators": price},
            ],
            "timeBuckets": buckets,
            "dimensions": dims,
        }
    )


LI = "(select l_returnflag as flag, l_linestatus as status, cast(round(l_quantity) as bigint) as n, cast(round(l_extendedprice * 100) as bigint) as p, (epoch_us(l_shipdate) // 1000) as t from lineitem) l"
_DAY_T = f"(t - t % {DAY})"


def line_cube(spark: SparkSession, sf_dir: str, spec: CubeSpec) -> DataFrame:
    return cube.compute(read(spark, sf_dir, "lineitem"), spec, time=epoch_millis(F.col("l_shipdate")))


@query(
    " union all ".join(
        f"select cast({i} as integer) as dd_id, {_DAY_T} as time, {f} as flag, {s} as status, cast(sum(n) as double) / 1.0 as quantity_sum from {LI} group by {', '.join([_DAY_T, *g])}"
        for i, f, s, g in [(0, "cast(null as varchar)", "cast(null as varchar)", []), (1, "flag", "cast(null as varchar)", ["flag"]), (2, "cast(null as varchar)", "status", ["status"]), (3, "flag", "status", ["flag", "status"])]
    )
)
def cube_all_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = line_spec("ALL_COMBINATIONS", ["SUM"], [], ["1d"])
    return line_cube(spark, sf_dir, spec).select("dd_id", "time", "flag", "status", "quantity_sum")


@query(
    f"select cast(0 as integer) as dd_id, {_DAY_T} as time, cast(null as varchar) as flag, cast(sum(n) as double) / 1.0 as quantity_sum, cast(null as double) as price_min, cast(null as double) as price_max from {LI} group by {_DAY_T}"
    f" union all select cast(1 as integer), {_DAY_T}, flag, cast(sum(n) as double) / 1.0, min(p) / 100.0, max(p) / 100.0 from {LI} group by {_DAY_T}, flag"
)
def cube_additional_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = line_spec([{"combination": []}, {"combination": ["flag"], "additionalValues": ["price:MIN", "price:MAX"]}], ["SUM"], [], ["1d"])
    return line_cube(spark, sf_dir, spec).select("dd_id", "time", "flag", "quantity_sum", "price_min", "price_max")


ORDER_SPEC = CubeSpec.from_json(
    {
        "keys": [{"name": "status", "type": "char", "expression": "o_orderstatus"}, {"name": "priority", "type": "string", "expression": "o_orderpriority"}],
        "values": [{"name": "price", "type": "double", "scale": 2, "expression": "o_totalprice", "aggregators": ["SUM", "COUNT"]}],
        "dimensions": [{"combination": ["status"]}, {"combination": ["priority"]}, {"combination": ["status", "priority"]}],
    }
)
_OR = "(select o_orderstatus as status, o_orderpriority as priority, cast(round(o_totalprice * 100) as bigint) as p from orders) o"


@query(
    " union all ".join(
        f"select cast({i} as integer) as dd_id, {s} as status, {p} as priority, cast(sum(p) as double) / 100.0 as price_sum, count(p) as price_count from {_OR} group by {g}"
        for i, s, p, g in [(0, "status", "cast(null as varchar)", "status"), (1, "cast(null as varchar)", "priority", "priority"), (2, "status", "priority", "status, priority")]
    )
)
def cube_no_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.compute(read(spark, sf_dir, "orders"), ORDER_SPEC, time=F.lit(None).cast("bigint"))
    return out.select("dd_id", "status", "priority", "price_sum", "price_count")


@query(
    f"select '1d' as time_bucket, (t - t % {DAY}) as time, cast(null as varchar) as event_type, {CNT} as value_count from {EV} group by 2"
    f" union all select '1d', (t - t % {DAY}), event_type, {CNT} from {EV} group by 2, 3 union all select '2h', (t - t % {2 * HOUR}), event_type, {CNT} from {EV} group by 2, 3"
)
def cube_dimension_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec([{"combination": []}, {"combination": ["event_type"], "timeBuckets": ["2h"]}], ["1d"], ["COUNT"])
    return event_cube(spark, sf_dir, spec).select("time_bucket", "time", "event_type", "value_count")


@query(per_bucket(["1d"], "{t} as time, event_type, cast(sum(v) as double) / count(v) / 100.0 as value_avg, min(v) / 100.0 as value_min, max(v) / 100.0 as value_max", "{t}, event_type"))
def cube_avg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec([{"combination": ["event_type"]}], ["1d"], ["AVG", "MIN", "MAX"])
    return event_cube(spark, sf_dir, spec).select("time", "event_type", "value_avg", "value_min", "value_max")


@query(f"select (t - t % {DAY}) as time, event_type, arg_min(v, (t, event_id)) / 100.0 as value_first, arg_max(v, (t, event_id)) / 100.0 as value_last from {EV} group by 1, 2")
def cube_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec([{"combination": ["event_type"]}], ["1d"], ["FIRST", "LAST"])
    return event_cube(spark, sf_dir, spec).select("time", "event_type", "value_first", "value_last")


@query(f"select time, event_type, cast(sum(s) over (partition by event_type order by time rows between unbounded preceding and current row) as double) / 100.0 as value_cum_sum from (select (t - t % {HOUR}) as time, event_type, sum(v) as s from {EV} group by 1, 2) g")
def cube_cum_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec([{"combination": ["event_type"]}], ["1h"], ["CUM_SUM"])
    return event_cube(spark, sf_dir, spec).select("time", "event_type", "value_cum_sum")


def top_spec(kind: str, inner: str) -> CubeSpec:
    composite = {"aggregator": kind, "count": 3, "embeddedAggregator": inner, "subCombinations": ["type"]}
    return CubeSpec.from_json(
        {
            "keys": [{"name": "brand", "type": "string", "expression": "p_brand"}, {"name": "type", "type": "string", "expression": "p_type"}],
            "values": [{"name": "quantity", "type": "double", "scale": 0, "expression": "l_quantity"}],
            "dimensions": [{"combination": ["brand"], "additionalValues": [{"quantity": composite}]}],
        }
    )


def top(spark: SparkSession, sf_dir: str, kind: str, inner: str) -> DataFrame:
    spec = top_spec(kind, inner)
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    rows = cube.compute(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), spec, time=F.lit(None).cast("bigint"))
    at = spec.find({"brand"}, "ALL")
    return cube.ranked(rows, spec, at, "quantity", at.aggregates[0][1]).select("brand", "rank", "type", F.col("value").cast("double").alias("value"))


def top_sql(value: str, direction: str) -> str:
    inner = f"select p_brand as brand, p_type as type, {value} as value from lineitem join part on l_partkey = p_partkey group by 1, 2"
    return f"select brand, cast(r as integer) as rank, type, value from (select *, row_number() over (partition by brand order by value {direction}, type) as r from ({inner}) g) h where r <= 3"


@query(top_sql("cast(sum(cast(round(l_quantity) as bigint)) as double) / 1.0", "desc"))
def cube_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir, "TOPN", "SUM")


@query(top_sql("cast(sum(cast(round(l_quantity) as bigint)) as double) / 1.0 / count(*)", "asc"))
def cube_bottomn_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir, "BOTTOMN", "AVG")


@query(ORACLE_SQL["cube_sum_hourly"])
def cube_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of two windows of events, made apart and merged."""
    rows = cube.project(events(spark, sf_dir), HOURLY, time="t", order="event_id")
    halves = [cube.partials(rows.where(F.pmod(F.col("_order.event_id"), F.lit(2)) == i), HOURLY) for i in (0, 1)]
    out = cube.finish(cube.group(cube.merge(*halves), HOURLY), HOURLY)
    return out.select("time_bucket", "time", "event_type", "value_sum", "value_count")


# ---- queries -------------------------------------------------------------------------

QSPEC = event_spec([{"combination": ["event_type"]}, {"combination": []}], ["1h", "1d"], ["SUM", "COUNT", "MIN"])
_GRID = f"(select (t - t % {HOUR}) as time, event_type, sum(v) as s, count(v) as n from {EV} group by 1, 2)"
_LAST = f"(select max(t) - max(t) % {HOUR} from {EV})"


def ask(spark: SparkSession, sf_dir: str, data: str, **more) -> tuple[DataFrame, q.DataQuery]:
    found = q.parse(f'{{"id": "1", "type": "dataQuery", "data": {data}}}', QSPEC)
    return q.execute(event_cube(spark, sf_dir, QSPEC), QSPEC, found, **more), found


def plainly(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.lower().replace(":", "_") for c in rows.columns])


@query(f"select time, event_type, cast(s as double) / 100.0 as value_sum, cast(s as double) / 100.0 / n as value_avg from {_GRID} g where time > {_LAST} - 24 * {HOUR}")
def query_latest_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plainly(ask(spark, sf_dir, '{"time": {"latestNumBuckets": 24, "bucket": "1h"}, "keys": {"event_type": []}, "fields": ["time", "event_type", "value:SUM", "value:AVG"]}')[0])


@query(f"select time, event_type, n as value_count from {_GRID} g where time between 1704672000000 and 1704930000000 - 1704930000000 % {HOUR}")
def query_from_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plainly(ask(spark, sf_dir, '{"time": {"from": "1704673800000", "to": "1704930000000", "bucket": "1h"}, "keys": {"event_type": []}, "fields": ["value:COUNT"]}')[0])


@query(f"select time, event_type, n as value_count from {_GRID} g where event_type in ('click', 'view') and time > {_LAST} - 100 * {HOUR}")
def query_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plainly(ask(spark, sf_dir, '{"time": {"latestNumBuckets": 100, "bucket": "1h"}, "keys": {"event_type": ["click", "view"]}, "fields": ["value:COUNT"]}')[0])


@query(f"select k.event_type, h.time, coalesce(g.n, 0) as value_count from (select distinct event_type from events) k cross join (select distinct (t - t % {DAY}) as time from {EV}) h left join (select (t - t % {DAY}) as time, event_type, count(v) as n from {EV} group by 1, 2) g on g.event_type = k.event_type and g.time = h.time")
def query_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seen values of a starred key by all buckets; keys without events count 0."""
    base = event_cube(spark, sf_dir, QSPEC)
    days = base.where(F.col("dd_id") == QSPEC.find(set(), "1d").dd_id).select("time")
    kinds = cube.seen_keys(read(spark, sf_dir, "events"), ["event_type"]).select(F.col("value").alias("event_type"))
    grid = cube.every_pair(days, kinds)
    rows = base.where(F.col("dd_id") == QSPEC.find({"event_type"}, "1d").dd_id).select("time", "event_type", "value_count")
    return grid.join(rows, ["time", "event_type"], "left").select("event_type", "time", F.coalesce("value_count", F.lit(0)).alias("value_count"))


@query(f"select time, event_type, n as value_count from {_GRID} g where time > {_LAST} - 48 * {HOUR} and event_type in (select event_type from events group by event_type having max(value) >= 200)")
def query_valid_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("m")).where("m >= 200").select("event_type")
    return plainly(ask(spark, sf_dir, '{"time": {"latestNumBuckets": 48, "bucket": "1h"}, "keys": {"event_type": []}, "fields": ["value:COUNT"]}', valid=valid)[0])


_ROLL = f"select time, event_type, sum(s) over w as s, sum(n) over w as n, count(*) over w as k from {_GRID} g window w as (partition by event_type order by time range between {4 * HOUR} preceding and current row)"


@query(f"select time, event_type, round(cast(s as double) / 100.0, 2) as value_sum, cast(n as bigint) as value_count, round(cast(s as double) / 100.0 / n, 6) as value_avg from ({_ROLL}) r where k = 5 and time > {_LAST} - 300 * {HOUR}")
def query_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ask(spark, sf_dir, '{"time": {"latestNumBuckets": 300, "bucket": "1h", "slidingAggregateSize": 5}, "keys": {"event_type": []}, "fields": ["value:SUM", "value:COUNT", "value:AVG"]}')
    out = plainly(rows)
    exact = lambda c, d: F.round(F.col(c), d)
    return out.select("time", "event_type", exact("value_sum", 2).alias("value_sum"), "value_count", exact("value_avg", 6).alias("value_avg"))


@query(f"select cast(time as varchar) as time, 'ALL' as region, event_type, cast(n as varchar) as value_count from {_GRID} g where time > {_LAST} - 10 * {HOUR}")
def query_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer of a query, read back; a field that is no key prints as ALL."""
    rows, found = ask(spark, sf_dir, '{"time": {"latestNumBuckets": 10, "bucket": "1h"}, "keys": {"event_type": []}, "fields": ["time", "region", "event_type", "value:COUNT"]}')
    message = q.to_json(rows, found, QSPEC)
    body = F.from_json("message", "data array<struct<time:string,region:string,event_type:string,`value:COUNT`:string>>")
    return message.select(F.explode(body["data"]).alias("r")).select("r.time", "r.region", "r.event_type", F.col("r.`value:COUNT`").alias("value_count"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as query results: a day's window, an id, and data that may be empty."""
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "schemaResult").otherwise("dataResult")
    data = F.when(F.col("value") < 40, F.array().cast("array<double>")).otherwise(F.array("value"))
    return e.select(F.floor(F.col("t") / DAY).alias("window_id"), F.pmod("user_id", F.lit(7)).alias("id"), kind.alias("type"), data.alias("data"), F.col("event_id").alias("seq"))


_MSG = f"(select t // {DAY} as window_id, user_id % 7 as id, case when event_type = 'error' then 'schemaResult' else 'dataResult' end as type, value >= 40 as full_, value, event_id as seq from {EV}) m"
_MSG_OUT = "cast(window_id as bigint) as window_id, cast(id as bigint) as id, type, seq, case when full_ then value end as value"


def message_rows(df: DataFrame) -> DataFrame:
    return df.select("window_id", "id", "type", "seq", F.get("data", F.lit(0)).alias("value"))


@query(f"select {_MSG_OUT} from (select *, row_number() over (partition by window_id, id, type order by not full_, seq) as r from {_MSG}) x where r = 1 or type <> 'dataResult'")
def query_merge_unifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_rows(results.merge_results(messages(spark, sf_dir)))


@query(f"select {_MSG_OUT} from {_MSG} where type <> 'dataResult' or full_")
def query_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_rows(results.non_empty(messages(spark, sf_dir)))


# ---- enrichment ----------------------------------------------------------------------


@query("select o_orderkey, coalesce(c_custkey, o_custkey) as o_custkey, c_name, c_mktsegment, case when c_custkey is not null then c_mktsegment else o_orderstatus end as o_orderstatus from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey")
def enrich_left_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment", F.col("c_mktsegment").alias("o_orderstatus"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return enrich.enrich_map(orders, lookup, {"o_custkey": "c_custkey"}, ["c_name", "c_mktsegment", "o_orderstatus"])


@query("select l_orderkey as order_key, l_linenumber as line, l_quantity as quantity, p_brand as brand, coalesce(p_size, 0) as size, coalesce(p_retailprice, 0.0) as price from lineitem left join (select * from part where p_size > 20) on l_partkey = p_partkey")
def enrich_default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = enrich.mapping("l_orderkey:order_key,l_linenumber:line,l_quantity:quantity")
    add = enrich.mapping("p_brand:brand,p_size:size,p_retailprice:price", reverse=True)
    lookup = read(spark, sf_dir, "part").where("p_size > 20")
    return enrich.enrich_typed(read(spark, sf_dir, "lineitem"), lookup, enrich.mapping("l_partkey:p_partkey"), copy, add)


@query("select c_custkey, c_name, last_value as last_value from customer left join (select user_id, arg_max(value, event_id) as last_value from events group by 1) on c_custkey = user_id")
def enrich_last_key_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = enrich.one_per_key(read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", F.col("value").alias("last_value"))
    return enrich.enrich_map(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), lookup, {"c_custkey": "user_id"}, ["last_value"])


@query("select c_custkey, c_name, first_type as first_type from customer left join (select user_id, arg_min(event_type, event_id) as first_type from events group by 1) on c_custkey = user_id")
def enrich_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = enrich.one_per_key(read(spark, sf_dir, "events"), ["user_id"], "event_id", last=False).select("user_id", F.col("event_type").alias("first_type"))
    return enrich.enrich_map(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), lookup, {"c_custkey": "user_id"}, ["first_type"])


# ---- deduplication and lateness ------------------------------------------------------


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive somewhat out of order: seq is the order of arrival."""
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", "event_type", "value", "t", ((F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(1000))) * 1_000_000_000 + F.col("event_id")).alias("seq"), F.floor(F.col("t") / HOUR).alias("hour"))


_SH = f"(select *, (event_id + (event_id * 7919) % 1000) * 1000000000 + event_id as seq, t // {HOUR} as hour from {EV}) s"


@query(f"select event_id, case when row_number() over (partition by user_id, event_type order by seq) = 1 then 'unique' else 'duplicate' end as disposition from {_SH}")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_key(shuffled(spark, sf_dir), ["user_id", "event_type"], "seq").select("event_id", "disposition")


def expiry_sql(value: str, period: int, span: int) -> str:
    seen = f"select *, {value} as k, max({value}) over (order by seq rows between unbounded preceding and 1 preceding) as seen from {_SH}"
    live = f"select *, case when k < coalesce(seen - {period} + 1, -1000000000000000) then 'expired' else 'live' end as state from ({seen}) a"
    return f"select event_id, case when state = 'expired' then 'expired' when row_number() over (partition by state, user_id, event_type, k // {span} order by seq) = 1 then 'unique' else 'duplicate' end as disposition from ({live}) b"


@query(expiry_sql("hour", 48, 6))
def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ordered_expiry(shuffled(spark, sf_dir), ["user_id", "event_type"], "hour", "seq", 48, 6).select("event_id", "disposition")


@query(expiry_sql("(t // 1000)", 172_800, 21_600))
def dedup_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.time_expiry(shuffled(spark, sf_dir), ["user_id", "event_type"], "t", "seq", 172_800, 21_600).select("event_id", "disposition")


NOW = 1_705_968_000_000


@query(f"select event_id, case when t // 1000 < {NOW // 1000 - 864_000 + 1} then 'expired' when row_number() over (partition by t // 1000 < {NOW // 1000 - 864_000 + 1}, user_id, event_type, (t // 1000) // 3600 order by seq) = 1 then 'unique' else 'duplicate' end as disposition from {_SH}")
def dedup_system_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.time_expiry(shuffled(spark, sf_dir), ["user_id", "event_type"], "t", "seq", 864_000, 3600, now_ms=NOW).select("event_id", "disposition")


_CAT = f"(select *, cast(t // {DAY} as varchar) as day from {_SH}) c"
_NTH = f"select c.*, f.nth from {_CAT} join (select day, row_number() over (order by min(seq)) as nth from {_CAT} group by day) f using (day)"
_NEW = f"select *, greatest(nth, coalesce(max(nth) over (order by seq rows between unbounded preceding and 1 preceding), 0)) as newest from ({_NTH}) n"


@query(f"select event_id, case when state = 'expired' then 'expired' when row_number() over (partition by state, user_id order by seq) = 1 then 'unique' else 'duplicate' end as disposition from (select *, case when nth < newest - 2 + 1 then 'expired' else 'live' end as state from ({_NEW}) a) b")
def dedup_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffled(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("string"))
    return dedup.categorical_expiry(rows, ["user_id"], "day", "seq", 2).select("event_id", "disposition")


def jump_sql(rows: str) -> str:
    """jump_expiry of the hour (48, 6, 3), row after row."""
    return f"""with recursive o as materialized (select row_number() over (order by seq) as r, event_id, user_id, event_type, seq, hour from {rows}),
    w(r, live, e) as (select r, 'live', hour from o where r = 1 union all
        select o.r, case when o.hour < w.e - 47 then 'expired' when w.e - 47 > 0 and o.hour - w.e > 3 then 'error' else 'live' end,
            case when o.hour < w.e - 47 or (w.e - 47 > 0 and o.hour - w.e > 3) then w.e else greatest(w.e, o.hour) end from w join o on o.r = w.r + 1)
    select event_id, case when live <> 'live' then live when row_number() over (partition by live, user_id, event_type, hour // 6 order by seq) = 1 then 'unique' else 'duplicate' end as disposition from o join w using (r)"""


@query(jump_sql(_SH))
def dedup_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jump_expiry(shuffled(spark, sf_dir), ["user_id", "event_type"], "hour", "seq", 48, 6, 3).select("event_id", "disposition")


@query(f"select event_id, case when r > 1 or exists (select 1 from events h where h.event_id % 10 < 3 and h.user_id = a.user_id and h.event_type = a.event_type and h.event_id // 50 = a.event_id // 50) then 'duplicate' else 'unique' end as disposition from (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type, event_id // 50 order by seq) as r from {_SH} where event_id % 10 >= 3) a")
def dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against keys seen before: those the filter does not know are never joined."""
    rows = shuffled(spark, sf_dir).withColumn("part", F.floor(F.col("event_id") / 50))
    seen, new = rows.where(F.col("event_id") % 10 < 3), rows.where(F.col("event_id") % 10 >= 3)
    return dedup.by_key_filtered(new, seen, ["user_id", "event_type", "part"], "seq", bloom.BloomShape(100_000, 0.01)).select("event_id", "disposition")


@query("select count(*) as built, 0 as missed, true as rate_held from events where event_id % 2 = 0")
def bloom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the event ids are built in: none is missed, and at most 2% of as many others pass (0.01 by design)."""
    ids = read(spark, sf_dir, "events").select("event_id")
    inside = F.col("event_id") % 2 == 0
    shape = bloom.BloomShape(max(100, ids.where(inside).count()), 0.01)
    found = bloom.probe(ids, "event_id", bloom.build(ids.where(inside), "event_id", shape), shape)
    share = F.avg(F.when(~inside, F.col("might_contain").cast("int")))
    return found.agg(F.sum(inside.cast("int")).alias("built"), F.sum((inside & ~F.col("might_contain")).cast("int")).alias("missed"), (share <= 0.02).alias("rate_held"))


@query(f"select event_id, row_number() over (order by seq) as place from {_SH} join ({expiry_sql('hour', 48, 6)}) d using (event_id) where disposition = 'unique'")
def dedup_ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique rows in the order of arrival, with their place."""
    rows = shuffled(spark, sf_dir)
    found = dedup.ordered_expiry(rows, ["user_id", "event_type"], "hour", "seq", 48, 6)
    return dedup.ordered_output(found, "seq").select("event_id", "place")


_EXP = expiry_sql("hour", 48, 6)


@query(f"select k.disposition, coalesce(n, 0) as n from (values ('unique'), ('duplicate'), ('expired'), ('error')) k(disposition) left join (select disposition, count(*) as n from ({_EXP}) x group by 1) c on c.disposition = k.disposition")
def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.counters(dedup_ordered(spark, sf_dir))


REF = 1_705_000_000_000


@query(f"select event_id, case when t > {REF} + 60000 then 'early' when t < {REF} - {REF} % {HOUR} - {HOUR * 240} then 'late' when t >= {REF} - {REF} % {HOUR} then 'normal' else 'laggard' end as lateness from {EV}")
def lateness_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", lateness.classify(F.col("t"), REF, laggards=240 * HOUR).alias("lateness"))


@query(f"select lateness, count(*) as n from ({ORACLE_SQL['lateness_split']}) x group by 1")
def lateness_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateness_split(spark, sf_dir).groupBy("lateness").agg(F.count("*").alias("n"))


# ---- keyed store and ranges ----------------------------------------------------------


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an operation log of 2,003 keys in four buckets, with deletes and purges."""
    o = read(spark, sf_dir, "orders")
    key = F.pmod("o_orderkey", F.lit(2003))
    op = F.when(F.pmod("o_orderkey", F.lit(500)) == 77, "PURGE").when(F.pmod("o_orderkey", F.lit(17)) == 3, "DELETE").otherwise("PUT")
    return o.select(F.col("o_orderkey").alias("seq"), F.pmod(key, F.lit(4)).alias("bucket"), op.alias("op"), key.alias("key"), F.when(op == "PURGE", key + 40).alias("end_key"), F.when(op == "PUT", F.col("o_totalprice")).alias("value"), F.floor(F.col("o_orderkey") / 1000).alias("window_id"))


_OP = "case when o_orderkey % 500 = 77 then 'PURGE' when o_orderkey % 17 = 3 then 'DELETE' else 'PUT' end"
_LOG = f"(select o_orderkey as seq, (o_orderkey % 2003) % 4 as bucket, {_OP} as op, o_orderkey % 2003 as key, case when {_OP} = 'PURGE' then o_orderkey % 2003 + 40 end as end_key, case when {_OP} = 'PUT' then o_totalprice end as value, o_orderkey // 1000 as window_id from orders) l"
_LIVE = f"(select bucket, key, value, seq from (select *, row_number() over (partition by bucket, key order by seq desc) as r from {_LOG} where op <> 'PURGE') x where r = 1 and op = 'PUT')"


@query(f"select bucket, key, value, seq from {_LIVE} v")
def kv_last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.last_writes(oplog(spark, sf_dir))


@query(f"select bucket, key, value, seq from {_LIVE} v where not exists (select 1 from {_LOG} where op = 'PURGE' and l.bucket = v.bucket and l.seq > v.seq and v.key between l.key and l.end_key)")
def kv_purge_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.compact(oplog(spark, sf_dir))


_WIDE = f"(select seq, bucket, op, key * 1000000007 as key, case when op = 'PURGE' then key * 1000000007 + 10000000000000 end as end_key, value from {_LOG}) l"


@query(f"select bucket, key, value, seq from (select *, row_number() over (partition by bucket, key order by seq desc) as r from {_WIDE} where op <> 'PURGE') v where r = 1 and op = 'PUT' and not exists (select 1 from {_WIDE} where l.op = 'PURGE' and l.bucket = v.bucket and l.seq > v.seq and v.key between l.key and l.end_key)")
def kv_purge_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a thousand million apart, purged in ranges of 10^13."""
    log = oplog(spark, sf_dir)
    wide = F.col("key") * 1_000_000_007
    return kvstore.compact(log.withColumn("end_key", F.when(F.col("op") == "PURGE", wide + 10_000_000_000_000)).withColumn("key", wide))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "store")
    kvstore.write_store(kvstore.last_writes(oplog(spark, sf_dir)), path)
    return path


@query(f"select key, value from {_LIVE} v where bucket = 3 and key in (3, 7, 8, 11, 1999, 5000)")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.get(spark, _stored(spark, sf_dir), 3, 3, 7, 8, 11, 1999, 5000)


@query(f"select key, value from {_LIVE} v where bucket = 2 and key between 100 and 900")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.scan(spark, _stored(spark, sf_dir), 2, 100, 900)


@query(f"select c_custkey as key, c_custkey % 4 as bucket, value from customer left join {_LIVE} v on v.key = c_custkey and v.bucket = c_custkey % 4")
def kv_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.pmod("c_custkey", F.lit(4)).alias("bucket"))
    return kvstore.look_up(wanted, spark.read.parquet(_stored(spark, sf_dir)))


@query("select c_custkey, row_number() over (order by encode(c_name)) as place from customer")
def kv_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte keys in unsigned order, as a store's files hold them."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("key"))
    ordered = lookups.row_range(rows, "key")
    return dedup.positions(ordered.withColumn("n", F.regexp_extract(F.col("key").cast("string"), "([0-9]+)", 1).cast("long")), "n", "place").select("c_custkey", "place")


@query(f"select window_id, parent, seq, row_number() over (partition by window_id order by parent, seq) as place from (select window_id, bucket % 2 as parent, seq from {_LOG}) x")
def kv_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = oplog(spark, sf_dir)
    return kvstore.merge_logs(log.where("bucket % 2 = 0"), log.where("bucket % 2 = 1")).select("window_id", F.col("parent").cast("long").alias("parent"), "seq", "place")


@query(f"select bucket, key, op, seq from {_LOG} where window_id > bucket + 2")
def replay_committed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.range(4).select(F.col("id").alias("bucket"), (F.col("id") + 2).alias("window_id"))
    return kvstore.committed_only(oplog(spark, sf_dir), done).select("bucket", "key", "op", "seq")


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), (F.col("l_partkey") * 20).alias("start"), (F.col("l_partkey") * 20 + F.col("l_quantity").cast("bigint")).alias("end"))


_RNG = "(select l_suppkey as set_id, l_partkey * 20 as start_, l_partkey * 20 + cast(l_quantity as bigint) as end_ from lineitem) r"
_MARK = f"select *, case when max(end_) over w is null or start_ > max(end_) over w then 1 else 0 end as new_ from {_RNG} window w as (partition by set_id order by start_, end_ rows between unbounded preceding and 1 preceding)"


@query(f'select set_id, min(start_) as "start", max(end_) as "end" from (select *, sum(new_) over (partition by set_id order by start_, end_ rows between unbounded preceding and current row) as island from ({_MARK}) m) i group by set_id, island')
def kv_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_ranges(line_ranges(spark, sf_dir), ["set_id"])


_ONE = "(select l_orderkey * 30 as start_, l_orderkey * 30 + cast(l_quantity as bigint) as end_ from lineitem) r"
_MARK1 = f"select *, case when max(end_) over w is null or start_ > max(end_) over w then 1 else 0 end as new_ from {_ONE} window w as (order by start_, end_ rows between unbounded preceding and 1 preceding)"


@query(f'select min(start_) as "start", max(end_) as "end" from (select *, sum(new_) over (order by start_, end_ rows between unbounded preceding and current row) as island from ({_MARK1}) m) i group by island')
def kv_range_merge_one_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_orderkey") * 30
    return ranges.merge_ranges(read(spark, sf_dir, "lineitem").select(start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end")))


def range_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select((F.col("p_partkey") * 20 - 15).alias("probe_start"), (F.col("p_partkey") * 20 + F.col("p_size").cast("bigint")).alias("probe_end"))


_PRB = "(select p_partkey * 20 - 15 as probe_start, p_partkey * 20 + p_size as probe_end from part) p"


@query(f'select set_id, start_ as "start", end_ as "end", probe_start, probe_end from {_RNG} join {_PRB} on start_ <= probe_end and end_ >= probe_start')
def kv_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.overlapping(line_ranges(spark, sf_dir), range_probes(spark, sf_dir)).select("set_id", "start", "end", "probe_start", "probe_end")


@query(f"select distinct probe_start as point from {_PRB} where exists (select 1 from {_RNG} where probe_start between start_ and end_)")
def kv_range_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.contains(line_ranges(spark, sf_dir), range_probes(spark, sf_dir).select(F.col("probe_start").alias("point")), "point")


@query(f'select set_id, min(start_) as "start", max(end_) as "end" from {_RNG} group by 1')
def kv_range_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.extent(line_ranges(spark, sf_dir), ["set_id"])


@query("select 'event_type' as key, event_type as value, min((epoch_us(ts) // 1000)) as from_time, max((epoch_us(ts) // 1000)) as to_time from events group by event_type union all select 'user_id', cast(user_id as varchar), min((epoch_us(ts) // 1000)), max((epoch_us(ts) // 1000)) from events group by user_id")
def seen_key_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.seen_keys(events(spark, sf_dir), ["event_type", "user_id"], "t")


# ---- delimited records ---------------------------------------------------------------


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    short = F.concat_ws("\x02", F.col("c_custkey").cast("string"), "c_name")
    whole = F.concat_ws("\x02", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.lit("2024-02-03 04:05:06"))
    body = F.when(F.pmod("c_custkey", F.lit(5)) == 0, short).otherwise(whole)
    return c.select("c_custkey", F.create_map(F.lit("id"), F.col("c_custkey").cast("string")).alias("headers"), F.encode(body, "UTF-8").alias("body"))


_SEG = "case when c_custkey % 5 = 0 then '' else c_mktsegment end"


@query(f"select c_custkey, {_SEG} || chr(1) || c_name || chr(1) || '' || chr(1) as body from customer")
def delimited_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir).select("c_custkey", delimited.pick(F.col("body"), [2, 1, 7]).cast("string").alias("body"))


@query(f"select c_custkey, 'a' || c_name || 'bc' || {_SEG} || 'def' || cast(c_custkey as varchar) || 'ghi' as body from customer")
def delimited_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir).select("c_custkey", delimited.fill(F.col("body"), "a{1}bc{2}def{0}ghi").cast("string").alias("body"))


@query("select c_custkey, c_custkey % 5 = 0 as dropped from customer")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without a time do not convert and go to the second output."""
    parse = lambda headers, body: F.when(delimited.raw_event(body, guid=0, time=3)["time"].isNotNull(), delimited.raw_event(body, guid=0, time=3))
    made, dropped = convert(bodies(spark, sf_dir).select("headers", "body"), parse)
    key = F.col("headers")["id"].cast("bigint").alias("c_custkey")
    return made.select(key, F.lit(False).alias("dropped")).union(dropped.select(key, F.lit(True).alias("dropped")))


@query("select event_type, '[' || string_agg('{' || user_id || ':' || n || '}', ',' order by k) || ']' as body from (select event_type, cast(user_id as varchar) as k, user_id, count(*) as n from events group by all) g group by 1")
def map_result_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").cast("string").alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).select("event_type", delimited.map_text(F.col("m")).alias("body"))


@query("select c_custkey, hex(encode(c_name)) as body, octet_length(encode(c_name)) as n from customer")
def string_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = delimited.to_bytes(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.hex(body).alias("body"), F.length(body).cast("bigint").alias("n"))


# ---- streams -------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master  # local-cluster has executors of its own
        local = master == "local" or master.startswith("local[")
        root = tempfile.mkdtemp(prefix="cubeloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A folder or a glob: the stream source lists files, and a single file is a glob of itself.
    return spark.readStream.schema(schema).parquet(path + "*").withColumn("t", epoch_millis(F.col("ts")))


@query(ORACLE_SQL["cube_sum_hourly"])
def streaming_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of the events read as a stream, merged from its micro-batches."""
    at = _folder(spark, "cube")
    store = stream_cube.CubeStore(spark, f"{at}/parts", HOURLY, time="t", order="event_id")
    stream_cube.start(event_stream(spark, sf_dir), store, f"{at}/checkpoint", available_now=True).awaitTermination()
    return store.cube().select("time_bucket", "time", "event_type", "value_sum", "value_count")


@query(ORACLE_SQL["cube_sum_hourly"])
def streaming_cube_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store with a folder per group, compacted, read one group at a time."""
    at = _folder(spark, "cube")
    store = stream_cube.CubeStore(spark, f"{at}/parts", HOURLY, by_group=True, time="t", order="event_id")
    stream_cube.start(event_stream(spark, sf_dir), store, f"{at}/checkpoint", available_now=True).awaitTermination()
    store.compact()
    groups = [d.dd_id for d in HOURLY.descriptors()]
    rows = reduce(DataFrame.unionByName, [store.cube().where(F.col("dd_id") == g) for g in groups])
    return rows.select("time_bucket", "time", "event_type", "value_sum", "value_count")


@query(ORACLE_SQL["cube_sum_hourly"])
def streaming_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the epochs changed, the last change of each row: all of the cube in the end."""
    at = _folder(spark, "cube")
    store = stream_cube.CubeStore(spark, f"{at}/parts", HOURLY, time="t", order="event_id")
    store.on_update = lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/updates/{epoch}")
    stream_cube.start(event_stream(spark, sf_dir), store, f"{at}/checkpoint", available_now=True).awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/updates")
    return enrich.one_per_key(found, ["dd_id", "time_bucket", "time", "event_type"], "epoch").select("time_bucket", "time", "event_type", "value_sum", "value_count")


@query("select event_id, case when c_custkey is null then 'none' else c_mktsegment end as segment from events left join customer on user_id = c_custkey")
def streaming_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch meets the lookup as it stands then."""
    at = _folder(spark, "enrich")
    load = lambda: read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    add = lambda rows, found: enrich.enrich_map(rows, found, {"user_id": "c_custkey"}, ["segment"])
    step = enrich.refreshing(load, add, lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{at}/out/{epoch}"))
    event_stream(spark, sf_dir).select("event_id", "user_id").writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out").select("event_id", F.coalesce("segment", F.lit("none")).alias("segment"))


_IN_ORDER = f"(select *, event_id as seq, t // {HOUR} as hour from {EV}) s"


def deduplicated(spark: SparkSession, sf_dir: str, keys: list[str], rule: stream_dedup.Rule) -> DataFrame:
    """Dispositions of the events read as a stream, with state between micro-batches."""
    at = _folder(spark, "dedup")
    rows = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("event_id").alias("seq"), F.floor(F.col("t") / HOUR).alias("hour"), F.floor(F.col("t") / 1000).alias("second"), F.floor(F.col("t") / DAY).cast("string").alias("day"))
    sink = lambda out, epoch: out.select("event_id", "disposition").write.mode("overwrite").parquet(f"{at}/out/{epoch}")
    store = stream_dedup.DedupStore(spark, f"{at}/state", keys, "seq", rule, sink)
    rows.writeStream.foreachBatch(store.apply).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, disposition string").option("recursiveFileLookup", "true").parquet(f"{at}/out")


@query(ORACLE_SQL["dedup_ordered"].replace(_SH, _IN_ORDER))
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir, ["user_id", "event_type"], stream_dedup.Rule("ordered", "hour", 48, 6))


@query(ORACLE_SQL["dedup_system_time"].replace(_SH, _IN_ORDER))
def streaming_dedup_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir, ["user_id", "event_type"], stream_dedup.Rule("clock", "second", 864_000, 3600, clock=lambda: NOW // 1000))


@query(jump_sql(_IN_ORDER))
def streaming_dedup_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir, ["user_id", "event_type"], stream_dedup.Rule("jump", "hour", 48, 6, max_jump=3))


@query(ORACLE_SQL["dedup_categorical"].replace(_SH, _IN_ORDER))
def streaming_dedup_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir, ["user_id"], stream_dedup.Rule("categorical", "day", live=2))


@query(ORACLE_SQL["lateness_split"])
def streaming_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "late")
    rows = stream_dedup.lateness(event_stream(spark, sf_dir).select("event_id", "t"), "t", REF, laggards=240 * HOUR).select("event_id", "lateness")
    rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, lateness string").parquet(f"{at}/out")


# ---- sources and partitions ----------------------------------------------------------


@query("select event_id, (row_number() over (order by event_id) - 1) // 4 // 25 as window_id from events")
def source_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a source of four partitions that takes 100 events a second."""
    return rate_windows(read(spark, sf_dir, "events").select("event_id"), "event_id", 100, 1000, 4)


@query("select user_id, event_type from events where event_id % 3 = 2 or (event_id % 3 = 1 and event_id >= 1501)")
def log_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of three flushes, cleaned up to the second, read from an address in it."""
    log = Log(spark, _folder(spark, "log"), "event_id long, user_id long, event_type string")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in range(3):
        log.store(rows.where(F.col("event_id") % 3 == part), "event_id")
    log.clean(1)
    return log.retrieve(1, 500).select("user_id", "event_type")


_LAT = "select user_id % 5 as partition, event_id as window_id, value as latency from events"
_AVG = f"select *, avg(latency) over w as average, count(latency) over w as n from ({_LAT}) l window w as (partition by partition order by window_id rows between 9 preceding and current row)"


@query(f"select partition, window_id, round(average, 6) as average, case when n = 10 and average > 30 then 'split' when n = 10 and average < 15 then 'merge' else 'keep' end as decision from ({_AVG}) a")
def partition_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(5)).alias("partition"), F.col("event_id").alias("window_id"), F.col("value").alias("latency"))
    return partitioning.decisions(rows, 15, 30).select("partition", "window_id", F.round("average", 6).alias("average"), "decision")


@query("select c_custkey, c_name from customer where c_name between 'Customer#000000100' and 'Customer#000000900'")
def lookup_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table of byte columns, from one row key to another."""
    table = read(spark, sf_dir, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("row"), F.create_map(F.lit("name"), F.encode("c_name", "UTF-8")).alias("personal"))
    keyed = lookups.keyed_bytes(lookups.row_range(table, "row", b"Customer#000000100", b"Customer#000000900"), "row", {"name": ("personal", "name")})
    return keyed.select(F.regexp_extract(F.col("row").cast("string"), "0*([0-9]+)$", 1).cast("long").alias("c_custkey"), F.col("name").cast("string").alias("c_name"))
