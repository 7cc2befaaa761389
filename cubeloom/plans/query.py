"""JSON queries over a cube: parse, plan as one filtered scan, and answer as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.operators.cube import column, ranked, ranked_map
from cubeloom.plans.spec import Composite, CubeSpec, Descriptor, TimeBucket

ALL = "ALL"
_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


@dataclass
class DataQuery:
    id: str
    bucket: str = ALL
    latest: int | None = None
    start: int | None = None
    end: int | None = None
    keys: dict[str, list] = field(default_factory=dict)  # [] is a star: all values
    fields: list[str] = field(default_factory=list)
    sliding: int = 1
    countdown: int | None = None
    incomplete_ok: bool = True

    @property
    def one_time(self) -> bool:
        return self.countdown is None


def typed(value: object, spark_type: str, name: str) -> object:
    """A key value as its field's type; raises where it does not fit."""
    if isinstance(value, (dict, list)) or value is None:
        raise ValueError(f"{name}: a key value must be a plain value")
    if spark_type in _RANGES:
        n = int(value)
        if isinstance(value, bool) or not -(1 << _RANGES[spark_type]) <= n < 1 << _RANGES[spark_type]:
            raise ValueError(f"{name}: {value} is out of range")
        return n
    if spark_type in ("float", "double"):
        return float(value)
    if spark_type == "boolean":
        if str(value).lower() not in ("true", "false"):
            raise ValueError(f"{name}: {value} is not a truth value")
        return str(value).lower() == "true"
    return str(value)


def parse(text: str, spec: CubeSpec) -> DataQuery | None:
    """A dataQuery message; None if the schema has no such combination and bucket."""
    raw = json.loads(text)
    if raw.get("type") != "dataQuery":
        raise ValueError(f"not a dataQuery: {raw.get('type')!r}")
    data = raw["data"]
    time = data.get("time") or {}
    types = {f.name: f for f in spec.keys}
    keys: dict[str, list] = {}
    for name, value in data.get("keys", {}).items():
        if name not in types:
            raise ValueError(f"unknown key {name!r}")
        f = types[name]
        keys[name] = [typed(v, f.spark_type, name) for v in (value if isinstance(value, list) else [value])]
        if f.type.lower() == "char" and any(len(v) != 1 for v in keys[name]):
            raise ValueError(f"{name}: a char has one character")
    q = DataQuery(
        str(raw["id"]),
        time.get("bucket", ALL),
        int(time["latestNumBuckets"]) if "latestNumBuckets" in time and "from" not in time else None,
        int(time["from"]) if "from" in time else None,
        int(time["to"]) if "to" in time else None,
        keys,
        list(data.get("fields", ())),
        int(time.get("slidingAggregateSize", 1)),
        int(raw["countdown"]) if "countdown" in raw else None,
        bool(data.get("incompleteResultOK", raw.get("incompleteResultOK", True))),
    )
    if q.sliding < 1 or (q.latest is not None and q.latest < 1):
        raise ValueError("counts of buckets start at 1")
    return q if spec.find(set(keys), q.bucket) else None


def wanted(query: DataQuery, spec: CubeSpec, at: Descriptor) -> tuple[list[str], list[tuple[str, str | Composite]]]:
    """Plain fields in order, and (value, aggregator) pairs; a value alone means all its aggregators."""
    plain, aggregates = [], []
    values = {f.name for f in spec.values}
    by_name = {(v, a if isinstance(a, str) else a.name): (v, a) for v, a in at.aggregates}
    for f in query.fields:
        v, _, a = f.partition(":")
        if a:
            if (v, a) in by_name:
                aggregates.append(by_name[v, a])
            elif a == "AVG" and {(v, "SUM"), (v, "COUNT")} <= set(by_name):
                aggregates.append((v, "AVG"))
            else:
                raise ValueError(f"the combination has no {f}")
        elif f in values:
            aggregates += [x for x in at.aggregates if x[0] == f]
        else:
            plain.append(f)
    return plain, list(dict.fromkeys(aggregates))


def expand(query: DataQuery, seen: dict[str, list], keep: Callable[[dict], dict] | None = None, valid: Callable[[dict, str, object], bool] | None = None) -> list[dict]:
    """Key combinations a query asks for; stars take the seen values.

    keep rewrites the map of values first; valid(combined so far, key, value) prunes.
    """
    lists = {k: (v or sorted(seen.get(k, ()))) for k, v in query.keys.items()}
    if keep:
        lists = keep(lists)
    found: list[dict] = [{}]
    for k, values in lists.items():
        found = [{**c, k: v} for c, v in product(found, values) if valid is None or valid(c, k, v)]
    return found


def single(query: DataQuery) -> dict:
    """The one key combination of a query that must name one value per key."""
    if any(len(v) != 1 for v in query.keys.values()):
        raise ValueError("each key needs exactly one value")
    return {k: v[0] for k, v in query.keys.items()}


def time_range(query: DataQuery, newest: Column | int | None) -> tuple[Column | int, Column | int] | None:
    """First and last bucket asked for; latest buckets count back from the newest time."""
    size = TimeBucket(query.bucket).millis
    if size is None:
        return None
    if query.start is not None:
        floor = lambda t: t - t % size
        return floor(query.start), floor(query.end)
    last = newest - newest % size if isinstance(newest, int) else newest - F.pmod(newest, F.lit(size))
    return last - (query.latest - 1) * size, last


def execute(cube: DataFrame, spec: CubeSpec, query: DataQuery, newest: int | None = None, valid: DataFrame | None = None) -> DataFrame:
    """Rows that answer a query: time, keys, and a column per value and aggregator.

    newest: time that the latest buckets count back from; by default the newest
    time of the group asked for. valid: table of valid key combinations, semi-joined.
    Sliding aggregates roll each key's buckets; a row needs all buckets of its frame.
    """
    at = spec.find(set(query.keys), query.bucket)
    if at is None:
        raise ValueError("the schema has no such combination and bucket")
    _, aggregates = wanted(query, spec, at)
    size = at.bucket.millis
    rows = cube.where(F.col("dd_id") == at.dd_id)
    for k, values in query.keys.items():
        if values:
            rows = rows.where(F.col(k).isin(values))
    if valid is not None:
        rows = rows.join(valid, [c for c in valid.columns if c in at.keys], "left_semi")
    bounds = None
    if size is not None:
        if query.start is None and newest is None:
            newest = cube.where(F.col("dd_id") == at.dd_id).agg(F.max("time")).first()[0]  # every group has every event
            if newest is None:
                newest = 0
        bounds = time_range(query, newest)
        rows = rows.where((F.col("time") >= bounds[0] - (query.sliding - 1) * size) & (F.col("time") <= bounds[1]))
    plain = [(v, a) for v, a in aggregates if not isinstance(a, Composite)]
    w = Window.partitionBy(*at.keys).orderBy("time").rangeBetween(-(query.sliding - 1) * (size or 1), 0) if query.sliding > 1 else None

    def cell(v: str, a: str) -> Column:
        part = {n: F.col(column(v, n)) for n in ("SUM", "COUNT") if (v, n) in at.aggregates}
        roll = {"MIN": F.min, "MAX": F.max, "COUNT": F.sum, "SUM": F.sum, "CUM_SUM": F.last, "FIRST": F.first, "LAST": F.last}
        over = lambda c, f: f(c).over(w) if w is not None else c
        if a == "AVG":
            if len(part) == 2:
                return over(part["SUM"], F.sum).cast("double") / over(part["COUNT"], F.sum)
            if w is None:
                return F.col(column(v, a))
            raise ValueError("a sliding AVG needs SUM and COUNT in the combination")
        return over(F.col(column(v, a)), roll.get(a, F.sum))

    out = rows.select("time", *at.keys, *[cell(v, a).alias(f"{v}:{a}") for v, a in plain], *([F.count(F.lit(1)).over(w).alias("_n")] if w is not None else []))
    if w is not None:
        out = out.where((F.col("_n") == query.sliding) & (F.col("time") >= bounds[0])).drop("_n")
    for v, a in aggregates:
        if isinstance(a, Composite):
            lists = ranked_map(ranked(cube, spec, at, v, a), at, a).withColumnRenamed(a.name, f"{v}:{a.name}")
            out = out.join(lists, ["time", *at.keys], "left")
    return out


def to_json(rows: DataFrame, query: DataQuery, spec: CubeSpec, number: str | None = None) -> DataFrame:
    """One dataResult message (column message): rows in time order, values as text.

    Fields that the combination lacks print as ALL. number: a printf format of
    floating values. Maps print as a list of one-entry objects.
    """
    at = spec.find(set(query.keys), query.bucket)
    plain, aggregates = wanted(query, spec, at)

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = rows.schema[name].dataType.simpleString()
        if kind.startswith("map"):
            return F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit("{"), e["key"], F.lit(":"), e["value"].cast("string"), F.lit("}"))), ","), F.lit("]"))
        return F.format_string(number, c) if number and kind in ("double", "float") else c.cast("string")

    cells = []
    for f in plain:
        if f == "time":
            if at.bucket.millis is not None:
                cells.append(F.col("time").alias("time"))
        else:
            cells.append((text(f) if f in at.keys else F.lit(ALL)).alias(f))
    names = [f"{v}:{a if isinstance(a, str) else a.name}" for v, a in aggregates]
    cells += [text(n).alias(n) for n in names]
    body = F.struct(*cells) if cells else F.struct(F.lit(None).alias("none"))
    order = F.struct(F.col("time").alias("t"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(at.keys)], body.alias("row"))
    gathered = rows.agg(F.array_sort(F.collect_list(order)).alias("data"))
    tail = [] if query.one_time else [F.lit(query.countdown).alias("countdown")]
    message = F.struct(F.lit(query.id).alias("id"), F.lit("dataResult").alias("type"), F.transform("data", lambda r: r["row"]).alias("data"), *tail)
    return gathered.select(F.to_json(message).alias("message"))


def schema_message(id_: str, spec: CubeSpec, cube: DataFrame, seen: dict[str, list] | None = None) -> str:
    """schemaQuery's answer: keys with their seen values, values, buckets, time bounds."""
    bounds = cube.where("time is not null").agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    return json.dumps(
        {
            "id": id_,
            "type": "schemaResult",
            "data": [
                {
                    "schemaType": "dimensions",
                    "time": {"from": bounds["a"], "to": bounds["b"], "buckets": list(spec.bucket_ids)},
                    "keys": [{"name": k.name, "type": k.type, "enumValues": (seen or {}).get(k.name, list(k.enum_values))} for k in spec.keys],
                    "values": [{"name": v.name, "type": v.type} for v in spec.values],
                    "dimensions": [{"combination": list(c.keys)} for c in spec.combinations if not c.implicit],
                }
            ],
        }
    )


def answer(spark: SparkSession, cube: DataFrame, spec: CubeSpec, text: str, seen: dict[str, list] | None = None) -> str | None:
    """The JSON answer to a JSON query of either kind; None if it asks for no known combination."""
    raw = json.loads(text)
    if raw.get("type") == "schemaQuery":
        return schema_message(str(raw["id"]), spec, cube, seen)
    query = parse(text, spec)
    return None if query is None else to_json(execute(cube, spec, query), query, spec).first()["message"]
