"""Dimensional computation: a cube of all combinations and time buckets of a spec.

Events are first aggregated at the finest grain any group needs (all keys, the
greatest common divisor of the buckets). Only these partials are expanded into
the spec's groups and aggregated again, so the input is shuffled once, combined on
the map side, and the expansion does not multiply raw rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.timebucket import round_down
from cubeloom.operators.enrich import small_enough
from cubeloom.plans.spec import Composite, CubeSpec, Descriptor, Field


@dataclass(frozen=True)
class Aggregator:
    """How an aggregate is made: named parts of raw rows, how parts merge, how they end.

    parts: name -> function(value column, order column) -> aggregate column
    merge: name -> function(part column) -> aggregate column
    end: function(dict of part columns) -> column
    """

    parts: dict[str, Callable[[Column, Column], Column]]
    merge: dict[str, Callable[[Column], Column]]
    end: Callable[[dict[str, Column]], Column]


def _ordered(pick: Callable[[Column], Column]) -> Aggregator:
    part = lambda v, o: pick(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))
    name = "first" if pick is F.min else "last"
    return Aggregator({name: part}, {name: pick}, lambda p: p[name]["v"])


_SUM = ({"sum": lambda v, o: F.sum(v)}, {"sum": F.sum})
_COUNT = ({"count": lambda v, o: F.count(v)}, {"count": F.sum})
REGISTRY: dict[str, Aggregator] = {
    "SUM": Aggregator(*_SUM, lambda p: p["sum"]),
    "COUNT": Aggregator(*_COUNT, lambda p: p["count"]),
    "MIN": Aggregator({"min": lambda v, o: F.min(v)}, {"min": F.min}, lambda p: p["min"]),
    "MAX": Aggregator({"max": lambda v, o: F.max(v)}, {"max": F.max}, lambda p: p["max"]),
    "FIRST": _ordered(F.min),
    "LAST": _ordered(F.max),
    "AVG": Aggregator(_SUM[0] | _COUNT[0], _SUM[1] | _COUNT[1], lambda p: p["sum"].cast("double") / p["count"]),
    "CUM_SUM": Aggregator(*_SUM, lambda p: p["sum"]),  # made a running total at the end
}


def register(name: str, aggregator: Aggregator) -> None:
    """Adds an aggregator; parts of one name are shared between aggregators."""
    from cubeloom.plans import spec

    REGISTRY[name] = aggregator
    if name not in spec.SIMPLE:
        spec.SIMPLE = (*spec.SIMPLE, name)


def project(df: DataFrame, spec: CubeSpec, time: str | Column = "time", expressions: dict[str, str] | None = None, aliases: dict[str, str] | None = None, order: str | Column | None = None) -> DataFrame:
    """Keys, values, time and order of the spec from an event table.

    A field is read by the expression given here, else the one in the spec, else
    the alias, else its own name; a field the table lacks is null.
    """
    merged = merge_expressions(expressions or {}, {f.name: f.expression for f in (*spec.keys, *spec.values) if f.expression})

    def read(f: Field) -> Column:
        if f.name in merged:
            return F.expr(merged[f.name])
        name = (aliases or {}).get(f.name, f.name)
        return F.col(name) if name in df.columns else F.lit(None)

    t = F.col(time) if isinstance(time, str) else time
    o = t if order is None else F.struct(t, F.col(order) if isinstance(order, str) else order)
    values = [(F.round(read(f) * 10**f.scale).cast("bigint") if f.scale is not None else read(f).cast(f.spark_type)).alias(f"v_{f.name}") for f in spec.values]
    return df.select(*[read(f).cast(f.spark_type).alias(f"k_{f.name}") for f in spec.keys], *values, t.cast("bigint").alias("_time"), o.alias("_order"))


def merge_expressions(first: dict[str, str], defaults: dict[str, str]) -> dict[str, str]:
    """What is given wins; defaults fill the holes."""
    return {**defaults, **first}


def needed(spec: CubeSpec) -> dict[tuple[str, str], Aggregator]:
    return {(v, a): REGISTRY[a] for d in spec.descriptors() for v, a in d.aggregates if not isinstance(a, Composite)}


def partials(events: DataFrame, spec: CubeSpec) -> DataFrame:
    """Finest-grain partial aggregates of projected events; unions of them merge again."""
    sizes = [b.millis for c in spec.combinations for b in c.buckets if b.millis]
    grain = reduce(gcd, sizes) if sizes else None
    t = F.col("_time") - F.pmod(F.col("_time"), F.lit(grain)) if grain else F.lit(None).cast("bigint")
    used = {k for c in spec.combinations for k in c.keys}
    keys = [F.col(f"k_{f.name}") for f in spec.keys if f.name in used]
    parts = {f"{n}_{v}": make(F.col(f"v_{v}"), F.col("_order")) for (v, _), a in needed(spec).items() for n, make in a.parts.items()}
    return events.groupBy(*keys, t.alias("_t")).agg(F.count(F.lit(1)).alias("n_events"), *[c.alias(n) for n, c in parts.items()])


def group(parts: DataFrame, spec: CubeSpec) -> DataFrame:
    """dd_id, time_bucket, time, keys and merged parts of every group."""
    known = {c[2:] for c in parts.columns if c.startswith("k_")}
    types = {f.name: f.spark_type for f in spec.keys}
    sets = F.array(
        *[
            F.struct(
                F.lit(d.dd_id).alias("dd_id"),
                F.lit(d.bucket.label).alias("time_bucket"),
                round_down(F.col("_t"), d.bucket).alias("time"),
                *[(F.col(f"k_{k}") if k in d.keys else F.lit(None).cast(types[k])).alias(k) for k in types if k in known],
            )
            for d in spec.descriptors()
        ]
    )
    merges = {f"{n}_{v}": make for (v, _), a in needed(spec).items() for n, make in a.merge.items()}
    wide = parts.select(F.explode(sets).alias("g"), "n_events", *merges).select("g.*", "n_events", *merges)
    names = ["dd_id", "time_bucket", "time", *[k for k in types if k in known]]
    return wide.groupBy(*names).agg(F.sum("n_events").alias("n_events"), *[make(F.col(c)).alias(c) for c, make in merges.items()])


def regroup(grouped: DataFrame, spec: CubeSpec) -> DataFrame:
    """Rows of group(), of several epochs, merged."""
    keys = [f.name for f in spec.keys if f.name in grouped.columns]
    merges = {f"{n}_{v}": make for (v, _), a in needed(spec).items() for n, make in a.merge.items()}
    return grouped.groupBy("dd_id", "time_bucket", "time", *keys).agg(F.sum("n_events").alias("n_events"), *[make(F.col(c)).alias(c) for c, make in merges.items()])


def column(value: str, aggregate: str) -> str:
    """Name of an aggregate's column in the cube."""
    return f"{value}_{aggregate.lower()}"


def finish(grouped: DataFrame, spec: CubeSpec) -> DataFrame:
    """Ends the aggregates; a column is null in groups whose combination lacks it."""
    keys = [f.name for f in spec.keys if f.name in grouped.columns]
    scale = {f.name: f.scale for f in spec.values}
    out = []
    for (v, a), agg in needed(spec).items():
        c = agg.end({n: F.col(f"{n}_{v}") for n in agg.parts})
        if a == "CUM_SUM":
            c = F.sum(c).over(Window.partitionBy("dd_id", *keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
        if scale[v] is not None and a != "COUNT":
            c = c / F.lit(float(10 ** scale[v]))
        have = [d.dd_id for d in spec.descriptors() if (v, a) in d.aggregates]
        out.append(F.when(F.col("dd_id").isin(have), c).alias(column(v, a)))
    return grouped.select("dd_id", "time_bucket", "time", *keys, "n_events", *out)


def compute(df: DataFrame, spec: CubeSpec, **reading) -> DataFrame:
    """The cube of an event table; keyword arguments go to project()."""
    return finish(group(partials(project(df, spec, **reading), spec), spec), spec)


def merge(*parts: DataFrame) -> DataFrame:
    """Union of partials of several windows or inputs; group() merges equal keys."""
    return reduce(DataFrame.unionByName, parts)


def ranked(cube: DataFrame, spec: CubeSpec, parent: Descriptor, value: str, composite: Composite) -> DataFrame:
    """Rows of a composite: the parent's time and keys, rank, further keys, value.

    Equal values rank by the further keys, smallest first.
    """
    sub = spec.find({*parent.keys, *composite.keys}, parent.bucket.label)
    source = F.col(column(value, "SUM")).cast("double") / F.col(column(value, "COUNT")) if composite.embedded == "AVG" else F.col(column(value, composite.embedded))
    rows = cube.where(F.col("dd_id") == sub.dd_id).select("time", *parent.keys, *composite.keys, source.alias("value")).where("value is not null")
    direction = F.desc("value") if composite.kind == "TOPN" else F.asc("value")
    w = Window.partitionBy("time", *parent.keys).orderBy(direction, *sorted(composite.keys))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= composite.count)


def ranked_map(rows: DataFrame, parent: Descriptor, composite: Composite) -> DataFrame:
    """ranked() as one map a parent row: further keys (joined by |) -> value."""
    key = F.concat_ws("|", *[F.col(k) for k in sorted(composite.keys)])
    return rows.groupBy("time", *parent.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), "value")))).alias(composite.name))


def seen_keys(df: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """key, value of every distinct key value; with time also each value's first and last time."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    extra = [] if time is None else [time]
    rows = df.select(pairs.alias("p"), *extra).select("p.*", *extra)
    if time is None:
        return rows.distinct()
    return rows.groupBy("key", "value").agg(F.min(time).alias("from_time"), F.max(time).alias("to_time"))


def every_pair(times: DataFrame, values: DataFrame, most: int = 100_000, salts: int = 64) -> DataFrame:
    """The grid of all buckets and all values of a starred key: as many rows as the answer has.

    Values are sent to all executors only if they are few; else they are dealt into
    parts, which each time is copied to and meets in as many tasks.
    """
    if small_enough(values, most):
        return times.join(F.broadcast(values), how="cross")
    dealt = values.withColumn("_part", F.pmod(F.xxhash64(*values.columns), F.lit(salts)))
    return times.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).join(dealt, "_part").drop("_part")
