"""Sets of ranges [start, end], both ends inside."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """df with the further columns of a small table of one row per value of on, where null is a value."""
    named = small.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)), F.lit(True))
    return df.join(F.broadcast(named), same, "left").drop(*(f"_on{i}" for i in range(len(on))))


def _stretches(rows: DataFrame, by: list[str], largest: int, most: int) -> DataFrame:
    """rows with _stretch, for sets of over ``most`` rows the number of the stretch of their order, of about most / 4 rows;
    0 and _whole for other sets. Rows that share a start which fills whole stretches are made one.

    The cuts are fetched, at most a value for each most / 8 rows, as quantiles found anew might differ.
    """
    n = math.ceil(largest / max(1, most // 4))
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    quantiles = F.percentile_approx("start", [i / n for i in range(1, n)], max(10_000, 10 * n))
    found = _beside(rows, large, by).where("_n is not null").groupBy(*by).agg(F.first("_n").alias("_n"), quantiles.alias("_cuts"))
    cuts = [(*r[:-2], r["_cuts"][(step := largest // r["_n"]) - 1 :: step]) for r in found.collect()]
    placed = _beside(rows, rows.sparkSession.createDataFrame(cuts, found.drop("_n").schema), by).withColumn("_stretch", F.lit(0))
    for step in (1 << k for k in reversed(range(n.bit_length()))):  # a binary search
        placed = placed.withColumn("_stretch", F.col("_stretch") + F.when(F.get("_cuts", F.col("_stretch") + (step - 1)) < F.col("start"), step).otherwise(0))
    fills = F.coalesce((F.get("_cuts", F.col("_stretch")) == F.col("start")) & (F.get("_cuts", F.col("_stretch") + 1) == F.col("start")), F.lit(False))
    placed = placed.select(*by, "_stretch", "start", "end", F.col("_cuts").isNull().alias("_whole"), fills.alias("_fills"))
    if not any(a == b for *_, c in cuts for a, b in zip(c, c[1:], strict=False)):
        return placed.drop("_fills")
    one = placed.where("_fills").groupBy(*by, "_stretch", "start", "_whole").agg(F.max("end").alias("end"))
    return placed.where("not _fills").drop("_fills").unionByName(one)


def _before(table: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """out: the largest value of a set's stretches before; one row per stretch."""
    w = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return table.groupBy(*by, "_stretch").agg(F.max(value).alias("_most")).select(*by, "_stretch", F.max("_most").over(w).alias(out))


def merge_ranges(ranges: DataFrame, by: list[str] | None = None, most: int = 200_000) -> DataFrame:
    """Disjoint ranges of the same points; ranges that share a point become one.

    by: columns that name separate sets, null being a name. Rows are counted first, and sets are
    dealt to tasks of about ``most`` rows, so a task holds no more when there are more sets.
    A set of more rows is cut into stretches of its order: the largest end and the last
    opened range of the stretches before are carried to each in tables of one row per
    stretch. The start is a number, date or timestamp.
    """
    by = by or []
    rows = ranges.where("start <= end").select(*by, "start", "end")
    size = rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).first()
    tasks = max(1, math.ceil((size["rows"] or 0) / most))
    cut = (size["largest"] or 0) > most
    unit = [*by, "_stretch"] if cut else by
    if cut:
        rows = _stretches(rows, by, size["largest"], most)
        rows = _beside(rows, _before(rows.where("not _whole"), by, "end", "_sofar"), unit)
    w = Window.partitionBy(*unit).orderBy("start")
    inside = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(inside, F.col("_sofar")) if cut else inside
    # a given number of partitions, as adaptive execution would put them together again
    opened = rows.repartition(tasks, *unit).withColumn("_reach", reach).withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")))
    island = opened.withColumn("_island", F.max("_open").over(w))  # with all rows of the same start
    merged = lambda df, *keys: df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if not cut:
        return merged(island, *by, "_island").drop("_island")
    local = merged(island, *unit, "_island")
    joined = _beside(local, _before(local, by, "_island", "_opened"), unit).withColumn("_island", F.coalesce("_island", "_opened"))
    return merged(joined.repartition(tasks, *by, "_island"), *by, "_island").drop("_island")


def _cut(df: DataFrame, start: str, end: str) -> DataFrame:
    """df with the cells, of width 2^_lv, that hold its ends; at most two where the range is no longer than that."""
    cells = F.array_distinct(F.array(F.expr(f"shiftright({start}, _lv)"), F.expr(f"shiftright({end}, _lv)")))
    return df.withColumn("_cell", F.explode(cells))


def overlapping(ranges: DataFrame, probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ranges' columns and probes' columns of each pair that shares a point.

    A range's level is the least power of two longer than it, so it touches at most
    two cells of that width. Each pair meets in the cells of the longer one's level:
    a side is cut at its own level, and the other at every level that side has from
    its own on, at most 64. So a row is copied a few times whatever its length. A pair
    is kept in the first cell both have, so none comes twice. Ends are whole numbers;
    rows with a null end or an end before the start meet nothing. Probes have columns
    probe_start, probe_end.
    """
    by = by or []
    level = lambda a, b: F.floor(F.log2(F.col(b).cast("double") - F.col(a).cast("double") + 1)).cast("int") + 1
    whole = lambda df, a, b: df.withColumns({a: F.col(a).cast("long"), b: F.col(b).cast("long")}).where(F.col(a) <= F.col(b)).withColumn("_own", F.least(level(a, b), F.lit(62)))
    left, right = whole(ranges, "start", "end"), whole(probes, "probe_start", "probe_end")
    levels = lambda df: F.broadcast(df.select(F.col("_own").alias("_lv")).distinct())  # noqa: E731  at most 62 rows
    own = lambda df: df.withColumn("_lv", F.col("_own")).drop("_own")
    wider = _cut(own(left), "start", "end").join(_cut(right.join(levels(left), F.col("_lv") >= F.col("_own")).drop("_own"), "probe_start", "probe_end"), [*by, "_lv", "_cell"])
    narrower = _cut(left.join(levels(right), F.col("_lv") > F.col("_own")).drop("_own"), "start", "end").join(_cut(own(right), "probe_start", "probe_end"), [*by, "_lv", "_cell"])
    first = F.expr("shiftright(greatest(start, probe_start), _lv)")
    return wider.unionByName(narrower).where("start <= probe_end and end >= probe_start").where(F.col("_cell") == first).drop("_lv", "_cell")


def contains(ranges: DataFrame, points: DataFrame, point: str, by: list[str] | None = None) -> DataFrame:
    """Rows of points that lie in a range."""
    return overlapping(ranges, points.withColumn("probe_start", F.col(point)).withColumn("probe_end", F.col(point)), by).select(points.columns).distinct()


def contained_ranges(ranges: DataFrame, probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """overlapping() pairs whose probe lies in the range entirely."""
    return overlapping(ranges, probes, by).where("start <= probe_start and end >= probe_end")


def extent(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First start and last end."""
    return ranges.groupBy(*(by or [])).agg(F.min("start").alias("start"), F.max("end").alias("end"))
