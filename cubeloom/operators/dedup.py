"""Deduplication in batches: each row becomes unique, duplicate, expired or error.

Rows are taken in the order of a unique sequence number. Streaming twins are in
cubeloom.streaming.dedup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions.bloom import BloomShape, build, probe


def by_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """disposition: the first row of a key is unique, others are duplicates."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("disposition", F.when(F.row_number().over(w) == 1, "unique").otherwise("duplicate"))


def _in_ranges(df: DataFrame, seq: str, groups: int) -> DataFrame:
    """df with _range, the number of the stretch of its order that a row lies in."""
    cuts = sorted(set(df.approxQuantile(seq, [i / groups for i in range(1, groups)], 0.5 / groups))) if groups > 1 else []

    def search(lo: int, hi: int) -> Column:  # a tree of comparisons: eight for 256 ranges
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(seq) <= cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return df.withColumn("_range", search(0, len(cuts)))


def _carried(ranged: DataFrame, total: Column, fold) -> DataFrame:
    """_range and _sofar: fold of the totals of the ranges before; one row per range."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(total.alias("_total"))
    return F.broadcast(totals.withColumn("_sofar", fold("_total").over(w)).drop("_total"))


def prefix_max(df: DataFrame, value: str, seq: str, out: str, groups: int = 256) -> DataFrame:
    """Largest value of all rows before, by seq; null on the first row.

    The order is cut into ranges, each range's maximum is carried to the later
    ones in a table of one row per range, and only ranges are sorted: no step
    takes all rows in one task. df is read three times; it should be cheap or cached.
    """
    ranged = _in_ranges(df, seq, groups)
    inside = F.max(value).over(Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    joined = ranged.withColumn("_inside", inside).join(_carried(ranged, F.max(value), F.max), "_range", "left")
    return joined.withColumn(out, F.greatest("_inside", "_sofar")).drop("_range", "_inside", "_sofar")


def positions(df: DataFrame, seq: str, out: str, groups: int = 256) -> DataFrame:
    """Place of each row in the order of seq, from 1, in ranges as prefix_max."""
    ranged = _in_ranges(df, seq, groups)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(seq))
    joined = ranged.withColumn("_inside", inside).join(_carried(ranged, F.count("*"), F.sum), "_range", "left")
    return joined.withColumn(out, F.col("_inside") + F.coalesce("_sofar", F.lit(0))).drop("_range", "_inside", "_sofar")


def ordered_output(df: DataFrame, seq: str, disposition: str = "unique") -> DataFrame:
    """Rows of one disposition in the order they arrived, with their place in the output."""
    return positions(df.where(F.col("disposition") == disposition), seq, "place").orderBy("place")


# How rows are marked: _live is live, expired or error. ``end`` is what was seen before the first row.


def mark_ordered(df: DataFrame, expiry: str, seq: str, period: int, end: int | None = None, groups: int = 256) -> DataFrame:
    """The point of expiry is the largest value so far less the period, plus 1."""
    marked = prefix_max(df, expiry, seq, "_seen", groups)
    seen = F.col("_seen") if end is None else F.greatest("_seen", F.lit(end))
    expired = F.col(expiry) < F.coalesce(seen - period + 1, F.lit(-(1 << 62)))
    return marked.withColumn("_live", F.when(F.col(expiry).isNull(), "error").when(expired, "expired").otherwise("live")).drop("_seen")


def mark_clock(df: DataFrame, expiry: str, now: int, period: int) -> DataFrame:
    """The point of expiry stands at the clock."""
    return df.withColumn("_live", F.when(F.col(expiry).isNull(), "error").when(F.col(expiry) < now - period + 1, "expired").otherwise("live"))


def mark_jump(df: DataFrame, expiry: str, seq: str, period: int, max_jump: int, end: int | None = None) -> DataFrame:
    """mark_ordered, where a value that leads the largest one by more than max_jump is an
    error and moves nothing. Each decision depends on the one before, so one task
    reads the expiry values in order, in batches, and nothing else."""
    schema = T.StructType([T.StructField("_at", df.schema[seq].dataType), T.StructField("_live", T.StringType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = end
        for pdf in batches:
            out = []
            for known, value in zip(pdf["_known"].tolist(), pdf["_value"].tolist(), strict=True):
                if not known:
                    out.append("error")
                elif last is not None and value < last - period + 1:
                    out.append("expired")
                elif last is not None and last - period + 1 > 0 and value - last > max_jump:
                    out.append("error")
                else:
                    last = value if last is None else max(last, value)
                    out.append("live")
            yield pd.DataFrame({"_at": pdf["_at"], "_live": out})

    # nulls as a column of their own: whole numbers stay whole in pandas
    narrow = df.select(F.col(seq).alias("_at"), F.col(expiry).isNotNull().alias("_known"), F.coalesce(F.col(expiry).cast("long"), F.lit(0)).alias("_value"))
    walked = narrow.repartition(1).sortWithinPartitions("_at").mapInPandas(walk, schema)
    return df.join(walked, df[seq] == walked["_at"]).drop("_at")


def first_seen(df: DataFrame, category: str, seq: str, known: DataFrame | None = None) -> DataFrame:
    """category, _nth: categories numbered by first appearance, after the known ones. One row per category."""
    firsts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("_cat")).agg(F.min(seq).alias("_first"))
    if known is None:
        return firsts.select("_cat", F.row_number().over(Window.orderBy("_first")).cast("long").alias("_nth"))
    fresh = firsts.join(known, "_cat", "left_anti").withColumn("_n", F.row_number().over(Window.orderBy("_first")))
    base = known.agg(F.coalesce(F.max("_nth"), F.lit(0)).alias("_base"))
    return known.select("_cat", "_nth").unionByName(fresh.join(F.broadcast(base)).select("_cat", (F.col("_n") + F.col("_base")).cast("long").alias("_nth")))


def mark_categorical(df: DataFrame, category: str, seq: str, live: int, numbers: DataFrame, newest: int | None = None, groups: int = 256) -> DataFrame:
    """A row is expired if ``live`` newer categories came before it. numbers: first_seen()."""
    marked = prefix_max(df.join(numbers, df[category] == numbers["_cat"], "left").drop("_cat"), "_nth", seq, "_seen", groups)
    top = F.greatest("_nth", F.coalesce("_seen", F.lit(0)), F.lit(newest or 0))
    state = F.when(F.col("_nth").isNull(), "error").when(F.col("_nth") < top - live + 1, "expired").otherwise("live")
    return marked.withColumn("_live", state).drop("_seen")


def _decided(marked: DataFrame, group: list, seq: str) -> DataFrame:
    w = Window.partitionBy("_live", *group).orderBy(seq)
    found = F.when(F.col("_live") != "live", F.col("_live")).when(F.row_number().over(w) == 1, "unique").otherwise("duplicate")
    return marked.withColumn("disposition", found).drop("_live")


def spans_of(expiry: str, span: int, bucket: Callable[[Column], Column] | None = None) -> Column:
    """Bucket of an expiry value: its span, or what a rule of one's own gives."""
    return bucket(F.col(expiry)) if bucket else F.floor(F.col(expiry) / span)


def ordered_expiry(df: DataFrame, keys: list[str], expiry: str, seq: str, period: int, span: int, groups: int = 256, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """disposition under a point of expiry that follows the largest expiry value seen.

    A row below the point is expired. Others are duplicates if their keys came before
    in the same bucket of values. Rows without an expiry value are errors. expiry is
    whole numbers.
    """
    return _decided(mark_ordered(df, expiry, seq, period, None, groups), [*keys, spans_of(expiry, span, bucket)], seq)


def time_expiry(df: DataFrame, keys: list[str], millis: str, seq: str, period_s: int = 86_400, span_s: int = 60, now_ms: int | None = None, groups: int = 256) -> DataFrame:
    """ordered_expiry on seconds; with now_ms the point of expiry stands at the clock."""
    rows = df.withColumn("_sec", F.floor(F.col(millis) / 1000))
    if now_ms is None:
        return ordered_expiry(rows, keys, "_sec", seq, period_s, span_s, groups).drop("_sec")
    return _decided(mark_clock(rows, "_sec", now_ms // 1000, period_s), [*keys, spans_of("_sec", span_s)], seq).drop("_sec")


def jump_expiry(df: DataFrame, keys: list[str], expiry: str, seq: str, period: int, span: int, max_jump: int) -> DataFrame:
    """ordered_expiry with mark_jump()."""
    return _decided(mark_jump(df, expiry, seq, period, max_jump), [*keys, spans_of(expiry, span)], seq)


def categorical_expiry(df: DataFrame, keys: list[str], category: str, seq: str, live: int, groups: int = 256) -> DataFrame:
    """disposition where the latest ``live`` categories, by first appearance, are live.

    A row is expired if as many newer categories came before it; rows without a
    category are errors. The categories' first rows are numbered in one small table.
    """
    marked = mark_categorical(df, category, seq, live, first_seen(df, category, seq), None, groups)
    return _decided(marked, keys, seq).select(*df.columns, "disposition")


def by_key_filtered(df: DataFrame, seen: DataFrame, keys: list[str], seq: str, shape: BloomShape) -> DataFrame:
    """by_key() after what was seen before: only rows that pass the filter of the seen
    keys are joined with them; the others are known to be new."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    held = seen.select(name.alias("_key")).distinct()
    w = Window.partitionBy("_key").orderBy(seq)
    rows = probe(df.withColumn("_key", name).withColumn("_r", F.row_number().over(w)), "_key", build(held, "_key", shape), shape)
    hits = rows.where("might_contain").join(held.withColumn("_old", F.lit(True)), "_key", "left")
    every = hits.unionByName(rows.where("not might_contain").withColumn("_old", F.lit(None).cast("boolean")))
    return every.withColumn("disposition", F.when(F.col("_old") | (F.col("_r") > 1), "duplicate").otherwise("unique")).drop("_key", "_r", "_old", "might_contain")


def counters(df: DataFrame) -> DataFrame:
    """Rows per disposition, all four always present."""
    spark = df.sparkSession
    kinds = spark.createDataFrame([(k,) for k in ("unique", "duplicate", "expired", "error")], "disposition string")
    return kinds.join(df.groupBy("disposition").agg(F.count("*").alias("n")), "disposition", "left").select("disposition", F.coalesce("n", F.lit(0)).alias("n"))
