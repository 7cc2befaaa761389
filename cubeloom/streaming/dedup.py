"""Deduplication and lateness of streams.

DedupStore takes micro-batches through the batch rules of cubeloom.operators.dedup,
with two tables of state: where the point of expiry stands (one row) and the keys
seen in each bucket. Each batch is marked by ranges and joined with the seen keys of
live buckets, in as many tasks as a batch query has, and every row goes out with its
disposition instead of being lost behind a watermark. Keys and values stay typed: a
key is the JSON text that Spark makes of its columns, so null, 5 and "5" are apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.operators import dedup
from cubeloom.operators.lateness import classify
from cubeloom.streaming.epochs import EpochTable


@dataclass(frozen=True)
class Rule:
    """When rows expire.

    kind: ordered (the largest value seen), jump (ordered, and a lead of more than
    max_jump is an error), clock (clock() gives the time, in the unit of expiry), or
    categorical (the latest ``live`` values of expiry, by first appearance).
    bucket: of a value; by default its span. Categories share one bucket, so a key is a
    duplicate whatever live category it came in first, and keys are kept for good.
    """

    kind: str
    expiry: str
    period: int = 86_400
    span: int = 60
    max_jump: int = 10_800
    live: int = 2
    clock: Callable[[], int] | None = None
    bucket: Callable[[Column], Column] | None = None


class DedupStore:
    """State of one deduplication, for foreachBatch. Rows of a batch are taken in the
    order of seq, and batches in the order they come."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, rule: Rule, sink: Callable[[DataFrame, int], None], groups: int = 32, compact_every: int = 20) -> None:
        self.spark, self.keys, self.seq, self.rule, self.sink, self.groups, self.compact_every = spark, keys, seq, rule, sink, groups, compact_every
        path = path.rstrip("/")
        self.seen, self.ends, self.categories = (EpochTable(spark, f"{path}/{t}") for t in ("seen", "ends", "categories"))

    def _end(self, epoch: int) -> int | None:
        """Where the rule stood after the epoch before."""
        rows = self.ends.read(before=epoch, schema="end long, epoch_no long")
        got = rows.orderBy(F.desc("epoch_no")).first() if rows is not None else None
        return got["end"] if got else None

    def _marked(self, batch: DataFrame, epoch: int, end: int | None) -> tuple[DataFrame, Column, Column]:
        """batch with _live; its bucket; and what the state takes from live rows."""
        r = self.rule
        value = F.col(r.expiry)
        if r.kind == "categorical":
            known = self.categories.read(before=epoch)
            numbers = dedup.first_seen(batch, r.expiry, self.seq, known).persist()
            fresh = numbers if known is None else numbers.join(known, "_cat", "left_anti")
            self.categories.write(fresh, epoch)
            marked = dedup.mark_categorical(batch, r.expiry, self.seq, r.live, numbers, end, self.groups)
            return marked, F.lit(0), F.col("_nth")
        bucket = dedup.spans_of(r.expiry, r.span, r.bucket)
        if r.kind == "clock":
            return dedup.mark_clock(batch, r.expiry, r.clock(), r.period), bucket, value
        if r.kind == "jump":
            return dedup.mark_jump(batch, r.expiry, self.seq, r.period, r.max_jump, end), bucket, value
        return dedup.mark_ordered(batch, r.expiry, self.seq, r.period, end, self.groups), bucket, value

    def apply(self, batch: DataFrame, epoch: int) -> None:
        columns = batch.columns
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        end = self._end(epoch)
        marked, bucket, value = self._marked(batch, epoch, end)
        key = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        rows = marked.withColumn("_key", key).withColumn("_bucket", F.when(F.col("_live") == "live", bucket).cast("long"))
        if "_nth" not in rows.columns:
            rows = rows.withColumn("_nth", F.lit(None).cast("long"))
        w = Window.partitionBy("_live", "_key", "_bucket").orderBy(self.seq)
        rows = rows.withColumn("_first", F.row_number().over(w) == 1)
        old = self.seen.read(before=epoch, schema="_key string, _bucket long")
        if old is not None:
            low = self._low(end)
            old = old if low is None else old.where(F.col("_bucket") >= low)
            rows = rows.join(old.withColumn("_old", F.lit(True)), ["_key", "_bucket"], "left")
        else:
            rows = rows.withColumn("_old", F.lit(None).cast("boolean"))
        found = F.when(F.col("_live") != "live", F.col("_live")).when(F.col("_first") & F.col("_old").isNull(), "unique").otherwise("duplicate")
        rows = rows.withColumn("disposition", found).persist(StorageLevel.MEMORY_AND_DISK)
        self.seen.write(rows.where("disposition = 'unique'").select("_key", "_bucket"), epoch)
        top = rows.where("_live = 'live'").agg(F.max(value.cast("long") if self.rule.kind != "categorical" else F.col("_nth")).alias("m")).first()["m"]
        now = max([x for x in (end, top) if x is not None], default=None)
        self.ends.write(self.spark.createDataFrame([(now, epoch)], "end long, epoch_no long").coalesce(1), epoch)
        self.sink(rows.select(*columns, "disposition"), epoch)
        rows.unpersist()
        batch.unpersist()
        if epoch % self.compact_every == self.compact_every - 1:
            self.compact(epoch)

    def _low(self, end: int | None) -> int | None:
        """The least bucket that can still hold live rows, where buckets are spans."""
        r = self.rule
        if r.kind == "categorical" or r.bucket is not None:
            return None
        at = r.clock() if r.kind == "clock" else end
        return None if at is None else (at - r.period + 1) // r.span

    def compact(self, epoch: int) -> None:
        """Drops the keys of buckets that are behind the point of expiry."""
        end = self._end(epoch + 1)
        rows, low = self.seen.read(schema="_key string, _bucket long"), self._low(end)
        if rows is not None:
            self.seen.compact(rows if low is None else rows.where(F.col("_bucket") >= low), epoch)
        if end is not None:
            self.ends.compact(self.spark.createDataFrame([(end, epoch)], "end long, epoch_no long").coalesce(1), epoch)


def by_key(df: DataFrame, keys: list[str], time: str, keep: str = "1 day") -> DataFrame:
    """First rows of each key within a time; Spark's own state."""
    return df.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def lateness(df: DataFrame, time: str, reference: int | None = None, **lengths: int) -> DataFrame:
    """df with a column lateness; the reference is the clock unless it is given."""
    ref = F.unix_millis(F.current_timestamp()) if reference is None else reference
    return df.withColumn("lateness", classify(F.col(time), ref, **lengths))
