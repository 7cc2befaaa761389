"""Keyed store as an operation log: seq, bucket, op (PUT, DELETE, PURGE), key, end_key, value.

The state is what the log leaves: the last PUT or DELETE of a key wins, and a
PURGE removes what was put into its range [key, end_key] before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.operators.ranges import overlapping


def last_writes(log: DataFrame) -> DataFrame:
    """bucket, key, value, seq of the last PUT or DELETE of each key, if it is a PUT."""
    last = log.where("op <> 'PURGE'").groupBy("bucket", "key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("w"))
    return last.where("w.op = 'PUT'").select("bucket", "key", F.col("w.value").alias("value"), F.col("w.seq").alias("seq"))


def compact(log: DataFrame) -> DataFrame:
    """bucket, key, value, seq that the whole log leaves; keys are whole numbers."""
    live = last_writes(log)
    purges = log.where("op = 'PURGE'").select("bucket", F.col("key").alias("start"), F.col("end_key").alias("end"), F.col("seq").alias("purge_seq"))
    points = live.select("bucket", "key", "seq", F.col("key").alias("probe_start"), F.col("key").alias("probe_end"))
    purged = overlapping(purges, points, ["bucket"]).where("purge_seq > seq").select("bucket", "key").distinct()
    return live.join(purged, ["bucket", "key"], "left_anti")


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key: its hash under a mask, for the least power of two of at least that many buckets."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << max(0, buckets - 1).bit_length()) - 1))


def encoded(events: DataFrame, key: Column, value: Column, buckets: int, seq: str) -> DataFrame:
    """PUT rows of an event table: the key and value that a codec makes, and the bucket they go to."""
    return events.select(F.col(seq).alias("seq"), bucket_of(key, buckets).alias("bucket"), F.lit("PUT").alias("op"), key.alias("key"), F.lit(None).cast("long").alias("end_key"), value.alias("value"))


def merge_logs(*logs: DataFrame) -> DataFrame:
    """Logs of several parents as one, by window and, within it, by parent and sequence: place counts from 1 in each window."""
    named = [log.withColumn("parent", F.lit(i)) for i, log in enumerate(logs)]
    w = Window.partitionBy("window_id").orderBy("parent", "seq")
    return reduce(DataFrame.unionByName, named).withColumn("place", F.row_number().over(w))


def committed_only(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows of windows after each bucket's committed window: what a replay must apply."""
    done = committed.select("bucket", F.col("window_id").alias("_done"))
    return log.join(done, "bucket", "left").where(F.col("window_id") > F.coalesce("_done", F.lit(-1))).drop("_done")


def write_store(state: DataFrame, path: str, files: int | None = None, order: Callable[[Column], Column] | None = None) -> None:
    """Parquet by bucket. Files hold ranges of keys in order, so that reads skip files by their key bounds.

    files: about as many in all; without it as many as shuffle partitions hold rows.
    order: what keys are ordered by; bytes are ordered as unsigned numbers.
    """
    by = (order or (lambda c: c))(F.col("key"))
    ranged = state.repartitionByRange(files, "bucket", by) if files else state.repartitionByRange("bucket", by)
    ranged.sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("bucket").parquet(path)


def get(spark: SparkSession, path: str, bucket: int, *keys) -> DataFrame:
    """key, value of some keys of one bucket: one folder is listed, and files whose bounds lack the keys are passed over."""
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & F.col("key").isin(*keys)).select("key", "value")


def scan(spark: SparkSession, path: str, bucket: int, first, last) -> DataFrame:
    """key, value of the keys from first to last, both inside, of one bucket."""
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & F.col("key").between(first, last)).select("key", "value")


def look_up(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (bucket, key, ...) with the value of each key, null where there is none."""
    return wanted.join(store.select("bucket", "key", "value"), ["bucket", "key"], "left")
