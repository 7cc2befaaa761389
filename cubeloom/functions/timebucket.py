"""Time columns as epoch milliseconds, and rounding down to buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeloom.plans.spec import TimeBucket


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def round_down(millis: Column, bucket: TimeBucket | str) -> Column:
    """Start of the bucket that holds the time, before 1970 too; null for ALL."""
    size = (bucket if isinstance(bucket, TimeBucket) else TimeBucket(bucket)).millis
    if size is None:
        return F.lit(None).cast("bigint")
    return millis - F.pmod(millis, F.lit(size))
