"""Lateness classifier: normal, laggard, late (too old), early (too far ahead)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000


def classify(time: Column, reference: Column | int, buffer: int = MINUTE, tumbling: int = 60 * MINUTE, laggards: int = 15 * MINUTE) -> Column:
    """Class of a time (epoch milliseconds) against a reference time.

    The window starts at the reference rounded down to the tumbling length;
    laggards reach back from it by the larger of both lengths. Times more than
    the buffer ahead of the reference, and older ones, are errors; null is one too.
    """
    ref = F.lit(reference) if isinstance(reference, int) else reference
    start = ref - F.pmod(ref, F.lit(tumbling))
    return (
        F.when(time.isNull() | (time > ref + buffer), F.lit("early"))
        .when(time < start - max(tumbling, laggards), F.lit("late"))
        .when(time >= start, F.lit("normal"))
        .otherwise(F.lit("laggard"))
    )


def is_error(kind: Column) -> Column:
    return kind.isin("early", "late")
