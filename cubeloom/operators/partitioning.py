"""When partitions of an operator should be split or merged, from their latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decisions(latencies: DataFrame, low: float, high: float, windows: int = 10) -> DataFrame:
    """average and decision of each row: split above high, merge below low, else keep.

    latencies: partition, window_id, latency. The average runs over a partition's last
    windows; one that has fewer yet is kept as it is.
    """
    w = Window.partitionBy("partition").orderBy("window_id").rowsBetween(1 - windows, 0)
    average = F.avg("latency").over(w)
    ready = F.count("latency").over(w) == windows
    decision = F.when(ready & (average > high), "split").when(ready & (average < low), "merge").otherwise("keep")
    return latencies.select("*", average.alias("average"), decision.alias("decision"))
