"""Unifiers of query results that several partitions answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def non_empty(results: DataFrame) -> DataFrame:
    """Drops dataResult rows whose data array is empty or null; other messages pass."""
    return results.where((F.col("type") != "dataResult") | (F.coalesce(F.size("data"), F.lit(0)) > 0))


def merge_results(results: DataFrame, seq: str = "seq") -> DataFrame:
    """Per window and query id the first non-empty dataResult, or one empty one if
    there is no other; messages of other types pass. Columns: window_id, id, type, data."""
    empty = F.coalesce(F.size("data"), F.lit(0)) <= 0
    w = Window.partitionBy("window_id", "id", "type").orderBy(empty, seq)
    first = results.where("type = 'dataResult'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.unionByName(results.where("type <> 'dataResult'"))
