"""Lookup tables: JSON lines, JDBC, and keyed byte tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubeloom.operators.enrich import one_per_key


def json_lines(spark: SparkSession, path: str, schema: StructType | str, keys: list[str] | None = None) -> DataFrame:
    """One object a line; lines that are no object of the schema are skipped.
    With keys, the last line of a key wins: by file, then by place in it."""
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    ok = F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    rows = text.where(ok).withColumn("_row", parsed).where("_row is not null")
    if keys is None:
        return rows.select("_row.*")
    picked = rows.select("_row.*", F.struct("_file", "_block", "_line").alias("_order"))
    return one_per_key(picked, keys, "_order").drop("_order")


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, keys: list[str] | None = None, order: str | Column | None = None, **options: str) -> DataFrame:
    """A table or a query of a database; with keys, the first row of each key."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    df = (reader.option("dbtable", table) if table else reader.option("query", query)).load()
    return df if keys is None else one_per_key(df, keys, order if order is not None else F.lit(0), last=False)


def keyed_bytes(df: DataFrame, row_key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows by key with (family, qualifier) columns as bytes. df: a row key column and
    a map column per family, qualifier -> bytes."""
    return df.select(F.col(row_key), *[F.try_element_at(F.col(family), F.lit(qualifier)).cast("binary").alias(out) for out, (family, qualifier) in columns.items()])


def row_range(df: DataFrame, row_key: str, first=None, last=None) -> DataFrame:
    """Rows of a keyed table from first to last, both inside, in key order; bytes order as unsigned numbers."""
    inside = F.lit(True)
    if first is not None:
        inside &= F.col(row_key) >= F.lit(first)
    if last is not None:
        inside &= F.col(row_key) <= F.lit(last)
    return df.where(inside).orderBy(row_key)
