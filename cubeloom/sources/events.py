"""Event sources: delimited files in a loop, compressed line files, converted records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators.dedup import positions


def convert(events: DataFrame, make: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(converted, dropped) from headers and body: rows whose conversion is null go to
    the second table, whole."""
    made = events.withColumn("value", make(F.col("headers"), F.col("body")))
    return made.where("value is not null").select("headers", "value"), made.where("value is null").drop("value")


def masked_json(body: Column, schema: str) -> Column:
    """A JSON body as a struct; null where it does not decode."""
    text = body.cast("string")
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def gz_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all .gz files below a folder: value, file."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def gz_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of the same lines, some files a trigger."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(path)


def replay(rows: DataFrame, now_ms: int, count: int, late_share: float = 0.0, seed: int = 0, order: str = "line") -> DataFrame:
    """count events from the rows in a loop: headers, body, time. rows: a column of
    line numbers from 0 and body. A late_share of them lies in the two days before now."""
    n = rows.count()
    if n == 0:
        return rows.select(F.create_map(F.lit("lineNumber"), F.lit("")).alias("headers"), "body", F.lit(None).cast("bigint").alias("time")).limit(0)
    ids = rows.sparkSession.range(count).withColumn(order, F.col("id") % n)
    draw = F.rand(seed)
    late = F.lit(now_ms) - F.floor(F.rand(seed + 1) * 2 * 86_400_000)
    joined = ids.join(rows, order)
    return joined.select("id", F.create_map(F.lit("lineNumber"), F.col(order).cast("string")).alias("headers"), "body", F.when(draw < late_share, late).otherwise(F.lit(now_ms)).cast("bigint").alias("time"))


def rate_windows(events: DataFrame, seq: str, per_second: int, window_ms: int = 1000, partitions: int = 1) -> DataFrame:
    """window_id of each event if a source of several partitions takes at most
    per_second events, dealt evenly: floor(per_second * window / partitions) of each
    partition in a window. Partition: events in turn."""
    cap = max(1, per_second * window_ms // 1000 // partitions)
    placed = positions(events, seq, "_at")
    return placed.withColumn("window_id", F.floor(F.floor((F.col("_at") - 1) / partitions) / cap)).drop("_at")


class Log:
    """Durable log of rows in append-only Parquet, a folder per flush. An address is
    (flush, offset); a flush that runs again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "headers map<string,string>, body binary") -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _flushes(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        done = [n for n in names if n.startswith("flush=") and self._fs.exists(self._root.suffix(f"/{n}/_SUCCESS"))]
        return sorted(int(n[6:]) for n in done)

    def store(self, events: DataFrame, seq: str | None = None, flush: int | None = None) -> int:
        """Appends events in the order of seq and gives the flush they went to."""
        n = flush if flush is not None else max([*self._flushes(), self.cleaned() - 1]) + 1
        if n < self.cleaned():
            raise ValueError(f"flush {n} has been cleaned")
        rows = positions(events, seq, "offset") if seq else events.withColumn("offset", F.monotonically_increasing_id() + 1)
        rows.withColumn("offset", F.col("offset") - 1).write.mode("overwrite").parquet(f"{self.path}/flush={n}")
        return n

    def retrieve(self, flush: int = 0, offset: int = 0) -> DataFrame:
        """Rows from an address on, with their own: flush, offset. An address that was cleaned is an error."""
        if flush < self.cleaned():
            raise ValueError(f"flush {flush} has been cleaned")
        kind = f"{self.schema}, offset long, flush int"
        if not self._flushes():
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("basePath", self.path).parquet(*[f"{self.path}/flush={n}" for n in self._flushes() if n >= flush] or [f"{self.path}/flush={self._flushes()[-1]}"])
        return rows.where((F.col("flush") > flush) | ((F.col("flush") == flush) & (F.col("offset") >= offset)))

    def cleaned(self) -> int:
        """The first flush that is still held."""
        at = self._root.suffix("/_cleaned")
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def clean(self, flush: int) -> None:
        """Drops the flushes before one; not beyond what has been flushed."""
        flush = min(flush, max(self._flushes(), default=-1) + 1)
        self._fs.mkdirs(self._root.suffix(f"/_cleaned/{flush}"))
        for n in self._flushes():
            if n < flush:
                self._fs.delete(self._root.suffix(f"/flush={n}"), True)


def append_log(events: DataFrame, path: str) -> None:
    """Durable log of (headers, body): append-only Parquet."""
    events.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str = "headers map<string,string>, body binary") -> DataFrame:
    """The log from its start: headers, body, file, offset in it."""
    return spark.read.schema(schema).parquet(path).select("headers", "body", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("offset"))
