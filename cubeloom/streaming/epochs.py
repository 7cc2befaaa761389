"""Tables that micro-batches add to: a folder per epoch and a base that replaces old ones.

An epoch that runs again after a failure replaces its own folder. compact() writes
a new base before it removes what the base replaces, and readers take the newest
complete base, so a failure between the two loses and repeats nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class EpochTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and self._fs.exists(self._root.suffix(f"/{n}/_SUCCESS")))

    def last(self) -> int:
        """The newest epoch that was written whole; -1 before the first."""
        return max([*self._done("epoch"), *self._done("base")], default=-1)

    def write(self, rows: DataFrame, epoch: int, by: list[str] | None = None) -> None:
        rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.path}/epoch={epoch}")

    def paths(self, before: int | None = None) -> list[str]:
        fits = lambda n: before is None or n < before
        base = max(filter(fits, self._done("base")), default=-1)
        return [*([f"{self.path}/base={base}"] if base >= 0 else []), *[f"{self.path}/epoch={n}" for n in self._done("epoch") if n > base and fits(n)]]

    def read(self, before: int | None = None, schema=None) -> DataFrame | None:
        """All rows, of the epochs before one; None if there are none."""
        paths = self.paths(before)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths]) if paths else None

    def epoch(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/epoch={n}")

    def compact(self, rows: DataFrame, upto: int, by: list[str] | None = None) -> None:
        """Makes rows, which stand for all epochs up to one, the new base."""
        if upto in self._done("base"):
            return
        rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.path}/base={upto}")
        for kind in ("epoch", "base"):
            for n in self._done(kind):
                if n < upto or (kind == "epoch" and n == upto):
                    self._fs.delete(self._root.suffix(f"/{kind}={n}"), True)

    def forget(self, before: int) -> None:
        """Drops the epochs before one."""
        for n in self._done("epoch"):
            if n < before:
                self._fs.delete(self._root.suffix(f"/epoch={n}"), True)
