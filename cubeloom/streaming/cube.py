"""Cube of a stream: each micro-batch is merged into a stored table of partials."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cubeloom.operators.cube import finish, group, needed, partials, project, regroup
from cubeloom.plans.query import DataQuery, execute, to_json
from cubeloom.plans.spec import CubeSpec
from cubeloom.streaming.epochs import EpochTable


class CubeStore:
    """Partials by epoch, as Parquet. An epoch that runs again after a failure replaces
    itself and counts once; what was committed and which queries are registered is
    read back from the store at a start.

    by_group: epochs hold merged rows of every group, in a folder per dd_id, so that a
    query reads the folders of its group alone; else they hold finest partials, which
    are less to write. compact() merges epochs; compact_every does it that often.
    """

    def __init__(self, spark: SparkSession, path: str, spec: CubeSpec, by_group: bool = False, compact_every: int | None = None, **reading) -> None:
        self.spark, self.path, self.spec, self.reading, self.by_group, self.compact_every = spark, path.rstrip("/"), spec, reading, by_group, compact_every
        self.table, self._asked = EpochTable(spark, f"{self.path}/parts"), EpochTable(spark, f"{self.path}/queries")
        self.committed = self.table.last()
        kept = self._asked.epoch(self._asked.last()).collect() if self._asked.last() >= 0 else []
        self.queries: list[tuple[DataQuery, int]] = [(DataQuery(**json.loads(r["query"])), r["ticks"]) for r in kept if r["query"]]
        self.on_result: Callable[[str, str], None] | None = None
        self.on_update: Callable[[DataFrame, int], None] | None = None

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch; an epoch that was committed before is skipped."""
        if epoch <= self.committed:
            return
        parts = partials(project(batch, self.spec, **self.reading), self.spec)
        self.table.write(group(parts, self.spec) if self.by_group else parts, epoch, ["dd_id"] if self.by_group else None)
        self.committed = epoch
        if self.on_update:
            self.on_update(self.updates(epoch), epoch)
        self._answer()
        if self.compact_every and (epoch + 1) % self.compact_every == 0:
            self.compact()

    def parts(self) -> DataFrame:
        return self.table.read()

    def cube(self) -> DataFrame:
        """The cube; of a store by group, what a filter on dd_id leaves is all that is read."""
        return finish(regroup(self.parts(), self.spec) if self.by_group else group(self.parts(), self.spec), self.spec)

    def updates(self, epoch: int) -> DataFrame:
        """Rows of the cube that an epoch changed, as they are after it."""
        new = self.table.epoch(epoch)
        named = new if self.by_group else group(new, self.spec)
        keys = ["dd_id", "time_bucket", "time", *[f.name for f in self.spec.keys if f.name in named.columns]]
        cube, changed = self.cube(), named.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [cube[k].eqNullSafe(changed[f"_{k}"]) for k in keys]
        return cube.join(changed, same, "left_semi")

    def compact(self) -> DataFrame:
        """Merges the epochs to the finest grain, in their place; gives what is stored then."""
        rows = self.parts()
        if self.by_group:
            self.table.compact(regroup(rows, self.spec), self.committed, ["dd_id"])
            return self.parts()
        keys = [c for c in rows.columns if c.startswith("k_") or c == "_t"]
        merges = {f"{n}_{v}": make for (v, _), a in needed(self.spec).items() for n, make in a.merge.items()}
        merged = rows.groupBy(*keys).agg(F.sum("n_events").alias("n_events"), *[make(F.col(c)).alias(c) for c, make in merges.items()])
        self.table.compact(merged, self.committed)
        return self.parts()

    def register(self, query: DataQuery) -> None:
        """Answered after each epoch while its countdown lasts; a query without one is answered once."""
        self.queries.append((query, 1 if query.one_time else query.countdown))
        self._keep()

    def _keep(self) -> None:
        rows = [(json.dumps(asdict(q)), ticks) for q, ticks in self.queries] or [(None, 0)]
        at = self._asked.last() + 1
        self._asked.write(self.spark.createDataFrame(rows, "query string, ticks int").coalesce(1), at)
        self._asked.forget(at)

    def _answer(self) -> None:
        left = []
        cube = self.cube() if self.queries else None
        for query, ticks in self.queries:
            rows = execute(cube, self.spec, query)
            complete = query.latest is None or rows.select("time").distinct().count() >= query.latest
            if self.on_result and (query.incomplete_ok or complete or ticks <= 1):
                self.on_result(query.id, to_json(rows, query, self.spec).first()["message"])
            if ticks > 1:
                left.append((query, ticks - 1))
        if self.queries:
            self.queries = left
            self._keep()


def start(events: DataFrame, store: CubeStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
