"""Connected components of an edge table.

Up to ``one_task`` edges (16 bytes each) one task joins them by union-find. More
go through alternating large-star and small-star steps. Each partition first replaces its edges by the spanning stars of its own
union-find. Every round is written to the shared folder, so no round depends on
the executors that made the one before, and nothing is gathered on the driver
but two sums per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import written


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def known() -> pd.DataFrame:
        nodes = list(parent.keys() | set(parent.values()))
        return pd.DataFrame({"a": nodes, "b": [find(n) for n in nodes]}, dtype="int64")

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:  # hand on what is known and start anew
            yield known()
            parent.clear()
    if parent:
        yield known()


def components(edges: DataFrame, rounds: int = 60, one_task: int = 1_000_000) -> DataFrame:
    """node, root of every node of edges(a, b); root is the smallest node reachable.

    a and b are integers; rows with a null end or equal ends are passed over, so
    nodes without another end do not appear.
    """
    clean = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a <> b")
    if clean.limit(one_task + 1).count() <= one_task:
        return clean.coalesce(1).mapInPandas(_local_stars, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    stars = written(clean.mapInPandas(_local_stars, "a long, b long").where("a <> b").distinct(), "stars")
    state = None
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        stars = written(small.where("a <> b").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
