"""Lookup enrichment: left outer join with a lookup table of one row per key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value that stands for a missing primitive, by Spark type.
ZERO = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False}


def mapping(text: str, reverse: bool = False) -> dict[str, str]:
    """``"a:b,c"`` as {a: b, c: c}; reversed for lists that name the table's field first."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = (x.strip() for x in part.partition(":"))
        b = b or a
        out[b if reverse else a] = a if reverse else b
    return out


def one_per_key(lookup: DataFrame, keys: list[str], order: str | Column, last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order."""
    o = F.col(order) if isinstance(order, str) else order
    w = Window.partitionBy(*keys).orderBy(o.desc() if last else o.asc())
    return lookup.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def small_enough(df: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> bool:
    """Whether df has at most so many rows and bytes; reads one row more than that."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.length(F.to_json(F.struct(f.name))) if "<" in f.dataType.simpleString() else F.lit(8) for f in df.schema]
    got = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.sum(reduce(Column.__add__, sizes, F.lit(0))).alias("b")).first()
    return got["n"] <= most_rows and (got["b"] or 0) <= most_bytes


def _joined(df: DataFrame, lookup: DataFrame, on: dict[str, str], fields: list[str], most_broadcast: int) -> DataFrame:
    """df with __hit and __<field> columns. The lookup is sent to all executors only if
    it has at most most_broadcast rows and 64 MB; beyond that both sides are shuffled."""
    side = lookup.select(*[F.col(db).alias(f"__k{i}") for i, db in enumerate(on.values())], *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    if small_enough(side, most_broadcast):
        side = F.broadcast(side)
    return df.join(side, [df[k] == side[f"__k{i}"] for i, k in enumerate(on)], "left")


def refreshing(load: Callable[[], DataFrame], enrich: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], need_refresh: Callable[[int], bool] = lambda epoch: True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is joined with the lookup as load() gives it
    then, or with the one before where need_refresh(epoch) is false. Lookups are read only."""
    held: list[DataFrame] = []

    def step(batch: DataFrame, epoch: int) -> None:
        if not held or need_refresh(epoch):
            held[:] = [load()]
        sink(enrich(batch, held[0]), epoch)

    return step


def enrich_map(df: DataFrame, lookup: DataFrame, on: dict[str, str], include: list[str] | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """Matched rows take the included fields, over their own of the same name too;
    other rows stay as they are, with null in new fields. on: field of df -> field of lookup."""
    fields = include or lookup.columns
    j = _joined(df, lookup, on, fields, most_broadcast)
    own = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns]
    return j.select(*own, *[F.col(f"__{c}").alias(c) for c in fields if c not in df.columns])


def enrich_typed(df: DataFrame, lookup: DataFrame, on: dict[str, str], copy: dict[str, str], add: dict[str, str], types: dict[str, str] | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """A new row of copied fields (in -> out) and looked-up fields (out -> field of
    lookup); numbers and truth values that stay without a value become zero."""
    j = _joined(df, lookup, on, list(dict.fromkeys(add.values())), most_broadcast)
    out = []
    for name, c, kind in [*[(o, F.col(i), df.schema[i].dataType) for i, o in copy.items()], *[(o, F.col(f"__{f}"), lookup.schema[f].dataType) for o, f in add.items()]]:
        kind = (types or {}).get(name, kind.simpleString())
        c = c.cast(kind)
        out.append((F.coalesce(c, F.lit(ZERO[kind]).cast(kind)) if kind in ZERO else c).alias(name))
    return j.select(*out)
