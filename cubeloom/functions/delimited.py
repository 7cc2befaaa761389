"""Columns of separator-delimited bodies: picking, reordering, templates, parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces(body: Column, separator: str) -> Column:
    return F.split(body.cast("string"), re.escape(separator), -1)


def pick(body: Column, columns: list[int], source: str = "\x02", target: str = "\x01") -> Column:
    """Columns by index, each followed by the target separator; a missing one is
    empty, a null body stays null. A body is bytes or text."""
    cells = pieces(body, source)
    out = F.concat(*[x for i in columns for x in (F.coalesce(F.get(cells, F.lit(i)), F.lit("")), F.lit(target))])
    return F.when(body.isNotNull(), out).cast("binary")


def fill(body: Column, template: str, source: str = "\x02") -> Column:
    """A template with {index} in place of columns; other text stands as it is."""
    cells, out = pieces(body, source), []
    for i, part in enumerate(re.split(r"\{(\d+)\}", template)):
        if i % 2:
            out.append(F.coalesce(F.get(cells, F.lit(int(part))), F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.when(body.isNotNull(), F.concat(*out)).cast("binary")


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def map_text(entries: Column) -> Column:
    """A map as ``[{k:v},{k:v}]``, by key."""
    cells = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(F.lit("{"), e["key"].cast("string"), F.lit(":"), e["value"].cast("string"), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))


def raw_event(body: Column, separator: str = "\x02", guid: int = 0, time: int = 1) -> Column:
    """struct(guid, time) of a delimited event; time is ``yyyy-MM-dd HH:mm:ss``, null if malformed."""
    cells = pieces(body, separator)
    return F.struct(F.get(cells, F.lit(guid)).alias("guid"), F.try_to_timestamp(F.get(cells, F.lit(time)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"))
