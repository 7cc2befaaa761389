"""Cube specification: keys, values, aggregators, time buckets and combinations.

``CubeSpec.from_json`` reads the JSON schema language described in README.md.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import combinations as subsets

#: Milliseconds of a time bucket's unit.
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
#: Ids of the common time buckets; others are numbered from 256 in order of appearance.
BUCKET_IDS = {"1m": 2, "1h": 3, "1d": 4}
TYPES = {
    "boolean": "boolean", "byte": "tinyint", "short": "smallint", "integer": "int", "int": "int", "long": "bigint",
    "char": "string", "string": "string", "float": "float", "double": "double", "object": "map<string,double>",
}
SIMPLE = ("SUM", "COUNT", "MIN", "MAX", "FIRST", "LAST")
DERIVED = ("AVG", "CUM_SUM")
COMPOSITE = ("TOPN", "BOTTOMN")


@dataclass(frozen=True)
class TimeBucket:
    """A tumbling window length; ``ALL`` is the bucket without time."""

    label: str

    @property
    def millis(self) -> int | None:
        if self.label == "ALL":
            return None
        m = re.fullmatch(r"([1-9]\d*)([smhd])", self.label)
        if not m:
            raise ValueError(f"not a time bucket: {self.label!r}")
        return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    expression: str | None = None
    enum_values: tuple = ()
    tags: tuple[str, ...] = ()
    scale: int | None = None  # decimal places kept by exact sums

    @property
    def spark_type(self) -> str:
        return TYPES[self.type.lower()]


@dataclass(frozen=True)
class Composite:
    """Top or bottom ``count`` of an aggregate over further keys."""

    kind: str
    count: int
    embedded: str
    keys: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.kind}-{self.embedded}-{self.count}_{'_'.join(sorted(self.keys))}"


Aggregate = str | Composite


@dataclass(frozen=True)
class Combination:
    keys: tuple[str, ...]
    buckets: tuple[TimeBucket, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]  # (value, aggregator)
    implicit: bool = False


@dataclass(frozen=True)
class Descriptor:
    """One combination in one time bucket: a group of rows of the cube."""

    dd_id: int
    keys: tuple[str, ...]
    bucket: TimeBucket
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass
class CubeSpec:
    keys: tuple[Field, ...]
    values: tuple[Field, ...]
    combinations: tuple[Combination, ...]
    tags: tuple[str, ...] = ()
    bucket_ids: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def from_json(text: str | dict) -> CubeSpec:
        raw = json.loads(text) if isinstance(text, str) else text

        def fields(name: str) -> tuple[Field, ...]:
            out = tuple(
                Field(f["name"], f["type"], f.get("expression"), tuple(f.get("enumValues", ())), tuple(f.get("tags", ())), f.get("scale"))
                for f in raw.get(name, ())
            )
            if len({f.name for f in out}) != len(out):
                raise ValueError(f"{name} repeat a name")
            for f in out:
                f.spark_type  # noqa: B018  an unknown type fails here
            return out

        keys, values = fields("keys"), fields("values")
        known = {k.name for k in keys}

        def aggregate(a: str | dict) -> Aggregate:
            if isinstance(a, str):
                if a not in SIMPLE + DERIVED:
                    raise ValueError(f"unknown aggregator {a!r}")
                return a
            if a["aggregator"] not in COMPOSITE:
                raise ValueError(f"unknown aggregator {a['aggregator']!r}")
            inner = a.get("embeddedAggregator", a.get("embededAggregator"))
            if int(a["count"]) < 1 or not isinstance(aggregate(inner), str):
                raise ValueError("a composite needs a count and a plain aggregator")
            return Composite(a["aggregator"], int(a["count"]), inner, tuple(a["subCombinations"]))

        everywhere = [(v["name"], aggregate(a)) for v in raw.get("values", ()) for a in v.get("aggregators", ())]
        buckets = [TimeBucket(b) for b in raw.get("timeBuckets", ())]
        dims = raw.get("dimensions")
        if dims == "ALL_COMBINATIONS":
            names = [k.name for k in keys]
            dims = [{"combination": list(c)} for n in range(len(names) + 1) for c in subsets(names, n)]
        elif not dims:
            dims = [{"combination": []}]
        found: list[Combination] = []
        for d in dims:
            cols = tuple(d["combination"])
            if set(cols) - known or len(set(cols)) != len(cols):
                raise ValueError(f"not a combination of the keys: {cols}")
            own = buckets + [TimeBucket(b) for b in d.get("timeBuckets", ()) if TimeBucket(b) not in buckets]
            own = own or [TimeBucket("ALL")]
            for b in own:
                b.millis  # noqa: B018  a malformed bucket fails here
            aggs = list(everywhere)
            for extra in d.get("additionalValues", ()):
                pairs = [tuple(extra.split(":", 1))] if isinstance(extra, str) else list(extra.items())
                aggs += [(v, aggregate(a)) for v, a in pairs if (v, aggregate(a)) not in aggs]
            for v, a in aggs:
                if v not in {x.name for x in values}:
                    raise ValueError(f"unknown value {v!r}")
                if isinstance(a, Composite) and (set(a.keys) - known or set(a.keys) & set(cols)):
                    raise ValueError(f"{a.name}: keys must be further keys of the schema")
            found.append(Combination(cols, tuple(own), tuple(aggs)))
        spec = CubeSpec(keys, values, tuple(found + _implied(found)), tuple(raw.get("tags", ())))
        for c in spec.combinations:
            for b in c.buckets:
                if b.label not in spec.bucket_ids:
                    new = [i for i in spec.bucket_ids.values() if i >= 256]
                    spec.bucket_ids[b.label] = 0 if b.label == "ALL" else BUCKET_IDS.get(b.label, 256 + len(new))
        return spec

    def descriptors(self) -> list[Descriptor]:
        """Ids are dense: combination first, time bucket second."""
        out: list[Descriptor] = []
        for c in self.combinations:
            out += [Descriptor(len(out) + i, c.keys, b, c.aggregates) for i, b in enumerate(c.buckets)]
        return out

    def find(self, keys: tuple[str, ...] | set[str], bucket: str) -> Descriptor | None:
        """The descriptor of a set of keys in a bucket; None if the schema has none."""
        return next((d for d in self.descriptors() if set(d.keys) == set(keys) and d.bucket.label == bucket), None)


def _implied(found: list[Combination]) -> list[Combination]:
    """Combinations that composites rank over and that the schema does not list."""
    wanted: dict[frozenset, dict] = {}
    for c in found:
        for v, a in c.aggregates:
            if isinstance(a, Composite):
                keys = frozenset(c.keys) | frozenset(a.keys)
                w = wanted.setdefault(keys, {"keys": tuple(dict.fromkeys([*c.keys, *a.keys])), "buckets": {}, "aggs": {}})
                w["buckets"] |= dict.fromkeys(c.buckets)
                w["aggs"] |= dict.fromkeys((v, x) for x in (("SUM", "COUNT") if a.embedded == "AVG" else (a.embedded,)))
    out = []
    for keys, w in wanted.items():
        listed = next((c for c in found if frozenset(c.keys) == keys), None)
        if listed is not None and set(w["buckets"]) <= set(listed.buckets) and set(w["aggs"]) <= set(listed.aggregates):
            continue
        out.append(Combination(w["keys"], tuple(w["buckets"]), tuple(w["aggs"]), True))
    return out
