"""Embedding near-duplicates: exact metric range join on the unit sphere.

Vectors are compared within one label and length. On unit vectors a cosine of
at least c is a distance of at most r = sqrt(2 - 2c). Each large label gets
pivots; a vector's home cell is its nearest pivot's, and it is also sent as a
probe to each cell whose pivot is at most 2r farther than its own: by the
triangle inequality no partner can live in another cell. Cells then join
independently, in blocks of bounded size, and every pair is decided by its
cosine in double precision. Equal vectors are joined once, with their number.

Blocks return a count per vector and a spanning star per group of links, never
the pairs, so the output grows with the vectors whatever the groups' sizes.

Vectors that are null, empty, zero, hold null or non-finite components, or
whose label or vec_id is null link with nothing. Repeated rows are vectors of
their own. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import sent, spanning_stars, stored
from cubeloom.llm.components import components

BLOCK = 3000
CELL = 2000
MOST_PIVOTS = 20_000


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in raw])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches):
    """vec (array) to its unit vector's bytes, for one row a time of any length."""
    for pdf in batches:
        out = [None] * len(pdf)
        for _, at in pdf.groupby(pdf["vec"].map(len), sort=False).indices.items():
            for i, row in zip(at, _unit(pdf["vec"].iloc[at]), strict=True):
                out[i] = row.tobytes()
        pdf["vec"] = out
        yield pdf


def _matrix(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _join_blocks(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home, probe = pdf[pdf["home"]], pdf[~pdf["home"]]
        out = []
        if len(home) and len(probe):
            h, hid, mult = _matrix(home["vec"]), home["rep"].to_numpy(), home["mult"].to_numpy()
            for at in range(0, len(probe), 1000):
                part = probe.iloc[at : at + 1000]
                pid = part["rep"].to_numpy()
                mask = (_matrix(part["vec"]) @ h.T >= cosine) & (pid[:, None] != hid[None, :])
                if not mask.any():
                    continue
                count = mask @ mult
                row, col = spanning_stars(mask)
                p, c = row >= 0, col >= 0
                out.append(pd.DataFrame({"rep": pid[p], "n": count[p], "to": hid[row[p]]}))
                out.append(pd.DataFrame({"rep": hid[c], "n": np.zeros(c.sum(), np.int64), "to": hid[col[c]]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "n": [], "to": []}, dtype="int64")

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    element = F.col("embedding")
    sound = F.forall(element, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(element, lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(element) > 0) & sound, F.lit(False))
    marked = vectors.select(
        "vec_id",
        F.when(ok, F.col("label")).alias("label"),
        F.when(ok, F.xxhash64("embedding")).alias("h1"),
        F.when(ok, F.xxhash64("embedding", F.lit(1))).alias("h2"),
        F.when(ok, F.size(element)).alias("dim"),
        F.when(ok, F.transform(element, lambda x: x.cast("double"))).alias("vec"),
    )
    key = ["label", "dim", "h1", "h2"]
    group = marked.where("label is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("vec").alias("vec"))
    schema = T.StructType([*[f for f in group.schema if f.name != "vec"], T.StructField("vec", T.BinaryType())])
    reps = stored(group.mapInPandas(_pack, schema), "reps")

    # Pivots: about one per `cell` vectors of the larger labels, MOST_PIVOTS at most in all.
    sizes = reps.groupBy("label", "dim").count().where(F.col("count") > 2 * cell).orderBy(F.desc("count"), "label", "dim").limit(MOST_PIVOTS // 8).collect()
    wanted = {(r["label"], r["dim"]): min(64, r["count"] // cell) for r in sizes}
    shrink = min(1.0, MOST_PIVOTS / max(1, sum(wanted.values())))
    pivots: dict[tuple, np.ndarray] = {}
    if wanted:
        ask = spark.createDataFrame([(lab, dim, max(2, int(wanted[lab, dim] * shrink)), r["count"]) for r in sizes for lab, dim in [(r["label"], r["dim"])]], T.StructType([reps.schema["label"], reps.schema["dim"], T.StructField("k", T.LongType()), T.StructField("n", T.LongType())]))
        drawn = reps.join(F.broadcast(ask), ["label", "dim"]).where(F.pmod(F.xxhash64("rep", F.lit(6)), F.col("n")) < F.col("k")).select("label", "dim", "rep", "vec").collect()
        for r in sorted(drawn, key=lambda r: r["rep"]):
            pivots.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["vec"], np.float64))
        pivots = {k: np.stack(v) for k, v in pivots.items()}
    shared = sent(spark, pivots)
    reach = 2 * np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7  # distances near 0 are off by 1e-8

    def cells(batches):
        for pdf in batches:
            homes, others = np.zeros(len(pdf), np.int32), [[0]] * len(pdf)
            for k, at in pdf.groupby(["label", "dim"], sort=False).indices.items():
                p = shared.value.get(k)
                if p is None:
                    continue
                x = _matrix(pdf["vec"].iloc[at])
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
                homes[at] = d.argmin(1)
                near = d <= d.min(1, keepdims=True) + reach
                for i, row in zip(at, near, strict=True):
                    others[i] = np.flatnonzero(row).tolist()
            pdf["cell"], pdf["probes"] = homes, others
            yield pdf

    at_home = reps.select("label", "dim", "rep", "mult", "vec").mapInPandas(cells, T.StructType([*[reps.schema[c] for c in ("label", "dim", "rep", "mult", "vec")], T.StructField("cell", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType()))]))
    placed = stored(at_home, "cells")
    where = ["label", "dim", "cell"]
    homes = placed.groupBy(*where).agg(F.count("*").alias("nh"))
    probes = placed.select("label", "dim", F.explode("probes").alias("cell")).groupBy(*where).agg(F.count("*").alias("np"))
    grid = homes.join(probes, where).select(*where, F.ceil(F.col("nh") / block).cast("int").alias("bh"), F.ceil(F.col("np") / block).cast("int").alias("bp"))
    salt = F.xxhash64("rep", F.lit(7))
    home_rows = placed.select(*where, "rep", "mult", "vec").join(grid, where).select(*where, F.pmod(salt, F.col("bh")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bp") - 1)).alias("j"), F.lit(True).alias("home"), "rep", "mult", "vec")
    probe_rows = placed.select("label", "dim", F.explode("probes").alias("cell"), "rep", "mult", "vec").join(grid, where).select(*where, F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("i"), F.pmod(salt, F.col("bp")).cast("int").alias("j"), F.lit(False).alias("home"), "rep", "mult", "vec")
    found = stored(home_rows.unionByName(probe_rows).groupBy(*where, "i", "j").applyInPandas(_join_blocks(cosine), "rep long, n long, to long"), "links")

    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select("rep", "to")).select(F.col("node").alias("rep"), "root")
    of_rep = reps.select(*key, "rep", "mult").join(links, "rep", "left").join(roots, "rep", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = marked.select("vec_id", *key).join(of_rep, key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
