"""Corpus preparation: toxicity, line dedup, near-duplicates, decontamination, packing.

STAGES lists (name, function(spark, docs, sf_dir) -> DataFrame). Each stage works
on all that the one before it kept; all but the last return the columns of
``documents``. run() writes each stage's rows as Parquet in the shared folder and
reads them again as the next one's documents.

Stages 1 and 3 of the list take labels and benchmark items from sf_dir; what a
stage counts in the corpus, it counts over its own input.

Decisions are made and applied by row. Where a doc_id is null or stands on several
rows, rows are told apart by doc_id and text; rows equal in both are one. Of rows
with one doc_id the order is that of their texts' hashes; rows without come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, lines, minhash, packing, toxicity
from cubeloom.llm._common import folder_of, read, remove, scope, written

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the score is of the whole text."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < TOXIC)


def _by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a column __key that orders as doc_id, and (doc_id, text) with it as doc_id."""
    key = F.col("doc_id")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
            key = F.lpad((key.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
        key = F.when(F.col("doc_id").isNull(), "~").otherwise(F.concat(F.lit("0"), key.cast("string")))
        key = F.concat(key, F.lit("\0"), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))).cast("binary")
    keyed = docs.withColumn("__key", key)
    return keyed, keyed.select(F.col("__key").alias("doc_id"), "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the lines whose component has an earlier line.

    All rows stay, a text of nothing but repeats as an empty one; n_chars follows
    the text. Texts that lose no line stay as they are, null ones too.
    """
    keyed, texts = _by_row(docs)
    gone = lines.near_duplicate_lines(texts).where(~F.col("kept")).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    joined = keyed.join(gone, F.col("__key").eqNullSafe(F.col("__doc")), "left")
    parts, lost = F.split(F.col("text"), "\n", -1), F.col("__gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
    text = F.when(lost.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    cut = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], lost.isNotNull().alias("__cut"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.drop("__cut")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id.

    Rows equal in doc_id and text are reduced to one of them.
    """
    keyed, texts = _by_row(docs)
    found = minhash.near_duplicates(texts)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__doc")).distinct()
    unique = keyed.join(gone, F.col("__key").eqNullSafe(F.col("__doc")), "left_anti")
    again = found.where("kept").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return unique.drop("__key")
    once = again.select(F.col("doc_id").alias("__doc"))
    same = F.col("__key") == F.col("__doc")
    repeated = unique.join(once, same, "left_semi").dropDuplicates(["__key"])
    return unique.join(once, same, "left_anti").unionByName(repeated).drop("__key")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, texts = _by_row(docs)
    found = decontaminate.leaks(texts, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__leak")).distinct()
    return keyed.join(found, F.col("__key").eqNullSafe(F.col("__leak")), "left_anti").drop("__key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage can be told in SQL whole: classifiers, similarity and tokens. Tests hold
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps, sends and writes is let go once its rows are
    written, and so are these when the next stage's are."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope():
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), own=False)
        if before:
            remove(spark, before)
        before = folder_of(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
