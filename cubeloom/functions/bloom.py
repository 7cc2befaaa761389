"""Bloom filters as tables of 64-bit words, made and probed by columns.

A filter is cut into blocks of about 4,096 bits. A key's bits lie in one block, so
a row meets half a kilobyte of the filter, however many items it is made for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096


@dataclass(frozen=True)
class BloomShape:
    """Bits and hash functions for n items at a false-positive rate of p."""

    n: int = 10_000
    p: float = 0.01

    @property
    def hashes(self) -> int:
        return max(1, math.ceil(-math.log2(self.p)))

    @property
    def bits(self) -> int:
        return max(1, math.ceil(self.n * self.hashes / math.log(2)))

    @property
    def blocks(self) -> int:
        return math.ceil(self.bits / BLOCK)

    @property
    def words(self) -> int:
        """Words of a block; all blocks together have at least ``bits``."""
        return math.ceil(self.bits / self.blocks / 64)

    def expected_rate(self, items: int) -> float:
        return (1 - math.exp(-self.hashes * items / self.bits)) ** self.hashes


def _places(key: Column, shape: BloomShape) -> tuple[Column, list[Column]]:
    """A key's block and its bits in there, by double hashing; the step is odd, so no bit comes twice."""
    a, b = F.shiftright(F.xxhash64(key), 1), F.shiftright(F.xxhash64(key, F.lit(42)), 16).bitwiseOR(F.lit(1))
    return F.pmod(F.xxhash64(key, F.lit(43)), F.lit(shape.blocks)), [F.pmod(a + i * b, F.lit(shape.words * 64)) for i in range(1, shape.hashes + 1)]


def positions(key: Column, shape: BloomShape) -> Column:
    """Bit positions of a key."""
    block, bits = _places(key, shape)
    return F.array(*(block * (shape.words * 64) + bit for bit in bits))


def build(items: DataFrame, key: str, shape: BloomShape) -> DataFrame:
    """word, mask: the words with set bits. Null keys are passed over."""
    bit = items.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), shape)).alias("bit"))
    return bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))


def empty(spark: SparkSession) -> DataFrame:
    """A filter that holds nothing."""
    return spark.createDataFrame([], "word long, mask long")


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all that was built into filters of one shape."""
    return reduce(DataFrame.unionByName, filters).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def estimate(built: DataFrame, shape: BloomShape) -> DataFrame:
    """bits set, n (items, estimated from them) and rate (of false positives now)."""
    bits = F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))
    size = shape.blocks * shape.words * 64
    share = bits / F.lit(float(size))
    n = F.when(share < 1, -F.lit(size / shape.hashes) * F.log(1 - share)).otherwise(F.lit(float("inf")))
    return built.agg(bits.alias("bits"), n.alias("n"), F.pow(share, F.lit(shape.hashes)).alias("rate"))


def probe(items: DataFrame, key: str, built: DataFrame, shape: BloomShape, most_broadcast: int = 32 << 20) -> DataFrame:
    """items with ``might_contain``; never false for a key that was built in, false for null keys.

    Rows meet the block of their key in a join. A filter of up to ``most_broadcast``
    bytes (26 million items at 0.01) is broadcast; for a larger one both sides are shuffled.
    """
    every = built.sparkSession.range(shape.blocks * shape.words).select(F.col("id").alias("word"))
    full = every.join(built, "word", "left").select(F.floor(F.col("word") / shape.words).alias("_block"), F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")).alias("w"))
    blocks = full.groupBy("_block").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["mask"]).alias("_words"))
    block, bits = _places(F.col(key), shape)
    is_set = (F.getbit(F.get("_words", F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1 for bit in bits)
    known = items.withColumn("_block", F.when(F.col(key).isNotNull(), block))
    j = known.join(F.broadcast(blocks) if shape.blocks * shape.words * 8 <= most_broadcast else blocks, "_block", "left")
    return j.withColumn("might_contain", F.col(key).isNotNull() & reduce(Column.__and__, is_set)).drop("_block", "_words")


def contains_all(items: DataFrame, key: str, built: DataFrame, shape: BloomShape) -> bool:
    """Whether the filter may hold every key."""
    return probe(items, key, built, shape).where("not might_contain").isEmpty()
