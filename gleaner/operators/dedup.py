"""Exact content dedup, URL anti joins, and a bloom filter as bitmap rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """Identity of a text (128 bits)."""
    return F.md5(F.coalesce(text, F.lit("")))


def first_seen(docs: DataFrame, order: str, text: str = "text", seen: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with a text not met before, in the order of ``order``; ``seen`` (digest) holds earlier ones.

    The first of each text is an aggregate with partial sums, so that a text of very many copies reaches its task as one
    row from each task. Texts met earlier leave it before the rows, with their texts, are joined."""
    rows = docs.withColumn("digest", digest(F.col(text)))
    first = rows.groupBy("digest").agg(F.min(order).alias(order))
    first = first if seen is None else first.join(seen.select("digest"), "digest", "left_anti")
    return rows.join(first, ["digest", order], "left_semi")


def dedup_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: unique, duplicates."""
    groups = docs.groupBy(digest(F.col(text)).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("unique_docs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def unseen(links: DataFrame, seen: DataFrame, on: str = "url") -> DataFrame:
    """Distinct links that are not in ``seen``."""
    return links.select(on).distinct().join(seen.select(on), on, "left_anti")


@dataclass(frozen=True)
class BloomSize:
    """m: bits, a multiple of 8; k: hashes."""

    m: int
    k: int

    @classmethod
    def of(cls, expected: int, target: float) -> BloomSize:
        if expected <= 0 or not 0 < target < 1:
            raise ValueError("expected items must be positive and the rate between 0 and 1")
        m = math.ceil(-expected * math.log(target) / math.log(2) ** 2)
        m += -m % 8
        return cls(m, max(1, round(m / expected * math.log(2))))

    def theoretical_fpr(self, items: int) -> float:
        return 0.0 if items == 0 else (1 - math.exp(-self.k * items / self.m)) ** self.k

    @property
    def size_bytes(self) -> int:
        return self.m // 8


def bloom_positions(item: Column, size: BloomSize) -> Column:
    """The item's ``k`` bits by double hashing of the halves of its digest (60 bits each)."""
    h = F.md5(item)
    h1 = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), F.lit(size.m))
    odd = F.conv(F.substring(h, 17, 15), 16, 10).cast("bigint").bitwiseOR(F.lit(1))
    h2 = F.pmod(odd, F.lit(size.m))
    return F.transform(F.sequence(F.lit(0), F.lit(size.k - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(size.m)))


@dataclass(frozen=True)
class Bloom:
    """bits: (bucket, bitmap), a row for each 32,768 bits that are not all clear. Adding never clears a bit."""

    size: BloomSize
    bits: DataFrame
    added: DataFrame  # one row: items

    @classmethod
    def build(cls, items: DataFrame, column: str, size: BloomSize) -> Bloom:
        at = items.select(F.explode(bloom_positions(F.col(column), size)).alias("p")).withColumn("p", F.col("p") + 1)
        bits = at.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
        return cls(size, bits, items.agg(F.count(F.lit(1)).alias("items")))

    def merge(self, other: Bloom) -> Bloom:
        bits = self.bits.unionByName(other.bits).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        return Bloom(self.size, bits, self.added.unionByName(other.added).agg(F.sum("items").alias("items")))

    def set_bits(self) -> DataFrame:
        return self.bits.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("bits_set"))

    def probe(self, items: DataFrame, column: str) -> DataFrame:
        """``items`` with maybe: false where the item was surely never added."""
        at = items.select(column).distinct().select(column, F.explode(bloom_positions(F.col(column), self.size)).alias("p")).withColumn("p", F.col("p") + 1)
        at = at.withColumns({"bucket": F.bitmap_bucket_number("p"), "bit": F.bitmap_bit_position("p")})
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.expr("shiftright(b, cast(bit % 8 as int)) & 1") == 1, F.lit(False))
        found = at.join(self.bits, "bucket", "left").withColumn("b", byte).withColumn("hit", hit).groupBy(column).agg(F.bool_and("hit").alias("maybe"))
        return items.join(found, column)
