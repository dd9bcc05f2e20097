"""Bloom filter whose slots are computed in the JVM."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(n: int, p: float) -> tuple[int, int]:
    """(bits, slots of each item) for n items and a false positive rate p."""
    bits = max(1, math.floor(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def py_slots(item: str, bits: int, k: int) -> list[int]:
    a, b = (int.from_bytes(h(item.encode()).digest(), "little") for h in (hashlib.sha1, hashlib.md5))
    return [(a + i * b) % bits for i in range(k)]


def _modulo(digest: Column, size: int, bits: int) -> Column:
    """A little-endian number given in hex, modulo the number of bits (below 2**31)."""
    value = F.lit(0).cast("long")
    for i in range(size - 1, -1, -1):
        byte = F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("long")
        value = (value * 256 + byte) % bits
    return value


def slots(item: Column, bits: int, k: int) -> Column:
    """Array of the k slots of an item, by two hashes; null for null."""
    a, b = _modulo(F.sha1(item), 20, bits), _modulo(F.md5(item), 16, bits)
    return F.when(item.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i * b) % bits))


class BloomFilter:
    """Set bits as a table of distinct slots (at most ``bits`` rows)."""

    def __init__(self, n: int, p: float):
        self.bits, self.k = parameters(n, p)
        self.set: DataFrame | None = None

    def add(self, items: DataFrame, column: str) -> BloomFilter:
        new = items.select(F.explode(slots(F.col(column), self.bits, self.k)).alias("slot")).distinct()
        self.set = new if self.set is None else self.set.union(new).distinct()
        return self

    def members(self, items: DataFrame, column: str) -> DataFrame:
        """Items with ``member``: False is certain, True may be wrong at the rate p. Null items are no members."""
        if self.set is None:
            return items.withColumn("member", F.lit(False))
        rows = items.withColumn("_s", F.array_distinct(slots(F.col(column), self.bits, self.k)))
        keys = rows.select(F.col(column).alias("_k"), "_s").where("_k is not null").dropDuplicates(["_k"])
        hit = keys.select("_k", F.size("_s").alias("_n"), F.explode("_s").alias("slot")).join(self.set, "slot").groupBy("_k", "_n").count().where("count = _n")
        return items.join(hit.select("_k"), items[column] == F.col("_k"), "left").withColumn("member", F.col("_k").isNotNull()).drop("_k")
