"""Bloom filters as DataFrame expressions: bits are summed by an aggregate and tested by bit functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of one filter, 16 MB of literal in a plan: room for a million keys at a rate of 1e-20.
MAX_BITS = 1 << 27


class Bloom:
    """m bits, k hashes over keys (key), as an array of 64-bit words that plans hold as a literal."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(n * self.k / math.log(2)))
        self.seed = seed
        if self.m > MAX_BITS:
            raise OverflowError(f"{n} keys need {self.m} bits; the bound is {MAX_BITS}")
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        bits = [0] * -(-self.m // 64)
        for row in words.toLocalIterator():  # m / 64 rows at most, bounded above
            bits[row.w] = row.bits
        self.bits = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")

    @classmethod
    def fits(cls, n: int, rate: float) -> bool:
        return n * max(1, round(-math.log2(rate))) / math.log(2) <= MAX_BITS

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.m)) for i in range(self.k)]

    def has(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self.places(key):
            out = out & (F.getbit(F.get(self.bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out


def may_be_in(keys: DataFrame, key: Column, rate: float = 0.05, seed: int = 3) -> Column | None:
    """Test of key that lets all of keys (key) pass and few others, so that other rows need not be
    shuffled for a join; None where keys are too many for a bounded filter."""
    keys = keys.distinct()
    n = keys.count()
    return Bloom(keys, n, rate, seed).has(key) if Bloom.fits(n, rate) else None
