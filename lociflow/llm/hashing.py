"""A blocked Bloom filter as a table of 64-bit blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6


def _mask(key: Column) -> Column:
    """BITS bits of a 64-bit word, from six-bit pieces of a second hash."""
    bits = F.lit(0).cast("long")
    for i in range(BITS):
        piece = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), piece))
    return bits


def block_of(key: Column, n_blocks: int) -> Column:
    """The block of a key."""
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(n_blocks))


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits) of the listed keys (column key)."""
    return keys.groupBy(block_of(F.col("key"), n_blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def may_contain(bits: Column, key: Column) -> Column:
    """Whether a key's block has all its bits."""
    return bits.bitwiseAND(_mask(key)) == _mask(key)
