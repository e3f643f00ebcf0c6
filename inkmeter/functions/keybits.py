"""Membership bitmaps: which rows of a large table may have a key of another one, without a shuffle.

A 64-bit hash names one of ``maps`` bitmaps of 32,768 bits each (what
``bitmap_construct_agg`` holds, 4 KB) and a bit in it.  The bitmaps of a key
set are a table of at most ``maps`` rows, so what is broadcast is bounded by
the number of maps and not by the keys.  A set bit means "perhaps", a clear
one "no"; the more keys, the more rows pass for nothing.  Everything stays in
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 15
#: 4,096 bitmaps are 16 MB: room for some ten million keys.
MAPS = 1 << 12


def _map(hash_col: str, maps: int) -> Column:
    return F.pmod(F.col(hash_col), F.lit(maps)).cast("int")


def _bit(hash_col: str) -> Column:
    # bits of the hash that did not choose the bitmap
    return F.pmod(F.shiftrightunsigned(F.col(hash_col), 24), F.lit(BITS))


def bitmaps(keys: DataFrame, hash_col: str, maps: int = MAPS) -> DataFrame:
    """(_map, _bits): the bitmaps of a key set, at most ``maps`` rows."""
    return (keys.select(_map(hash_col, maps).alias("_map"), _bit(hash_col).alias("_bit"))
            .groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def marked(df: DataFrame, hash_col: str, maps_table: DataFrame, name: str, maps: int = MAPS) -> DataFrame:
    """``df`` without ``hash_col``, plus ``name``: whether the row's hash may be among the keys (false: it is not)."""
    bit = _bit(hash_col)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = df.withColumn("_map", _map(hash_col, maps)).join(F.broadcast(maps_table), "_map", "left")
    return joined.select(*[c for c in df.columns if c != hash_col], there.alias(name))
