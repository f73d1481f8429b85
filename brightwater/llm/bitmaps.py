"""Sets of hashed keys as bitmaps of bounded size, which can be broadcast however many keys there are.

A set bit may stand for several keys, so a bitmap only tells which rows cannot
have a key of the set; what it lets through has to be compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwater.llm.common import write_shared

#: Least and most bits of a bitmap whose size follows the number of keys; 128 MB at most.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
#: Bits in one row of a bitmap; Spark's bitmap functions have this size.
_ROW_BITS = 1 << 15


def bits_for(keys: int) -> int:
    """Sixteen bits a key within the bounds, so that one other row in sixteen passes."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys - 1).bit_length() if keys else LEAST_BITS))


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """Row of the bitmap and bit within it."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (at / _ROW_BITS).cast("int"), F.pmod(at, F.lit(_ROW_BITS))


def bitmap_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The bitmap of the values of one column, which should be distinct."""
    row, bit = _place(F.col(key), bits)
    placed = keys.select(row.alias("bitmap_row"), bit.alias("bit")).repartition("bitmap_row")
    return write_shared(placed.groupBy("bitmap_row").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "bitmap")


def marked(rows: DataFrame, key: str, bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """`rows` with a boolean `name`: whether the bitmap has the row's key, or another on the same bit."""
    row, bit = _place(F.col(key), bits)
    byte = F.conv(F.hex(F.substring("bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    found = rows.withColumn("_row", row).join(F.broadcast(bitmap), F.col("_row") == F.col("bitmap_row"), "left")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return found.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(name))


def passing(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that may have one of `keys`, a written table with one distinct column `key`: all that do and few others."""
    bits = bits_for(keys.count())
    return marked(rows, key, bitmap_of(keys, key, bits), bits, "_passes").where("_passes").select(*rows.columns)
