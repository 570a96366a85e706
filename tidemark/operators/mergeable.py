"""Aggregates whose partial results merge exactly: hashes of link sets, and distinct counts as bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import row_numbers

MODULUS = "18446744073709551616"  # 2 to the 64th


def half(value: Column, first: int) -> Column:
    """Sixteen hexadecimal digits of the value's MD5 as a number below 2 to the 64th."""
    return F.conv(F.substring(F.md5(value), first, 16), 16, 10).cast("decimal(20,0)")


def modulo(total: Column) -> Column:
    return F.pmod(total.cast("decimal(38,0)"), F.lit(MODULUS).cast("decimal(38,0)")).cast("decimal(20,0)")


def set_hash(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, h1, h2): the 128-bit hash of the multiset of a key's values, null values left out.

    Two sums modulo 2 to the 64th of independent halves of a digest: whatever the order and the split, the sums are the same, so rows combine
    before the shuffle and no list of values is built.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(half(F.col(value), 1)).alias("h1"), F.sum(half(F.col(value), 17)).alias("h2")
    )
    return g.withColumns({"h1": modulo(F.col("h1")), "h2": modulo(F.col("h2"))})


def merge_set_hash(stored: DataFrame, added: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set hashes after values were added and removed, from the three hashes alone; keys without a value left are gone."""
    minus = removed.select(*keys, *[(-F.col(c)).alias(c) for c in ("n", "h1", "h2")])
    every = stored.select(*keys, "n", "h1", "h2").unionByName(added.select(*keys, "n", "h1", "h2")).unionByName(minus)
    g = every.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    return g.withColumns({"h1": modulo(F.col("h1")), "h2": modulo(F.col("h2"))}).where("n > 0")


def dictionary(values: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): consecutive numbers from 0 of the distinct values."""
    one = values.where(F.col(value).isNotNull()).select(value).distinct().withColumn("_one", F.lit(1))
    return row_numbers(one, ["_one"], [F.col(value)], name).select(value, (F.col(name) - 1).alias(name))


def bitmaps(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, part, bits): which dictionary numbers occur, in blocks of 32,768 bits."""
    part = F.bitmap_bucket_number(number).alias("part")
    return rows.where(F.col(number).isNotNull()).groupBy(*keys, part).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def distinct_counts(partials: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): exact distinct numbers of any union of bitmaps, such as the hours of a window."""
    merged = partials.groupBy(*keys, "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.groupBy(*keys).agg(F.sum("n").alias(name))
