"""Substring search that skips blocks: a table in hash blocks, and for each block a bitmap of the trigrams that its texts hold."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 18  # eight bitmaps of 32,768 bits a block
PIECE = 65_536


def grams(text: Column) -> Column:
    """All runs of three characters of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))


def places(gram: Column) -> Column:
    """1 to BITS, the numbers that the bitmap functions count from."""
    return F.pmod(F.xxhash64(gram), F.lit(BITS)) + 1


def create(df: DataFrame, path: str, key: str, columns: Sequence[str], blocks: int) -> None:
    """Write ``df`` in ``blocks`` blocks by hash of ``key`` with their signatures; null texts have no trigrams.

    Texts are cut into pieces that share two characters, so a very long text is many short rows. Trigrams are made distinct by place before
    they meet, so a block shuffles at most BITS rows a task, whatever its texts weigh.
    """
    spark = df.sparkSession
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    df.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    texts = rows.select("block", F.explode(F.array(*[F.lower(c) for c in columns])).alias("text")).where("char_length(text) >= 3")
    start = F.explode(F.sequence(F.lit(1), F.char_length("text"), F.lit(PIECE)))
    pieces = texts.select("block", "text", start.alias("s")).select("block", F.substring("text", F.col("s"), F.lit(PIECE + 2)).alias("piece"))
    marks = pieces.select("block", F.explode(F.array_distinct(grams(F.col("piece")))).alias("g")).select("block", places(F.col("g")).alias("p")).distinct()
    part = F.bitmap_bucket_number("p").alias("part")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    marks.groupBy("block", part).agg(bits).write.parquet(f"{path}/signatures")


def wanted(spark: SparkSession, needle: str) -> DataFrame:
    """(part, bit) of the trigrams that any match holds; ``%``, ``_`` and ``\\`` end a run, as they may stand for anything."""
    runs = [r for r in re.split(r"[%_\\]", needle) if r]
    one = spark.createDataFrame([(r,) for r in runs], "run string")
    p = one.select(F.explode(grams(F.lower("run"))).alias("g")).select(places(F.col("g")).alias("p")).distinct()
    return p.select(F.bitmap_bucket_number("p").alias("part"), F.bitmap_bit_position("p").alias("bit"))


def matching_blocks(spark: SparkSession, path: str, needle: str) -> list[int] | None:
    """Blocks whose signature holds every trigram of the needle, at most as many as there are blocks; None (all) for a needle without one."""
    w = wanted(spark, needle)
    n = w.count()
    if not n:
        return None
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, CAST(bit % 8 AS INT)) & 1") == 1
    hit = spark.read.parquet(f"{path}/signatures").join(w, "part").withColumn("byte", byte).where(is_set)
    return sorted(r.block for r in hit.groupBy("block").count().where(F.col("count") == n).select("block").collect())


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """Rows of the blocks that can hold the needle; only their folders are opened, and the exact test is the caller's."""
    rows, blocks = spark.read.parquet(f"{path}/rows"), matching_blocks(spark, path, needle)
    return (rows if blocks is None else rows.where(F.col("block").isin(blocks))).drop("block")
