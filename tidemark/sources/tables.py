"""Tables laid out by hash bucket of their key, so that a write touches only the buckets of changed keys; compacted batch logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import first_per_key
from tidemark.session import cut_lineage
from tidemark.sources import sinks

BUCKET = "bucket"


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """A new table; ``buckets`` is fixed for its life, choose it so that one bucket is a file or a few."""
    bucketed(df, keys, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def touched_part(spark: SparkSession, path: str, changes: DataFrame) -> tuple[DataFrame, list[int]]:
    """The rows of the buckets that ``changes`` (bucketed) touches, and those buckets: at most as many numbers as the table has buckets."""
    numbers = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
    return spark.read.parquet(path).where(F.col(BUCKET).isin(numbers)).drop(BUCKET), numbers


def rewrite(after: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Replace the buckets that ``after`` has rows of, all others stay as they are; the old files go when the new ones are committed.

    The rows are checkpointed first, since they come from the files that are replaced.
    """
    part = cut_lineage(bucketed(after, keys, buckets).repartition(BUCKET))
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert(spark: SparkSession, path: str, delta: DataFrame, keys: Sequence[str], buckets: int, order: Sequence[Column] | None = None) -> None:
    """``sinks.upsert`` in place: only buckets with a key of ``delta`` are read and written."""
    base, numbers = touched_part(spark, path, bucketed(delta, keys, buckets))
    if numbers:
        rewrite(sinks.upsert(base, delta, keys, order), path, keys, buckets)


def replace_by_key(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int) -> None:
    """``sinks.replace_by_key`` in place, for a table laid out by ``key``."""
    base, numbers = touched_part(spark, path, bucketed(rows, [key], buckets))
    if numbers:
        rewrite(sinks.replace_by_key(base, rows, key), path, [key], buckets)


def update_if(spark: SparkSession, path: str, changes: DataFrame, key: str, condition: Column, buckets: int) -> None:
    """``sinks.update_if`` in place, for a table laid out by ``key``."""
    base, numbers = touched_part(spark, path, bucketed(changes, [key], buckets))
    if numbers:
        rewrite(sinks.update_if(base, changes, key, condition)[0], path, [key], buckets)


# --- batch logs with snapshots ----------------------------------------------------------------


def last_snapshot(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Number of the last batch that a whole snapshot covers, -1 without one: a marker row per snapshot says so.

    With ``before`` only snapshots of earlier batches count, so a replayed batch does not see itself.
    """
    try:
        markers = spark.read.schema("upto int").parquet(f"{path}/markers")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    known = markers if before is None else markers.where(F.col("upto") < before)
    return known.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def log_rows(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest snapshot and the batches after it, with ``batch``: no older file is opened. ``before`` leaves out later batches."""
    upto = last_snapshot(spark, path, before)
    tail = spark.read.parquet(f"{path}/rows").where(F.col("batch") > upto)
    tail = tail if before is None else tail.where(F.col("batch") < before)
    if upto >= 0:
        tail = tail.unionByName(spark.read.parquet(f"{path}/snapshots/{upto}").withColumn("batch", F.lit(upto)))
    return tail


def read_log(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column] = (), before: int | None = None) -> DataFrame:
    """Last row per key of the log in ``path``."""
    return first_per_key(log_rows(spark, path, before), list(keys), [F.col("batch").desc(), *order]).drop("batch")


def snapshot(state: DataFrame, path: str, upto: int) -> None:
    """``state`` as the snapshot of the log after batch ``upto``; the marker comes when it is whole."""
    state.write.mode("overwrite").parquet(f"{path}/snapshots/{upto}")
    state.sparkSession.range(1).select(F.lit(upto).alias("upto")).write.mode("append").parquet(f"{path}/markers")


def compact(spark: SparkSession, path: str, upto: int, keys: Sequence[str], order: Sequence[Column] = ()) -> None:
    """A snapshot of the log up to batch ``upto``, from the one before and the batches since."""
    if last_snapshot(spark, path) < upto:
        snapshot(read_log(spark, path, keys, order, upto + 1), path, upto)


def upsert_log(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: Sequence[Column], every: int = 20) -> None:
    """One micro-batch into the log, with a snapshot after every ``every`` batches; a replayed batch overwrites its own folders."""
    sinks.write_batch(first_per_key(batch, list(keys), list(order)), f"{path}/rows", batch_id)
    if (batch_id + 1) % every == 0:
        compact(batch.sparkSession, path, batch_id, keys, order)
