"""Structured Streaming forms of the polled operators.

Every stream can run with ``availableNow`` as a scheduled job or continuously;
writes go through ``foreachBatch`` into batch logs whose folders are
overwritten on replay, so a restarted batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import first_per_key
from tidemark.operators.mentions import extract_mentions, extract_mentions_loose
from tidemark.plans.ingest import changed, newest_items, url_set_hash
from tidemark.plans.reports import hot_alerts
from tidemark.plans.signals import slot, velocity, window_counts
from tidemark.semantics import WINDOW_SECONDS
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.sinks import write_batch
from tidemark.sources.social import chat_posts
from tidemark.sources.tables import last_snapshot, log_rows, read_log, snapshot, upsert_log


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output and checkpoint, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex[:8]}"


def file_stream(spark: SparkSession, folder: str, glob: str, schema, fmt: str = "parquet") -> DataFrame:
    """Files of ``folder`` whose names fit ``glob``, and the files in folders of such a name (a table of many files).

    In braces the name is a pattern of paths, which may be files or folders; a plain path would have to be a folder.
    """
    return spark.readStream.format(fmt).schema(schema).load(f"{folder}/{{{glob}}}")


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process what is there now and stop."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", f"{folder}/out")
    w.start().awaitTermination()


def tumbling(stream: DataFrame, ts: str, keys: list[str], aggs: dict[str, Column], size: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Fixed epoch-aligned windows; rows later than ``delay`` behind the newest event are dropped."""
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return g.select(F.col("window.start").alias("bucket"), F.col("window.end").alias("bucket_end"), *keys, *aggs)


def sliding(
    stream: DataFrame, ts: str, keys: list[str], aggs: dict[str, Column], size: str, slide: str, delay: str = "1 hour"
) -> DataFrame:
    """Trailing windows re-evaluated every ``slide``. State grows with size / slide; for long windows sum hourly partials instead."""
    g = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return g.select(F.col("window.start").alias("bucket"), F.col("window.end").alias("bucket_end"), *keys, *aggs)


def hourly_partials(mentions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(bucket, coin_symbol, n): the only state the four trailing windows and the history need."""
    w = mentions.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 hour"), "coin_symbol")
    return w.agg(F.sum("mention_count").cast("long").alias("n")).select(F.col("window.start").alias("bucket"), "coin_symbol", "n")


def windows_from_partials(partials: DataFrame, as_of, windows=tuple(WINDOW_SECONDS)) -> DataFrame:
    """Batch sums of hourly partials at a tick on the hour: mentions and velocity per (coin, window)."""
    h = partials.select("coin_symbol", slot("bucket", as_of).alias("slot"), "n").where(F.col("slot").between(-2 * 168, -1))
    return window_counts(h, windows).withColumn("mention_velocity", velocity("mentions", "prev_mentions"))


def chat_ingest(messages: DataFrame, coins: DataFrame, folder: str, loose: bool = True, every: int = 20) -> None:
    """Messages to posts and mentions. The posts log decides which batch of mentions is valid for a post.

    After every ``every`` batches both logs get a snapshot: the last posts, and the mentions valid for them.
    """
    extract = extract_mentions_loose if loose else extract_mentions

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, written = batch.sparkSession, F.lit(batch_id).alias("written")
        posts = first_per_key(chat_posts(batch), ["source_id"], [F.col("posted_at").desc(), F.col("title")]).persist()
        write_batch(posts.select("*", written), f"{folder}/posts/rows", batch_id)
        found = extract(posts.select(F.col("source_id").alias("id"), "title", "body"), coins).withColumnRenamed("id", "source_id")
        write_batch(found.select("*", written), f"{folder}/mentions/rows", batch_id)
        posts.unpersist()
        if (batch_id + 1) % every == 0:
            for log, state in zip(("posts", "mentions"), chat_state(spark, folder, batch_id + 1), strict=True):
                if last_snapshot(spark, f"{folder}/{log}") < batch_id:
                    snapshot(state, f"{folder}/{log}", batch_id)

    drain(messages, folder, each)


def chat_state(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts (last write wins) and the mentions found in that write, each with the batch it was ``written`` by."""
    posts = read_log(spark, f"{folder}/posts", ["source_id"], before=before)
    mentions = log_rows(spark, f"{folder}/mentions", before).drop("batch")
    return posts, mentions.join(posts.select("source_id", "written"), ["source_id", "written"], "left_semi")


def read_chat(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Posts and their mentions, from the last snapshots and the batches after them."""
    posts, mentions = chat_state(spark, folder)
    return posts.drop("written"), mentions.drop("written")


def upsert_stream(rows: DataFrame, folder: str, keys: list[str], order: list[Column], every: int = 20) -> None:
    """Idempotent replay: the last row per key of each batch goes to the log, the last batch wins on ``tables.read_log``."""
    drain(rows, folder, lambda b, i: upsert_log(b, i, folder, keys, order, every))


def change_detect(items: DataFrame, folder: str, key: str = "source_name", every: int = 20) -> None:
    """Per batch, keep items only of sources whose link set changed since the last batch.

    The state is a log of hashes with a snapshot after every ``every`` batches, so a batch reads one row a source and a short tail.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = newest_items(batch, key=key).persist()
        state = read_state(spark, f"{folder}/state", batch_id, key)
        write_batch(changed(top, state, key), f"{folder}/items", batch_id)
        upsert_log(url_set_hash(top, key), batch_id, f"{folder}/state", [key], [F.col("url_hash")], every)
        top.unpersist()

    drain(items, folder, each)


def read_state(spark: SparkSession, path: str, before: int, key: str) -> DataFrame:
    """Last hash per source of batches before this one (a replayed batch does not see itself, nor a snapshot that holds it)."""
    if before == 0:
        return spark.createDataFrame([], f"{key} string, url_hash string")
    return read_log(spark, path, [key], before=before).select(key, "url_hash")


def alert_rows(signals: DataFrame, channels: DataFrame, threshold: float = 60, n: int = 3) -> DataFrame:
    """Hot signals fanned out to the alert channels; the at most ``n`` alerts travel as one array value."""
    hot = hot_alerts(signals, threshold, n)
    alerts = hot.agg(F.sort_array(F.collect_list(F.struct("weighted_score", "coin_symbol", "signal_label")), asc=False)).scalar()
    return channels.select("guild_id", "channel_id", F.explode(alerts).alias("a")).select("guild_id", "channel_id", "a.*")


def alert_stream(signals: DataFrame, channels: DataFrame, folder: str) -> None:
    drain(signals, folder, lambda b, i: write_batch(alert_rows(b, channels), f"{folder}/alerts", i))
