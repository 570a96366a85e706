"""Pending-work queues over posts and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import row_numbers
from tidemark.semantics import ago


def text_length(*cols: str) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.char_length(c), F.lit(0))
    return total


def newest(df: DataFrame, ts: str, limit: int | None) -> DataFrame:
    """The newest ``limit`` rows; all rows, unsorted, without a limit (``chunked`` numbers them in order)."""
    return df if limit is None else df.orderBy(F.col(ts).desc(), "id").limit(limit)


def posts_without_sentiment(posts: DataFrame, sentiments: DataFrame, mentions: DataFrame | None = None, min_chars: int = 30,
                            limit: int | None = None) -> DataFrame:
    """Newest posts that have no sentiment yet; with ``mentions``, only those naming a coin and long enough."""
    p = posts.join(sentiments.select(F.col("post_id").alias("id")), "id", "left_anti")
    if mentions is not None:
        p = p.where(text_length("title", "body") >= min_chars).join(mentions.select(F.col("post_id").alias("id")), "id", "left_semi")
    return newest(p, "posted_at", limit)


def register_queue_function(posts: DataFrame, sentiments: DataFrame, mentions: DataFrame, name: str = "get_posts_without_sentiment", min_chars: int = 30) -> None:
    """The queue as an SQL table function with the number of posts as argument.

    Its body is SQL over temporary views, so the optimizer inlines it into the statement that calls it.  As LIMIT takes no
    argument there, a rank filter does the same; Spark applies it to each partition before rows meet.
    """
    for df, view in ((posts, "posts"), (sentiments, "sentiments"), (mentions, "mentions")):
        df.createOrReplaceTempView(f"{name}_{view}")
    posts.sparkSession.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(max_rows INT)
        RETURNS TABLE (id {posts.schema["id"].dataType.simpleString()}, posted_at TIMESTAMP, place INT)
        RETURN SELECT id, posted_at, place FROM (
          SELECT p.id, p.posted_at, row_number() OVER (ORDER BY p.posted_at DESC, p.id) AS place FROM {name}_posts p
          WHERE char_length(coalesce(p.title, '')) + char_length(coalesce(p.body, '')) >= {min_chars}
            AND NOT EXISTS (SELECT 1 FROM {name}_sentiments s WHERE s.post_id = p.id)
            AND EXISTS (SELECT 1 FROM {name}_mentions m WHERE m.post_id = p.id)) ranked
        WHERE place <= {name}.max_rows""")


def articles_without_summary(articles: DataFrame, limit: int | None = None) -> DataFrame:
    return newest(articles.where(F.col("summary").isNull() & F.col("is_active")), "crawled_at", limit)


def chunked(df: DataFrame, order: list[Column], size: int = 10, by: str | None = None) -> DataFrame:
    """Number the rows in order (per ``by``) and cut them into work chunks of ``size``."""
    keys = [by] if by else []
    n = row_numbers(df.withColumn("_all", F.lit(1)) if not keys else df, keys or ["_all"], order, "seq")
    return n.withColumn("chunk", F.ceil(F.col("seq") / F.lit(float(size))).cast("long")).drop("_all")


def posts_mentioning(posts: DataFrame, mentions: DataFrame, coin: str) -> DataFrame:
    m = mentions.where(F.col("coin_symbol") == coin.upper()).select(F.col("post_id").alias("id"))
    return posts.join(m, "id", "left_semi")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 12) -> DataFrame:
    """One page in a total order, with the exact total and whether more rows follow."""
    lo = (max(1, number) - 1) * size
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(lo).limit(size).withColumn("total", total).withColumn("has_more", F.col("total") > lo + size)


def inactive(configured: DataFrame, posts: DataFrame, key: str, ts: str, as_of, days: float = 7) -> DataFrame:
    """Configured channels without a post in the last ``days``."""
    live = posts.where(F.col(ts) >= ago(as_of, days * 86400)).select(key).distinct()
    return configured.select(key).distinct().join(live, key, "left_anti")


def due(sources: DataFrame, runs: DataFrame, as_of, min_hours: float = 6) -> DataFrame:
    """Sources whose last run is at least ``min_hours`` old, or that never ran."""
    last = runs.groupBy("source_id").agg(F.max("started_at").alias("_last"))
    j = sources.join(last, sources["id"] == last["source_id"], "left")
    return j.where(F.col("_last").isNull() | (F.col("_last") <= ago(as_of, min_hours * 3600))).drop("_last", "source_id")
