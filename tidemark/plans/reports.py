"""Signal lists, alerts and text statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import LABELS
from tidemark.semantics import js_round, ratio


def top_signals(signals: DataFrame, window: str = "24h", kind: str = "fomo", limit: int = 50, latest_only: bool = True) -> DataFrame:
    """Best scores of the newest snapshot of a window and type; ``latest_only=False`` mixes snapshots."""
    s = signals.where((F.col("time_window") == window) & (F.col("signal_type") == kind))
    if latest_only:
        s = s.where(F.col("computed_at") == s.agg(F.max("computed_at")).scalar())
    return s.orderBy(F.col("weighted_score").desc_nulls_last(), "coin_symbol", F.col("computed_at").desc()).limit(limit)


def hot_alerts(signals: DataFrame, threshold: float = 60, n: int = 3, window: str = "24h") -> DataFrame:
    """Of the top three, those at or over the threshold."""
    return top_signals(signals, window, limit=n).where(F.col("weighted_score") >= threshold)


def trending(signals: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    """Fast and strong signals by velocity; when there is none, the first rows in order."""
    fast = signals.where("mention_velocity > 0.5 AND weighted_score >= 50")
    some = fast.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    a = fast.orderBy(F.col("mention_velocity").desc(), *order).limit(n)
    b = signals.where(~some).orderBy(*order).limit(n)
    return a.unionByName(b)


def by_label_order(df: DataFrame, label: str = "signal_label") -> DataFrame:
    rank = F.coalesce(*[F.when(F.col(label) == x, F.lit(i)) for i, x in enumerate(LABELS)], F.lit(len(LABELS)))
    return df.orderBy(rank, label)


def length_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rounded mean and upper median of text lengths; both aggregate map side (the median over a histogram)."""
    n = df.select(key, F.char_length(text).cast("long").alias("_n"))
    return n.groupBy(key).agg(
        js_round(ratio(F.sum("_n"), F.count(F.lit(1)))).alias("mean_chars"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _n DESC)").cast("long").alias("median_chars"),
    )
