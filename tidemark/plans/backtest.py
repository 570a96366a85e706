"""Backtest of past signals against later prices, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.keyed import asof_first_ticks, asof_nearest, null_safe_join
from tidemark.semantics import WINDOW_SECONDS, at, exact, js_round, ratio

TOLERANCE_SECONDS = 12 * 3600
SIGNAL_KEY = ["coin_symbol", "time_window", "signal_type", "computed_at"]
RESULT_KEY = ["coin_symbol", "time_window", "signal_type", "signal_at", "lookup_window"]


def shift(ts, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(F.col(ts)) + seconds.cast("long") * 1_000_000)


def lookup_dim(lookups: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(w).alias("lookup_window"), F.lit(WINDOW_SECONDS[w]).alias("_after")) for w in lookups
    ])


def run_backtest(
    signals: DataFrame, prices: DataFrame, coins: DataFrame, as_of, existing: DataFrame | None = None,
    lookups: Sequence[str] = tuple(WINDOW_SECONDS), days: int = 7, limit5: bool = False,
) -> DataFrame:
    """One row per recent signal and lookup window that is not recorded yet.

    The signal time and its four lookup times go through one as-of pass, so
    prices are sorted once.  ``limit5`` looks only at the first five ticks of
    the tolerance range.
    """
    lo = F.timestamp_micros(F.unix_micros(at(as_of)) - days * 86_400_000_000)
    active = coins.select(F.upper("symbol").alias("_sym")).distinct()
    sig = signals.where((F.col("computed_at") >= lo) & (F.col("computed_at") <= at(as_of)))
    sig = sig.join(active, F.upper("coin_symbol") == F.col("_sym"), "left_semi")
    offsets = F.array(F.lit(0), *[F.lit(WINDOW_SECONDS[w]) for w in lookups])
    probes = sig.select(*SIGNAL_KEY, "signal_label", "weighted_score", F.explode(offsets).alias("_off"))
    probes = probes.withColumn("_target", shift("computed_at", F.col("_off"))).where(F.col("_target") <= at(as_of))
    nearest = asof_first_ticks if limit5 else asof_nearest
    priced = nearest(probes, prices, "coin_symbol", "_target", "fetched_at", "price_usd", TOLERANCE_SECONDS, out="_price")
    wide = priced.groupBy(*SIGNAL_KEY, "signal_label", "weighted_score").agg(
        F.max(F.when(F.col("_off") == 0, F.col("_price"))).alias("price_at_signal"),
        F.map_from_entries(F.collect_list(F.struct("_off", "_price"))).alias("_after_prices"),
    ).where(F.col("price_at_signal").isNotNull())
    rows = wide.select(
        *SIGNAL_KEY[:3], F.col("computed_at").alias("signal_at"), "signal_label", "weighted_score", "price_at_signal",
        "_after_prices", F.explode(lookup_dim(lookups)).alias("_l"),
    ).select("*", "_l.lookup_window", F.element_at("_after_prices", F.col("_l._after")).alias("price_after")).drop("_l", "_after_prices")
    if existing is not None:
        rows = rows.join(existing.select(*RESULT_KEY).distinct(), RESULT_KEY, "left_anti")
    return evaluate(rows, as_of)


def evaluate(rows: DataFrame, as_of) -> DataFrame:
    """Adds change, hit and evaluation time where a later price is known."""
    pct = F.when(F.col("price_at_signal") > 0, S.pct_change("price_at_signal", "price_after"))
    return rows.withColumn("price_change_pct", pct).withColumns({
        "hit": F.when(F.col("price_change_pct").isNotNull(), S.evaluate_hit("signal_label", "price_change_pct", "signal_type")),
        "evaluated_at": F.when(F.col("price_change_pct").isNotNull(), at(as_of)),
    })


def evaluate_pending(results: DataFrame, prices: DataFrame, coins: DataFrame, as_of) -> DataFrame:
    """Rows whose lookup time has passed and whose price is known by now, evaluated."""
    secs = F.create_map(*[x for w, s in WINDOW_SECONDS.items() for x in (F.lit(w), F.lit(s))])
    p = results.where(F.col("evaluated_at").isNull()).withColumn("_target", shift("signal_at", secs[F.col("lookup_window")]))
    active = coins.select(F.upper("symbol").alias("_sym")).distinct()
    p = p.where(F.col("_target") <= at(as_of)).join(active, F.upper("coin_symbol") == F.col("_sym"), "left_semi")
    p = p.drop("price_after", "price_change_pct", "hit", "evaluated_at")
    found = asof_nearest(p, prices, "coin_symbol", "_target", "fetched_at", "price_usd", TOLERANCE_SECONDS, "price_after", "_at")
    return evaluate(found.where(F.col("price_after").isNotNull()).drop("_target", "_at"), as_of)


def summary_view(results: DataFrame) -> DataFrame:
    """Filtered aggregates by label, type and lookup window; stored-numeric rounding (half away from zero)."""
    done = F.col("evaluated_at").isNotNull()

    def avg_where(cond: Column) -> Column:
        return F.round(F.avg(F.when(cond, exact("price_change_pct", 6))).cast("double"), 2)

    g = results.groupBy("signal_label", "signal_type", "lookup_window").agg(
        F.count_if(done).alias("total_evaluated"), F.count_if(F.col("hit")).alias("wins"),
        avg_where(done).alias("avg_return_pct"),
        avg_where(done & F.col("signal_label").isin(S.BULLISH)).alias("avg_hot_return_pct"),
        avg_where(done & F.col("signal_label").isin(S.BEARISH)).alias("avg_cold_return_pct"),
    )
    return g.withColumn("win_rate_pct", F.round(ratio("wins", "total_evaluated") * 100, 1))


def evaluated(results: DataFrame, lookup_window: str = "24h", signal_type: str = "fomo", coin: str | None = None) -> DataFrame:
    r = results.where(
        (F.col("lookup_window") == lookup_window) & (F.col("signal_type") == signal_type) & F.col("evaluated_at").isNotNull()
    )
    return r.where(F.col("coin_symbol") == coin.upper()) if coin else r


def rate_1dp(hits, total) -> Column:
    return F.floor(ratio(hits, total) * 1000 + 0.5).cast("double") / 10


def stats_by(rows: DataFrame, key: str) -> DataFrame:
    """total, wins, win rate (1 decimal) and average return (2 decimals) per label or coin."""
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit")).alias("wins"),
        F.sum(F.coalesce(exact("price_change_pct", 6), F.lit(0))).alias("_r"),
    )
    return g.select(key, "total", "wins", rate_1dp("wins", "total").alias("win_rate"), js_round(ratio("_r", "total"), 2).alias("avg_return"))


def daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.date_format("signal_at", "yyyy-MM-dd").alias("date"), "signal_label").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit")).alias("hits")
    )


def daily_pivot(rows: DataFrame) -> DataFrame:
    """date x label: hit rate (null without rows) and count (0 without rows)."""
    p = daily(rows).groupBy("date").pivot("signal_label", S.LABELS).agg(
        F.first(rate_1dp("hits", "total")).alias("rate"), F.first("total").alias("n")
    )
    return p.select(
        "date", *[F.col(f"{x}_rate") for x in S.LABELS], *[F.coalesce(f"{x}_n", F.lit(0)).alias(f"{x}_n") for x in S.LABELS]
    )


def cumulative_hit_rate(rows: DataFrame) -> DataFrame:
    """Running hit rate by day. The window has one row per day, so its single partition stays tiny."""
    d = daily(rows.where(F.col("signal_label").isin(S.LABELS))).groupBy("date").agg(F.sum("total").alias("t"), F.sum("hits").alias("h"))
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({"total": F.sum("t").over(w), "_h": F.sum("h").over(w)}).select(
        "date", F.coalesce(rate_1dp("_h", "total"), F.lit(0.0)).alias("hit_rate"), "total"
    )


def accuracy_lines(results: DataFrame) -> DataFrame:
    """Summary rows ordered by type, then best hit rate."""
    return summary_view(results).orderBy("signal_type", F.col("win_rate_pct").desc_nulls_last(), "signal_label", "lookup_window")


def missing_lookups(signals: DataFrame, existing: DataFrame, lookups: Sequence[str] = tuple(WINDOW_SECONDS)) -> DataFrame:
    """Each signal with the lookup windows it has no result row for."""
    s = signals.select(*SIGNAL_KEY[:3], F.col("computed_at").alias("signal_at"), F.explode(F.array(*[F.lit(w) for w in lookups])).alias("lookup_window"))
    return s.join(existing.select(*RESULT_KEY).distinct(), RESULT_KEY, "left_anti")
