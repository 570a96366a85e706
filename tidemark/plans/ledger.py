"""Ledger, portfolio valuation and the deterministic exit and entry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.keyed import top_k
from tidemark.plans.signals import latest_price
from tidemark.semantics import exact, js_round, ratio

# Thresholds of the rule table.
START = 100.0
STOP_LOSS, TP1, TP2, TRAILING = 0.10, 0.20, 0.40, 0.15
PARTIAL = 1 / 3
SENTIMENT_DROP, VELOCITY_DEAD = -0.5, 0.05
MIN_SCORE, MIN_MENTIONS, MIN_CONFIDENCE = 30, 3, 55
SIZE_BY_LABEL = {"extremely_hot": 0.18, "hot": 0.12, "warm": 0.08}
ENTRY_WINDOWS = ["24h", "6h", "1h"]
CROSS_WINDOW = 0.5
CASH_FLOOR = 0.20
DUST = 0.01


def cash(trades: DataFrame) -> DataFrame:
    """Cash per player: 100 - buys + sells with their profit, never under zero."""
    size, pnl = exact("trade_size", 8, 28), F.coalesce(exact("pnl", 8, 28), F.lit(0))
    flow = F.when(F.col("action") == "buy", -size).when(F.col("action") == "sell", size + pnl)
    return trades.groupBy("player").agg(
        F.greatest(F.lit(START) + F.coalesce(F.sum(flow).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("cash")
    )


def open_value(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Value and number of open positions per player at the latest price; without a price the size counts as is."""
    p = positions.where("status = 'open'").join(latest_price(prices), "coin_symbol", "left")
    v = F.when(F.coalesce("price_usd", F.lit(0.0)) > 0, F.col("remaining_size") * (F.col("price_usd") / F.col("entry_price"))).otherwise(
        F.col("remaining_size")
    )
    return p.groupBy("player").agg(F.sum(exact(v, 8, 28)).cast("double").alias("open_value"), F.count(F.lit(1)).alias("open_positions"))


def trade_stats(trades: DataFrame) -> DataFrame:
    sell = F.col("action") == "sell"
    g = trades.groupBy("player").agg(F.count_if(sell).alias("total_trades"), F.count_if(sell & (F.col("pnl") > 0)).alias("win_count"))
    return g.withColumn("win_rate", F.coalesce(ratio("win_count", "total_trades") * 100, F.lit(0.0)))


def portfolio(trades: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per player: cash, current value, change and trade statistics."""
    j = cash(trades).join(open_value(positions, prices), "player", "full_outer").join(trade_stats(trades), "player", "left")
    value = F.coalesce("cash", F.lit(START)) + F.coalesce("open_value", F.lit(0.0))
    return j.select(
        "player", js_round(value, 2).alias("current_value"), js_round(value - START, 2).alias("change_pct"),
        js_round(F.coalesce("cash", F.lit(START)), 2).alias("cash"), F.coalesce("open_positions", F.lit(0)).alias("open_positions"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"), F.coalesce("win_count", F.lit(0)).alias("win_count"),
        js_round(F.coalesce("win_rate", F.lit(0.0)), 2).alias("win_rate"),
    )


def daily_snapshot(trades: DataFrame, positions: DataFrame, prices: DataFrame, day: str) -> DataFrame:
    """Upsert row per (date, player)."""
    p = portfolio(trades, positions, prices)
    return p.select(
        F.lit(day).cast("date").alias("snapshot_date"), "player", F.col("current_value").alias("portfolio_value"),
        "total_trades", "win_count", F.col("cash").alias("cash_balance"), "open_positions",
    )


def history_pivot(snapshots: DataFrame, players: tuple[str, ...] = ("monkey", "robot")) -> DataFrame:
    """date x player portfolio value; 100 where a player has no snapshot that day."""
    return (
        snapshots.groupBy("snapshot_date").pivot("player", list(players)).agg(F.max("portfolio_value")).fillna(START, list(players))
    )


def latest_two_signals(signals: DataFrame, window: str = "24h") -> DataFrame:
    """Per coin, from its two latest signals of the window: the fomo one (else the newest) and the fud one."""
    s = signals.where(F.col("time_window") == window)
    two = top_k(s, ["coin_symbol"], [F.col("computed_at").desc(), F.col("signal_type")], 2, "_r")
    item = F.struct("signal_label", "avg_sentiment", "mention_velocity", "contrarian_warning")
    g = two.groupBy("coin_symbol").agg(
        F.max_by(F.when(F.col("signal_type") == "fomo", item), F.when(F.col("signal_type") == "fomo", -F.col("_r"))).alias("_fomo"),
        F.min_by(item, "_r").alias("_newest"),
        F.max_by(F.when(F.col("signal_type") == "fud", F.col("signal_label")), F.when(F.col("signal_type") == "fud", -F.col("_r"))).alias("fud_label"),
    )
    return g.select("coin_symbol", F.coalesce("_fomo", "_newest").alias("lead"), "fud_label")


def exit_decisions(positions: DataFrame, prices: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """First matching exit rule per open position, with the partial or full close it leads to.

    Without ``signals`` only the price rules apply.
    """
    p = positions.where((F.col("status") == "open") & (F.col("remaining_size") > DUST))
    p = p.join(latest_price(prices), "coin_symbol").where("price_usd > 0")
    p = p.withColumns({
        "pnl_pct": (F.col("price_usd") - F.col("entry_price")) / F.col("entry_price"),
        "peak": F.greatest(F.coalesce("peak_price", "entry_price"), "price_usd"),
    })
    stage, pct = F.col("take_profit_stage"), F.col("pnl_pct")
    rule = (
        F.when(pct <= -STOP_LOSS, "stop_loss")
        .when((stage >= 1) & (F.col("price_usd") <= F.col("entry_price")), "stop_loss")
        .when((stage == 0) & (pct >= TP1), "take_profit_1")
        .when((stage == 1) & (pct >= TP2), "take_profit_2")
        .when((stage >= 2) & ((F.col("price_usd") - F.col("peak")) / F.col("peak") <= -TRAILING), "trailing_stop")
    )
    if signals is not None:
        p = p.join(latest_two_signals(signals), "coin_symbol", "left")
        lead = F.col("lead")
        rule = (
            rule.when(lead["signal_label"] == "cold", "signal_reversal")
            .when((lead["contrarian_warning"] == "potential_reversal") & (pct > 0), "contrarian_exit")
            .when(lead["avg_sentiment"] - F.coalesce("entry_sentiment", F.lit(0.0)) <= SENTIMENT_DROP, "sentiment_drop")
            .when(lead["mention_velocity"] < VELOCITY_DEAD, "velocity_dead")
            .when(F.col("fud_label").isin(S.BULLISH), "fud_surge")
        )
    d = p.withColumn("reason", rule).where(F.col("reason").isNotNull())
    return apply_close(d)


def apply_close(d: DataFrame) -> DataFrame:
    """Close size, profit and the position's next state for a decided exit."""
    partial = F.col("reason").isin("take_profit_1", "take_profit_2")
    size = F.when(partial, F.least(F.col("initial_size") * PARTIAL, F.col("remaining_size"))).otherwise(F.col("remaining_size"))
    left = F.col("remaining_size") - size
    closed = left <= DUST
    return d.select(
        "id", "player", "coin_symbol", "reason", "price_usd", "pnl_pct", F.col("peak").alias("peak_price"),
        size.alias("close_size"), (size * F.col("pnl_pct")).alias("pnl"),
        F.when(closed, F.lit(0.0)).otherwise(left).alias("remaining_size"),
        F.when(F.col("reason") == "take_profit_1", 1).when(F.col("reason") == "take_profit_2", 2).otherwise(F.col("take_profit_stage")).alias("take_profit_stage"),
        F.when(closed, "closed").otherwise("open").alias("status"),
    )


def first_nonempty_window(signals: DataFrame, order=tuple(ENTRY_WINDOWS)) -> DataFrame:
    """Rows of the first window in ``order`` that has any row."""
    rank = F.coalesce(*[F.when(F.col("time_window") == w, F.lit(i)) for i, w in enumerate(order)])
    s = signals.withColumn("_w", rank).where(F.col("_w").isNotNull())
    return s.where(F.col("_w") == s.agg(F.min("_w")).scalar()).drop("_w")


def latest_snapshot(signals: DataFrame, by: str = "computed_at") -> DataFrame:
    return signals.where(F.col(by) == signals.agg(F.max(by)).scalar())


def entry_confidence() -> Column:
    def bonus(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        F.lit(50) + bonus(F.col("weighted_score") >= 50, 15) + bonus(F.col("mention_velocity") > 0.5, 15)
        + bonus(F.col("avg_sentiment") > 0.2, 10) + bonus(F.coalesce("fomo_avg", F.lit(0.0)) > 0.3, 10)
        + bonus(F.coalesce("event_modifier", F.lit(0.0)) >= 10, 10)
    )


def entry_candidates(
    signals: DataFrame, prices: DataFrame, coins: DataFrame, positions: DataFrame, cash_balance: float | Column,
    portfolio_value: float | Column, player: str = "robot",
) -> DataFrame:
    """All coins that pass the entry rules, best score first (column ``rank``); the first one is the entry."""
    cash_c = cash_balance if isinstance(cash_balance, Column) else F.lit(float(cash_balance))
    value = portfolio_value if isinstance(portfolio_value, Column) else F.lit(float(portfolio_value))
    fomo = signals.where("signal_type = 'fomo'")
    ok = fomo.where(
        F.col("signal_label").isin(*SIZE_BY_LABEL) & (F.col("weighted_score") >= MIN_SCORE) & (F.col("mention_count") >= MIN_MENTIONS)
    )
    used = first_nonempty_window(latest_per_window(ok))
    long = fomo.where("time_window = '24h'").groupBy("coin_symbol").agg(F.max_by("signal_label", "computed_at").alias("_long"))
    held = positions.where((F.col("player") == player) & (F.col("status") == "open")).select("coin_symbol").distinct()
    c = (
        used.join(latest_price(prices), "coin_symbol")
        .join(coins.select(F.col("symbol").alias("coin_symbol")).distinct(), "coin_symbol", "left_semi")
        .join(held, "coin_symbol", "left_anti")
        .join(long, "coin_symbol", "left")
        .where(F.coalesce("contrarian_warning", F.lit("")) != "potential_reversal")
        .withColumn("confidence", entry_confidence())
        .where(F.col("confidence") >= MIN_CONFIDENCE)
    )
    size = F.coalesce(*[F.when(F.col("signal_label") == k, F.lit(v)) for k, v in SIZE_BY_LABEL.items()], F.lit(0.12))
    pump = (F.col("time_window") != "24h") & F.col("_long").isin(S.BEARISH)
    c = c.withColumn("position_size", value * size * F.when(pump, F.lit(CROSS_WINDOW)).otherwise(F.lit(1.0)))
    c = c.where(cash_c - F.col("position_size") >= value * CASH_FLOOR)
    return c.select(
        "coin_symbol", "time_window", "signal_label", "weighted_score", "confidence", "position_size", "price_usd"
    ).orderBy(F.col("weighted_score").desc(), "coin_symbol")


def latest_per_window(signals: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of each window."""
    last = signals.groupBy("time_window").agg(F.max("computed_at").alias("_at"))
    return signals.join(last, "time_window").where(F.col("computed_at") == F.col("_at")).drop("_at")


def position_view(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Open positions with PnL percent and unrealised PnL at the latest price."""
    p = positions.where("status = 'open'").join(latest_price(prices), "coin_symbol", "left")
    return p.select(
        "id", "player", "coin_symbol", "price_usd",
        js_round(S.pct_change("entry_price", "price_usd"), 4).alias("pnl_pct"),
        js_round(F.col("remaining_size") * (F.col("price_usd") / F.col("entry_price")) - F.col("remaining_size"), 4).alias("unrealised"),
        S.price_text("price_usd").alias("price_text"),
    )
