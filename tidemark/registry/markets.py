"""Backtest, price and ledger queries."""

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.keyed import asof_first_ticks, asof_nearest, running_max, top_k
from tidemark.plans import backtest as B
from tidemark.plans import ledger as L
from tidemark.plans import signals as G
from tidemark.registry.base import AS_OF, query
from tidemark.semantics import js_round

T0 = f"TIMESTAMP '{AS_OF}'"
BT_AS_OF = "2024-01-20 00:00:00"
BT0 = f"TIMESTAMP '{BT_AS_OF}'"
HIT = """CASE WHEN signal_label IN ('extremely_hot','hot') THEN (CASE WHEN signal_type = 'fud' THEN -{p} ELSE {p} END) > 0
              WHEN signal_label IN ('cold','cool') THEN (CASE WHEN signal_type = 'fud' THEN -{p} ELSE {p} END) < 0
              ELSE abs({p}) < 2 END"""


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


NEAREST_SQL = """
  SELECT coin_symbol, t, price, tick_us FROM (
    SELECT q.coin_symbol, q.t, p.price_usd AS price, epoch_us(p.fetched_at) AS tick_us,
           row_number() OVER (PARTITION BY q.coin_symbol, q.t
             ORDER BY abs(epoch_us(p.fetched_at) - epoch_us(q.t)), p.fetched_at, p.price_usd) AS rn
    FROM ({probes}) q JOIN v_prices p ON p.coin_symbol = q.coin_symbol
     AND p.fetched_at BETWEEN q.t - INTERVAL 12 HOUR AND q.t + INTERVAL 12 HOUR) x WHERE rn = 1"""


@query("j13_asof_nearest", f"""
SELECT s.coin_symbol, s.time_window, s.signal_type, epoch_us(s.computed_at) AS signal_us, n.price AS nearest_price, n.tick_us
FROM v_signals s LEFT JOIN ({NEAREST_SQL.format(probes='SELECT DISTINCT coin_symbol, computed_at AS t FROM v_signals')}) n
ON n.coin_symbol = s.coin_symbol AND n.t = s.computed_at""")
def j13(t):
    r = asof_nearest(t.v_signals, t.v_prices, "coin_symbol", "computed_at", "fetched_at", "price_usd", B.TOLERANCE_SECONDS, "nearest_price", "ts")
    return r.select("coin_symbol", "time_window", "signal_type", us("computed_at").alias("signal_us"), "nearest_price", us("ts").alias("tick_us"))


@query("w7_nearest_first_five", """
SELECT DISTINCT coin_symbol, epoch_us(t) AS signal_us, price AS nearest_price FROM (
  SELECT *, row_number() OVER (PARTITION BY coin_symbol, t ORDER BY abs(epoch_us(fetched_at) - epoch_us(t)), fetched_at) AS best FROM (
    SELECT q.coin_symbol, q.t, p.price_usd AS price, p.fetched_at,
           row_number() OVER (PARTITION BY q.coin_symbol, q.t ORDER BY p.fetched_at, p.price_usd) AS rn
    FROM (SELECT DISTINCT coin_symbol, computed_at AS t FROM v_signals) q JOIN v_prices p ON p.coin_symbol = q.coin_symbol
     AND p.fetched_at BETWEEN q.t - INTERVAL 12 HOUR AND q.t + INTERVAL 12 HOUR) x WHERE rn <= 5) y WHERE best = 1""")
def w7(t):
    s = t.v_signals.select("coin_symbol", "computed_at").distinct()
    r = asof_first_ticks(s, t.v_prices, "coin_symbol", "computed_at", "fetched_at", "price_usd", B.TOLERANCE_SECONDS, 5, "nearest_price")
    return r.where("nearest_price IS NOT NULL").select("coin_symbol", us("computed_at").alias("signal_us"), "nearest_price")


LOOK = "(VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168)) AS w(lookup_window, h)"
RECENT = f"SELECT * FROM v_signals WHERE computed_at >= {BT0} - INTERVAL 7 DAY AND computed_at <= {BT0}"
PROBES = f"""SELECT DISTINCT coin_symbol, computed_at + to_hours(h) AS t FROM ({RECENT}) r,
             (VALUES (0), (1), (6), (24), (168)) AS o(h) WHERE computed_at + to_hours(h) <= {BT0}"""


@query("p6_backtest", f"""
WITH near AS MATERIALIZED ({NEAREST_SQL.format(probes=PROBES)}),
x AS (SELECT s.coin_symbol, s.time_window, s.signal_type, s.signal_label, w.lookup_window, epoch_us(s.computed_at) AS signal_us,
        a.price AS price_at_signal, b.price AS price_after, (b.price - a.price) / a.price * 100 AS pct
      FROM ({RECENT}) s JOIN near a ON a.coin_symbol = s.coin_symbol AND a.t = s.computed_at, {LOOK}
      LEFT JOIN near b ON b.coin_symbol = s.coin_symbol AND b.t = s.computed_at + to_hours(w.h))
SELECT coin_symbol, time_window, signal_type, signal_label, lookup_window, signal_us, price_at_signal, price_after,
       floor(pct * 1e6 + 0.5) / 1e6 AS price_change_pct, CASE WHEN pct IS NOT NULL THEN {HIT.format(p='pct')} END AS hit FROM x""")
def p6(t):
    r = B.run_backtest(t.v_signals, t.v_prices, t.v_coins, BT_AS_OF)
    return r.select(
        "coin_symbol", "time_window", "signal_type", "signal_label", "lookup_window", us("signal_at").alias("signal_us"),
        "price_at_signal", "price_after", js_round("price_change_pct", 6).alias("price_change_pct"), "hit",
    )


@query("t9_evaluate_pending", f"""
WITH pend AS (SELECT id, coin_symbol, signal_type, signal_label, signal_at, lookup_window, 1.0E0 + weighted_score AS price_at_signal,
    signal_at + to_hours(CASE lookup_window WHEN '1h' THEN 1 WHEN '6h' THEN 6 ELSE 24 END) AS t
  FROM v_backtest WHERE evaluated_at IS NULL),
near AS MATERIALIZED ({NEAREST_SQL.format(probes=f'SELECT DISTINCT coin_symbol, t FROM pend WHERE t <= {T0}')})
SELECT id, price AS price_after, floor((price - price_at_signal) / price_at_signal * 100 * 1e6 + 0.5) / 1e6 AS price_change_pct,
       {HIT.format(p='((price - price_at_signal) / price_at_signal * 100)')} AS hit
FROM pend p JOIN near n ON n.coin_symbol = p.coin_symbol AND n.t = p.t""")
def t9(t):
    r = t.v_backtest.withColumn("price_at_signal", F.lit(1.0) + F.col("weighted_score"))
    e = B.evaluate_pending(r, t.v_prices, t.v_coins, AS_OF)
    return e.select("id", "price_after", js_round("price_change_pct", 6).alias("price_change_pct"), "hit")


@query("j14_missing_lookups", f"""
SELECT s.coin_symbol, s.time_window, s.signal_type, epoch_us(s.computed_at) AS signal_us, w.lookup_window
FROM v_signals s, {LOOK} WHERE NOT EXISTS (
  SELECT 1 FROM v_backtest b WHERE b.coin_symbol = s.coin_symbol AND b.signal_type = s.signal_type
   AND date_trunc('day', b.signal_at) = s.computed_at AND b.lookup_window = w.lookup_window)""")
def j14(t):
    have = t.v_backtest.select(
        "coin_symbol", "signal_type", F.date_trunc("day", "signal_at").alias("signal_at"), "lookup_window",
        F.explode(F.array(*[F.lit(w) for w in ("1h", "6h", "24h", "7d")])).alias("time_window"),
    )
    r = B.missing_lookups(t.v_signals, have)
    return r.select("coin_symbol", "time_window", "signal_type", us("signal_at").alias("signal_us"), "lookup_window")


@query("a8_backtest_summary", """
SELECT signal_label, signal_type, lookup_window, count(*) FILTER (WHERE evaluated_at IS NOT NULL) AS total_evaluated,
  count(*) FILTER (WHERE hit) AS wins,
  round(count(*) FILTER (WHERE hit) / CAST(nullif(count(*) FILTER (WHERE evaluated_at IS NOT NULL), 0) AS DOUBLE) * 100, 1) AS win_rate_pct,
  round(avg(price_change_pct) FILTER (WHERE evaluated_at IS NOT NULL), 2) AS avg_return_pct,
  round(avg(price_change_pct) FILTER (WHERE signal_label IN ('extremely_hot','hot') AND evaluated_at IS NOT NULL), 2) AS avg_hot_return_pct,
  round(avg(price_change_pct) FILTER (WHERE signal_label IN ('cold','cool') AND evaluated_at IS NOT NULL), 2) AS avg_cold_return_pct
FROM v_backtest GROUP BY 1, 2, 3""")
def a8(t):
    return B.summary_view(t.v_backtest)


@query("l13_accuracy_lines", """
SELECT signal_type, signal_label, lookup_window, count(*) FILTER (WHERE evaluated_at IS NOT NULL) AS total_evaluated,
  count(*) FILTER (WHERE hit) AS wins,
  round(count(*) FILTER (WHERE hit) / CAST(nullif(count(*) FILTER (WHERE evaluated_at IS NOT NULL), 0) AS DOUBLE) * 100, 1) AS win_rate_pct
FROM v_backtest GROUP BY 1, 2, 3 ORDER BY 1, 6 DESC NULLS LAST, 2, 3""")
def l13(t):
    return B.accuracy_lines(t.v_backtest).select("signal_type", "signal_label", "lookup_window", "total_evaluated", "wins", "win_rate_pct")


EVAL = "FROM v_backtest WHERE lookup_window = '24h' AND signal_type = 'fomo' AND evaluated_at IS NOT NULL"


def stat_sql(key):
    return f"""SELECT {key}, count(*) AS total, count(CASE WHEN hit THEN 1 END) AS wins,
      floor(count(CASE WHEN hit THEN 1 END) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 10 AS win_rate,
      floor(CAST(sum(CAST(price_change_pct AS DECIMAL(20,6))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_return {EVAL} GROUP BY 1"""


@query("a9_label_stats", stat_sql("signal_label"))
def a9(t):
    return B.stats_by(B.evaluated(t.v_backtest), "signal_label")


@query("a10_coin_stats", stat_sql("coin_symbol") + " ORDER BY total DESC, coin_symbol")
def a10(t):
    return B.stats_by(B.evaluated(t.v_backtest), "coin_symbol").orderBy(F.col("total").desc(), "coin_symbol")


PIVOT = ",\n".join(
    f"""floor(count(CASE WHEN signal_label = '{x}' AND hit THEN 1 END) / nullif(CAST(count(CASE WHEN signal_label = '{x}' THEN 1 END) AS DOUBLE), 0)
      * 1000 + 0.5) / 10 AS {x}_rate, count(CASE WHEN signal_label = '{x}' THEN 1 END) AS {x}_n""" for x in S.LABELS)


@query("a11_daily_label_pivot", f"SELECT strftime(signal_at, '%Y-%m-%d') AS date, {PIVOT} {EVAL} GROUP BY 1")
def a11(t):
    return B.daily_pivot(B.evaluated(t.v_backtest))


@query("w2_cumulative_hits", f"""
SELECT date, floor(h / CAST(t AS DOUBLE) * 1000 + 0.5) / 10 AS hit_rate, CAST(t AS BIGINT) AS total FROM (
  SELECT date, sum(h) OVER (ORDER BY date) AS h, sum(t) OVER (ORDER BY date) AS t FROM (
    SELECT strftime(signal_at, '%Y-%m-%d') AS date, count(CASE WHEN hit THEN 1 END) AS h, count(*) AS t {EVAL} GROUP BY 1) a) b""")
def w2(t):
    return B.cumulative_hit_rate(B.evaluated(t.v_backtest))


@query("p7_backtest_recent", f"""
SELECT id, coin_symbol, signal_label, weighted_score, price_change_pct, hit, epoch_us(signal_at) AS signal_us
{EVAL} ORDER BY signal_at DESC, id LIMIT 20""")
def p7(t):
    return B.evaluated(t.v_backtest).orderBy(F.col("signal_at").desc(), "id").limit(20).select(
        "id", "coin_symbol", "signal_label", "weighted_score", "price_change_pct", "hit", us("signal_at").alias("signal_us"))


@query("h40_evaluate_hit", f"SELECT id, {HIT.format(p='price_change_pct')} AS hit FROM v_backtest")
def h40(t):
    return t.v_backtest.select("id", S.evaluate_hit("signal_label", "price_change_pct", "signal_type").alias("hit"))


@query("j5_latest_price", """
SELECT c.symbol, c.market_cap_rank, p.price_usd FROM v_coins c LEFT JOIN
 (SELECT coin_symbol, price_usd, row_number() OVER (PARTITION BY coin_symbol ORDER BY fetched_at DESC, id DESC) AS rn FROM v_prices) p
 ON p.coin_symbol = c.symbol AND p.rn = 1""")
def j5(t):
    return t.v_coins.join(G.latest_price(t.v_prices).withColumnRenamed("coin_symbol", "symbol"), "symbol", "left").select(
        "symbol", "market_cap_rank", "price_usd")


@query("w1_latest_row", """
SELECT coin_symbol, id, price_usd, epoch_us(fetched_at) AS fetched_us FROM (
 SELECT *, row_number() OVER (PARTITION BY coin_symbol ORDER BY fetched_at DESC, id) AS rn FROM v_prices) x WHERE rn = 1""")
def w1(t):
    return top_k(t.v_prices, ["coin_symbol"], [F.col("fetched_at").desc(), F.col("id")], 1).select(
        "coin_symbol", "id", "price_usd", us("fetched_at").alias("fetched_us"))


@query("w6_peak_drawdown", """
SELECT id, coin_symbol, peak, floor((price_usd - peak) / peak * 1e6 + 0.5) / 1e6 AS drawdown FROM (
 SELECT id, coin_symbol, price_usd, max(price_usd) OVER (PARTITION BY coin_symbol ORDER BY fetched_at, id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM v_prices) x""")
def w6(t):
    r = running_max(t.v_prices, ["coin_symbol"], [F.col("fetched_at"), F.col("id")], "price_usd", "peak")
    return r.select("id", "coin_symbol", "peak", js_round((F.col("price_usd") - F.col("peak")) / F.col("peak"), 6).alias("drawdown"))


@query("j9_price_with_coin", "SELECT p.id, p.price_usd, c.symbol, c.market_cap_rank FROM v_prices p JOIN v_coins c ON c.symbol = p.coin_symbol")
def j9(t):
    return t.v_prices.join(t.v_coins, F.col("coin_symbol") == F.col("symbol")).select("id", "price_usd", "symbol", "market_cap_rank")


@query("l5_prices_by_cap", """
SELECT coin_symbol, price_usd, market_cap FROM (
 SELECT *, row_number() OVER (PARTITION BY coin_symbol ORDER BY fetched_at DESC, id DESC) AS rn FROM v_prices) x
WHERE rn = 1 ORDER BY market_cap DESC NULLS LAST, coin_symbol LIMIT 200""")
def l5(t):
    r = top_k(t.v_prices, ["coin_symbol"], [F.col("fetched_at").desc(), F.col("id").desc()], 1)
    return r.select("coin_symbol", "price_usd", "market_cap").orderBy(F.col("market_cap").desc_nulls_last(), "coin_symbol").limit(200)


CASH_SQL = """SELECT player, greatest(0.0, 100 + sum(CASE WHEN action = 'buy' THEN -trade_size ELSE trade_size + coalesce(pnl, 0) END)) AS cash
              FROM v_trades GROUP BY 1"""
PRICE_SQL = "SELECT coin_symbol, arg_max(price_usd, fetched_at) AS price_usd FROM v_prices GROUP BY 1"
VALUE_SQL = f"""SELECT player, sum(coalesce(remaining_size * (price_usd / entry_price), remaining_size)) AS open_value, count(*) AS open_positions
  FROM v_positions o LEFT JOIN ({PRICE_SQL}) p USING (coin_symbol) WHERE status = 'open' GROUP BY 1"""


@query("a26_cash_balance", f"SELECT player, floor(cash * 100 + 0.5) / 100 AS cash FROM ({CASH_SQL}) c")
def a26(t):
    return L.cash(t.v_trades).select("player", js_round("cash", 2).alias("cash"))


@query("a27_open_value", f"SELECT player, floor(open_value * 1e4 + 0.5) / 1e4 AS open_value, open_positions FROM ({VALUE_SQL}) v")
def a27(t):
    return L.open_value(t.v_positions, t.v_prices).withColumn("open_value", js_round("open_value", 4))


STATS_SQL = """SELECT player, count(CASE WHEN action = 'sell' THEN 1 END) AS total_trades,
  count(CASE WHEN action = 'sell' AND pnl > 0 THEN 1 END) AS win_count FROM v_trades GROUP BY 1"""


@query("a28_trade_stats", f"SELECT *, win_count / CAST(total_trades AS DOUBLE) * 100 AS win_rate FROM ({STATS_SQL}) s")
def a28(t):
    return L.trade_stats(t.v_trades)


@query("p11_portfolio", f"""
SELECT c.player, floor((cash + open_value) * 100 + 0.5) / 100 AS current_value, floor((cash + open_value - 100) * 100 + 0.5) / 100 AS change_pct,
  floor(cash * 100 + 0.5) / 100 AS cash, open_positions, total_trades, win_count,
  floor(win_count / CAST(total_trades AS DOUBLE) * 100 * 100 + 0.5) / 100 AS win_rate
FROM ({CASH_SQL}) c JOIN ({VALUE_SQL}) v USING (player) JOIN ({STATS_SQL}) s USING (player)""")
def p11(t):
    return L.portfolio(t.v_trades, t.v_positions, t.v_prices)


@query("a29_history_pivot", """
SELECT trade_date AS snapshot_date, coalesce(max(CASE WHEN player = 'monkey' THEN v END), 100.0) AS monkey,
       coalesce(max(CASE WHEN player = 'robot' THEN v END), 100.0) AS robot
FROM (SELECT trade_date, player, sum(trade_size) AS v FROM v_trades GROUP BY 1, 2) x GROUP BY 1""")
def a29(t):
    day = t.v_trades.groupBy(F.col("trade_date").alias("snapshot_date"), "player").agg(F.sum("trade_size").alias("portfolio_value"))
    return L.history_pivot(day)


TWO_SQL = """
  SELECT coin_symbol, coalesce(min(CASE WHEN signal_type = 'fomo' THEN rn END), 1) AS lead_rn,
         arg_min(signal_label, rn) FILTER (WHERE signal_type = 'fud') AS fud_label FROM (
    SELECT *, row_number() OVER (PARTITION BY coin_symbol ORDER BY computed_at DESC, signal_type) AS rn FROM v_signals WHERE time_window = '24h') x
  WHERE rn <= 2 GROUP BY 1"""
LEAD_SQL = f"""SELECT a.coin_symbol, a.fud_label, s.signal_label, s.avg_sentiment, s.mention_velocity, s.contrarian_warning
  FROM ({TWO_SQL}) a JOIN (SELECT *, row_number() OVER (PARTITION BY coin_symbol ORDER BY computed_at DESC, signal_type) AS rn
    FROM v_signals WHERE time_window = '24h') s ON s.coin_symbol = a.coin_symbol AND s.rn = a.lead_rn"""


@query("w9_latest_two", f"SELECT coin_symbol, signal_label, avg_sentiment, mention_velocity, contrarian_warning, fud_label FROM ({LEAD_SQL}) l")
def w9(t):
    return L.latest_two_signals(t.v_signals).select("coin_symbol", "lead.*", "fud_label")


@query("p9_exit_rules", f"""
SELECT id, player, coin_symbol, reason, floor(close_size * 1e6 + 0.5) / 1e6 AS close_size, floor(close_size * pct * 1e6 + 0.5) / 1e6 AS pnl,
  CASE WHEN remaining_size - close_size <= 0.01 THEN 'closed' ELSE 'open' END AS status FROM (
 SELECT *, CASE WHEN reason LIKE 'take%' THEN least(initial_size / 3, remaining_size) ELSE remaining_size END AS close_size FROM (
  SELECT o.*, pct, CASE
    WHEN pct <= -0.1 THEN 'stop_loss' WHEN take_profit_stage >= 1 AND price_usd <= entry_price THEN 'stop_loss'
    WHEN take_profit_stage = 0 AND pct >= 0.2 THEN 'take_profit_1' WHEN take_profit_stage = 1 AND pct >= 0.4 THEN 'take_profit_2'
    WHEN take_profit_stage >= 2 AND (price_usd - greatest(peak_price, price_usd)) / greatest(peak_price, price_usd) <= -0.15 THEN 'trailing_stop'
    WHEN l.signal_label = 'cold' THEN 'signal_reversal' WHEN l.contrarian_warning = 'potential_reversal' AND pct > 0 THEN 'contrarian_exit'
    WHEN l.avg_sentiment - entry_sentiment <= -0.5 THEN 'sentiment_drop' WHEN l.mention_velocity < 0.05 THEN 'velocity_dead'
    WHEN l.fud_label IN ('extremely_hot', 'hot') THEN 'fud_surge' END AS reason
  FROM (SELECT v.*, p.price_usd, (p.price_usd - v.entry_price) / v.entry_price AS pct FROM v_positions v JOIN ({PRICE_SQL}) p USING (coin_symbol)
        WHERE status = 'open' AND remaining_size > 0.01) o LEFT JOIN ({LEAD_SQL}) l ON l.coin_symbol = o.coin_symbol) x WHERE reason IS NOT NULL) y""")
def p9(t):
    return L.exit_decisions(t.v_positions, t.v_prices, t.v_signals).select(
        "id", "player", "coin_symbol", "reason", js_round("close_size", 6).alias("close_size"), js_round("pnl", 6).alias("pnl"), "status")


OK_SIG = """SELECT * FROM v_signals WHERE signal_type = 'fomo' AND signal_label IN ('extremely_hot','hot','warm')
            AND weighted_score >= 30 AND mention_count >= 3"""
FIRST_SQL = f"""
  SELECT a.* FROM ({OK_SIG}) a JOIN (SELECT time_window, max(computed_at) AS m FROM ({OK_SIG}) z GROUP BY 1) b
    ON b.time_window = a.time_window AND b.m = a.computed_at
  WHERE CASE a.time_window WHEN '24h' THEN 0 WHEN '6h' THEN 1 WHEN '1h' THEN 2 END =
    (SELECT min(CASE time_window WHEN '24h' THEN 0 WHEN '6h' THEN 1 WHEN '1h' THEN 2 END) FROM ({OK_SIG}) y)"""


@query("p10_entry_candidates", f"""
SELECT coin_symbol, time_window, signal_label, weighted_score, confidence, floor(position_size * 1e6 + 0.5) / 1e6 AS position_size, price_usd FROM (
 SELECT f.*, p.price_usd, 50 + CASE WHEN weighted_score >= 50 THEN 15 ELSE 0 END + CASE WHEN mention_velocity > 0.5 THEN 15 ELSE 0 END
   + CASE WHEN avg_sentiment > 0.2 THEN 10 ELSE 0 END + CASE WHEN event_modifier >= 10 THEN 10 ELSE 0 END AS confidence,
   1000 * CASE signal_label WHEN 'extremely_hot' THEN 0.18 WHEN 'hot' THEN 0.12 ELSE 0.08 END
     * CASE WHEN time_window <> '24h' AND l.ll IN ('cold','cool') THEN 0.5 ELSE 1.0 END AS position_size
 FROM ({FIRST_SQL}) f JOIN ({PRICE_SQL}) p USING (coin_symbol)
 LEFT JOIN (SELECT coin_symbol, arg_max(signal_label, computed_at) AS ll FROM v_signals WHERE signal_type = 'fomo' AND time_window = '24h' GROUP BY 1) l USING (coin_symbol)
 WHERE coin_symbol IN (SELECT symbol FROM v_coins)
   AND coin_symbol NOT IN (SELECT coin_symbol FROM v_positions WHERE player = 'robot' AND status = 'open' AND coin_symbol IS NOT NULL)
   AND coalesce(contrarian_warning, '') <> 'potential_reversal') x
WHERE confidence >= 55 AND 400 - position_size >= 1000 * 0.2""")
def p10(t):
    s = t.v_signals.withColumn("fomo_avg", F.lit(None).cast("double"))
    return L.entry_candidates(s, t.v_prices, t.v_coins, t.v_positions, 400.0, 1000.0).withColumn("position_size", js_round("position_size", 6))


@query("l11_first_nonempty_window", f"SELECT coin_symbol, time_window, signal_type, epoch_us(computed_at) AS at_us, weighted_score FROM ({FIRST_SQL}) f")
def l11(t):
    ok = t.v_signals.where("signal_type = 'fomo' AND signal_label IN ('extremely_hot','hot','warm') AND weighted_score >= 30 AND mention_count >= 3")
    return L.first_nonempty_window(L.latest_per_window(ok)).select(
        "coin_symbol", "time_window", "signal_type", us("computed_at").alias("at_us"), "weighted_score")


@query("l10_first_candidate", f"""
SELECT coin_symbol, weighted_score FROM ({FIRST_SQL}) f WHERE coin_symbol IN (SELECT coin_symbol FROM v_prices)
ORDER BY weighted_score DESC, coin_symbol LIMIT 1""")
def l10(t):
    ok = t.v_signals.where("signal_type = 'fomo' AND signal_label IN ('extremely_hot','hot','warm') AND weighted_score >= 30 AND mention_count >= 3")
    priced = t.v_prices.select("coin_symbol").distinct()
    return L.first_nonempty_window(L.latest_per_window(ok)).join(priced, "coin_symbol", "left_semi").orderBy(
        F.col("weighted_score").desc(), "coin_symbol").limit(1).select("coin_symbol", "weighted_score")


@query("j22_long_window", """
SELECT s.coin_symbol, s.time_window, epoch_us(s.computed_at) AS at_us, s.signal_type, l.signal_label AS long_label FROM v_signals s
LEFT JOIN v_signals l ON l.coin_symbol = s.coin_symbol AND l.time_window = '24h' AND l.computed_at = s.computed_at AND l.signal_type = s.signal_type
WHERE s.time_window IN ('1h', '6h')""")
def j22(t):
    k = ["coin_symbol", "computed_at", "signal_type"]
    long = t.v_signals.where("time_window = '24h'").select(*k, F.col("signal_label").alias("long_label"))
    return t.v_signals.where("time_window IN ('1h', '6h')").join(long, k, "left").select(
        "coin_symbol", "time_window", us("computed_at").alias("at_us"), "signal_type", "long_label")


@query("j23_open_anti_tradable_semi", """
SELECT DISTINCT coin_symbol FROM v_prices WHERE coin_symbol IN (SELECT symbol FROM v_coins)
AND NOT EXISTS (SELECT 1 FROM v_positions o WHERE o.coin_symbol = v_prices.coin_symbol AND o.status = 'open' AND o.player = 'robot')""")
def j23(t):
    held = t.v_positions.where("status = 'open' AND player = 'robot'").select("coin_symbol").distinct()
    coins = t.v_coins.select(F.col("symbol").alias("coin_symbol"))
    return t.v_prices.select("coin_symbol").distinct().join(coins, "coin_symbol", "left_semi").join(held, "coin_symbol", "left_anti")


@query("h41_position_pnl", f"""
SELECT id, player, coin_symbol, price_usd, floor((price_usd - entry_price) / entry_price * 100 * 1e4 + 0.5) / 1e4 AS pnl_pct,
  floor((remaining_size * (price_usd / entry_price) - remaining_size) * 1e4 + 0.5) / 1e4 AS unrealised,
  CASE WHEN price_usd >= 1 THEN printf('%.2f', price_usd) WHEN price_usd >= 0.01 THEN printf('%.4f', price_usd) ELSE printf('%.6f', price_usd) END AS price_text
FROM v_positions LEFT JOIN ({PRICE_SQL}) p USING (coin_symbol) WHERE status = 'open'""")
def h41(t):
    return L.position_view(t.v_positions, t.v_prices).withColumn(
        "price_text", F.when(F.col("price_usd").isNotNull(), F.col("price_text")))
