"""Derived views over the given tables and the query/oracle registry.

Each view has one SQL text that both engines accept; Spark runs it as a plan
over the parquet scan, the oracle prepends it as a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import spread

AS_OF = "2024-01-30 00:00:00"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TEXTS = ("documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "v_posts": """
        SELECT event_id AS id, event_type AS source, 'ch' || CAST(user_id % 12 AS STRING) AS channel,
               'author' || CAST(event_id % 90 AS STRING) AS author, CAST(floor(value) AS INT) AS score,
               CAST(event_id * 7 % 200 AS INT) AS upvotes, CAST(event_id * 3 % 50 AS INT) AS num_comments,
               CAST(event_id % 4 AS INT) AS num_awards, 
               'post ' || CAST(event_id AS STRING) || ' by author' || CAST(event_id % 90 AS STRING) AS title,
               props AS body, CAST(ts AS TIMESTAMP) AS posted_at FROM events""",
    # one to three coins per post, 40 coins
    "v_mentions": """
        SELECT e.event_id AS post_id, 'C' || CAST((e.user_id + 7 * t.j) % 40 AS STRING) AS coin_symbol,
               CAST(1 + (e.event_id + t.j) % 3 AS INT) AS mention_count, CAST(e.ts AS TIMESTAMP) AS created_at
        FROM events e JOIN (VALUES (0),(1),(2)) AS t(j) ON t.j <= e.event_id % 3""",
    # posts of one type have no sentiment yet, so anti joins have work
    "v_sentiments": """
        SELECT event_id AS post_id, ((event_id * 37) % 201 - 100) / 100.0E0 AS sentiment_score,
               ((event_id * 13) % 101) / 100.0E0 AS fomo_score, ((event_id * 29) % 101) / 100.0E0 AS fud_score,
               ((event_id * 11) % 101) / 100.0E0 AS confidence,
               CASE WHEN (event_id * 37) % 201 > 120 THEN 'bullish' WHEN (event_id * 37) % 201 < 80 THEN 'bearish'
                    ELSE 'neutral' END AS sentiment_label, CAST(ts AS TIMESTAMP) AS created_at
        FROM events WHERE event_type <> 'error'""",
    "v_phrases": """
        SELECT e.event_id AS post_id, t.j AS pos, CASE (e.event_id + 5 * t.j) % 12
                 WHEN 0 THEN 'Binance listing' WHEN 1 THEN 'rug pull' WHEN 2 THEN 'whale buy' WHEN 3 THEN 'whale dump'
                 WHEN 4 THEN 'ETF approved' WHEN 5 THEN 'SEC lawsuit' WHEN 6 THEN 'Partnership' WHEN 7 THEN 'airdrop'
                 WHEN 8 THEN 'to the moon' WHEN 9 THEN 'mainnet upgrade' WHEN 10 THEN 'chart looks weak'
                 ELSE 'hold' END AS phrase
        FROM events e JOIN (VALUES (0),(1)) AS t(j) ON t.j <= e.event_id % 2 WHERE e.event_type <> 'error'""",
    "v_prices": """
        SELECT event_id AS id, 'C' || CAST(user_id % 40 AS STRING) AS coin_symbol, 1.0E0 + value AS price_usd,
               value * 1.0E6 AS market_cap, CAST(ts AS TIMESTAMP) AS fetched_at FROM events WHERE event_type = 'purchase'""",
    "v_coins": """
        SELECT DISTINCT coin_symbol AS symbol, 'Coin ' || substring(coin_symbol, 2) AS name,
               CAST(1 + CAST(substring(coin_symbol, 2) AS INT) * 5 AS INT) AS market_cap_rank FROM v_mentions""",
    "v_articles": """
        SELECT doc_id AS id, 'feed' || CAST(doc_id % 9 AS STRING) AS source_name,
               'https://' || source || '.example.com/' || lang || '/a/' || CAST(doc_id AS STRING) AS source_url,
               regexp_extract(text, '^[^\\n.!?]*', 0) AS title, text AS content, source AS category, lang,
               'a' || CAST(doc_id % 30 AS STRING) AS author, n_chars, 'u' || CAST(doc_id % 3 AS STRING) AS user_id,
               CASE WHEN n_chars >= 300 THEN true ELSE false END AS is_active,
               CASE WHEN n_chars >= 2500 THEN NULL ELSE 'summary ' || CAST(n_chars AS STRING) END AS summary,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * doc_id AS crawled_at FROM documents""",
    "v_trades": """
        SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'monkey' ELSE 'robot' END AS player,
               'C' || CAST(o_custkey % 40 AS STRING) AS coin_symbol,
               CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS action,
               CAST(1 + o_orderkey % 18 AS DOUBLE) AS trade_size,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN ((o_orderkey * 31) % 201 - 100) / 10.0E0 END AS pnl,
               CAST(o_orderdate AS TIMESTAMP) AS traded_at, CAST(o_orderdate AS DATE) AS trade_date FROM orders""",
    "v_positions": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'monkey' ELSE 'robot' END AS player,
               'C' || CAST(c_nationkey * 2 % 45 AS STRING) AS coin_symbol, CAST(1 + c_custkey * 13 % 300 AS DOUBLE) AS entry_price,
               CAST(5 + c_custkey % 14 AS DOUBLE) AS initial_size,
               (5 + c_custkey % 14) * (1 + c_custkey % 3) / 3.0E0 AS remaining_size,
               CAST(c_custkey % 3 AS INT) AS take_profit_stage,
               CAST(1 + c_custkey * 13 % 300 AS DOUBLE) * (1.0E0 + c_custkey % 5 / 10.0E0) AS peak_price,
               (c_custkey % 11 - 5) / 10.0E0 AS entry_sentiment,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'closed' ELSE 'open' END AS status FROM customer""",
    "v_sources": """
        SELECT s_suppkey AS id, s_name AS name, CAST(1 + s_suppkey % 3 AS INT) AS priority,
               CASE WHEN s_acctbal > 0 THEN true ELSE false END AS is_active,
               CASE s_nationkey % 4 WHEN 0 THEN 'RSS' WHEN 1 THEN 'STATIC' WHEN 2 THEN 'SPA' ELSE 'SITEMAP' END AS crawler_type,
               'https://site' || CAST(s_suppkey AS STRING) || '.example.com' AS base_url,
               '{"category": "cat' || CAST(s_nationkey % 5 AS STRING) || '"}' AS config FROM supplier""",
    "v_crawl_logs": """
        SELECT event_id AS id, 1 + user_id % 100 AS source_id, CAST(ts AS TIMESTAMP) AS started_at,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
               CAST(event_id % 6 AS INT) AS articles_found, CAST(event_id % 4 AS INT) AS articles_new FROM events""",
    # past signals of four windows and two types, one snapshot every 12 hours
    "v_signals": """
        SELECT coin_symbol, time_window, signal_type, computed_at, mention_count, weighted_score, avg_sentiment,
               mention_velocity,
               CASE WHEN weighted_score >= 80 THEN 'extremely_hot' WHEN weighted_score >= 60 THEN 'hot'
                    WHEN weighted_score >= 40 THEN 'warm' WHEN weighted_score >= 20 THEN 'cool' ELSE 'cold' END AS signal_label,
               CASE WHEN avg_sentiment > 0.3 THEN 'potential_reversal' END AS contrarian_warning, event_modifier
        FROM (SELECT 'C' || CAST(user_id % 40 AS STRING) AS coin_symbol,
                     CASE event_id % 4 WHEN 0 THEN '1h' WHEN 1 THEN '6h' WHEN 2 THEN '24h' ELSE '7d' END AS time_window,
                     CASE WHEN event_type IN ('click', 'view') THEN 'fomo' ELSE 'fud' END AS signal_type,
                     date_trunc('day', CAST(ts AS TIMESTAMP)) AS computed_at,
                     CAST(sum(1 + event_id % 6) AS BIGINT) AS mention_count,
                     CAST(least(100, max(floor(value))) AS DOUBLE) AS weighted_score,
                     (max(event_id * 37 % 201) - 100) / 200.0E0 AS avg_sentiment,
                     (max(event_id * 17 % 301) - 100) / 100.0E0 AS mention_velocity,
                     CAST(max(event_id % 31) - 15 AS DOUBLE) AS event_modifier
              FROM events GROUP BY 1, 2, 3, 4) s""",
    "v_pairs": """
        SELECT a.coin_symbol AS src, b.coin_symbol AS tgt, CAST(count(*) AS BIGINT) AS weight FROM
               (SELECT DISTINCT post_id, coin_symbol FROM v_mentions) a
               JOIN (SELECT DISTINCT post_id, coin_symbol FROM v_mentions) b
               ON a.post_id = b.post_id AND a.coin_symbol < b.coin_symbol
        GROUP BY a.coin_symbol, b.coin_symbol HAVING count(*) >= 3""",
    # coins in one or two narratives
    "v_members": """
        SELECT symbol, 'N' || CAST(market_cap_rank % 7 AS STRING) AS narrative FROM v_coins
        UNION SELECT symbol, 'N' || CAST(market_cap_rank % 4 AS STRING) AS narrative FROM v_coins""",
    # strongest bullish endorsement of a coin by an author
    "v_recommends": """
        SELECT p.author, m.coin_symbol, max(p.score / 100.0E0) AS weight, max(s.confidence) AS confidence
        FROM v_posts p JOIN v_sentiments s ON s.post_id = p.id JOIN v_mentions m ON m.post_id = p.id
        WHERE s.sentiment_label = 'bullish' AND s.confidence > 0.7 AND p.score >= 100 GROUP BY p.author, m.coin_symbol""",
    "v_impacts": """
        SELECT k.phrase AS event_name, m.coin_symbol,
               CASE WHEN max(s.sentiment_score) > 0.99 THEN 'positive' WHEN min(s.sentiment_score) < -0.99 THEN 'negative'
                    ELSE 'neutral' END AS impact
        FROM v_phrases k JOIN v_mentions m ON m.post_id = k.post_id JOIN v_sentiments s ON s.post_id = k.post_id
        GROUP BY k.phrase, m.coin_symbol""",
    "v_backtest": """
        SELECT event_id AS id, 'C' || CAST(user_id % 40 AS STRING) AS coin_symbol,
               CASE event_id % 5 WHEN 0 THEN 'extremely_hot' WHEN 1 THEN 'hot' WHEN 2 THEN 'warm' WHEN 3 THEN 'cool'
                    ELSE 'cold' END AS signal_label,
               CASE WHEN user_id % 2 = 0 THEN 'fomo' ELSE 'fud' END AS signal_type,
               CASE event_id % 3 WHEN 0 THEN '1h' WHEN 1 THEN '6h' ELSE '24h' END AS lookup_window,
               value AS weighted_score, CAST(ts AS TIMESTAMP) AS signal_at,
               CASE WHEN event_type <> 'error' THEN ((event_id * 41) % 2001 - 1000) / 100.0E0 END AS price_change_pct,
               CASE WHEN event_type <> 'error' THEN (event_id * 41) % 2001 > 1000 END AS hit,
               CASE WHEN event_type <> 'error' THEN CAST(ts AS TIMESTAMP) END AS evaluated_at FROM events""",
}


class Tables:
    """Lazily built frames of one data folder: ``t.events`` is a table, ``t.v_posts`` a view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._seen:
            return self._seen[name]
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            df = spread(df) if name in TEXTS else df
        elif name == "events_spread":
            df = spread(self.events)
        elif name == "v_mentions":
            j = F.explode(F.sequence(F.lit(0), F.col("event_id") % 3))
            df = self.events.select("event_id", "user_id", "ts", j.alias("j")).select(
                F.col("event_id").alias("post_id"),
                F.concat(F.lit("C"), ((F.col("user_id") + 7 * F.col("j")) % 40).cast("string")).alias("coin_symbol"),
                (1 + (F.col("event_id") + F.col("j")) % 3).cast("int").alias("mention_count"),
                F.col("ts").cast("timestamp").alias("created_at"),
            )
        elif name == "v_phrases":
            j = F.explode(F.sequence(F.lit(0), F.col("event_id") % 2))
            base = self.events.where("event_type <> 'error'").select("event_id", j.alias("j"))
            names = F.array(*[F.lit(x) for x in PHRASES])
            pick = F.element_at(names, ((F.col("event_id") + 5 * F.col("j")) % 12 + 1).cast("int"))
            df = base.select(F.col("event_id").alias("post_id"), F.col("j").cast("int").alias("pos"), pick.alias("phrase"))
        elif name in VIEWS:
            text = VIEWS[name].replace("{", "{{").replace("}", "}}")
            used = [x for x in [*TABLES, *VIEWS] if x != name and re.search(rf"\b(FROM|JOIN)\s+{x}\b", text)]
            df = self.spark.sql(
                re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", text).replace("\\n", "\\\\n"),
                **{x: getattr(self, x) for x in used},
            )
        else:
            raise AttributeError(name)
        self._seen[name] = df
        return df


PHRASES = [
    "Binance listing", "rug pull", "whale buy", "whale dump", "ETF approved", "SEC lawsuit", "Partnership", "airdrop",
    "to the moon", "mainnet upgrade", "chart looks weak", "hold",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prepend the views a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return deco
