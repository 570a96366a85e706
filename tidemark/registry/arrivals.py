"""Operators over data that arrives in steps, keyed writes of every stored table, and rules with no query of their own."""

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators.keyed import first_per_key
from tidemark.plans import graph as K
from tidemark.plans import ingest as I
from tidemark.registry.base import query
from tidemark.registry.feed import ITEM_SQL2, items
from tidemark.registry.intake import EVENT_SCHEMA, us
from tidemark.registry.social import graph
from tidemark.sources import feeds as SF
from tidemark.sources import sinks
from tidemark.sources import social as SO
from tidemark.streaming import streams as ST


def arriving(t, name, df, steps):
    """A stream in which the rows of each step arrive as one file, in order, one file a micro-batch."""
    folder = ST.stream_folder(t.spark, name)
    for step in steps:
        df.where(step).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    s = t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return s, folder


DAY_NO = "CAST(date_part('day', ts) AS INT)"


@query("t6_late_rows", """SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE date_part('day', ts) NOT BETWEEN 11 AND 14
 AND epoch_us(ts) // 86400000000 * 86400000000 + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 43200000000 GROUP BY 1""")
def t6_late(t):
    """Days 11 to 14 arrive after day 20; rows are late by the watermark that the batch before last had set, so all of theirs are dropped."""
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    day = F.dayofmonth("created_at")
    s, folder = arriving(t, "late-rows", e, [day <= 10, day.between(15, 18), day.between(19, 20), day.between(11, 14), day > 20])
    ST.drain(ST.tumbling(s, "created_at", ["user_id"], {"n": F.count(F.lit(1))}, "1 day", "12 hours"), folder)
    return t.spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.sum("n").alias("n"))


@query("t8_change_stream", f"""SELECT 0 AS batch, source_name, least(count(*), 3) AS n FROM ({ITEM_SQL2}) i GROUP BY 2
 UNION ALL SELECT 1, source_name, least(count(*), 3) FROM ({ITEM_SQL2}) i WHERE source_name >= 'feed5' GROUP BY 2""")
def t8_stream(t):
    """Three crawls: all sources are new, then some have other links, then nothing has changed."""
    i = items(t).select("source_name", "link", "pos")
    moved = F.when(F.col("source_name") >= "feed5", F.concat("link", F.lit("?new"))).otherwise(F.col("link"))
    crawls = [i.withColumn("crawl", F.lit(0)), i.withColumns({"link": moved, "crawl": F.lit(1)}), i.withColumns({"link": moved, "crawl": F.lit(2)})]
    every = reduce(lambda a, b: a.unionByName(b), crawls)
    s, folder = arriving(t, "crawls", every, [F.col("crawl") == k for k in range(3)])
    ST.change_detect(s, folder)
    out = t.spark.read.parquet(f"{folder}/items")
    return out.groupBy(F.col("batch").cast("int").alias("batch"), "source_name").agg(F.count(F.lit(1)).alias("n"))


@query("t7_alert_stream", """SELECT CAST(n_nationkey AS VARCHAR) AS guild_id, batch, coin_symbol, weighted_score FROM nation, (
 SELECT *, row_number() OVER (PARTITION BY batch ORDER BY weighted_score DESC, coin_symbol) AS rn FROM (
  SELECT *, least((date_part('day', computed_at) - 1) // 10, 2) AS batch, max(computed_at) OVER (PARTITION BY least((date_part('day', computed_at) - 1) // 10, 2)) AS last
  FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo') a WHERE computed_at = last) b WHERE rn <= 3 AND weighted_score >= 60""")
def t7_stream(t):
    """Signals arrive in three steps of ten days; each step alerts on its newest snapshot."""
    part = F.least(F.floor((F.dayofmonth("computed_at") - 1) / 10), F.lit(2))
    s, folder = arriving(t, "signals", t.v_signals, [part == k for k in range(3)])
    channels = t.nation.select(F.col("n_nationkey").cast("string").alias("guild_id"), F.lit("1").alias("channel_id"))
    ST.alert_stream(s, channels, folder)
    return t.spark.read.parquet(f"{folder}/alerts").select("guild_id", F.col("batch").cast("long").alias("batch"), "coin_symbol", "weighted_score")


# --- keyed writes: the first half of the rows is stored, all rows are written again -----------


def upserted(t, table, rows, order):
    keys = sinks.KEYS[table]
    half = rows.where(F.pmod(F.xxhash64(*keys), F.lit(2)) == 0)
    base = first_per_key(half, keys, [c.asc() for c in order])
    return sinks.upsert(base, rows, keys, [c.desc() for c in order])


@query("s17_upsert_signals", """SELECT coin_symbol, time_window, signal_type, epoch_us(computed_at) AS at_us, weighted_score FROM v_signals""")
def s17_signals(t):
    out = upserted(t, "signals", t.v_signals.unionByName(t.v_signals.withColumn("weighted_score", F.lit(-1.0))), [F.col("weighted_score")])
    return out.select("coin_symbol", "time_window", "signal_type", us("computed_at").alias("at_us"), "weighted_score")


@query("s17_upsert_backtest", """SELECT coin_symbol, time_window, signal_type, epoch_us(signal_at) AS at_us, lookup_window, id FROM (
 SELECT *, 'w' || id % 2 AS time_window, row_number() OVER (PARTITION BY coin_symbol, id % 2, signal_type, signal_at, lookup_window ORDER BY id DESC) AS rn FROM v_backtest) x WHERE rn = 1""")
def s17_backtest(t):
    rows = t.v_backtest.withColumn("time_window", F.concat(F.lit("w"), (F.col("id") % 2).cast("string")))
    out = upserted(t, "backtest", rows, [F.col("id")])
    return out.select("coin_symbol", "time_window", "signal_type", us("signal_at").alias("at_us"), "lookup_window", "id")


@query("s17_upsert_entities", "SELECT 'author' AS entity_type, author AS name, max(id) AS id FROM v_posts GROUP BY 2 UNION ALL SELECT 'channel', channel, max(id) FROM v_posts GROUP BY 2")
def s17_entities(t):
    rows = reduce(lambda a, b: a.unionByName(b), [t.v_posts.select(F.lit(k).alias("entity_type"), F.col(k).alias("name"), "id") for k in ("author", "channel")])
    return upserted(t, "entities", rows, [F.col("id")])


@query("s17_upsert_relations", "SELECT author AS source_id, coin_symbol AS target_id, 'recommends' AS relation_type, max(post_id) AS post_id FROM v_mentions m JOIN v_posts p ON p.id = m.post_id GROUP BY 1, 2")
def s17_relations(t):
    m = t.v_mentions.join(t.v_posts.select(F.col("id").alias("post_id"), "author"), "post_id")
    rows = m.select(F.col("author").alias("source_id"), F.col("coin_symbol").alias("target_id"), F.lit("recommends").alias("relation_type"), "post_id")
    return upserted(t, "relations", rows, [F.col("post_id")])


@query("s17_upsert_portfolio", "SELECT trade_date AS snapshot_date, player, max(id) AS id FROM v_trades GROUP BY 1, 2")
def s17_portfolio(t):
    return upserted(t, "portfolio", t.v_trades.select(F.col("trade_date").alias("snapshot_date"), "player", "id"), [F.col("id")])


@query("s17_upsert_channels", "SELECT 'g' || c_nationkey AS guild_id, max(c_custkey) AS channel_id FROM customer GROUP BY 1")
def s17_channels(t):
    rows = t.customer.select(F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("guild_id"), F.col("c_custkey").alias("channel_id"))
    return upserted(t, "alert_channels", rows, [F.col("channel_id")])


@query("s23_add_categories", """SELECT s_name AS name, 'u1' AS user_id, CAST((SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 3 > 0) + row_number() OVER (ORDER BY s_name) AS INT) AS display_order
 FROM supplier WHERE s_suppkey % 3 <> 1""")
def s23_add(t):
    """User u1 has a third of the names, u2 another; display_order goes on after the highest of all."""
    key = F.col("s_suppkey")
    have = t.supplier.where(key % 3 > 0).select(F.col("s_name").alias("name"), F.concat(F.lit("u"), (key % 3).cast("string")).alias("user_id"), key.cast("int").alias("display_order"))
    names = t.supplier.select(F.concat(F.lit(" "), "s_name").alias("name")).unionByName(t.supplier.select(F.lit("  ").alias("name")))
    return sinks.add_categories(have, names, "u1")


# --- rules --------------------------------------------------------------------------


@query("b12_sentiment_domains", """SELECT post_id, sentiment_score BETWEEN -1 AND 1 AND confidence BETWEEN 0 AND 1 AND fomo_score BETWEEN 0 AND 1 AND fud_score BETWEEN 0 AND 1 AND sentiment_label IN ('bullish', 'bearish', 'neutral') AS valid FROM (
 SELECT post_id, sentiment_score * 1.1E0 AS sentiment_score, confidence + CASE post_id % 11 WHEN 0 THEN 0.5E0 ELSE 0.0E0 END AS confidence, fomo_score, fud_score - CASE post_id % 13 WHEN 0 THEN 0.5E0 ELSE 0.0E0 END AS fud_score,
  CASE post_id % 17 WHEN 0 THEN 'hot' ELSE sentiment_label END AS sentiment_label FROM v_sentiments) x""")
def b12_domains(t):
    def off(k, by):
        return F.when(F.col("post_id") % k == 0, by).otherwise(0.0)

    rows = t.v_sentiments.withColumns({
        "sentiment_score": F.col("sentiment_score") * 1.1, "confidence": F.col("confidence") + off(11, 0.5), "fud_score": F.col("fud_score") - off(13, 0.5),
        "sentiment_label": F.when(F.col("post_id") % 17 == 0, "hot").otherwise(F.col("sentiment_label")),
    })
    good, bad = SF.valid_sentiments(rows)
    return good.select("post_id", F.lit(True).alias("valid")).unionByName(bad.select("post_id", F.lit(False).alias("valid")))


@query("p8_connected_nodes", """WITH top AS (SELECT symbol FROM v_coins ORDER BY market_cap_rank DESC, symbol LIMIT 30), l AS (SELECT src, tgt FROM v_pairs WHERE src IN (SELECT symbol FROM top) AND tgt IN (SELECT symbol FROM top))
 SELECT src AS name FROM l UNION SELECT tgt FROM l""")
def p8_connected(t):
    ents, rels = graph(t)
    e = ents.join(t.v_coins.select("symbol", F.col("market_cap_rank").alias("mention_count")), "symbol").withColumn("name", F.col("symbol"))
    return K.connected_nodes(*K.graph_view(e, rels, t.v_signals)).select("name")


@query("s6_fallback_mentions", """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'X' ELSE 'C' || user_id % 40 END AS coin_symbol, CASE WHEN event_id % 3 = 0 THEN 'Ex' ELSE 'Coin ' || event_type END AS coin_name,
 CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS mention_count, CASE WHEN event_id % 6 = 0 THEN 'seen' ELSE 'CoinGecko Trending #' || (event_id % 15 + 1) END AS context FROM events""")
def s6_fallback(t):
    rank = (F.col("event_id") % 15 + 1).cast("string")
    title = F.concat(F.lit("CoinGecko Trending #"), rank, F.lit(": Coin "), "event_type", F.lit(" (C"), (F.col("user_id") % 40).cast("string"), F.lit(")"))
    posts = t.events.select(F.col("event_id").alias("id"), title.alias("title"), F.concat(F.lit('{"trending_rank":'), rank, F.lit("}")).alias("metadata"))
    found = t.events.where("event_id % 3 = 0").select(
        F.col("event_id").alias("id"), F.lit("X").alias("coin_symbol"), F.lit("Ex").alias("coin_name"), F.lit(2).alias("mention_count"),
        F.when(F.col("event_id") % 6 == 0, "seen").alias("context"))
    return SO.with_fallback_mentions(posts, found)


@query("h29_platforms", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'stibee' WHEN 1 THEN 'substack' WHEN 2 THEN 'mailchimp' ELSE 'generic' END AS platform, CASE page_id % 6 WHEN 3 THEN 'w' || page_id WHEN 4 THEN 'b' || page_id END AS blog,
 CASE page_id % 6 WHEN 5 THEN 'a' || page_id END AS author FROM pages""")
def h29_platforms(t):
    n = F.col("page_id").cast("string")
    url = F.element_at(F.array(
        F.concat(F.lit("https://page.Stibee.com/archives/"), n), F.concat(F.lit("https://x.substack.com/?p="), n), F.concat(F.lit("https://us1.campaign-archive.com/?u="), n),
        F.concat(F.lit("https://blog.naver.com/w"), n, F.lit("/1")), F.concat(F.lit("https://blog.naver.com/PostList.naver?blogId=b"), n), F.concat(F.lit("https://brunch.co.kr/@a"), n, F.lit("/12")),
    ), (F.col("page_id") % 6 + 1).cast("int"))
    p = t.pages.select("page_id", url.alias("u"))
    blog = F.when((F.col("page_id") % 6).isin(3, 4), U.blog_id("u"))
    return p.select("page_id", U.newsletter_platform("u").alias("platform"), blog.alias("blog"), U.author_handle("u").alias("author"))


@query("h29_magazines", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'm' || page_id END AS magazine FROM pages")
def h29_magazines(t):
    n = F.col("page_id").cast("string")
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://brunch.co.kr/magazine/m"), n, F.lit("?x"))).otherwise(F.concat(F.lit("https://brunch.co.kr/@m"), n))
    return t.pages.select("page_id", U.magazine_name(u).alias("magazine"))
