"""Queries over posts, mentions, sentiments and the knowledge graph."""

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.keyed import first_per_key, top_k
from tidemark.plans import explain as X
from tidemark.plans import graph as K
from tidemark.plans import queues as Q
from tidemark.plans import signals as G
from tidemark.registry.base import AS_OF, query
from tidemark.registry.signals import BASE_SQL, EXPECTED_EVENTS, FACTS_SQL, T0, WINDOWS, graph, phrased
from tidemark.semantics import exact, js_round, mean, nz

DAY = f"{T0} - INTERVAL 1 DAY"
WEEK = f"{T0} - INTERVAL 7 DAY"


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def facts(t):
    return G.window_facts(G.hourly_facts(t.v_mentions, t.v_posts, phrased(t), AS_OF), WINDOWS)


@query("a2_conditional_means", f"""
SELECT coin_symbol, time_window, fomo_n, fud_n,
  coalesce(floor(CAST(fomo_s AS DOUBLE) / nullif(fomo_n, 0) * 1e4 + 0.5) / 1e4, 0.0) AS fomo_sentiment,
  coalesce(floor(CAST(fud_s AS DOUBLE) / nullif(fud_n, 0) * 1e4 + 0.5) / 1e4, 0.0) AS fud_sentiment,
  coalesce(floor(CAST(fomo_d AS DOUBLE) / nullif(fomo_n, 0) * 1e4 + 0.5) / 1e4, 0.0) AS avg_fomo,
  coalesce(floor(CAST(fud_d AS DOUBLE) / nullif(fud_n, 0) * 1e4 + 0.5) / 1e4, 0.0) AS avg_fud FROM ({FACTS_SQL}) f""")
def a2(t):
    return facts(t).select(
        "coin_symbol", "time_window", F.coalesce("fomo_n", F.lit(0)).alias("fomo_n"), F.coalesce("fud_n", F.lit(0)).alias("fud_n"),
        js_round(mean("fomo_s", "fomo_n"), 4).alias("fomo_sentiment"), js_round(mean("fud_s", "fud_n"), 4).alias("fud_sentiment"),
        js_round(mean("fomo_d", "fomo_n"), 4).alias("avg_fomo"), js_round(mean("fud_d", "fud_n"), 4).alias("avg_fud"))


@query("a3_engagement_sum", f"SELECT coin_symbol, time_window, CAST(eng AS BIGINT) AS eng FROM ({FACTS_SQL}) f")
def a3(t):
    return facts(t).select("coin_symbol", "time_window", "eng")


@query("a4_platform_count", f"SELECT coin_symbol, time_window, CAST(source_count AS INT) AS source_count FROM ({FACTS_SQL}) f")
def a4(t):
    return facts(t).select("coin_symbol", "time_window", "source_count")


@query("a7_sentiment_skew", f"""
SELECT coin_symbol, time_window, CASE WHEN fomo_n >= 5 THEN floor(fomo_bull / CAST(fomo_n AS DOUBLE) * 100 + 0.5) ELSE 50.0 END AS skew,
 CASE WHEN fomo_n >= 5 THEN CASE WHEN fomo_bull / CAST(fomo_n AS DOUBLE) > 0.85 THEN 'potential_reversal'
      WHEN fomo_bull / CAST(fomo_n AS DOUBLE) < 1 - 0.85 THEN 'potential_bounce' END END AS warning FROM ({FACTS_SQL}) f""")
def a7(t):
    n, b = F.coalesce("fomo_n", F.lit(0)), F.coalesce("fomo_bull", F.lit(0))
    return facts(t).select("coin_symbol", "time_window", S.sentiment_skew(n, b).alias("skew"), S.contrarian_warning(n, b).alias("warning"))


@query("h37_event_classes", f"""
SELECT coin_symbol, time_window, {', '.join(f'CAST(ev_{n} AS INT) AS ev_{n}' for n in EXPECTED_EVENTS)},
 CAST(greatest(-30.0, least(25.0, {' + '.join(f'ev_{n} * ({v[0]}.0E0)' for n, v in EXPECTED_EVENTS.items())})) AS DOUBLE) AS event_modifier FROM ({FACTS_SQL}) f""")
def h37(t):
    f = facts(t)
    return f.select("coin_symbol", "time_window", *[f"ev_{n}" for n in S.EVENT_CLASSES],
                    S.event_modifier({n: F.col(f"ev_{n}") == 1 for n in S.EVENT_CLASSES}).alias("event_modifier"))


@query("a12_six_hour_series", f"""
WITH a AS (SELECT m.coin_symbol, epoch_us(m.created_at) // 21600000000 * 21600000000 AS b, sum(m.mention_count) AS mentions,
    floor(CAST(sum(CAST(s.sentiment_score AS DECIMAL(20,3))) AS DOUBLE) / nullif(count(s.sentiment_score), 0) * 1000 + 0.5) / 1000 AS avg_sentiment,
    floor(CAST(sum(CAST(s.fomo_score AS DECIMAL(20,3))) AS DOUBLE) / nullif(count(s.sentiment_score), 0) * 1000 + 0.5) / 1000 AS avg_fomo
  FROM v_mentions m LEFT JOIN v_sentiments s USING (post_id) WHERE m.created_at >= {WEEK} GROUP BY 1, 2),
p AS (SELECT coin_symbol, epoch_us(fetched_at) // 21600000000 * 21600000000 AS b,
    floor(CAST(sum(CAST(price_usd AS DECIMAL(28,8))) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS price_usd FROM v_prices WHERE fetched_at >= {WEEK} GROUP BY 1, 2)
SELECT coalesce(a.coin_symbol, p.coin_symbol) AS coin_symbol, coalesce(a.b, p.b) AS bucket_us, CAST(coalesce(mentions, 0) AS BIGINT) AS mentions,
  avg_sentiment, avg_fomo, price_usd FROM a FULL JOIN p ON a.coin_symbol = p.coin_symbol AND a.b = p.b""")
def a12(t):
    return X.bucket_series(t.v_mentions, t.v_sentiments, t.v_prices, AS_OF).withColumn("bucket_us", us("bucket")).drop("bucket")


@query("j25_timeline_keys", f"""
SELECT coin_symbol, b AS bucket_us, max(m) AS has_mentions, max(p) AS has_price FROM (
 SELECT coin_symbol, epoch_us(created_at) // 21600000000 * 21600000000 AS b, 1 AS m, 0 AS p FROM v_mentions WHERE created_at >= {WEEK}
 UNION ALL SELECT coin_symbol, epoch_us(fetched_at) // 21600000000 * 21600000000, 0, 1 FROM v_prices WHERE fetched_at >= {WEEK}) x GROUP BY 1, 2""")
def j25(t):
    s = X.bucket_series(t.v_mentions, t.v_sentiments, t.v_prices, AS_OF)
    return s.select("coin_symbol", us("bucket").alias("bucket_us"), (F.col("mentions") > 0).cast("int").alias("has_mentions"),
                    F.col("price_usd").isNotNull().cast("int").alias("has_price"))


@query("a13_phrase_counts", "SELECT lower(phrase) AS phrase, count(*) AS n FROM v_phrases GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def a13(t):
    return X.phrase_counts(t.v_phrases, 15)


@query("a13_coin_keywords", """
SELECT lower(trim(phrase)) AS phrase, count(*) AS n FROM v_phrases WHERE post_id IN (SELECT post_id FROM v_mentions WHERE coin_symbol = 'C7')
AND length(trim(phrase)) >= 2 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 40""")
def a13k(t):
    m = t.v_mentions.where("coin_symbol = 'C7'").select("post_id")
    return X.phrase_counts(t.v_phrases.join(m, "post_id", "left_semi"), 40, trim=True)


@query("a14_source_breakdown", """
SELECT source, count(*) AS posts, floor(CAST(sum(coalesce(CAST(s.sentiment_score AS DECIMAL(20,3)), 0)) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS avg_sentiment,
 floor(count(*) / CAST((SELECT count(*) FROM v_posts) AS DOUBLE) * 100 + 0.5) AS share_pct
FROM v_posts p LEFT JOIN v_sentiments s ON s.post_id = p.id GROUP BY 1""")
def a14(t):
    return X.source_breakdown(t.v_posts, t.v_sentiments)


@query("a18_pair_counts", "SELECT src, tgt, weight FROM v_pairs")
def a18(t):
    return K.co_mentions(t.v_mentions)


@query("j16_co_mention_pairs", """
SELECT a.coin_symbol AS src, b.coin_symbol AS tgt, count(*) AS weight FROM (SELECT DISTINCT post_id, coin_symbol FROM v_mentions) a
JOIN (SELECT DISTINCT post_id, coin_symbol FROM v_mentions) b ON a.post_id = b.post_id AND a.coin_symbol < b.coin_symbol GROUP BY 1, 2""")
def j16(t):
    return K.co_mentions(t.v_mentions, 1)


INFL_SQL = f"""SELECT author, count(*) AS n, count(DISTINCT source) AS k FROM v_posts WHERE posted_at >= {WEEK} AND score >= 50
  AND author IS NOT NULL AND author <> '[deleted]' GROUP BY 1 HAVING count(*) >= 3"""


@query("a19_influencers", f"""SELECT author AS name, n AS mention_count, CAST(k AS INT) AS source_count,
 floor(least(1.0, 0.4 + n / 10.0E0 * 0.3 + k * 0.15) * 1e6 + 0.5) / 1e6 AS confidence FROM ({INFL_SQL}) i""")
def a19(t):
    return K.influencer_entities(t.v_posts, AS_OF).select("name", "mention_count", "source_count", js_round("confidence", 6).alias("confidence"))


@query("a20_coin_entities", f"""SELECT symbol, c.name, n AS mention_count, CAST(k AS INT) AS source_count,
 floor(least(1.0, 0.3 + n / 10.0E0 * 0.3 + k * 0.2) * 1e6 + 0.5) / 1e6 AS confidence FROM (
 SELECT m.coin_symbol, CAST(sum(m.mention_count) AS BIGINT) AS n, count(DISTINCT p.source) AS k FROM v_mentions m LEFT JOIN v_posts p ON p.id = m.post_id
 WHERE m.created_at >= {DAY} GROUP BY 1) g JOIN v_coins c ON c.symbol = g.coin_symbol""")
def a20(t):
    return K.coin_entities(t.v_mentions, t.v_posts, AS_OF, t.v_coins).select(
        "symbol", "name", "mention_count", "source_count", js_round("confidence", 6).alias("confidence"))


def outputs(t):
    """Model outputs: narratives for one post type, events for another, coins and key phrases for all."""
    ph = t.v_phrases.groupBy("post_id").agg(F.sort_array(F.collect_list("phrase")).alias("key_phrases"))
    mc = t.v_mentions.groupBy("post_id").agg(F.sort_array(F.collect_set("coin_symbol")).alias("mentioned_coins"))
    p = t.v_posts.select(F.col("id").alias("post_id"), "source")
    name = F.concat(F.lit("Event "), (F.col("post_id") % 15).cast("string"))
    impact = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("")), (F.col("post_id") % 3 + 1).cast("int"))
    ev = F.struct(name.alias("name"), F.array().cast("array<string>").alias("coins"), impact.alias("impact"))
    theme = F.concat(F.lit(" Theme "), (F.col("post_id") % 6).cast("string"))
    return (
        t.v_sentiments.join(p, "post_id").join(ph, "post_id", "left").join(mc, "post_id", "left")
        .withColumn("narratives", F.when(F.col("source") == "purchase", F.array(theme)))
        .withColumn("events", F.when(F.col("source") == "click", F.array(ev)))
    )


FIXED = {"Even": [f"C{i}" for i in range(0, 40, 2)], "Theme 1": ["C1", "C3"], "Lonely": ["C5"]}
FIXED_SQL = "(VALUES " + ", ".join(f"('{n}','{c}')" for n, cs in FIXED.items() for c in cs) + ") AS fx(narrative, coin_symbol)"


def fixed(t):
    rows = [(n, c) for n, cs in FIXED.items() for c in cs]
    return t.spark.createDataFrame(rows, "narrative string, coin_symbol string")


NARR_SQL = f"""
  SELECT narrative, coin_symbol, origin FROM (
   SELECT *, count(*) OVER (PARTITION BY narrative) AS c FROM (
    SELECT DISTINCT 'Theme ' || (o.post_id % 6) AS narrative, m.coin_symbol, 'model' AS origin FROM v_sentiments o JOIN v_posts p ON p.id = o.post_id
     JOIN v_mentions m ON m.post_id = o.post_id WHERE p.source = 'purchase' AND o.created_at >= {DAY}
     AND m.coin_symbol IN (SELECT coin_symbol FROM v_mentions WHERE created_at >= {DAY})
    UNION SELECT fx.narrative, fx.coin_symbol, 'fixed' FROM {FIXED_SQL}
     WHERE coin_symbol IN (SELECT coin_symbol FROM v_mentions WHERE created_at >= {DAY})
     AND narrative NOT IN (SELECT 'Theme ' || (o.post_id % 6) FROM v_sentiments o JOIN v_posts p ON p.id = o.post_id WHERE p.source = 'purchase' AND o.created_at >= {DAY})) x) y
  WHERE c >= 2"""


@query("a21_narrative_coins", NARR_SQL)
def a21(t):
    return K.narrative_coins(outputs(t), t.v_mentions, AS_OF, fixed(t))


@query("u5_model_overrides_fixed", f"SELECT narrative, origin, count(*) AS coins FROM ({NARR_SQL}) n GROUP BY 1, 2")
def u5(t):
    return K.narrative_coins(outputs(t), t.v_mentions, AS_OF, fixed(t)).groupBy("narrative", "origin").agg(F.count(F.lit(1)).alias("coins"))


@query("u4_active_intersect", f"SELECT DISTINCT fx.coin_symbol FROM {FIXED_SQL} JOIN v_mentions m ON m.coin_symbol = fx.coin_symbol WHERE m.created_at >= {DAY}")
def u4(t):
    return fixed(t).select("coin_symbol").intersect(K.active_coins(t.v_mentions, AS_OF))


# phrases that hold an event word, written out
EVENT_PHRASES = "('Binance listing', 'rug pull', 'ETF approved', 'SEC lawsuit', 'Partnership', 'airdrop', 'mainnet upgrade')"
EVENT_ROWS = f"""
   SELECT o.created_at, o.post_id, 0 AS pos, 'Event ' || (o.post_id % 15) AS event_name,
     CASE o.post_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS impact, 'model' AS origin
   FROM v_sentiments o JOIN v_posts p ON p.id = o.post_id WHERE p.source = 'click' AND o.created_at >= {DAY}
   UNION ALL SELECT o.created_at, o.post_id, k.pos, trim(k.phrase), 'neutral', 'keyword' FROM v_sentiments o JOIN v_posts p ON p.id = o.post_id
   JOIN v_phrases k ON k.post_id = o.post_id WHERE p.source <> 'click' AND o.created_at >= {DAY} AND k.phrase IN {EVENT_PHRASES}"""
EVENT_SQL = f"""
  SELECT e.event_name, e.coin_symbol, f.impact, f.origin FROM (SELECT DISTINCT r.event_name, m.coin_symbol FROM ({EVENT_ROWS}) r JOIN v_mentions m USING (post_id)) e
  JOIN (SELECT event_name, impact, origin FROM (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY created_at, post_id, pos) AS rn FROM ({EVENT_ROWS}) q) z
        WHERE rn = 1) f USING (event_name)"""


@query("a22_event_coins", EVENT_SQL)
def a22(t):
    return K.event_coins(outputs(t), AS_OF)


@query("a23_recommend_strength", "SELECT coin_symbol, least(1.0, max(confidence * weight / 10)) AS strength FROM v_recommends GROUP BY 1")
def a23(t):
    ents, rels = graph(t)
    g = G.graph_context(ents, rels)
    return g.where("rec_strength > 0").select("coin_symbol", F.col("rec_strength").alias("strength"))


def trending_posts(t):
    e = t.events.where("event_type = 'signup'")
    return e.select(
        F.lit("coingecko").alias("source"), F.col("ts").cast("timestamp").alias("crawled_at"),
        (F.col("event_id") % 15 + 1).cast("int").alias("trending_rank"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("id-C"), (F.col("user_id") % 40).cast("string"))).alias("coingecko_id"),
        F.concat(F.lit("Trending ("), F.upper(F.translate(F.lpad((F.col("user_id") % 40).cast("string"), 2, "0"), "0123456789", "ABCDEFGHIJ")), F.lit(")")).alias("title"),
    )


TREND_SQL = f"SELECT event_id % 15 + 1 AS r, user_id FROM events WHERE event_type = 'signup' AND ts >= {T0} - INTERVAL 6 HOUR"


@query("a24_trending_rank", f"""
SELECT coin_symbol, CAST(coalesce(min(a), min(b)) AS INT) AS trending_rank FROM (
 SELECT 'C' || (user_id % 40) AS coin_symbol, r AS a, NULL AS b FROM ({TREND_SQL}) x WHERE user_id % 2 = 0
 UNION ALL SELECT translate(lpad(CAST(user_id % 40 AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ'), NULL, r FROM ({TREND_SQL}) y) z GROUP BY 1""")
def a24(t):
    coins = t.v_coins.select("symbol", F.concat(F.lit("id-"), "symbol").alias("coingecko_id"))
    return G.trending_ranks(trending_posts(t), coins, AS_OF)


@query("j24_trending_lookup", f"""
SELECT c.symbol, CAST(min(r) AS INT) AS trending_rank FROM v_coins c LEFT JOIN (SELECT 'C' || (user_id % 40) AS s, r FROM ({TREND_SQL}) x WHERE user_id % 2 = 0) k
ON k.s = c.symbol GROUP BY 1""")
def j24(t):
    coins = t.v_coins.select("symbol", F.concat(F.lit("id-"), "symbol").alias("coingecko_id"))
    r = G.trending_ranks(trending_posts(t), coins, AS_OF).withColumnRenamed("coin_symbol", "symbol")
    return t.v_coins.join(r, "symbol", "left").select("symbol", "trending_rank")


def base(t):
    return G.base_scores(t.v_mentions, t.v_posts, phrased(t), t.v_coins, t.v_prices, AS_OF)


PEER_SQL = f"""
SELECT coin_symbol, time_window, signal_type, floor(CAST(sum(CAST(base_score AS DECIMAL(28,10))) AS DOUBLE) / count(*) * 1e4 + 0.5) / 1e4 AS narrative_avg FROM (
 SELECT DISTINCT m.symbol AS coin_symbol, q.coin_symbol AS peer, q.time_window, q.signal_type, q.base_score FROM v_members m
 JOIN v_members m2 ON m.narrative = m2.narrative AND m.symbol <> m2.symbol JOIN ({BASE_SQL}) q ON q.coin_symbol = m2.symbol WHERE q.base_score > 0) y GROUP BY ALL"""


def peer_avg(t):
    m = t.v_members.select(F.col("symbol").alias("coin_symbol"), "narrative")
    n = G.narrative_average(base(t).select("coin_symbol", "time_window", "signal_type", "base_score"), m)
    return n.where("narrative_avg IS NOT NULL").withColumn("narrative_avg", js_round("narrative_avg", 4))


@query("a25_peer_average", PEER_SQL)
def a25(t):
    return peer_avg(t)


@query("j17_narrative_peers", f"SELECT coin_symbol, count(*) AS peers FROM (SELECT DISTINCT m.symbol AS coin_symbol, m2.symbol AS peer FROM v_members m JOIN v_members m2 ON m.narrative = m2.narrative AND m.symbol <> m2.symbol) x GROUP BY 1")
def j17(t):
    m = t.v_members.select(F.col("symbol").alias("coin_symbol"), "narrative")
    sig = m.groupBy("coin_symbol").agg(F.array_sort(F.collect_set("narrative")).alias("sig"))
    sets = sig.select("sig").distinct().withColumn("narrative", F.explode("sig")).join(m, "narrative").select("sig", "coin_symbol").distinct()
    return sig.join(sets.groupBy("sig").agg((F.count(F.lit(1)) - 1).alias("peers")), "sig").select("coin_symbol", "peers").where("peers > 0")


@query("j18_hot_peers", f"""
SELECT e.coin_symbol, h.time_window, h.signal_type, count(*) AS hot_peers FROM (SELECT src AS coin_symbol, tgt AS peer FROM v_pairs UNION ALL SELECT tgt, src FROM v_pairs) e
JOIN ({BASE_SQL}) h ON h.coin_symbol = e.peer WHERE h.base_score >= 60 GROUP BY ALL""")
def j18(t):
    ents, rels = graph(t)
    hot = base(t).where("base_score >= 60").select(F.col("coin_symbol").alias("peer"), "time_window", "signal_type")
    return G.coin_edges(ents, rels).join(hot, "peer").groupBy("coin_symbol", "time_window", "signal_type").agg(F.count(F.lit(1)).alias("hot_peers"))


@query("w10_top_peer_weights", """
SELECT coin_symbol, string_agg(CAST(weight AS VARCHAR), ',' ORDER BY weight DESC) AS weights FROM (
 SELECT *, row_number() OVER (PARTITION BY coin_symbol ORDER BY weight DESC, peer) AS rn FROM (
  SELECT src AS coin_symbol, tgt AS peer, weight FROM v_pairs UNION ALL SELECT tgt, src, weight FROM v_pairs) e) x WHERE rn <= 3 GROUP BY 1""")
def w10(t):
    e = t.v_pairs.select(F.explode(F.array(
        F.struct(F.col("src").alias("coin_symbol"), F.col("tgt").alias("peer"), "weight"),
        F.struct(F.col("tgt").alias("coin_symbol"), F.col("src").alias("peer"), "weight"))).alias("e")).select("e.*")
    k = top_k(e, ["coin_symbol"], [F.col("weight").desc(), F.col("peer")], 3)
    return k.groupBy("coin_symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list("weight"), asc=False), lambda x: x.cast("string")), ",").alias("weights"))


@query("j1_mention_post", "SELECT m.coin_symbol, count(*) AS mentions, count(p.id) AS with_post, CAST(sum(p.upvotes) AS BIGINT) AS upvotes FROM v_mentions m LEFT JOIN v_posts p ON p.id = m.post_id AND p.score > 50 GROUP BY 1")
def j1(t):
    p = t.v_posts.where("score > 50").select(F.col("id").alias("post_id"), "upvotes")
    return t.v_mentions.join(p, "post_id", "left").groupBy("coin_symbol").agg(
        F.count(F.lit(1)).alias("mentions"), F.count("upvotes").alias("with_post"), F.sum("upvotes").alias("upvotes"))


@query("j2_mention_sentiment", "SELECT coin_symbol, count(*) AS mentions, count(s.sentiment_score) AS scored FROM v_mentions m LEFT JOIN v_sentiments s USING (post_id) GROUP BY 1")
def j2(t):
    return t.v_mentions.join(t.v_sentiments.select("post_id", "sentiment_score"), "post_id", "left").groupBy("coin_symbol").agg(
        F.count(F.lit(1)).alias("mentions"), F.count("sentiment_score").alias("scored"))


@query("j3_previous_window_sentiment", f"""
SELECT coin_symbol, count(*) AS n, floor(CAST(sum(CAST(sentiment_score AS DECIMAL(20,3))) AS DOUBLE) / count(*) * 1e4 + 0.5) / 1e4 AS prev_avg FROM v_mentions m
JOIN v_sentiments s USING (post_id) WHERE m.created_at >= {T0} - INTERVAL 48 HOUR AND m.created_at < {T0} - INTERVAL 24 HOUR GROUP BY 1""")
def j3(t):
    f = G.window_facts(G.hourly_facts(t.v_mentions, t.v_posts, phrased(t), AS_OF), ["24h"]).where("prev_n > 0")
    return f.select("coin_symbol", F.col("prev_n").alias("n"), js_round(mean("prev_s", "prev_n"), 4).alias("prev_avg"))


@query("j4_coin_rank", "SELECT m.coin_symbol, max(c.market_cap_rank) AS market_cap_rank, count(*) AS mentions FROM v_mentions m LEFT JOIN v_coins c ON upper(c.symbol) = m.coin_symbol GROUP BY 1")
def j4(t):
    g = t.v_mentions.groupBy("coin_symbol").agg(F.count(F.lit(1)).alias("mentions"))
    return g.join(t.v_coins.select(F.upper("symbol").alias("coin_symbol"), "market_cap_rank"), "coin_symbol", "left").select("coin_symbol", "market_cap_rank", "mentions")


@query("j6_posts_without_sentiment", "SELECT id, source FROM v_posts WHERE id NOT IN (SELECT post_id FROM v_sentiments) ORDER BY posted_at DESC, id LIMIT 30")
def j6(t):
    return Q.posts_without_sentiment(t.v_posts, t.v_sentiments, limit=30).select("id", "source")


J7_SQL = """SELECT id, title, body, source, posted_at FROM v_posts p WHERE NOT EXISTS (SELECT 1 FROM v_sentiments s WHERE s.post_id = p.id)
 AND EXISTS (SELECT 1 FROM v_mentions m WHERE m.post_id = p.id) AND coalesce(length(title), 0) + coalesce(length(body), 0) >= 30"""


@query("j7_posts_to_score", f"SELECT id, title, body, source FROM ({J7_SQL}) x")
def j7(t):
    return Q.posts_without_sentiment(t.v_posts, t.v_sentiments, t.v_mentions).select("id", "title", "body", "source")


@query("x1_posts_without_sentiment", f"SELECT id, source FROM ({J7_SQL}) x ORDER BY posted_at DESC, id LIMIT 200")
def x1(t):
    return Q.posts_without_sentiment(t.v_posts, t.v_sentiments, t.v_mentions, limit=200).select("id", "source")


@query("p17_sentiment_chunks", f"""SELECT id, source, seq, CAST(ceil(seq / 10.0) AS BIGINT) AS chunk FROM (
 SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY posted_at DESC, id) AS seq FROM ({J7_SQL}) x) y""")
def p17(t):
    q = Q.posts_without_sentiment(t.v_posts, t.v_sentiments, t.v_mentions).select("id", "source", "posted_at")
    return Q.chunked(q, [F.col("posted_at").desc(), F.col("id")], 10, "source").select("id", "source", "seq", "chunk")


@query("p17_summary_queue", "SELECT id, CAST(ceil(row_number() OVER (ORDER BY crawled_at DESC, id) / 10.0) AS BIGINT) AS chunk FROM v_articles WHERE summary IS NULL AND is_active")
def p17s(t):
    return Q.chunked(Q.articles_without_summary(t.v_articles).select("id", "crawled_at"), [F.col("crawled_at").desc(), F.col("id")]).select("id", "chunk")


@query("b19_length_gate", "SELECT id FROM v_posts WHERE coalesce(length(title), 0) + coalesce(length(body), 0) >= 30")
def b19(t):
    return t.v_posts.where(Q.text_length("title", "body") >= 30).select("id")


@query("j8_posts_of_coin", "SELECT id, title FROM v_posts WHERE id IN (SELECT post_id FROM v_mentions WHERE coin_symbol = 'C7') ORDER BY posted_at DESC, id LIMIT 20 OFFSET 20")
def j8(t):
    return Q.posts_mentioning(t.v_posts, t.v_mentions, "c7").orderBy(F.col("posted_at").desc(), "id").offset(20).limit(20).select("id", "title")


ENTS = "(SELECT 'coin:' || symbol AS id, 'coin' AS entity_type, symbol FROM v_coins)"


@query("j11_edge_endpoints", "SELECT 'coin:' || src AS source_id, 'coin:' || tgt AS target_id, a.symbol AS source_symbol, b.symbol AS target_symbol, weight / 25.0E0 AS weight FROM v_pairs p JOIN v_coins a ON a.symbol = p.src JOIN v_coins b ON b.symbol = p.tgt")
def j11(t):
    ents, rels = graph(t)
    return K.with_endpoints(rels, ents.withColumn("name", F.col("symbol"))).select("source_id", "target_id", "source_symbol", "target_symbol", "weight")


NODES = "(SELECT symbol FROM v_coins WHERE market_cap_rank <= 50)"


@query("j12_edges_touching", f"SELECT src, tgt, weight FROM v_pairs WHERE src IN {NODES} OR tgt IN {NODES}")
def j12(t):
    n = t.v_coins.where("market_cap_rank <= 50").select(F.col("symbol").alias("id"))
    r = t.v_pairs.select(F.col("src").alias("source_id"), F.col("tgt").alias("target_id"), "weight")
    return K.touching(r, n).select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), "weight")


@query("j12_induced_subgraph", f"SELECT src, tgt, weight FROM v_pairs WHERE src IN {NODES} AND tgt IN {NODES}")
def j12i(t):
    n = t.v_coins.where("market_cap_rank <= 50").select(F.col("symbol").alias("id"))
    r = t.v_pairs.select(F.col("src").alias("source_id"), F.col("tgt").alias("target_id"), "weight")
    return K.induced(r, n).select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), "weight")


@query("j19_influencer_links", f"""
SELECT p.author, m.coin_symbol, count(*) AS posts, count(CASE WHEN s.sentiment_label = 'bullish' AND s.confidence > 0.7 THEN 1 END) AS bullish
FROM v_posts p JOIN (SELECT DISTINCT post_id, coin_symbol FROM v_mentions) m ON m.post_id = p.id LEFT JOIN v_sentiments s ON s.post_id = p.id
WHERE p.posted_at >= {WEEK} AND p.score >= 100 AND p.author IN (SELECT author FROM ({INFL_SQL}) i) GROUP BY 1, 2""")
def j19(t):
    r = K.influencer_posts(t.v_posts, t.v_mentions, t.v_sentiments, K.influencer_entities(t.v_posts, AS_OF), AS_OF)
    return r.groupBy("author", "coin_symbol").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if((F.col("sentiment_label") == "bullish") & (F.col("confidence") > 0.7)).alias("bullish"))


@query("j26_inactive_channels", f"""SELECT DISTINCT channel || '-' || author AS channel FROM v_posts WHERE channel || '-' || author NOT IN
 (SELECT channel || '-' || author FROM v_posts WHERE posted_at >= {WEEK})""")
def j26(t):
    p = t.v_posts.select(F.concat_ws("-", "channel", "author").alias("channel"), "posted_at")
    return Q.inactive(p.select("channel"), p, "channel", "posted_at", AS_OF)


def kg(t):
    return K.refresh(t.v_mentions, t.v_posts, t.v_sentiments, outputs(t), fixed(t), AS_OF, t.v_coins)


@query("p4_graph_entities", f"""
SELECT entity_type, name, mention_count FROM (
 SELECT 'coin' AS entity_type, c.name, CAST(sum(m.mention_count) AS BIGINT) AS mention_count FROM v_mentions m JOIN v_coins c ON c.symbol = m.coin_symbol WHERE m.created_at >= {DAY} GROUP BY 2
 UNION ALL SELECT 'influencer', author, n FROM ({INFL_SQL}) i
 UNION ALL SELECT 'narrative', narrative, count(*) FROM ({NARR_SQL}) n GROUP BY 2
 UNION ALL SELECT 'event', event_name, count(*) FROM ({EVENT_SQL}) e GROUP BY 2) x""")
def p4e(t):
    return kg(t)[0].select("entity_type", "name", "mention_count")


ACT = f"(SELECT DISTINCT coin_symbol FROM v_mentions WHERE created_at >= {DAY})"


@query("p4_graph_relations", f"""
SELECT relation_type, count(*) AS edges, floor(sum(weight) * 1e4 + 0.5) / 1e4 AS total_weight FROM (
 SELECT 'correlates_with' AS relation_type, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT DISTINCT post_id, coin_symbol FROM v_mentions WHERE created_at >= {DAY}) a
  JOIN (SELECT DISTINCT post_id, coin_symbol FROM v_mentions WHERE created_at >= {DAY}) b ON a.post_id = b.post_id AND a.coin_symbol < b.coin_symbol
  GROUP BY a.coin_symbol, b.coin_symbol HAVING count(*) >= 3
 UNION ALL SELECT 'part_of', 1.0 FROM ({NARR_SQL}) n
 UNION ALL SELECT 'impacts', 1.0 FROM ({EVENT_SQL}) e WHERE coin_symbol IN {ACT}
 UNION ALL SELECT 'mentions', 1.0 FROM (SELECT DISTINCT p.author, m.coin_symbol FROM v_posts p JOIN v_mentions m ON m.post_id = p.id
   WHERE p.posted_at >= {WEEK} AND p.score >= 100 AND p.author IN (SELECT author FROM ({INFL_SQL}) i) AND m.coin_symbol IN {ACT}) q
 UNION ALL SELECT 'recommends', score / 100.0E0 FROM (SELECT p.author, m.coin_symbol, arg_max(p.score, struct_pack(a := p.posted_at, b := p.id)) AS score FROM v_posts p JOIN v_mentions m ON m.post_id = p.id
   JOIN v_sentiments s ON s.post_id = p.id WHERE p.posted_at >= {WEEK} AND p.score >= 100 AND s.sentiment_label = 'bullish' AND s.confidence > 0.7
   AND p.author IN (SELECT author FROM ({INFL_SQL}) i) AND m.coin_symbol IN {ACT} GROUP BY 1, 2) r) x GROUP BY 1""")
def p4r(t):
    return kg(t)[1].groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"), js_round(F.sum("weight"), 4).alias("total_weight"))


@query("p5_relation_decay", f"""SELECT src, tgt, CASE WHEN last_at < {T0} - INTERVAL 3 DAY THEN 0.0 ELSE CAST(weight AS DOUBLE) END AS weight FROM v_pairs p JOIN (
 SELECT coin_symbol, min(created_at) + INTERVAL 1 HOUR * CAST(substr(coin_symbol, 2) AS INT) * 18 AS last_at FROM v_mentions GROUP BY 1) m ON m.coin_symbol = p.src""")
def p5(t):
    m = t.v_mentions.groupBy(F.col("coin_symbol").alias("src")).agg(F.min("created_at").alias("_c")).withColumn(
        "updated_at", F.timestamp_micros(F.unix_micros("_c") + F.substring("src", 2, 9).cast("long") * 18 * 3_600_000_000))
    r = t.v_pairs.withColumn("weight", F.col("weight").cast("double")).join(m, "src")
    return K.decay_relations(r, AS_OF).select("src", "tgt", "weight")


@query("h43_entity_decay", f"""
SELECT name, floor(CASE WHEN d > 7 THEN greatest(0.05, 0.6 * pow(0.85, d - 7)) ELSE 0.6 END * 1000 + 0.5) / 1000 AS confidence,
 CASE WHEN d > 7 THEN greatest(0.05, 0.6 * pow(0.85, d - 7)) < 0.15 ELSE false END AS decayed FROM (
 SELECT lower(phrase) || post_id AS name, (epoch_us({T0}) - epoch_us(s.created_at)) / 86400000000.0 AS d FROM v_phrases JOIN v_sentiments s USING (post_id)) x""")
def h43(t):
    e = t.v_phrases.join(t.v_sentiments, "post_id").select(
        F.concat(F.lower("phrase"), F.col("post_id").cast("string")).alias("name"), F.lit("event").alias("entity_type"),
        F.lit(0.6).alias("confidence"), F.col("created_at").alias("last_seen_at"))
    return K.decay_entities(e, AS_OF).select("name", "confidence", "decayed")


@query("p8_graph_nodes", """
SELECT c.symbol AS name, c.market_cap_rank AS mentions, coalesce(s.weighted_score, 0.0) AS score, coalesce(s.signal_label, 'neutral') AS label FROM (
 SELECT * FROM v_coins ORDER BY market_cap_rank DESC, symbol LIMIT 30) c LEFT JOIN (
 SELECT coin_symbol, arg_max(weighted_score, computed_at) AS weighted_score, arg_max(signal_label, computed_at) AS signal_label FROM v_signals
 WHERE time_window = '24h' AND signal_type = 'fomo' GROUP BY 1) s ON s.coin_symbol = c.symbol""")
def p8n(t):
    ents, rels = graph(t)
    e = ents.join(t.v_coins.select("symbol", F.col("market_cap_rank").alias("mention_count")), "symbol").withColumn("name", F.col("symbol"))
    return K.graph_view(e, rels, t.v_signals)[0].select("name", "mentions", "score", "label")


@query("p8_graph_links", """
WITH top AS (SELECT symbol FROM v_coins ORDER BY market_cap_rank DESC, symbol LIMIT 30)
SELECT src AS source, tgt AS target, weight / 25.0E0 AS weight FROM v_pairs WHERE src IN (SELECT symbol FROM top) AND tgt IN (SELECT symbol FROM top)""")
def p8l(t):
    ents, rels = graph(t)
    e = ents.join(t.v_coins.select("symbol", F.col("market_cap_rank").alias("mention_count")), "symbol").withColumn("name", F.col("symbol"))
    n, links = K.graph_view(e, rels, t.v_signals)
    return links.select(F.substring("source", 6, 99).alias("source"), F.substring("target", 6, 99).alias("target"), "weight")


@query("p8_neighbours", "SELECT tgt AS id FROM v_pairs WHERE src = 'C7' UNION SELECT src FROM v_pairs WHERE tgt = 'C7'")
def p8x(t):
    return K.neighbours(t.v_pairs.select(F.col("src").alias("source"), F.col("tgt").alias("target")), "C7")


@query("a35_scaled_mentions", "SELECT coin_symbol, n / CAST(max(n) OVER () AS DOUBLE) AS scaled FROM (SELECT coin_symbol, sum(mention_count) AS n FROM v_mentions GROUP BY 1) x")
def a35(t):
    g = t.v_mentions.groupBy("coin_symbol").agg(F.sum("mention_count").alias("n"))
    return g.select("coin_symbol", (F.col("n") / g.agg(F.max("n")).scalar().cast("double")).alias("scaled"))


@query("p19_event_timeline", f"""
SELECT event_name AS name, count(*) AS mentions, max(CASE WHEN impact = 'positive' THEN 'positive' WHEN impact = 'negative' THEN 'negative' ELSE 'neutral' END) AS impact,
 string_agg(CASE WHEN coin_symbol IN {ACT} THEN coin_symbol END, ',' ORDER BY coin_symbol) AS coins FROM ({EVENT_SQL}) e GROUP BY 1""")
def p19(t):
    ents, rels = kg(t)
    tl = K.event_timeline(ents, rels, AS_OF, limit=100)
    return tl.select("name", "mentions", "impact", F.array_join("coins", ",").alias("coins"))


@query("j15_event_coin_fallback", f"""
SELECT event_name AS name, string_agg(coin_symbol, ',' ORDER BY coin_symbol) AS coins FROM ({EVENT_SQL}) e GROUP BY 1""")
def j15(t):
    ents, rels = kg(t)
    return K.event_timeline(ents, rels.where("1 = 0"), AS_OF, limit=100).select("name", F.array_join("coins", ",").alias("coins"))


@query("b12_relation_grammar", "SELECT source_type, target_type, relation_type FROM (SELECT DISTINCT 'coin' AS source_type, 'coin' AS target_type, CASE WHEN src < 'C2' THEN 'correlates_with' ELSE 'impacts' END AS relation_type FROM v_pairs) x WHERE relation_type = 'correlates_with'")
def b12(t):
    kind = F.when(F.col("src") < "C2", "correlates_with").otherwise("impacts")
    r = t.v_pairs.select(F.lit("coin").alias("source_type"), F.lit("coin").alias("target_type"), kind.alias("relation_type")).distinct()
    return K.valid_relations(r)[0]


@query("w4_first_five_posts", f"""
SELECT coin_symbol, time_window, string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY score DESC, post_id DESC) AS posts FROM (
 SELECT m.coin_symbol, w.time_window, m.post_id, p.score, row_number() OVER (PARTITION BY m.coin_symbol, w.time_window ORDER BY m.created_at, m.post_id) AS rn
 FROM v_mentions m JOIN v_posts p ON p.id = m.post_id, (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168)) AS w(time_window, h)
 WHERE m.created_at >= {T0} - to_hours(w.h) AND m.created_at <= {T0}) x WHERE rn <= 5 GROUP BY 1, 2""")
def w4(t):
    p = G.first_posts(t.v_mentions, t.v_posts, t.v_sentiments, AS_OF, WINDOWS)
    return p.select("coin_symbol", "time_window", F.array_join(F.transform("top_posts", lambda x: x["source_id"].cast("string")), ",").alias("posts"))


@query("w8_first_wins", "SELECT channel, min(id) AS id FROM v_posts GROUP BY 1")
def w8(t):
    return first_per_key(t.v_posts, ["channel"], [F.col("posted_at"), F.col("id")]).select("channel", "id")


def ex(t, kind="fomo"):
    return X.Explain("C7", "7d", kind, t.v_signals.where("1 = 0"), t.v_mentions, t.v_posts, t.v_sentiments, AS_OF)


CUR7 = f"(SELECT post_id, mention_count FROM v_mentions WHERE coin_symbol = 'C7' AND created_at BETWEEN {WEEK} AND {T0})"


@query("p3_explain_breakdown", f"""
SELECT CAST(mentions AS BIGINT) AS mentions, CAST(prev AS BIGINT) AS prev_mentions, floor(s * 1e6 + 0.5) / 1e6 AS avg_sentiment, floor(eng / CAST(mentions AS DOUBLE) * 1e4 + 0.5) / 1e4 AS eng_pm,
 floor(greatest(0.0, least(100.0, (greatest(0.0, least(100.0, ((mentions - prev) / CAST(prev AS DOUBLE) + 1) * 50)) * 0.25 + (s + 1) * 50 * 0.30 + 50 * 0.15
  + least(100.0, log10(eng / CAST(mentions AS DOUBLE) + 1) * 25) * 0.20 + least(100.0, d * 100) * 0.10) * least(1.0, mentions / 5.0))) * 100 + 0.5) / 100 AS final_score FROM (
 SELECT (SELECT sum(mention_count) FROM {CUR7} c) AS mentions,
  (SELECT sum(mention_count) FROM v_mentions WHERE coin_symbol = 'C7' AND created_at >= {T0} - INTERVAL 14 DAY AND created_at < {WEEK}) AS prev,
  (SELECT CAST(sum(CAST(sentiment_score AS DECIMAL(20,3))) AS DOUBLE) / count(*) FROM v_sentiments WHERE post_id IN (SELECT post_id FROM {CUR7} c)) AS s,
  (SELECT CAST(sum(CAST(fomo_score AS DECIMAL(20,3))) AS DOUBLE) / count(*) FROM v_sentiments WHERE post_id IN (SELECT post_id FROM {CUR7} c)) AS d,
  (SELECT sum(upvotes + 2 * num_comments + 5 * num_awards) FROM v_posts WHERE id IN (SELECT post_id FROM {CUR7} c)) AS eng) x""")
def p3(t):
    return ex(t).breakdown().select("mentions", "prev_mentions", js_round("avg_sentiment", 6).alias("avg_sentiment"), js_round("eng_pm", 4).alias("eng_pm"), "final_score")


@query("p3_explain_posts", f"""SELECT id, score, coalesce(sentiment_label, 'neutral') AS sentiment_label FROM v_posts p LEFT JOIN v_sentiments s ON s.post_id = p.id
WHERE id IN (SELECT post_id FROM {CUR7} c) ORDER BY score DESC, id LIMIT 5""")
def p3p(t):
    return ex(t).top_posts().select("id", "score", "sentiment_label")


@query("p3_explain_phrases", f"SELECT lower(phrase) AS phrase, count(*) AS n FROM v_phrases WHERE post_id IN (SELECT post_id FROM {CUR7} c) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def p3f(t):
    return ex(t).phrases(t.v_phrases)


@query("p3_explain_sources", f"""SELECT source, count(*) AS posts, floor(CAST(sum(coalesce(CAST(s.sentiment_score AS DECIMAL(20,3)), 0)) AS DOUBLE) / count(*) * 1000 + 0.5) / 1000 AS avg_sentiment
FROM v_posts p LEFT JOIN v_sentiments s ON s.post_id = p.id WHERE p.id IN (SELECT post_id FROM {CUR7} c) GROUP BY 1""")
def p3s(t):
    return ex(t).sources().drop("share_pct")


SC = "floor({} * 1e6 + 0.5) / 1e6 AS {}"


def cl(x, lo="0.0", hi="100.0"):
    return f"greatest({lo}, least({hi}, {x}))"


@query("h30_velocity_sentiment_norm", f"SELECT post_id, {SC.format(cl('(sentiment_score + 1) * 50'), 'norm')} FROM v_sentiments")
def h30(t):
    return t.v_sentiments.select("post_id", js_round(S.sentiment_norm("sentiment_score"), 6).alias("norm"))


@query("h31_engagement_fomo_norm", f"""SELECT s.post_id, {SC.format(cl('log10(p.upvotes + 2 * p.num_comments + 5 * p.num_awards + 1) * 25'), 'eng_norm')},
 {SC.format(cl('fomo_score * 100'), 'fomo_norm')}, {SC.format(cl('abs(least(sentiment_score, 0.0)) * 100'), 'fud_sentiment')} FROM v_sentiments s JOIN v_posts p ON p.id = s.post_id""")
def h31(t):
    j = t.v_sentiments.join(t.v_posts, F.col("post_id") == F.col("id"))
    eng = F.col("upvotes") + 2 * F.col("num_comments") + 5 * F.col("num_awards")
    return j.select("post_id", js_round(S.engagement_norm(eng), 6).alias("eng_norm"), js_round(S.fomo_norm("fomo_score"), 6).alias("fomo_norm"),
                    js_round(S.fud_sentiment_norm("sentiment_score"), 6).alias("fud_sentiment"))


@query("h32_signal_label", "SELECT id, CASE WHEN score >= 80 THEN 'extremely_hot' WHEN score >= 60 THEN 'hot' WHEN score >= 40 THEN 'warm' WHEN score >= 20 THEN 'cool' ELSE 'cold' END AS label FROM v_posts")
def h32(t):
    return t.v_posts.select("id", S.signal_label("score").alias("label"))


@query("h33_mention_confidence", "SELECT id, greatest(0.0, least(1.0, num_comments / 5.0E0)) AS confidence FROM v_posts")
def h33(t):
    return t.v_posts.select("id", S.mention_confidence("num_comments").alias("confidence"))


@query("h34_cap_dampening", f"""SELECT id, floor((CASE WHEN market_cap > 0 THEN CASE WHEN market_cap <= 5e7 THEN 1.0 ELSE {cl('pow(5e7 / market_cap, 0.3)', '0.05', '1.0')} END ELSE 1.0 END) * 1e6 + 0.5) / 1e6 AS by_cap,
 floor({cl('0.15 + 0.85 * (log10(c.market_cap_rank) / log10(200))', '0.15', '1.0')} * 1e6 + 0.5) / 1e6 AS by_rank FROM v_prices p JOIN v_coins c ON c.symbol = p.coin_symbol""")
def h34(t):
    j = t.v_prices.join(t.v_coins, F.col("coin_symbol") == F.col("symbol"))
    none = F.lit(None).cast("double")
    return j.select("id", js_round(S.market_cap_dampening(none, "market_cap"), 6).alias("by_cap"), js_round(S.market_cap_dampening("market_cap_rank", none), 6).alias("by_rank"))


@query("h35_multipliers", "SELECT id, CASE WHEN value / 50 <= 2 THEN 1.0 ELSE least(1 + (value / 50 - 2) * 0.25, 1.5) END AS z_mult, CASE WHEN num_awards <= 1 THEN 0.7E0 WHEN num_awards = 2 THEN 1.0E0 ELSE 1.3E0 END AS platform_mult FROM v_posts JOIN events ON event_id = id")
def h35(t):
    j = t.v_posts.join(t.events.select(F.col("event_id").alias("id"), "value"), "id")
    return j.select("id", S.z_multiplier(F.col("value") / 50).alias("z_mult"), S.platform_multiplier("num_awards").alias("platform_mult"))


@query("h36_contrarian", """SELECT channel, CASE WHEN n >= 5 THEN CASE WHEN b / CAST(n AS DOUBLE) > 0.85 THEN 'potential_reversal' WHEN b / CAST(n AS DOUBLE) < 1 - 0.85 THEN 'potential_bounce' END END AS warning FROM (
 SELECT p.channel || '-' || p.author AS channel, count(*) AS n, count(CASE WHEN s.sentiment_score > 0 THEN 1 END) AS b FROM v_posts p JOIN v_sentiments s ON s.post_id = p.id GROUP BY 1) x""")
def h36(t):
    g = t.v_posts.join(t.v_sentiments, F.col("id") == F.col("post_id")).groupBy(F.concat_ws("-", "channel", "author").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sentiment_score") > 0).alias("b"))
    return g.select("channel", S.contrarian_warning("n", "b").alias("warning"))


@query("h42_entity_confidence", "SELECT coin_symbol, least(1.0E0, 0.6E0 + count(*) * 0.1E0) AS narrative, CASE WHEN count(*) >= 5 THEN 0.9E0 WHEN count(*) >= 2 THEN 0.6E0 ELSE 0.3E0 END AS plain FROM v_mentions GROUP BY 1")
def h42(t):
    g = t.v_mentions.groupBy("coin_symbol").agg(F.count(F.lit(1)).alias("n"))
    return g.select("coin_symbol", S.entity_confidence("narrative_model", "n").alias("narrative"), S.entity_confidence("default", "n").alias("plain"))


DEX = """SELECT event_id AS id, 'C' || (user_id % 40) AS symbol, '0xA' || (event_id % 500) AS token_address, value * (event_id % 13) AS volume_h1, value * 6.0E0 AS volume_h6,
 value * (event_id % 40) * 5 AS volume_h24, value * 100 AS liquidity_usd, event_id % 9 AS buys_h24, event_id % 37 AS sells_h24 FROM events"""
EVS = """CASE WHEN volume_h6 / 6.0 > 0 AND volume_h1 > volume_h6 / 6.0 * 5 THEN {a} END, CASE WHEN volume_h24 > 0 AND liquidity_usd < volume_h24 * 0.5 THEN {b} END,
 CASE WHEN buys_h24 > 0 AND sells_h24 / CAST(buys_h24 AS DOUBLE) > 3 THEN {c} END, CASE WHEN boosted THEN {d} END"""


def dex(t):
    return t.events.selectExpr(
        "event_id AS id", "'C' || (user_id % 40) AS symbol", "'0xA' || (event_id % 500) AS token_address", "value * (event_id % 13) AS volume_h1",
        "value * 6.0E0 AS volume_h6", "value * (event_id % 40) * 5 AS volume_h24", "value * 100 AS liquidity_usd", "event_id % 9 AS buys_h24", "event_id % 37 AS sells_h24")


def boosted(t):
    return t.supplier.select(F.concat(F.lit("0xa"), F.col("s_suppkey").cast("string")).alias("token_address"))


BOOSTED = "(SELECT '0xa' || s_suppkey FROM supplier)"


@query("h39_onchain_events", f"""SELECT coin_symbol, names, {'+'.join(f'CASE WHEN contains(names, {chr(39)}{k}{chr(39)}) THEN {v} ELSE 0.0E0 END' for k, v in [('volume_spike', '7.0E0'), ('liquidity_drain', '-12.0E0'), ('sell_pressure', '-5.0E0'), ('token_boosted', '-3.0E0')])} AS onchain_modifier FROM (
 SELECT coin_symbol, concat_ws(',', {EVS.format(a="'dex:volume_spike'", b="'dex:liquidity_drain'", c="'dex:sell_pressure'", d="'dex:token_boosted'")}) AS names FROM (
  SELECT *, symbol AS coin_symbol, lower(token_address) IN {BOOSTED} AS boosted, row_number() OVER (PARTITION BY symbol ORDER BY liquidity_usd DESC, token_address) AS rn
  FROM ({DEX}) d WHERE liquidity_usd > 1000) x WHERE rn = 1) y WHERE names <> ''""")
def h39(t):
    o = G.onchain_signals(dex(t), t.v_mentions.select("coin_symbol"), boosted(t))
    return o.select("coin_symbol", F.array_join("onchain_names", ",").alias("names"), "onchain_modifier")


@query("l12_main_pair", f"SELECT symbol, token_address, liquidity_usd FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY liquidity_usd DESC, token_address) AS rn FROM ({DEX}) d WHERE liquidity_usd > 1000) x WHERE rn = 1")
def l12(t):
    return first_per_key(dex(t).where("liquidity_usd > 1000"), ["symbol"], [F.col("liquidity_usd").desc(), F.col("token_address")]).select("symbol", "token_address", "liquidity_usd")


@query("b22_pair_admission", f"SELECT id, symbol FROM ({DEX}) d WHERE liquidity_usd > 1000 AND symbol NOT IN ('C1', 'C2', 'C3')")
def b22(t):
    ex_ = t.v_coins.where("symbol IN ('C1', 'C2', 'C3')").select("symbol")
    return dex(t).where("liquidity_usd > 1000").join(ex_, "symbol", "left_anti").select("id", "symbol")


@query("j27_boosted_flag", f"SELECT id, lower(token_address) IN {BOOSTED} AS boosted FROM ({DEX}) d")
def j27(t):
    b = boosted(t).distinct().withColumn("_b", F.lit(True))
    d = dex(t).withColumn("_a", F.lower("token_address"))
    return d.join(b.withColumnRenamed("token_address", "_a"), "_a", "left").select("id", F.coalesce("_b", F.lit(False)).alias("boosted"))
