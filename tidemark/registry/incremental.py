"""State that does not grow: keyed stream state, compacted logs, bucketed tables, mergeable aggregates, and the queue as an SQL function."""

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import mergeable as MG
from tidemark.operators.keyed import first_per_key
from tidemark.plans import queues as Q
from tidemark.registry.arrivals import arriving
from tidemark.registry.base import AS_OF, query
from tidemark.registry.feed import ITEM_SQL2, items
from tidemark.registry.social import J7_SQL
from tidemark.semantics import js_round
from tidemark.sources import tables as TB
from tidemark.streaming import stateful as SS
from tidemark.streaming import streams as ST

T0 = f"TIMESTAMP '{AS_OF}'"
HOUR, PERIOD = 3_600_000_000, 21_600_000_000


@query("t8_change_state", f"""SELECT 0 AS batch, source_name, least(count(*), 3) AS n FROM ({ITEM_SQL2}) i GROUP BY 2
 UNION ALL SELECT 1, source_name, least(count(*), 3) FROM ({ITEM_SQL2}) i WHERE source_name >= 'feed5' GROUP BY 2""")
def t8_state(t):
    """The three crawls of ``t8_change_stream`` with the hashes in the state store."""
    SS.use_rocksdb(t.spark)
    i = items(t).select("source_name", "link", "pos")
    moved = F.when(F.col("source_name") >= "feed5", F.concat("link", F.lit("?new"))).otherwise(F.col("link"))
    crawls = [i.withColumn("crawl", F.lit(0)), i.withColumns({"link": moved, "crawl": F.lit(1)}), i.withColumns({"link": moved, "crawl": F.lit(2)})]
    s, folder = arriving(t, "crawl-state", reduce(lambda a, b: a.unionByName(b), crawls), [F.col("crawl") == k for k in range(3)])
    ST.drain(SS.changed_links(s), folder)
    out = t.spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.col("crawl").alias("batch"), "source_name").agg(F.count(F.lit(1)).alias("n"))


@query("t5_history_state", f"""WITH p AS (SELECT coin_symbol, epoch_us(created_at) // {PERIOD} AS p, sum(mention_count) AS b FROM v_mentions GROUP BY 1, 2),
 mark AS (SELECT max(epoch_us(created_at)) - {HOUR} AS w FROM v_mentions)
 SELECT coin_symbol, CAST(k * {PERIOD} AS BIGINT) AS tick_us, CAST(count(*) AS BIGINT) AS hist_buckets, floor(CAST(sum(b) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS hist_mean
 FROM (SELECT coin_symbol, b, unnest(range(p + 2, p + 12)) AS k FROM p) x, mark WHERE k * {PERIOD} <= w GROUP BY 1, 2""")
def t5_state(t):
    """Mentions arrive in three steps of ten days; every coin's history rolls at each period end that the watermark passes."""
    SS.use_rocksdb(t.spark)
    day = F.least(F.floor((F.dayofmonth("created_at") - 1) / 10), F.lit(2))
    s, folder = arriving(t, "history-state", t.v_mentions, [day == k for k in range(3)])
    ST.drain(SS.rolling_history(s, "coin_symbol", "created_at", "mention_count", dt.timedelta(hours=6)), folder)
    out = t.spark.read.parquet(f"{folder}/out")
    return out.select(
        F.col("key").alias("coin_symbol"), (F.col("tick_ms") * 1000).alias("tick_us"), F.col("buckets").alias("hist_buckets"),
        js_round(F.col("total") / F.col("buckets"), 6).alias("hist_mean"),
    )


@query("t9_pending_stream", f"""WITH s AS (SELECT id, coin_symbol, signal_at FROM v_backtest), p AS (SELECT coin_symbol, fetched_at FROM v_prices WHERE coin_symbol <> 'C7'),
 mark AS (SELECT least((SELECT max(epoch_us(signal_at)) FROM s), (SELECT max(epoch_us(fetched_at)) FROM p)) - {HOUR} AS w),
 j AS (SELECT s.id, s.signal_at, count(p.fetched_at) AS n FROM s LEFT JOIN p ON p.coin_symbol = s.coin_symbol
       AND p.fetched_at >= s.signal_at - INTERVAL 12 HOUR AND p.fetched_at <= s.signal_at + INTERVAL 12 HOUR GROUP BY 1, 2)
 SELECT id, CAST(n AS BIGINT) AS n_prices, n = 0 AS expired FROM j, mark WHERE n > 0 OR epoch_us(signal_at) + 12 * {HOUR} < w""")
def t9_stream(t):
    """Signals and prices arrive side by side in five steps; one coin has no prices, so its signals expire."""
    SS.use_rocksdb(t.spark)
    step = F.floor((F.dayofmonth("ts") - 1) / 7)
    steps = [step == k for k in range(5)]
    signals = t.v_backtest.select("id", "coin_symbol", "signal_at", F.col("signal_at").alias("ts"))
    prices = t.v_prices.where("coin_symbol <> 'C7'").select("coin_symbol", "fetched_at", "price_usd", F.col("fetched_at").alias("ts"))
    s, folder = arriving(t, "signals", signals, steps)
    p, _ = arriving(t, "prices", prices, steps)
    ST.drain(SS.pending_matches(s, p), folder)
    out = t.spark.read.parquet(f"{folder}/out")
    return out.groupBy("id").agg(F.sum("n_prices").alias("n_prices")).withColumn("expired", F.col("n_prices") == 0)


@query("t2_compacted_log", "SELECT channel, author, id FROM (SELECT *, row_number() OVER (PARTITION BY channel, author ORDER BY date_part('day', posted_at) DESC, posted_at DESC, id) AS rn FROM v_posts) x WHERE rn = 1")
def t2_compacted(t):
    """Six steps of five days with a snapshot after every second batch; reading opens the last snapshot and what follows it."""
    part = F.least(F.floor((F.dayofmonth("posted_at") - 1) / 5), F.lit(5))
    s, folder = arriving(t, "compacted", t.v_posts.select("channel", "author", "id", "posted_at"), [part == k for k in range(6)])
    keys, order = ["channel", "author"], [F.col("posted_at").desc(), F.col("id")]
    ST.drain(s, folder, lambda b, i: TB.upsert_log(b, i, f"{folder}/log", keys, order, every=2))
    return TB.read_log(t.spark, f"{folder}/log", keys, order).select("channel", "author", "id")


@query("t2_first_wins", "SELECT DISTINCT channel, author FROM v_posts")
def t2_first(t):
    part = F.least(F.floor((F.dayofmonth("posted_at") - 1) / 10), F.lit(2))
    s, folder = arriving(t, "first-wins", t.v_posts.select("channel", "author", "id", "posted_at"), [part == k for k in range(3)])
    ST.drain(SS.first_wins(s, ["channel", "author"], "posted_at", "60 days"), folder)
    return t.spark.read.parquet(f"{folder}/out").select("channel", "author")


@query("s17_upsert_buckets", "SELECT channel, id, score FROM (SELECT *, row_number() OVER (PARTITION BY channel, author ORDER BY posted_at DESC, id) AS rn FROM v_posts) x WHERE rn = 1")
def s17_buckets(t):
    """The upsert of ``s17_upsert`` in place, on a table laid out by hash bucket of the key."""
    p = t.v_posts.select("channel", "author", "id", "score", "posted_at")
    keys, order, path = ["channel", "author"], [F.col("posted_at").desc(), F.col("id")], ST.stream_folder(t.spark, "buckets")
    TB.create(first_per_key(t.v_posts.where("source IN ('click', 'view')").select(*p.columns), keys, order), path, keys, 16)
    TB.upsert(t.spark, path, p, keys, 16, order)
    return TB.read(t.spark, path).select("channel", "id", "score")


@query("s18_replace_buckets", "SELECT post_id, coin_symbol, mention_count FROM v_mentions WHERE post_id NOT IN (SELECT id FROM v_posts WHERE source = 'click') UNION ALL SELECT id, 'NEW', 1 FROM v_posts WHERE source = 'click'")
def s18_buckets(t):
    new = t.v_posts.where("source = 'click'").select(F.col("id").alias("post_id"), F.lit("NEW").alias("coin_symbol"), F.lit(1).alias("mention_count"))
    path = ST.stream_folder(t.spark, "buckets")
    TB.create(t.v_mentions.select("post_id", "coin_symbol", "mention_count"), path, ["post_id"], 16)
    TB.replace_by_key(t.spark, path, new, "post_id", 16)
    return TB.read(t.spark, path)


@query("s20_update_buckets", """SELECT id, coin_symbol, CASE WHEN status = 'open' AND remaining_size > 0.01 AND id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'closed' ELSE status END AS status FROM v_positions""")
def s20_buckets(t):
    ch = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("closed").alias("status"), F.lit(0.0).alias("remaining_size"))
    path = ST.stream_folder(t.spark, "buckets")
    TB.create(t.v_positions, path, ["id"], 16)
    TB.update_if(t.spark, path, ch, "id", (F.col("status") == "open") & (F.col("remaining_size") > 0.01), 16)
    return TB.read(t.spark, path).select("id", "coin_symbol", "status")


@query("a34_set_hash", f"""SELECT source_name, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(link), 1, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS h1,
 CAST(sum(CAST(CAST('0x' || substr(md5(link), 17, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS h2 FROM ({ITEM_SQL2}) i WHERE link IS NOT NULL GROUP BY 1""")
def a34_set(t):
    """All links of each source: the hash of two thirds, the rest added, something wrong added and removed again."""
    i = items(t)
    rest, key = F.col("id") % 3 == 0, ["source_name"]
    wrong = MG.set_hash(i.where("id % 5 = 0").withColumn("link", F.concat("link", F.lit("?gone"))), key, "link")
    first = MG.merge_set_hash(MG.set_hash(i.where(~rest), key, "link"), wrong, wrong.limit(0), key)
    h = MG.merge_set_hash(first, MG.set_hash(i.where(rest), key, "link"), wrong, key)
    return h.select("source_name", "n", F.col("h1").cast("string").alias("h1"), F.col("h2").cast("string").alias("h2"))


WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}


@query("a4_distinct_partials", f"""SELECT m.coin_symbol, w.time_window, count(DISTINCT p.author) AS authors, count(DISTINCT p.source) AS platforms, count(DISTINCT p.id) AS posts
 FROM v_mentions m JOIN v_posts p ON p.id = m.post_id, (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168)) AS w(time_window, h)
 WHERE m.created_at < {T0} AND m.created_at >= {T0} - to_hours(w.h) GROUP BY 1, 2""")
def a4_partials(t):
    """Distinct authors, platforms and posts of four overlapping windows from hourly bitmaps; mentions are read once a measure."""
    posts = t.v_posts.select(F.col("id").alias("post_id"), "author", "source")
    m = t.v_mentions.join(posts, "post_id").where(F.col("created_at") < F.lit(AS_OF).cast("timestamp"))
    hour = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - 1 - F.unix_micros("created_at")) / HOUR).cast("int")
    m = m.withColumn("hour", hour).where(F.col("hour") < 168)
    numbered = m.join(MG.dictionary(t.v_posts, "author", "author_no"), "author").join(MG.dictionary(t.v_posts, "source", "source_no"), "source")
    numbered = numbered.join(MG.dictionary(t.v_posts.select(F.col("id").alias("post_id")), "post_id", "post_no"), "post_id")
    windows = F.explode(F.array(*[F.struct(F.lit(w).alias("time_window"), F.lit(h).alias("hours")) for w, h in WINDOWS.items()]))
    out = None
    for number, name in (("author_no", "authors"), ("source_no", "platforms"), ("post_no", "posts")):
        hourly = MG.bitmaps(numbered, ["coin_symbol", "hour"], number)
        per_window = hourly.select("*", windows.alias("w")).where("hour < w.hours").select("coin_symbol", F.col("w.time_window").alias("time_window"), "part", "bits")
        n = MG.distinct_counts(per_window, ["coin_symbol", "time_window"], name)
        out = n if out is None else out.join(n, ["coin_symbol", "time_window"])
    return out


@query("x1_table_function", f"SELECT p.id, p.source FROM (SELECT id FROM ({J7_SQL}) x ORDER BY posted_at DESC, id LIMIT 50) q JOIN v_posts p USING (id)")
def x1_function(t):
    Q.register_queue_function(t.v_posts, t.v_sentiments, t.v_mentions)
    return t.spark.sql("SELECT p.id, p.source FROM get_posts_without_sentiment(50) q JOIN {posts} p ON p.id = q.id", posts=t.v_posts)
