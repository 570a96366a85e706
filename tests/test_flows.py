"""Sources, sinks, streams and whole jobs: replays, malformed input, order independence."""

import json
import re

from pyspark.sql import functions as F

from tests.helpers import plan, table
from tidemark.plans import backtest as B
from tidemark.plans import ingest as I
from tidemark.plans import signals as G
from tidemark.registry.base import AS_OF, Tables
from tidemark.registry.signals import phrased
from tidemark.sources import feeds as SF
from tidemark.sources import sinks as K
from tidemark.sources import social as SO
from tidemark.streaming import streams as ST


def test_listing_ignores_broken_payloads(spark):
    post = {"name": "t3_1", "title": "a\u0007b", "selftext": "", "author": "x", "permalink": "/p", "ups": 3, "score": 2, "created_utc": 1700000000.5}
    ok = json.dumps({"data": {"children": [{"data": post}]}})
    df = spark.createDataFrame([("c", ok), ("c", "{broken"), ("c", "")], "channel string, payload string")
    r = SO.listing_posts(df).collect()
    assert len(r) == 1 and (r[0].source_id, r[0].title, r[0].body, r[0].upvotes) == ("reddit_t3_1", "ab", None, 3)


def test_trending_fallback_mentions(spark):
    posts = spark.createDataFrame([(1, "CoinGecko Trending #2: Foo Bar (FOO)", '{"trending_rank":2}'), (2, "CoinGecko Trending #1: Bit (BTC)", '{"trending_rank":1}')], "id int, title string, metadata string")
    found = spark.createDataFrame([(2, "BTC", "Bitcoin", 2, None)], "id int, coin_symbol string, coin_name string, mention_count int, context string")
    got = {r.id: (r.coin_symbol, r.coin_name, r.mention_count, r.context) for r in SO.with_fallback_mentions(posts, found).collect()}
    assert got == {1: ("FOO", "Foo Bar", 1, "CoinGecko Trending #2"), 2: ("BTC", "Bitcoin", 2, "CoinGecko Trending #1")}


def test_api_default_keys(spark):
    body = json.dumps({"posts": [{"title": "Some title", "url": "/x?ref=1"}, {"title": "Other title"}]})
    df = spark.createDataFrame([("s", "https://a.com/api", body), ("s", "https://a.com/api", "nope")], "source_name string, url string, payload string")
    m = {"title": "title", "link": "url"}
    assert [(r.title, r.link) for r in SF.api_items(df, AS_OF, m).collect()] == [("Some title", "https://a.com/x")]


def test_model_results_by_position(spark):
    a = spark.createDataFrame([(1, '[{"sentiment_score": "x"}, {"id": "p9", "sentiment_score": 0.5, "sentiment_label": "bullish"}]')], "batch_id int, payload string")
    asked = spark.createDataFrame([(1, 0, "p1"), (1, 1, "p2"), (1, 2, "p9")], "batch_id int, pos int, post_id string")
    got = {r.post_id: (r.success, r.sentiment_score, r.sentiment_label) for r in SF.model_results(a, asked).collect()}
    assert got == {"p1": (True, 0.0, "neutral"), "p2": (False, 0.0, "neutral"), "p9": (True, 0.5, "bullish")}


def test_upsert_twice_is_the_same(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    once = K.upsert(base, delta, ["k"], [F.col("v").desc()])
    twice = K.upsert(once, delta, ["k"], [F.col("v").desc()])
    want = [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_conditional_update(spark):
    base = spark.createDataFrame([(1, "open"), (2, "closed")], "id int, status string")
    ch = spark.createDataFrame([(1, "closed"), (2, "reopened")], "id int, status string")
    after, hit = K.update_if(base, ch, "id", F.col("status") == "open")
    assert sorted(map(tuple, after.collect())) == [(1, "closed"), (2, "closed")] and [r.id for r in hit.collect()] == [1]


def test_register_keeps_selectors(spark):
    have = spark.createDataFrame([(1, "u1", "RSS", '{"category":"a","selectors":"old"}'), (2, "u2", "RSS", '{"category":"a"}')], "id int, base_url string, crawler_type string, config string")
    inc = spark.createDataFrame(
        [("u1", "n", "a", "AUTO", "STATIC", "new"), ("u2", "n", "a", "AUTO", None, None), ("u3", "n", "b", "API", None, None)],
        "base_url string, name string, category string, crawler_type string, resolved_type string, selectors string")
    got = {r.base_url: (r.action, r.crawler_type, json.loads(r.config)) for r in K.register_sources(have, inc).collect()}
    assert got["u1"] == ("update", "STATIC", {"category": "a", "selectors": "old"})
    assert got["u2"][0] == "skip" and got["u3"] == ("insert", "API", {"category": "b"})


def item(source, pos, link):
    return (source, "u", f"Title number {pos} of {source}", link, None, None, None, "cat", pos)


ITEM = "source_name string, user_id string, title string, link string, author string, date_text string, content string, category string, pos int"


def test_ingest_skips_unchanged_and_known(spark):
    rows = [item("s1", i, f"https://a.com/p/{i}") for i in range(4)] + [item("s2", i, f"https://b.com/p/{i}") for i in range(3)]
    items = spark.createDataFrame(rows, ITEM)
    empty = I.to_articles(items.where("1 = 0"), AS_OF)
    no_state = spark.createDataFrame([], "source_name string, url_hash string")
    first, state = I.ingest(items, empty, no_state, AS_OF)
    assert first.count() == 6
    again, _ = I.ingest(items, first, state, AS_OF)
    assert again.count() == 0
    moved = items.withColumn("link", F.when(F.col("link") == "https://b.com/p/0", "https://b.com/p/new").otherwise(F.col("link")))
    third, _ = I.ingest(moved.withColumn("title", F.concat("title", F.lit(" again"))), first, state, AS_OF)
    assert [r.source_url for r in third.collect()] == ["https://b.com/p/new"]


def test_change_stream_over_two_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], ITEM).schema
    a = [item("s1", 0, "https://a.com/1"), item("s2", 0, "https://b.com/1")]
    b = [item("s1", 0, "https://a.com/1"), item("s2", 0, "https://b.com/2")]
    folder = ST.stream_folder(spark, "chg")
    for rows in (a, b):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(src)
        ST.change_detect(ST.file_stream(spark, src, "*.parquet", schema), folder)
    got = spark.read.parquet(f"{folder}/items").orderBy("batch", "source_name").select("batch", "link").collect()
    assert [tuple(r) for r in got] == [(0, "https://a.com/1"), (0, "https://b.com/1"), (1, "https://b.com/2")]


def test_chat_replay_changes_nothing(spark, tmp_path):
    coins = spark.createDataFrame([("BTC", "bitcoin")], "symbol string, name string")
    msg = [(1, "g", "1", "general", "1", "ann", False, "bitcoin is going up a lot today", "2024-01-01 00:00:00")]
    schema = "id long, guild string, guild_id string, channel string, channel_id string, author string, is_bot boolean, content string, created_at string"
    src, folder = str(tmp_path / "in"), ST.stream_folder(spark, "chat")
    df = spark.createDataFrame(msg, schema)
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
        ST.chat_ingest(ST.file_stream(spark, src, "*.parquet", df.schema), coins, folder)
    posts, mentions = ST.read_chat(spark, folder)
    assert posts.count() == 1
    assert [(r.source_id, r.coin_symbol, r.mention_count) for r in mentions.collect()] == [("discord_1", "BTC", 1)]


def opened(df):
    """The bound of the batches that a log read opens, and its snapshots."""
    bounds = re.findall(r"PartitionFilters: \[isnotnull\(batch[^]]*?(> \d+\))", plan(df))
    return (*set(bounds), {f.split("/snapshots/")[1].split("/")[0] for f in df.inputFiles() if "/snapshots/" in f})


def test_chat_reads_snapshots_and_the_tail(spark, tmp_path):
    """Six batches with edited messages and a snapshot after every second: old batches are not opened, results as without snapshots."""
    coins = spark.createDataFrame([("BTC", "bitcoin"), ("ETH", "ethereum")], "symbol string, name string")
    schema = "id long, guild string, guild_id string, channel string, channel_id string, author string, is_bot boolean, content string, created_at string"
    src, folder = str(tmp_path / "in"), ST.stream_folder(spark, "chat")
    for i in range(6):
        word = ("bitcoin", "ethereum", "nothing")[i % 3]
        rows = [(k, "g", "1", "general", "1", "ann", False, f"{word} is going up a lot today", f"2024-01-0{i + 1} 00:00:00") for k in (0, i, 10 + i % 2)]
        df = spark.createDataFrame(sorted(set(rows)), schema)
        df.coalesce(1).write.mode("append").parquet(src)
        ST.chat_ingest(ST.file_stream(spark, src, "*.parquet", df.schema), coins, folder, every=2)
    posts, mentions = ST.read_chat(spark, folder)
    want = {0: "nothing", 1: "ethereum", 2: "nothing", 3: "bitcoin", 4: "ethereum", 5: "nothing", 10: "ethereum", 11: "nothing"}
    assert {r.source_id: r.title.split()[0] for r in posts.collect()} == {f"discord_{k}": w for k, w in want.items()}
    symbol = {"bitcoin": "BTC", "ethereum": "ETH"}
    assert {(r.source_id, r.coin_symbol) for r in mentions.collect()} == {(f"discord_{k}", symbol[w]) for k, w in want.items() if w in symbol}
    # the snapshot of batch 5 holds all; batch 5 itself saw the snapshot of batch 3 and batch 4
    assert opened(posts) == opened(mentions) == ("> 5)", {"5"})
    assert opened(ST.chat_state(spark, folder, 5)[0]) == ("> 3)", {"3"})


def test_change_state_with_snapshots(spark, tmp_path):
    """A source is announced again only in batches where its links changed, whether or not a snapshot lies between."""
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], ITEM).schema
    folder, want = ST.stream_folder(spark, "chg"), set()
    for i in range(5):
        links = {"s1": "https://a.com/1", "s2": f"https://b.com/{i // 2}", "s3": f"https://c.com/{i}"}
        want |= {(i, links["s3"])} | ({(i, links["s2"])} if i % 2 == 0 else set()) | ({(i, links["s1"])} if i == 0 else set())
        spark.createDataFrame([item(s, 0, x) for s, x in links.items()], ITEM).coalesce(1).write.mode("append").parquet(src)
        ST.change_detect(ST.file_stream(spark, src, "*.parquet", schema), folder, every=2)
    got = spark.read.parquet(f"{folder}/items").select("batch", "link").collect()
    assert {tuple(r) for r in got} == want
    assert opened(ST.read_state(spark, f"{folder}/state", 5, "source_name")) == ("> 3)", {"3"})


def signal_rows(t, reverse=False):
    m = t.v_mentions.orderBy(F.rand(3)).repartition(7) if reverse else t.v_mentions
    s = G.generate_signals(m, t.v_posts, phrased(t), t.v_coins, t.v_prices, AS_OF)
    s = s.select("coin_symbol", "time_window", "signal_type", "weighted_score", "avg_sentiment", "z_score", F.array_join("detected_events", ",").alias("ev"))
    return table(s.columns, [tuple(r) for r in s.collect()])


def test_signals_do_not_depend_on_row_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = signal_rows(t)
    assert a == signal_rows(t, True)
    assert all(0 <= r[-2] <= 100 for r in a)


def test_backtest_leaves_out_recorded_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = B.run_backtest(t.v_signals, t.v_prices, t.v_coins, "2024-01-20 00:00:00")
    assert one.count() > 0
    assert B.run_backtest(t.v_signals, t.v_prices, t.v_coins, "2024-01-20 00:00:00", existing=one).count() == 0


def test_plans_have_no_pairing_joins(spark, sf_dir):
    import __spark_entry__ as e

    q = e.queries()
    for name in ("p2_signals", "a12_six_hour_series", "j28_related_articles", "p1_mentions", "p9_exit_rules", "p16_cross_source_dedup", "j12_edges_touching", "t7_alert_fanout"):
        text = plan(q[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_filters_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as e

    text = e.queries()["s16_scan_predicates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text and "EqualTo(l_returnflag,R)" in text
    assert "l_comment" not in text and "l_extendedprice" not in text
