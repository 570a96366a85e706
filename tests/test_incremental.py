"""In-place writes, compacted logs, mergeable aggregates and stream state: what they touch and that parts add up."""

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tidemark.operators import mergeable as MG
from tidemark.plans import ingest as I
from tidemark.plans import queues as Q
from tidemark.sources import tables as TB


def files(path):
    return {f"{d}/{x}": os.stat(f"{d}/{x}").st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    TB.create(spark.range(2000).selectExpr("concat('k', id) AS k", "id AS v"), path, keys, 32)
    before = files(path)
    delta = spark.createDataFrame([("k7", -7), ("new", 1)], "k string, v long")
    TB.upsert(spark, path, delta, keys, 32)
    after = files(path)
    hit = {r[0] for r in TB.bucketed(delta, keys, 32).select("bucket").collect()}
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in hit}
    assert len(same) >= 30 and all(after[f] == before[f] for f in same)
    assert {f for f in after if f not in same} and not {f for f in before if f not in same} & set(after)
    got = {r.k: r.v for r in TB.read(spark, path).collect()}
    assert got == {f"k{i}": i for i in range(2000)} | {"k7": -7, "new": 1}
    TB.upsert(spark, path, delta.limit(0), keys, 32)
    assert files(path) == after
    TB.replace_by_key(spark, path, spark.createDataFrame([("k1", 5), ("k1", 6)], "k string, v long"), "k", 32)
    assert sorted(r.v for r in TB.read(spark, path).where("k = 'k1'").collect()) == [5, 6]
    TB.update_if(spark, path, spark.createDataFrame([("k2", 0), ("k3", 0)], "k string, v long"), "k", F.col("v") > 2, 32)
    assert {r.k: r.v for r in TB.read(spark, path).where("k IN ('k2', 'k3')").collect()} == {"k2": 2, "k3": 0}


def test_log_opens_the_last_snapshot_and_the_tail(spark, tmp_path):
    path, order = str(tmp_path / "log"), [F.col("v").desc()]
    for i in range(20):
        batch = spark.range(10).selectExpr(f"concat('k', (id * 7 + {i}) % 23) AS k", f"{i} * 100 + id AS v")
        TB.upsert_log(batch, i, path, ["k"], order, every=6)
    want = {}
    for i in range(20):
        rows = {}
        for x in range(10):
            rows[f"k{(x * 7 + i) % 23}"] = max(i * 100 + x, rows.get(f"k{(x * 7 + i) % 23}", -1))
        want |= rows
    log = TB.read_log(spark, path, ["k"], order)
    assert {r.k: r.v for r in log.collect()} == want
    assert TB.last_snapshot(spark, path) == 17
    assert any("/snapshots/17/" in f for f in log.inputFiles()) and not any("/snapshots/11/" in f for f in log.inputFiles())
    assert "PartitionFilters: [isnotnull(batch" in plan(log) and "> 17)" in plan(log)
    # a replayed batch changes nothing
    TB.upsert_log(spark.range(10).selectExpr("concat('k', (id * 7 + 19) % 23) AS k", "1900 + id AS v"), 19, path, ["k"], order, every=6)
    assert {r.k: r.v for r in TB.read_log(spark, path, ["k"], order).collect()} == want


def test_set_hash_of_parts(spark):
    rows = [("a", f"x{i % 40}") for i in range(100)] + [("b", None), ("b", "y"), ("c", "y")]
    df = spark.createDataFrame(rows, "s string, link string")
    whole = {r.s: (r.n, r.h1, r.h2) for r in MG.set_hash(df, ["s"], "link").collect()}
    assert whole == {r.s: (r.n, r.h1, r.h2) for r in MG.set_hash(df.repartition(5).orderBy(F.rand(1)), ["s"], "link").collect()}
    assert whole["b"] == whole["c"] and whole["a"][0] == 100
    left, right = df.limit(60), df.exceptAll(df.limit(60))
    part = MG.set_hash(left, ["s"], "link")
    merged = MG.merge_set_hash(part, MG.set_hash(right, ["s"], "link"), part.limit(0), ["s"])
    assert {r.s: (r.n, r.h1, r.h2) for r in merged.collect()} == whole
    back = MG.merge_set_hash(MG.set_hash(df, ["s"], "link"), part.limit(0), MG.set_hash(right, ["s"], "link"), ["s"])
    assert {r.s: (r.n, r.h1, r.h2) for r in back.collect()} == {r.s: (r.n, r.h1, r.h2) for r in part.collect()}


def test_distinct_counts_over_many_blocks(spark):
    df = spark.range(120_000).selectExpr("id % 3 AS k", "id % 7 AS hour", "id % 90001 AS number")
    got = {r.k: r.n for r in MG.distinct_counts(MG.bitmaps(df, ["k", "hour"], "number").drop("hour"), ["k"], "n").collect()}
    assert got == {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("number").alias("n")).collect()}
    d = {r.v: r.no for r in MG.dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v", "no").collect()}
    assert d == {"a": 0, "b": 1}


def test_queue_function_in_sql(spark):
    posts = spark.createDataFrame([(i, "t" * 40, None, f"2024-01-0{1 + i % 9} 00:00:00") for i in range(30)], "id long, title string, body string, at string")
    posts = posts.withColumn("posted_at", F.col("at").cast("timestamp")).drop("at")
    sentiments, mentions = posts.where("id % 3 = 0").selectExpr("id AS post_id"), posts.where("id < 25").selectExpr("id AS post_id")
    Q.register_queue_function(posts, sentiments, mentions, "queue_of_test")
    want = [r.id for r in Q.posts_without_sentiment(posts, sentiments, mentions, limit=7).collect()]
    got = spark.sql("SELECT id FROM queue_of_test(7) ORDER BY place")
    assert [r.id for r in got.collect()] == want
    assert spark.sql("SELECT count(*) FROM queue_of_test(1000)").first()[0] == 16


def test_titles_are_normalised_once_and_short_ones_stay(spark):
    rows = [(1, "The same long headline", "a"), (2, "The same long headline", "b"), (3, "short", "a"), (4, "short", "b"), (5, None, "c"), (6, "Another long headline", "c")]
    a = spark.createDataFrame(rows, "id long, title string, source_name string").withColumn("crawled_at", F.lit("2024-01-01").cast("timestamp") - F.col("id").cast("int") * F.expr("INTERVAL 1 DAY"))
    assert sorted(r.id for r in I.without_duplicates(a, "source_name").collect()) == [2, 3, 4, 5, 6]
    assert [r.id for r in I.duplicates_to_remove(a).collect()] == [1]


@pytest.mark.parametrize("name", ["s27_changed_urls", "h17_time_ago"])
def test_whole_tables_under_the_old_names(name):
    import __spark_entry__ as e

    assert e.oracle_sql()[name] == e.oracle_sql()[f"{name}_all"]
