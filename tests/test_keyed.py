"""Skew-safe operators against brute force, with one key holding most rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan
from tidemark.operators import keyed as K
from tidemark.plans.graph import co_mentions

BASE = 1_700_000_000


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    key = lambda: "hot" if rnd.random() < 0.8 else rnd.choice("ab")
    ticks = [(i, key(), BASE + rnd.randrange(0, 400_000), float(rnd.randrange(1000))) for i in range(900)]
    probes = [(i, key() if i else "none", BASE + rnd.randrange(-50_000, 450_000)) for i in range(300)]
    t = spark.createDataFrame(ticks, "id int, k string, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    p = spark.createDataFrame(probes, "pid int, k string, s long").withColumn("when", F.timestamp_seconds("s"))
    return ticks, probes, t.repartition(5), p


def test_asof_nearest(data):
    ticks, probes, t, p = data
    got = {r.pid: r.nearest_value for r in K.asof_nearest(p, t, "k", "when", "at", "v", 3600).collect()}
    for pid, k, s in probes:
        near = [(abs(x[2] - s), x[2], x[3]) for x in ticks if x[1] == k and abs(x[2] - s) <= 3600]
        assert got[pid] == (min(near)[2] if near else None)


def test_asof_first_ticks(data):
    ticks, probes, t, p = data
    got = {r.pid: r.nearest_value for r in K.asof_first_ticks(p, t, "k", "when", "at", "v", 3600, 5).collect()}
    for pid, k, s in probes:
        inside = sorted((x[2], x[3]) for x in ticks if x[1] == k and abs(x[2] - s) <= 3600)[:5]
        best = min(((abs(a - s), a, v) for a, v in inside), default=None)
        assert got[pid] == (best[2] if best else None)


def test_row_numbers_and_running_max(data):
    ticks, _, t, _ = data
    got = {r.id: r.row_num for r in K.row_numbers(t, ["k"], [F.col("s").desc(), F.col("id")]).collect()}
    peak = {r.id: r.peak for r in K.running_max(t, ["k"], [F.col("s"), F.col("id")], "v", "peak").collect()}
    for k in {x[1] for x in ticks}:
        mine = [x for x in ticks if x[1] == k]
        for n, x in enumerate(sorted(mine, key=lambda x: (-x[2], x[0])), 1):
            assert got[x[0]] == n
        top = 0.0
        for x in sorted(mine, key=lambda x: (x[2], x[0])):
            top = max(top, x[3])
            assert peak[x[0]] == top


def test_row_numbers_with_one_order_value(spark):
    d = spark.range(500).select("id", F.lit("k").alias("k"), F.lit(1).alias("o"))
    assert sorted(r.row_num for r in K.row_numbers(d, ["k"], [F.col("o"), F.col("id")]).collect()) == list(range(1, 501))


def test_top_k_limits_before_the_shuffle(data):
    text = plan(K.top_k(data[2], ["k"], [F.col("s").desc(), F.col("id")], 3))
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit") and "Partial" in text


def test_co_mentions(spark):
    rnd = random.Random(3)
    posts = [(p, c) for p in range(300) for c in set(rnd.choices("ABCDEFG", k=rnd.randrange(1, 5)))]
    posts += [(p, c) for p in range(1000, 1200) for c in "AB"] + posts[:50]
    sets = {}
    for p, c in posts:
        sets.setdefault(p, set()).add(c)
    want = {}
    for s in sets.values():
        for a, b in itertools.combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    d = spark.createDataFrame(posts, "post_id int, coin_symbol string")
    got = {(r.src, r.tgt): r.weight for r in co_mentions(d).collect()}
    assert got == {k: v for k, v in want.items() if v >= 3}
