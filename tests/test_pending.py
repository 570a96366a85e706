"""Pending evaluation over streams: runs of matches against pairs by brute force, and how many rows come out."""

import datetime as dt

import pytest

from tidemark.streaming import stateful as SS
from tidemark.streaming import streams as ST

T0, REACH = dt.datetime(2024, 1, 1), dt.timedelta(hours=12)
PRICE = "coin_symbol string, fetched_at timestamp, price_usd double"


def at(hours, us=0):
    return T0 + dt.timedelta(hours=hours, microseconds=us)


@pytest.fixture
def evaluated(spark, tmp_path):
    """Runs a stream over steps of signals and prices; gives what was written and all prices."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    SS.use_rocksdb(spark)

    def arriving(name, steps, schema):
        for step in steps:
            spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    def run(signals, prices, ident="long"):
        s, p = arriving("signals", signals, f"id {ident}, coin_symbol string, signal_at timestamp"), arriving("prices", prices, PRICE)
        ST.drain(SS.pending_matches(s, p), str(tmp_path))
        return spark.read.parquet(f"{tmp_path}/out"), spark.read.schema(PRICE).parquet(f"{tmp_path}/prices")

    yield run
    spark.conf.set(provider, before)


def brute(signals, prices, mark):
    out = []
    for i, coin, t in signals:
        near = [(f, x) for c, f, x in prices if coin is not None and c == coin and abs(f - t) <= REACH]
        out += [(i, coin, t, f, x) for f, x in near] or ([(i, coin, t, None, None)] if t + REACH < mark else [])
    return sorted(out, key=repr)


def test_runs_hold_every_pair(spark, evaluated):
    signals = [
        [(1, "A", at(12)), (2, "A", at(24, -1)), (3, "A", at(24)), (4, "A", at(24, 1)), (5, "B", at(3)), (6, None, at(4)), (None, "A", at(5)), (7, "A", at(30)), (7, "A", at(30))],
        [(8, "A", at(40)), (2**60 + 1, "A", at(40)), (9, "D", at(41)), (1, "A", at(44))],
        [(10, "A", at(90)), (11, "C", at(91)), (12, "A", at(150)), (13, "D", at(151))],
    ]
    prices = [
        [("A", at(0), 1.0), ("A", at(0, -1), 2.0), ("A", at(36), 3.0), ("A", at(36), 4.0), ("A", at(36, 1), 5.0), (None, at(4), 6.0), ("C", at(2), 7.0)],
        [("A", at(38), 8.0), ("A", at(41), 9.0), ("A", at(50), 10.0), ("D", at(50), None)],
        [("A", at(78), 11.0), ("A", at(102), 12.0), ("A", at(102, 1), 13.0), ("C", at(160), 14.0)],
    ]
    out, ticks = evaluated(signals, prices)
    every = [r for step in signals for r in step]
    want = brute(every, [r for step in prices for r in step], at(150))
    assert sorted((tuple(r) for r in SS.match_pairs(out, ticks).collect()), key=repr) == want
    runs = out.collect()
    assert {r.id for r in runs if r.n_prices == 0} == {2, 5, 6, 11} and all((r.n_prices == 0) == (r.first_at is None) == (r.last_at is None) for r in runs)


def test_dense_periods_write_no_pairs(spark, evaluated):
    # 400 signals and 300 prices of one coin within reach of each other are 120,000 pairs
    signals = [[(f"s{i}", "A", at(6, i + 1000 * k)) for i in range(200)] for k in range(2)]
    prices = [[("A", at(8, i + 1000 * k), 1.0) for i in range(150)] for k in range(2)]
    out, ticks = evaluated(signals, prices, "string")
    got = out.groupBy("id").sum("n_prices").collect()
    assert len(got) == 200 and {r[1] for r in got} == {600}
    assert out.count() <= 600
    assert SS.match_pairs(out.where("id = 's7'"), ticks).count() == 600


def test_signals_expire_when_their_reach_has_passed(evaluated):
    # the watermark ends at hour 13
    signals = [[(1, "A", at(1, -1000)), (2, "B", at(1, -1)), (3, "C", at(1)), (4, "D", at(1, 1)), (5, "E", at(1, -1)), (6, "E", at(1)), (7, "F", at(1, -1))], [(9, "Z", at(14))]]
    prices = [[("X", at(0), 1.0)], [("X", at(14), 1.0), ("F", at(13, -1), 1.0)]]
    out, _ = evaluated(signals, prices)
    assert sorted((r.id, r.n_prices) for r in out.collect()) == [(1, 0), (2, 0), (5, 0), (7, 1)]
