"""Keyed state in the state store: change detection, rolling history and pending evaluation that read no earlier batch.

State is bounded per key: one hash, a dozen period sums, or the rows of an open time range.  The processors need the RocksDB
state store, which ``use_rocksdb`` sets for streams started afterwards.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.ingest import PER_SOURCE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LinkSets(StatefulProcessor):
    """Emits a source's newest links when their set differs from the one last seen; a hash per source is all that is kept."""

    def __init__(self, n: int, ttl_days: int | None):
        self.n, self.ttl_ms = n, ttl_days and ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("links", "hash string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # only the few newest rows are held, however many a source sends
        newest = heapq.nsmallest(self.n, ((r["pos"], r["link"], r["crawl"]) for r in rows))
        value = hashlib.sha256("|".join(sorted(x[1] for x in newest)).encode()).hexdigest()
        if not self.seen.exists() or self.seen.get()[0] != value:
            for _, link, crawl in newest:
                yield Row(crawl=crawl, source_name=key[0], link=link)
        self.seen.update((value,))

    def close(self) -> None:
        pass


def changed_links(items: DataFrame, n: int = PER_SOURCE, ttl_days: int | None = None) -> DataFrame:
    """(crawl, source_name, link) of sources whose ``n`` newest links changed; ``items`` has crawl, source_name, link, pos.

    One micro-batch is one crawl of a source.  With ``ttl_days`` a source not seen for so long is forgotten and counts as new;
    such a stream has to run on, as one that processes what is there and stops would wait for the time to pass.
    """
    rows = items.select("crawl", "source_name", "link", "pos").where("link IS NOT NULL AND source_name IS NOT NULL")
    return rows.groupBy("source_name").transformWithState(
        LinkSets(n, ttl_days), "crawl int, source_name string, link string", outputMode="Append", timeMode="ProcessingTime" if ttl_days else "None"
    )


class RollingPeriods(StatefulProcessor):
    """Sums of the last periods of a key; an event-time timer rolls them at every period end, whether or not rows come."""

    def __init__(self, period_ms: int, n: int):
        self.period, self.n = period_ms, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "period long", "n long")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            periods = batch["ms"] // self.period
            for period, n in batch["n"].groupby(periods).sum().items():
                old = self.sums.getValue((int(period),))[0] if self.sums.containsKey((int(period),)) else 0
                self.sums.updateValue((int(period),), (old + int(n),))
            first = (int(periods.min()) + 1) * self.period
            if not self.next.exists() or self.next.get()[0] > first:
                if self.next.exists():
                    self.handle.deleteTimer(self.next.get()[0])
                self.handle.registerTimer(first)
                self.next.update((first,))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "tick_ms": pd.Series([], dtype="int64"), "buckets": pd.Series([], dtype="int64"), "total": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick, mark, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        sums = {k[0]: v[0] for k, v in self.sums.iterator()}
        while tick <= mark and sums:
            now = tick // self.period  # the period that begins at the tick; the one before it is current
            kept = [sums[p] for p in range(now - 1 - self.n, now - 1) if p in sums]
            if kept:
                out.append((key[0], tick, len(kept), sum(kept)))
            for p in [p for p in sums if p <= now - 1 - self.n]:
                self.sums.removeKey((p,))
                del sums[p]
            tick += self.period
        if sums:
            self.handle.registerTimer(tick)
            self.next.update((tick,))
        else:
            self.next.clear()
        yield pd.DataFrame(out, columns=["key", "tick_ms", "buckets", "total"])

    def close(self) -> None:
        pass


def rolling_history(rows: DataFrame, key: str, ts: str, value: str, period: dt.timedelta, n: int = 10, delay: str = "1 hour") -> DataFrame:
    """(key, tick_ms, buckets, total) at every period end: sums over the ``n`` periods before the one that ended.

    Periods without rows count neither as a bucket nor in the sum, and a tick without any bucket is not emitted.  State is at
    most n + 1 sums a key; a key whose periods have all gone keeps none.
    """
    marked = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    slim = marked.select(F.col(key).alias("key"), ts, F.floor(F.unix_millis(ts)).cast("long").alias("ms"), F.col(value).cast("long").alias("n"))
    return slim.groupBy("key").transformWithStateInPandas(
        RollingPeriods(int(period.total_seconds() * 1000), n), "key string, tick_ms long, buckets long, total long", outputMode="Append", timeMode="EventTime"
    )


class PendingRanges(StatefulProcessor):
    """Signals of a coin and a stretch of time, each with the run of prices that lies in its reach.

    A batch sorts its prices once and finds both ends of each signal's run by bisection, so no pair is formed.  Kept are the
    signals whose reach is still open and the prices they or later ones can meet.
    """

    def __init__(self, reach_us: int):
        self.reach = reach_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getValueState("prices", "us binary")
        self.signals = handle.getValueState("signals", "ids binary, us binary, found binary")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat([b[["id", "us", "price"]] for b in rows], ignore_index=True)
        price = come["price"].to_numpy(dtype=bool)
        us = come["us"].to_numpy(dtype=np.int64)
        ids, at, found, old_prices = self.read()
        new_prices, new_ids, new_at = np.sort(us[price]), come["id"].to_numpy(dtype=object)[~price], us[~price]
        prices = np.sort(np.concatenate([old_prices, new_prices]))
        # an old signal has met the old prices before, a new one meets all
        was, now = self.runs(key, ids, at, new_prices), self.runs(key, new_ids, new_at, prices)
        ids, at = np.concatenate([ids, new_ids]), np.concatenate([at, new_at])
        found = np.concatenate([found | (was["n_prices"].to_numpy() > 0), now["n_prices"].to_numpy() > 0])
        for out in (was, now):
            yield out[out["n_prices"] > 0]
        yield self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000, ids, at, found, prices)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next.clear()
        yield self.settle(key, timerValues.getCurrentWatermarkInMs() * 1000, *self.read())

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        prices = np.frombuffer(self.prices.get()[0], np.int64) if self.prices.exists() else np.empty(0, np.int64)
        if not self.signals.exists():
            return np.empty(0, object), np.empty(0, np.int64), np.empty(0, bool), prices
        ids, at, found = self.signals.get()
        with pa.ipc.open_stream(bytes(ids)) as packed:
            ids = packed.read_all().column("id").to_numpy()
        return ids, np.frombuffer(at, np.int64), np.frombuffer(found, bool), prices

    def runs(self, key, ids: np.ndarray, at: np.ndarray, prices: np.ndarray) -> pd.DataFrame:
        lo, hi = np.searchsorted(prices, at - self.reach, "left"), np.searchsorted(prices, at + self.reach, "right")
        met = hi > lo
        first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        first[met], last[met] = prices[lo[met]], prices[hi[met] - 1]
        coin = pd.Series(np.full(len(at), key[0], dtype=object), dtype=object)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "coin": coin, "signal_us": at, "n_prices": (hi - lo).astype(np.int64), "first_us": first, "last_us": last})

    def settle(self, key, mark: int, ids: np.ndarray, at: np.ndarray, found: np.ndarray, prices: np.ndarray) -> pd.DataFrame:
        """The signals that no price can reach any more; keeps what is open and sets the timer for what falls due first."""
        end = (int(key[1]) + 1) * self.reach
        closed = at + self.reach < mark
        gone = self.runs(key, ids[closed & ~found], at[closed & ~found], prices[:0])
        ids, at, found = ids[~closed], at[~closed], found[~closed]
        prices = prices[prices + self.reach > mark] if end > mark else prices[:0]  # old signals have met them, new ones would be late
        if len(prices):
            self.prices.update((prices.tobytes(),))
        else:
            self.prices.clear()
        if len(at):
            table, sink = pa.table({"id": pa.array(ids, pa.string())}), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as packed:
                packed.write_table(table)
            self.signals.update((sink.getvalue().to_pybytes(), at.tobytes(), found.tobytes()))
        else:
            self.signals.clear()
        if self.next.exists():
            self.handle.deleteTimer(self.next.get()[0])
            self.next.clear()
        if len(at) or len(prices):
            due = int(at[~found].min()) + self.reach if not found.all() else end + (self.reach if len(at) else 0)
            self.handle.registerTimer(due // 1000)
            self.next.update((due // 1000,))
        return gone

    def close(self) -> None:
        pass


def pending_matches(signals: DataFrame, prices: DataFrame, hours: int = 12, delay: str = "1 hour") -> DataFrame:
    """(id, coin, signal_at, n_prices, first_at, last_at): signals (id, coin_symbol, signal_at) with the prices at most ``hours`` away.

    The matches of a signal are a run of its coin's prices (coin_symbol, fetched_at, ...): ``n_prices`` of them, from ``first_at`` to
    ``last_at``.  Runs are what comes out, as pairs grow with the square of the rows in a period; ``match_pairs`` spells them out.  A run
    comes out as soon as both sides are there, one more for prices that come after it, and the counts add up; a signal without any comes
    out once, with 0 and nulls, when the watermark shows that no price in range can arrive any more.  Both sides leave the state when
    their range has passed.  A signal lies in one stretch of ``hours`` of its coin, a price in that and the two beside it, so a coin's
    rows are spread over tasks by time.  An id may be of any type that comes back from its text; the RocksDB state store is needed.
    """
    reach = hours * HOUR_US

    def side(rows: DataFrame, ts: str, ident: Column, price: bool) -> DataFrame:
        slim = rows.where(F.col(ts).isNotNull()).select(F.col(ts).alias("at"), ident.cast("string").alias("id"), F.col("coin_symbol").alias("coin"), F.lit(price).alias("price"))
        own = F.expr(f"(us - pmod(us, {reach}L)) div {reach}L")
        return slim.withWatermark("at", delay).withColumn("us", F.unix_micros("at")).withColumn("stretch", F.explode(F.array(own - 1, own, own + 1)) if price else own)

    s = side(signals, "signal_at", F.col("id"), False)
    p = side(prices.where(F.col("coin_symbol").isNotNull()), "fetched_at", F.lit(None), True)
    ranges = s.unionByName(p).groupBy("coin", "stretch").transformWithStateInPandas(
        PendingRanges(reach), "id string, coin string, signal_us long, n_prices long, first_us long, last_us long", outputMode="Append", timeMode="EventTime"
    )

    def when_met(us: str) -> Column:
        return F.when(F.col("n_prices") > 0, F.timestamp_micros(us))

    ident = F.col("id").cast(signals.schema["id"].dataType).alias("id")
    return ranges.select(ident, "coin", F.timestamp_micros("signal_us").alias("signal_at"), "n_prices", when_met("first_us").alias("first_at"), when_met("last_us").alias("last_at"))


def match_pairs(matches: DataFrame, prices: DataFrame) -> DataFrame:
    """(id, coin, signal_at, fetched_at, price_usd): each pair of the ``matches`` written so far and the prices that had arrived by then.

    A signal that expired stands once, with nulls; one that came several times keeps its pairs as often.  The rows are as many as the
    pairs, so ask for the signals that are needed.
    """
    on = ["id", "coin", "signal_at"]
    whole = matches.groupBy(*on).agg(F.sum("n_prices").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("first_at").alias("first"), F.max("last_at").alias("last"))
    p = prices.select("coin_symbol", "fetched_at", "price_usd")
    met = whole.join(p, (F.col("coin") == F.col("coin_symbol")) & F.col("fetched_at").between(F.col("first"), F.col("last")), "left")
    run = F.count(F.lit(1)).over(Window.partitionBy(*on))
    times = F.when(F.col("n") > 0, F.floor(F.col("n") / run)).otherwise(F.col("rows")).cast("int")
    return met.withColumn("times", times).select(*on, "fetched_at", "price_usd", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def first_wins(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Rows whose key has not come within ``delay`` of event time before; older keys leave the state."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
