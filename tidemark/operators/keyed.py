"""Per-key operators that stay safe when one key holds a large share of all rows.

``first_per_key``/``top_k`` rank inside the key and keep a constant number of
rows; Spark's window group limit drops the rest before the shuffle, so a hot
key costs k rows per map task.  ``sorted_parts`` is for operators that need a
total order inside a key (as-of, running values, numbering): rows are range
partitioned on (key, order), so a hot key spans many tasks, and callers carry
a constant amount of state from one part to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.semantics import col
from tidemark.session import cut_lineage


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than cores, dealt to all cores; tables of many files are left alone.

    For per-row work that is heavy on the CPU: one parquet row group is one
    task, however long its texts take.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def exploded(df: DataFrame, array: Column, name: str, *keep, pos: str | None = None) -> DataFrame:
    """One row per non-null array element.

    A plain explode makes the optimizer add a size test on the array, which
    evaluates a parsed or matched array a second time below the generator.
    """
    gen = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, gen).where(F.col(name).isNotNull())


def top_k(df: DataFrame, keys: Sequence, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    w = Window.partitionBy(*[col(c) for c in keys]).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def sorted_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], part: str = "_part") -> DataFrame:
    """Globally sort on (keys, order) and tag each row with its part and its place in the part.

    The sorted rows are checkpointed so that parts are the same however often
    the result is read.
    """
    s = df.sort(*[F.col(k) for k in keys], *order)
    s = s.withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    return s.withColumn(part, F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_mid")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_num") -> DataFrame:
    """Exact ``row_number`` per key without putting a key into one task."""
    keys = list(keys)
    s = sorted_parts(df, keys, order)
    local = s.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = local.select("_part", *keys, "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    on = ["_part", *keys]
    return (
        null_safe_join(s, offs, on)
        .withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_lo") + 1).cast("long"))
        .drop("_part", "_pos", "_lo", "_off")
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``on`` where null matches null; keeps the left copy of the keys."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Maximum so far per key, computed part by part with the carry of the earlier parts."""
    keys = list(keys)
    s = sorted_parts(df, keys, order)
    local = s.groupBy("_part", *keys).agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = local.select("_part", *keys, F.max("_m").over(before).alias("_carry"))
    here = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_here", F.max(value).over(here))
    return (
        null_safe_join(s, carry, ["_part", *keys])
        .withColumn(name, F.greatest("_here", "_carry"))
        .drop("_part", "_pos", "_here", "_carry")
    )


def asof_nearest(
    probes: DataFrame,
    ticks: DataFrame,
    key: str,
    probe_ts: str,
    tick_ts: str,
    value: str,
    tolerance_seconds: float,
    out: str = "nearest_value",
    out_ts: str = "nearest_ts",
) -> DataFrame:
    """Value of the tick closest to each probe within the tolerance; ties go to the earlier tick.

    Probes and ticks are merged on one sort of (key, time), so the work is
    linear in both inputs: no probe is paired with more than two ticks however
    dense a key or a period is.
    """
    one_tick = ticks.where(F.col(tick_ts).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_k"), F.unix_micros(F.col(tick_ts).cast("timestamp")).alias("_t")
    ).agg(F.min(value).alias("_v"))
    asked = probes.select(F.col(key).alias("_k"), F.unix_micros(F.col(probe_ts).cast("timestamp")).alias("_t")).where(
        F.col("_k").isNotNull() & F.col("_t").isNotNull()
    ).distinct()
    merged = one_tick.select("_k", "_t", F.lit(0).alias("_probe"), F.struct("_t", "_v").alias("_tick")).unionByName(
        asked.select("_k", "_t", F.lit(1).alias("_probe"), F.lit(None).cast("struct<_t:bigint,_v:double>").alias("_tick"))
    )
    s = sorted_parts(merged, ["_k"], [F.col("_t"), F.col("_probe")])

    edge = s.where(F.col("_probe") == 0).groupBy("_k", "_part").agg(
        F.min("_tick").alias("_first"), F.max("_tick").alias("_last")
    )
    parts = s.select("_k", "_part").distinct().join(edge, ["_k", "_part"], "left")
    up = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("_k").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        "_k", "_part",
        F.last("_last", ignorenulls=True).over(up).alias("_from_before"),
        F.last("_first", ignorenulls=True).over(down).alias("_from_after"),
    )
    fwd = Window.partitionBy("_part", "_k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy("_part", "_k").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = (
        s.withColumn("_prev", F.last("_tick", ignorenulls=True).over(fwd))
        .withColumn("_next", F.last("_tick", ignorenulls=True).over(bwd))
        .where(F.col("_probe") == 1)
        .join(carry, ["_k", "_part"])
        .select(
            "_k", "_t",
            F.coalesce("_prev", "_from_before").alias("_prev"),
            F.coalesce("_next", "_from_after").alias("_next"),
        )
    )
    tol = F.lit(int(tolerance_seconds * 1_000_000))
    back = F.col("_t") - F.col("_prev._t")
    ahead = F.col("_next._t") - F.col("_t")
    pick = F.when(
        (back <= tol) & (F.col("_next").isNull() | (ahead > tol) | (back <= ahead)), F.col("_prev")
    ).when(ahead <= tol, F.col("_next"))
    found = near.select("_k", "_t", pick.alias("_hit")).where(F.col("_hit").isNotNull()).select(
        F.col("_k"), F.col("_t"), F.col("_hit._v").alias(out), F.timestamp_micros("_hit._t").alias(out_ts)
    )
    p = probes.withColumn("_pt", F.unix_micros(F.col(probe_ts).cast("timestamp")))
    return p.join(found, (p[key] == found["_k"]) & (p["_pt"] == found["_t"]), "left").drop("_k", "_t", "_pt")


def asof_first_ticks(
    probes: DataFrame,
    ticks: DataFrame,
    key: str,
    probe_ts: str,
    tick_ts: str,
    value: str,
    tolerance_seconds: float,
    first: int = 5,
    out: str = "nearest_value",
) -> DataFrame:
    """Nearest among only the first few ticks of the tolerance range, oldest first.

    Ticks get their exact rank per key; the first tick at or after the range
    start is found by counting ticks before it, and each probe then looks up
    ``first`` consecutive ranks by equi join.
    """
    tol = int(tolerance_seconds * 1_000_000)
    t = ticks.where(F.col(tick_ts).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.unix_micros(F.col(tick_ts).cast("timestamp")).alias("_t"), F.col(value).alias("_v")
    )
    p = probes.withColumn("_pt", F.unix_micros(F.col(probe_ts).cast("timestamp")))
    starts = p.select(F.col(key).alias("_k"), (F.col("_pt") - tol).alias("_t")).where(
        F.col("_k").isNotNull() & F.col("_t").isNotNull()
    ).distinct()
    # probes sort before ticks of the same instant: the range start is inclusive
    merged = t.withColumn("_tick", F.lit(1)).unionByName(
        starts.withColumn("_v", F.lit(None).cast("double")).withColumn("_tick", F.lit(0))
    )
    # one sorted pass: the running number of ticks ranks each tick and counts the ticks before each start
    s = sorted_parts(merged, ["_k"], [F.col("_t"), F.col("_tick"), F.col("_v")])
    local = s.groupBy("_part", "_k").agg(F.sum("_tick").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = local.select("_part", "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    here = Window.partitionBy("_part", "_k").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    ranked = s.withColumn("_cum", F.sum("_tick").over(here)).join(offs, ["_part", "_k"]).withColumn("_cum", F.col("_off") + F.col("_cum"))
    tick_rank = ranked.where("_tick = 1").select("_k", F.col("_cum").alias("_rn"), "_t", "_v")
    pos = ranked.where("_tick = 0").select("_k", F.col("_t").alias("_from"), F.col("_cum").alias("_ticks_before"))
    look = pos.withColumn("_rn", F.explode(F.sequence(F.col("_ticks_before") + 1, F.col("_ticks_before") + first)))
    cand = look.join(tick_rank, ["_k", "_rn"]).where(F.col("_t") <= F.col("_from") + 2 * tol)
    best = cand.groupBy("_k", "_from").agg(
        F.min(F.struct(F.abs(F.col("_t") - F.col("_from") - tol).alias("d"), F.col("_t"), F.col("_v"))).alias("_b")
    ).select("_k", F.col("_from"), F.col("_b._v").alias(out))
    return p.join(best, (p[key] == best["_k"]) & (p["_pt"] - tol == best["_from"]), "left").drop("_k", "_from", "_pt")
