"""Windowed per-coin signals.

Mentions are reduced once to hourly partial sums per (coin, platform); the
four trailing windows, their previous windows and the ten-period history are
all sums over those partials.  A hot coin therefore reaches the shuffle as at
most hours x platforms rows per map task, and the raw tables are scanned once
each.  Slots count back from ``as_of``, so window edges fall on slot edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.operators.keyed import first_per_key, top_k
from tidemark.semantics import WINDOW_SECONDS, at, clamp, exact, js_round, mean, nz
from tidemark.session import cut_lineage

HOUR = 3600
HISTORY_PERIODS = 10
TYPES = ("fomo", "fud")
MAX_HOURS = max(WINDOW_SECONDS.values()) // HOUR


def slot(ts, as_of) -> Column:
    """Whole hours from ``as_of``; 0 is the instant itself, -1 the hour before it."""
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(at(as_of))) / F.lit(HOUR * 1_000_000.0)).cast("int")


def recent(df: DataFrame, ts: str, as_of, hours: int) -> DataFrame:
    """Rows of the last ``hours``, both ends included; the plain range reaches the scan."""
    lo = F.timestamp_micros(F.unix_micros(at(as_of)) - F.lit(hours * HOUR * 1_000_000))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= at(as_of)))


def hourly_counts(mentions: DataFrame, as_of, periods: int = HISTORY_PERIODS) -> DataFrame:
    """(coin_symbol, slot, n): the partial that counts, velocity and history share."""
    m = recent(mentions, "created_at", as_of, MAX_HOURS * (periods + 1))
    return m.groupBy("coin_symbol", slot("created_at", as_of).alias("slot")).agg(
        F.sum("mention_count").cast("long").alias("n")
    )


def window_rows(partials: DataFrame, windows: Sequence[str], periods: int = 0) -> DataFrame:
    """Attach each hourly partial to the windows it falls in: ``bucket`` 0 is current, 1 the one before, ..."""
    opts = F.array(*[F.struct(F.lit(w).alias("time_window"), F.lit(WINDOW_SECONDS[w] // HOUR).alias("h")) for w in windows])
    s = F.col("slot")
    w = partials.withColumn("_w", F.explode(opts)).select("*", "_w.time_window", F.col("_w.h").alias("_h")).drop("_w")
    # the current window is closed at both ends, earlier ones are half open
    bucket = F.when(s >= -F.col("_h"), F.lit(0)).otherwise(F.floor((-s - 1) / F.col("_h")).cast("int"))
    return w.withColumn("bucket", bucket).where(F.col("bucket") <= max(1, periods)).drop("_h")


def window_counts(hourly: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Current and previous mention totals per (coin, window), only for coins mentioned now."""
    return (
        window_rows(hourly, windows)
        .groupBy("coin_symbol", "time_window")
        .agg(
            F.coalesce(F.sum(F.when(F.col("bucket") == 0, F.col("n"))), F.lit(0)).alias("mentions"),
            F.coalesce(F.sum(F.when(F.col("bucket") == 1, F.col("n"))), F.lit(0)).alias("prev_mentions"),
            F.max(F.when(F.col("bucket") == 0, 1)).alias("_now"),
        )
        .where("_now = 1")
        .drop("_now")
    )


def velocity(cur, prev) -> Column:
    c, p = F.col(cur).cast("double"), F.col(prev).cast("double")
    return F.when(p > 0, (c - p) / p).otherwise(F.lit(0.0))


def history_stats(hourly: DataFrame, windows: Sequence[str], periods: int = HISTORY_PERIODS, fill_zero: bool = False) -> DataFrame:
    """Population mean and deviation of past bucket totals per (coin, window), from exact integer sums.

    Empty buckets are left out, as the source does; ``fill_zero`` counts them as zero.
    """
    b = (
        window_rows(hourly, windows, periods)
        .where("bucket >= 1")
        .groupBy("coin_symbol", "time_window", "bucket")
        .agg(F.sum("n").cast("decimal(19,0)").alias("b"))
    )
    k = F.lit(periods).cast("decimal(10,0)") if fill_zero else F.count(F.lit(1)).cast("decimal(10,0)")
    g = b.groupBy("coin_symbol", "time_window").agg(
        k.alias("_k"), F.sum("b").cast("decimal(19,0)").alias("_s"), F.sum((F.col("b") * F.col("b")).cast("decimal(27,0)")).alias("_q")
    )
    kd, sd, qd = (F.col(c).cast("double") for c in ("_k", "_s", "_q"))
    spread = (F.col("_k") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    return g.select(
        "coin_symbol", "time_window", F.col("_k").cast("int").alias("hist_buckets"), (sd / kd).alias("hist_mean"),
        (F.sqrt(F.greatest(spread, F.lit(0.0))) / kd).alias("hist_std"),
    )


def phrase_flags(sentiments: DataFrame) -> DataFrame:
    """Adds one boolean per event class from the ``key_phrases`` array, without exploding it."""
    p = F.coalesce(F.col("key_phrases"), F.array().cast("array<string>"))

    def seen(name: str) -> Column:
        return F.exists(p, lambda x: S.phrase_class(x, name))

    return sentiments.withColumns({f"ev_{n}": seen(n) for n in S.EVENT_CLASSES}).drop("key_phrases")


def hourly_facts(mentions: DataFrame, posts: DataFrame, sentiments: DataFrame, as_of) -> DataFrame:
    """Additive facts per (coin, platform, hour slot) over the current and previous windows."""
    m = recent(mentions, "created_at", as_of, 2 * MAX_HOURS).select(
        "post_id", "coin_symbol", slot("created_at", as_of).alias("slot")
    )
    p = posts.select(
        F.col("id").alias("post_id"), F.col("source").alias("platform"), F.lit(True).alias("_has_post"),
        (nz("upvotes") + nz("num_comments") * 2 + nz("num_awards") * 5).cast("long").alias("_eng"),
    )
    s = phrase_flags(sentiments).withColumn("_s", exact("sentiment_score")).select(
        "post_id", "_s", exact(nz("fomo_score")).alias("_fomo"), exact(nz("fud_score")).alias("_fud"),
        *[f"ev_{n}" for n in S.EVENT_CLASSES],
    )
    j = m.join(p, "post_id", "left").join(s, "post_id", "left")
    has = F.col("_has_post") & F.col("_s").isNotNull()
    pos, neg = has & (F.col("_s") >= 0), has & (F.col("_s") <= 0)
    return j.groupBy("coin_symbol", "platform", "slot").agg(
        F.sum("_eng").alias("eng"),
        F.count_if(pos).alias("fomo_n"), F.sum(F.when(pos, F.col("_s"))).alias("fomo_s"),
        F.sum(F.when(pos, F.col("_fomo"))).alias("fomo_d"), F.count_if(has & (F.col("_s") > 0)).alias("fomo_bull"),
        F.count_if(neg).alias("fud_n"), F.sum(F.when(neg, F.col("_s"))).alias("fud_s"),
        F.sum(F.when(neg, F.col("_fud"))).alias("fud_d"),
        F.count("_s").alias("all_n"), F.sum("_s").alias("all_s"),
        *[F.max((has & F.col(f"ev_{n}")).cast("int")).alias(f"ev_{n}") for n in S.EVENT_CLASSES],
    )


def window_facts(facts: DataFrame, windows: Sequence[str]) -> DataFrame:
    """Roll the hourly facts up to (coin, window)."""
    now, before = F.col("bucket") == 0, F.col("bucket") == 1

    def total(c: str) -> Column:
        return F.sum(F.when(now, F.col(c))).alias(c)

    return window_rows(facts, windows).groupBy("coin_symbol", "time_window").agg(
        *[total(c) for c in ("eng", "fomo_n", "fomo_s", "fomo_d", "fomo_bull", "fud_n", "fud_s", "fud_d")],
        F.count_distinct(F.when(now, F.col("platform"))).cast("int").alias("source_count"),
        F.sum(F.when(before, F.col("all_n"))).alias("prev_n"),
        F.sum(F.when(before, F.col("all_s"))).alias("prev_s"),
        *[F.coalesce(F.max(F.when(now, F.col(f"ev_{n}"))), F.lit(0)).alias(f"ev_{n}") for n in S.EVENT_CLASSES],
    )


def latest_price(prices: DataFrame, value: str = "price_usd", key: str = "coin_symbol", tie: str = "id") -> DataFrame:
    """Latest value per key; a max over (time, id) combines map side, so a hot key is no problem."""
    order = F.struct(F.col("fetched_at"), F.col(tie))
    return prices.groupBy(key).agg(F.max_by(value, order).alias(value))


def trending_ranks(posts: DataFrame, coins: DataFrame, as_of) -> DataFrame:
    """Best trending rank per symbol in the last 6 hours: by coin id, else by the symbol in the title."""
    t = posts.where(
        (F.col("source") == "coingecko") & (F.col("crawled_at") >= F.timestamp_micros(F.unix_micros(at(as_of)) - 6 * HOUR * 1_000_000))
    )
    by_id = (
        t.join(coins.select("coingecko_id", F.upper("symbol").alias("coin_symbol")), "coingecko_id")
        .groupBy("coin_symbol").agg(F.min("trending_rank").alias("_a"))
    )
    sym = F.regexp_extract("title", r"\(([A-Z]{2,10})\)", 1)
    by_title = (
        t.where(F.col("trending_rank").isNotNull() & (sym != ""))
        .groupBy(sym.alias("coin_symbol")).agg(F.min("trending_rank").alias("_b"))
    )
    return by_id.join(by_title, "coin_symbol", "full_outer").select("coin_symbol", F.coalesce("_a", "_b").alias("trending_rank"))


def graph_context(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per coin: entity confidence, strongest recommendation, impact counts (relations with weight > 0)."""
    coin = entities.where("entity_type = 'coin'").select(
        F.col("id").alias("eid"), F.col("symbol").alias("coin_symbol"), F.coalesce("confidence", F.lit(1.0)).alias("entity_conf")
    )
    r = relations.where("weight > 0 AND relation_type IN ('recommends', 'impacts')").groupBy(F.col("target_id").alias("eid")).agg(
        F.max(F.when(F.col("relation_type") == "recommends", F.coalesce("confidence", F.lit(1.0)) * F.col("weight") / 10)).alias("_rec"),
        *[F.count_if((F.col("relation_type") == "impacts") & c).alias(a) for c, a in [
            (F.col("impact") == "positive", "n_pos"), (F.col("impact") == "negative", "n_neg"), (F.lit(True), "n_impacts")]],
    )
    return coin.join(r, "eid", "left").select(
        "coin_symbol", "entity_conf", F.least(F.coalesce("_rec", F.lit(0.0)), F.lit(1.0)).alias("rec_strength"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pos", "n_neg", "n_impacts")],
    )


def coin_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Correlated coin pairs in both directions as (coin_symbol, peer, weight)."""
    c = entities.where("entity_type = 'coin'").select("id", "symbol")
    e = (
        relations.where("weight > 0 AND relation_type = 'correlates_with'")
        .join(c.select(F.col("id").alias("source_id"), F.col("symbol").alias("a")), "source_id")
        .join(c.select(F.col("id").alias("target_id"), F.col("symbol").alias("b")), "target_id")
    )
    return e.select(F.explode(F.array(
        F.struct(F.col("a").alias("coin_symbol"), F.col("b").alias("peer"), "weight"),
        F.struct(F.col("b").alias("coin_symbol"), F.col("a").alias("peer"), "weight"),
    )).alias("e")).select("e.*")


def narrative_members(entities: DataFrame, relations: DataFrame) -> DataFrame:
    c = entities.where("entity_type = 'coin'").select(F.col("id").alias("source_id"), F.col("symbol").alias("coin_symbol"))
    return (
        relations.where("weight > 0 AND relation_type = 'part_of'").join(c, "source_id")
        .select("coin_symbol", F.col("target_id").cast("string").alias("narrative")).distinct()
    )


def hot_peer_weights(base: DataFrame, edges: DataFrame, keys: Sequence[str] = ("time_window", "signal_type")) -> DataFrame:
    """The three heaviest links of each coin to peers scoring at least 60, as an array."""
    hot = base.where(F.col("base_score") >= S.PEER_HOT).select(F.col("coin_symbol").alias("peer"), *keys)
    j = edges.join(hot, "peer")
    best = top_k(j, ["coin_symbol", *keys], [F.col("weight").desc(), F.col("peer")], S.PEERS_USED, "_r")
    return best.groupBy("coin_symbol", *keys).agg(
        F.sort_array(F.collect_list(F.col("weight").cast("double")), asc=False).alias("peer_weights")
    )


def narrative_average(
    base: DataFrame, members: DataFrame, keys: Sequence[str] = ("time_window", "signal_type"), last_only: bool = False
) -> DataFrame:
    """Average positive score over the distinct peers of a coin's narratives, without pairing coins.

    Coins with the same set of narratives share one peer set; its total is
    computed once per set and each coin takes itself out of it.
    """
    keys = list(keys)
    m = members.groupBy("coin_symbol").agg(F.max("narrative").alias("narrative")) if last_only else members
    sig = m.groupBy("coin_symbol").agg(F.array_sort(F.collect_set("narrative")).alias("sig"))
    peers = (
        sig.select("sig").distinct().withColumn("narrative", F.explode("sig"))
        .join(m, "narrative").select("sig", "coin_symbol").distinct()
    )
    pos = base.where("base_score > 0").select("coin_symbol", *keys, exact("base_score", 10, 28).alias("_b"))
    tot = peers.join(pos, "coin_symbol").groupBy("sig", *keys).agg(F.sum("_b").alias("_t"), F.count(F.lit(1)).alias("_n"))
    own = sig.join(tot, "sig").join(pos, ["coin_symbol", *keys], "left")
    n = F.col("_n") - F.col("_b").isNotNull().cast("int")
    return own.select(
        "coin_symbol", *keys,
        F.when(n > 0, (F.col("_t") - F.coalesce("_b", F.lit(0))).cast("double") / n).alias("narrative_avg"),
    )


def first_posts(mentions: DataFrame, posts: DataFrame, sentiments: DataFrame, as_of, windows: Sequence[str]) -> DataFrame:
    """The first five posts met per (coin, window), then ordered by score, as an array of structs."""
    m = recent(mentions, "created_at", as_of, MAX_HOURS).withColumn("slot", slot("created_at", as_of)).join(
        posts.select(F.col("id").alias("post_id")), "post_id", "left_semi"
    )
    w = window_rows(m, windows).where("bucket = 0")
    five = top_k(w, ["coin_symbol", "time_window"], [F.col("created_at"), F.col("post_id")], 5)
    j = five.join(posts.select(F.col("id").alias("post_id"), "title", "score", "channel"), "post_id").join(
        sentiments.select("post_id", "sentiment_score"), "post_id", "left"
    )
    item = F.struct(
        F.col("score"), F.col("post_id").alias("source_id"), "title", nz("sentiment_score").alias("sentiment_score"), "channel"
    )
    return j.groupBy("coin_symbol", "time_window").agg(F.sort_array(F.collect_list(item), asc=False).alias("top_posts"))


def score_by_type(d: DataFrame, types: Sequence[str] = TYPES) -> DataFrame:
    """Turn one (coin, window) row into one row per signal type with its base score."""
    d = d.withColumn("signal_type", F.explode(F.array(*[F.lit(t) for t in types])))
    fomo = F.col("signal_type") == "fomo"

    def by_type(a: str, b: str | Column) -> Column:
        return F.when(fomo, F.col(a)).otherwise(F.col(b) if isinstance(b, str) else b)

    flags = {n: F.col(f"ev_{n}") == 1 for n in S.EVENT_CLASSES}
    d = d.withColumns({
        "_n": F.coalesce(by_type("fomo_n", "fud_n"), F.lit(0)),
        "_bull": F.coalesce(by_type("fomo_bull", F.lit(0)), F.lit(0)),
        "velocity": velocity("mentions", "prev_mentions"),
        "avg_s": mean(by_type("fomo_s", "fud_s"), by_type("fomo_n", "fud_n")),
        "avg_d": mean(by_type("fomo_d", "fud_d"), by_type("fomo_n", "fud_n")),
        "eng_pm": mean(F.coalesce("eng", F.lit(0)), "mentions"),
        "z": S.z_score("mentions", "hist_buckets", "hist_mean", "hist_std"),
    })
    d = d.withColumn("trend", F.when(F.col("prev_n") > 0, F.col("avg_s") - mean("prev_s", "prev_n")).otherwise(F.lit(0.0)))
    w = S.WEIGHTS
    raw = (
        S.velocity_norm("velocity") * w["velocity"]
        + F.when(fomo, S.sentiment_norm("avg_s")).otherwise(S.fud_sentiment_norm("avg_s")) * w["sentiment"]
        + S.trend_norm("trend") * w["trend"]
        + S.engagement_norm("eng_pm") * w["engagement"]
        + S.share_norm("avg_d") * w["direction"]
    )
    conf = S.mention_confidence("mentions")
    conf = F.when(F.col("trending_rank").isNotNull(), F.greatest(conf, F.lit(S.TRENDING_MIN_CONFIDENCE))).otherwise(conf)
    ev = clamp(
        S.event_modifier(flags) + S.trending_modifier("trending_rank") + F.coalesce("onchain_modifier", F.lit(0.0)),
        S.EVENT_FLOOR, S.EVENT_CEILING,
    )
    names = F.concat(
        S.event_names(flags),
        F.when(F.col("trending_rank").isNotNull(), F.array(F.lit("coingecko_trending"))).otherwise(F.array().cast("array<string>")),
        F.coalesce("onchain_names", F.array().cast("array<string>")),
    )
    return d.withColumns({
        "event_modifier": ev,
        "detected_events": names,
        "base_score": raw * conf * S.market_cap_dampening("market_cap_rank", "market_cap") * S.z_multiplier("z")
        * S.platform_multiplier("source_count") + ev,
        "contrarian_warning": S.contrarian_warning("_n", "_bull"),
        "sentiment_skew": S.sentiment_skew("_n", "_bull"),
    })


def base_scores(
    mentions: DataFrame, posts: DataFrame, sentiments: DataFrame, coins: DataFrame, prices: DataFrame, as_of,
    windows: Sequence[str] = tuple(WINDOW_SECONDS), types: Sequence[str] = TYPES,
    trending: DataFrame | None = None, onchain: DataFrame | None = None,
) -> DataFrame:
    """First pass: everything but the graph boost."""
    hourly = hourly_counts(mentions, as_of)
    rank = coins.groupBy(F.upper("symbol").alias("coin_symbol")).agg(F.min("market_cap_rank").alias("market_cap_rank"))
    d = (
        window_counts(hourly, windows)
        .join(window_facts(hourly_facts(mentions, posts, sentiments, as_of), windows), ["coin_symbol", "time_window"], "left")
        .join(history_stats(hourly, windows), ["coin_symbol", "time_window"], "left")
        .join(rank, "coin_symbol", "left")
        .join(latest_price(prices, "market_cap"), "coin_symbol", "left")
    )
    d = d.join(trending, "coin_symbol", "left") if trending is not None else d.withColumn("trending_rank", F.lit(None).cast("int"))
    if onchain is not None:
        d = d.join(onchain, "coin_symbol", "left")
    else:
        d = d.withColumns({"onchain_modifier": F.lit(0.0), "onchain_names": F.array().cast("array<string>")})
    d = d.withColumns({"source_count": F.coalesce("source_count", F.lit(0)), "hist_buckets": F.coalesce("hist_buckets", F.lit(0))})
    return score_by_type(d, types)


def final_scores(
    base: DataFrame, context: DataFrame | None = None, edges: DataFrame | None = None, members: DataFrame | None = None,
    last_narrative_only: bool = False,
) -> DataFrame:
    """Second pass: add the graph boost, which needs the first-pass scores of peers, and round for storage."""
    keys = ["coin_symbol", "time_window", "signal_type"]
    d = base
    if edges is not None or members is not None:
        d = cut_lineage(base)
    empty = {"peer_weights": F.array().cast("array<double>"), "narrative_avg": F.lit(None).cast("double")}
    scored = d
    if edges is not None:
        scored = scored.join(hot_peer_weights(d, edges), keys, "left")
        empty.pop("peer_weights")
    if members is not None:
        scored = scored.join(narrative_average(d, members, last_only=last_narrative_only), keys, "left")
        empty.pop("narrative_avg")
    scored = scored.withColumns(empty)
    ctx = {"entity_conf": 1.0, "rec_strength": 0.0, "n_pos": 0, "n_neg": 0, "n_impacts": 0}
    if context is not None:
        scored = scored.join(context, "coin_symbol", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in ctx.items()})
    else:
        scored = scored.withColumns({c: F.lit(v) for c, v in ctx.items()})
    scored = scored.withColumn("kg", S.graph_boost("rec_strength", "peer_weights", "entity_conf", "narrative_avg", "n_pos", "n_neg", "n_impacts"))
    score = clamp(F.col("base_score") * F.col("kg.multiplier") + F.col("kg.boost"), 0, 100)
    return scored.select(
        *keys, F.col("mentions").alias("mention_count"),
        js_round("velocity", 4).alias("mention_velocity"), js_round("avg_s", 3).alias("avg_sentiment"),
        js_round("trend", 3).alias("sentiment_trend"), js_round(score, 2).alias("weighted_score"),
        js_round("eng_pm", 2).alias("engagement_score"), S.signal_label(score).alias("signal_label"),
        js_round("avg_d", 3).alias("fomo_avg"), js_round("z", 3).alias("z_score"), "source_count", "contrarian_warning",
        "sentiment_skew", "detected_events", "event_modifier", js_round("kg.boost", 2).alias("kg_boost"),
        F.col("kg.multiplier").alias("kg_multiplier"), F.col("kg.details").alias("kg_details"),
    )


def generate_signals(
    mentions: DataFrame, posts: DataFrame, sentiments: DataFrame, coins: DataFrame, prices: DataFrame, as_of,
    entities: DataFrame | None = None, relations: DataFrame | None = None,
    trending: DataFrame | None = None, onchain: DataFrame | None = None,
    windows: Sequence[str] = tuple(WINDOW_SECONDS), types: Sequence[str] = TYPES, with_posts: bool = False,
    last_narrative_only: bool = False,
) -> DataFrame:
    """All signals of one run, stamped with ``as_of``; the graph is the one of the previous run."""
    base = base_scores(mentions, posts, sentiments, coins, prices, as_of, windows, types, trending, onchain)
    if relations is None:
        out = final_scores(base)
    else:
        out = final_scores(
            base, graph_context(entities, relations), coin_edges(entities, relations),
            narrative_members(entities, relations), last_narrative_only,
        )
    if with_posts:
        out = out.join(first_posts(mentions, posts, sentiments, as_of, windows), ["coin_symbol", "time_window"], "left")
    return out.withColumn("computed_at", at(as_of))


def onchain_signals(pairs: DataFrame, symbols: DataFrame, boosted: DataFrame, min_liquidity: float = 1000.0) -> DataFrame:
    """Main pair per symbol (highest liquidity) to its events: (coin_symbol, onchain_modifier, onchain_names, events)."""
    p = pairs.withColumn("coin_symbol", F.upper("symbol")).where(
        (F.col("liquidity_usd") > min_liquidity) & ~F.col("coin_symbol").isin(*LARGE_COINS)
    )
    p = p.join(symbols.select(F.upper("coin_symbol").alias("coin_symbol")).distinct(), "coin_symbol", "left_semi")
    best = first_per_key(p, ["coin_symbol"], [F.col("liquidity_usd").desc(), F.col("token_address")])
    b = boosted.select(F.lower("token_address").alias("_addr")).distinct().withColumn("_boosted", F.lit(True))
    best = best.join(b, F.lower("token_address") == F.col("_addr"), "left")
    ev = S.onchain_events("volume_h1", "volume_h6", "volume_h24", "liquidity_usd", "buys_h24", "sells_h24", F.coalesce("_boosted", F.lit(False)))
    return best.select("coin_symbol", ev.alias("events")).where(F.size("events") > 0).select(
        "coin_symbol",
        F.aggregate("events", F.lit(0.0), lambda a, e: a + e["modifier"]).alias("onchain_modifier"),
        F.transform("events", lambda e: F.concat(F.lit("dex:"), e["type"])).alias("onchain_names"), "events",
    )


# Large coins whose on-chain volume says little.
LARGE_COINS = [
    "BTC", "ETH", "BNB", "SOL", "XRP", "ADA", "AVAX", "DOT", "MATIC", "LINK", "ATOM", "LTC", "FIL", "NEAR", "APT",
    "ARB", "OP", "SUI", "SEI", "INJ", "TIA",
]
