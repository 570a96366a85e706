"""Scoring formulas as Column -> Column expressions; all of them stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.semantics import clamp, col, js_round, nz, ratio

# Weights, thresholds and tiers of the scoring rules.
WEIGHTS = {"velocity": 0.25, "sentiment": 0.30, "trend": 0.15, "engagement": 0.20, "direction": 0.10}
MIN_MENTIONS = 5
REFERENCE_CAP = 50_000_000.0
CAP_POWER = 0.3
CAP_FLOOR = 0.05
RANK_FLOOR = 0.15
MAX_RANK = 200
SPIKE = 2.0
SPIKE_SLOPE = 0.25
SPIKE_MAX = 1.5
PLATFORM = {"single": 0.7, "dual": 1.0, "multi": 1.3}
CONTRARIAN = 0.85
EVENT_FLOOR, EVENT_CEILING = -30.0, 25.0
TRENDING_MIN_CONFIDENCE = 0.4
LABEL_CUTS = [(80, "extremely_hot"), (60, "hot"), (40, "warm"), (20, "cool")]
LABELS = ["extremely_hot", "hot", "warm", "cool", "cold"]
BULLISH = ["extremely_hot", "hot"]
BEARISH = ["cold", "cool"]

# Phrase classes and their score change.
EVENT_CLASSES = {
    "exchange_listing": (15, ["listing", "listed on binance", "listed on coinbase", "coinbase listing", "binance listing", "upbit listing"]),
    "security_incident": (-20, ["hacked", "exploit", "rug pull", "rugpull", "rugged", "vulnerability", "breach", "drained", "funds stolen"]),
    "whale_buy": (10, ["whale buy", "whale accumulation", "whale bought", "whales accumulating", "large purchase"]),
    "whale_sell": (-10, ["whale sell", "whale dump", "whale sold", "whales dumping", "large sell-off"]),
    "regulatory_positive": (10, ["etf approved", "sec approves", "regulation positive", "legal win", "etf approval"]),
    "regulatory_negative": (-15, ["sec lawsuit", "sec sues", "banned", "delisted", "crackdown", "regulation negative"]),
    "partnership": (8, ["partnership", "partners with", "integrates with", "collaboration", "strategic alliance"]),
    "airdrop": (5, ["airdrop", "token distribution", "free tokens"]),
}

# Graph boost.
RECOMMEND_MAX = 0.15
PEER_BOOST = 5.0
PEER_HOT = 60.0
PEER_WEIGHT_CAP = 10.0
PEERS_USED = 3
NARRATIVE_BOOST = 4.0
IMPACT_BOOST = 3.0
BOOST_LIMIT = 15.0
ENTITY_CONF_FLOOR = 0.3


def shifted_norm(x) -> Column:
    """(x + 1) * 50 in [0, 100]: velocity, sentiment and trend share it."""
    return clamp((col(x) + F.lit(1.0)) * F.lit(50.0), 0, 100)


velocity_norm = sentiment_norm = trend_norm = shifted_norm


def engagement_norm(per_mention) -> Column:
    return clamp(F.log10(col(per_mention) + F.lit(1.0)) * F.lit(25.0), 0, 100)


def share_norm(x) -> Column:
    return clamp(col(x) * F.lit(100.0), 0, 100)


fomo_norm = fud_norm = share_norm


def fud_sentiment_norm(avg) -> Column:
    return clamp(F.abs(F.least(col(avg), F.lit(0.0))) * F.lit(100.0), 0, 100)


def signal_label(score) -> Column:
    s, out = col(score), None
    for cut, name in LABEL_CUTS:
        out = F.when(s >= cut, name) if out is None else out.when(s >= cut, name)
    return out.otherwise("cold")


def mention_confidence(n) -> Column:
    return clamp(col(n).cast("double") / F.lit(float(MIN_MENTIONS)), 0, 1)


def market_cap_dampening(rank, cap_usd) -> Column:
    cap, rank = col(cap_usd).cast("double"), col(rank).cast("double")
    by_cap = F.when(cap <= REFERENCE_CAP, F.lit(1.0)).otherwise(
        clamp(F.pow(F.lit(REFERENCE_CAP) / cap, F.lit(CAP_POWER)), CAP_FLOOR, 1)
    )
    log_share = F.log10(rank) / F.lit(math.log10(MAX_RANK))
    by_rank = clamp(F.lit(RANK_FLOOR) + F.lit(1 - RANK_FLOOR) * log_share, RANK_FLOOR, 1)
    return F.when(cap > 0, by_cap).when(rank > 0, by_rank).otherwise(F.lit(1.0))


def z_score(current, n_buckets, bucket_mean, bucket_std) -> Column:
    std = col(bucket_std)
    return F.when((col(n_buckets) < 3) | std.isNull() | (std == 0), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(col(current).cast("double") - col(bucket_mean), std), F.lit(0.0))
    )


def z_multiplier(z) -> Column:
    z = col(z)
    return F.when(z <= SPIKE, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0) + (z - F.lit(SPIKE)) * F.lit(SPIKE_SLOPE), F.lit(SPIKE_MAX))
    )


def platform_multiplier(n_sources) -> Column:
    n = col(n_sources)
    return F.when(n <= 1, F.lit(PLATFORM["single"])).when(n == 2, F.lit(PLATFORM["dual"])).otherwise(
        F.lit(PLATFORM["multi"])
    )


def sentiment_skew(n, n_bullish) -> Column:
    return F.when(col(n) < 5, F.lit(50.0)).otherwise(
        F.coalesce(js_round(ratio(n_bullish, n) * F.lit(100.0)), F.lit(50.0))
    )


def contrarian_warning(n, n_bullish) -> Column:
    r = ratio(n_bullish, n)
    return F.when(col(n) >= 5, F.when(r > CONTRARIAN, "potential_reversal").when(r < 1 - CONTRARIAN, "potential_bounce"))


def phrase_class(phrase, name: str) -> Column:
    """Whether one phrase falls into an event class (plain substring rule, so 'delisting' holds 'listing')."""
    low = F.lower(col(phrase))
    hits = [low.contains(k) for k in EVENT_CLASSES[name][1]]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def event_modifier(flags: dict[str, Column]) -> Column:
    """Sum of the changes of the classes seen; each class counts once. ``flags`` are booleans per class."""
    total = F.lit(0.0)
    for name, flag in flags.items():
        total = total + F.when(flag, F.lit(float(EVENT_CLASSES[name][0]))).otherwise(F.lit(0.0))
    return clamp(total, EVENT_FLOOR, EVENT_CEILING)


def event_names(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))


def trending_modifier(rank) -> Column:
    r = col(rank)
    return F.when(r.isNull(), F.lit(0.0)).when(r <= 3, F.lit(12.0)).when(r <= 7, F.lit(8.0)).otherwise(F.lit(5.0))


def graph_boost(strength, peer_weights, entity_confidence, narrative_avg, n_positive, n_negative, n_impacts) -> Column:
    """Struct(boost, multiplier, details) from one coin's graph context. ``peer_weights`` is already ordered."""
    s, peers, nav = col(strength), F.coalesce(col(peer_weights), F.array().cast("array<double>")), col(narrative_avg)
    conf = clamp(entity_confidence, ENTITY_CONF_FLOOR, 1)
    used = F.slice(peers, 1, PEERS_USED)
    peer_part = F.aggregate(
        used, F.lit(0.0), lambda acc, w: acc + F.lit(PEER_BOOST) * clamp(w / F.lit(PEER_WEIGHT_CAP), 0, 1)
    )
    nav_part = F.coalesce((nav - 50) / 50 * F.lit(NARRATIVE_BOOST), F.lit(0.0))
    impact_part = (col(n_positive) - col(n_negative)).cast("double") * F.lit(IMPACT_BOOST)
    boost = clamp(peer_part + nav_part + impact_part, -BOOST_LIMIT, BOOST_LIMIT) * conf
    multiplier = F.when(s > 0, F.lit(1.0) + F.lit(RECOMMEND_MAX) * clamp(s, 0, 1)).otherwise(F.lit(1.0))
    details = F.array_compact(F.array(
        F.when(s > 0, F.format_string("influencer_recommends(%.2f)", s)),
        F.when(F.size(peers) > 0, F.format_string("correlated_hot×%d(w)", F.least(F.size(peers), F.lit(PEERS_USED)))),
        F.when(nav.isNotNull(), F.format_string("narrative_momentum(%.0f)", nav)),
        F.when(col(n_impacts) > 0, F.format_string("event_impacts×%d", col(n_impacts).cast("int"))),
        F.when(conf < 1, F.format_string("entity_conf(%.2f)", conf)),
    ))
    return F.struct(boost.alias("boost"), multiplier.alias("multiplier"), details.alias("details"))


def onchain_events(vol_1h, vol_6h, vol_24h, liquidity, buys, sells, boosted) -> Column:
    """Array of (type, modifier, detail) for one token's main trading pair."""
    v1, v24, liq = (nz(c) for c in (vol_1h, vol_24h, liquidity))
    hourly = nz(vol_6h) / F.lit(6.0)
    pressure = F.try_divide(nz(sells), nz(buys))

    def ev(kind: str, change: float, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(change).alias("modifier"), detail.alias("detail"))

    return F.array_compact(F.array(
        F.when((hourly > 0) & (v1 > hourly * 5), ev(
            "volume_spike", 7.0, F.format_string("h1 vol %.0fx vs h6 avg", js_round(F.try_divide(v1, hourly))))),
        F.when((v24 > 0) & (liq < v24 * 0.5), ev(
            "liquidity_drain", -12.0, F.format_string("liq $%.0f < 50%% of 24h vol", js_round(liq)))),
        F.when(pressure > 3, ev("sell_pressure", -5.0, F.format_string("sell/buy ratio %.1fx", pressure))),
        F.when(col(boosted), ev("token_boosted", -3.0, F.lit("promoted token"))),
    ))


def evaluate_hit(label, pct, kind) -> Column:
    up = F.when(col(kind) == "fud", -col(pct)).otherwise(col(pct))
    return F.when(col(label).isin(BULLISH), up > 0).when(col(label).isin(BEARISH), up < 0).otherwise(F.abs(col(pct)) < 2)


def pct_change(before, after) -> Column:
    return F.try_divide(col(after) - col(before), col(before)) * F.lit(100.0)


def price_text(p) -> Column:
    """Price with decimals by tier, as dashboards show it."""
    p = col(p)
    return (
        F.when(p >= 1, F.format_string("%.2f", p))
        .when(p >= 0.01, F.format_string("%.4f", p))
        .otherwise(F.format_string("%.6f", p))
    )


def entity_confidence(kind: str, n, n_sources=None) -> Column:
    n = col(n).cast("double")
    if kind == "coin":
        e = F.lit(0.3) + n / 10 * 0.3 + col(n_sources) * 0.2
    elif kind == "influencer":
        e = F.lit(0.4) + n / 10 * 0.3 + col(n_sources) * 0.15
    elif kind == "narrative_model":
        e = F.lit(0.6) + n * 0.1
    elif kind == "narrative_fixed":
        e = F.lit(0.5) + n * 0.1
    elif kind == "event_model":
        e = F.lit(0.75)
    elif kind == "event_keyword":
        e = F.lit(0.6)
    else:
        e = F.when(n >= 5, 0.9).when(n >= 2, 0.6).otherwise(0.3)
    return F.least(e, F.lit(1.0))


def decayed_confidence(original, days_since_seen, threshold_days: float = 7.0) -> Column:
    """0.85 per day beyond the threshold, never under 0.05; unchanged before it."""
    base = F.when(nz(original) == 0, F.lit(0.6)).otherwise(col(original))
    over = col(days_since_seen) - F.lit(float(threshold_days))
    return F.when(over > 0, F.greatest(F.lit(0.05), base * F.pow(F.lit(0.85), over))).otherwise(base)
