"""Signal queries: windowed aggregates, scoring and the two-pass signal job."""

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.plans import signals as G
from tidemark.registry.base import AS_OF, query
from tidemark.semantics import exact, js_round, mean, nz

WINDOWS = ("1h", "6h", "24h", "7d")
T0 = f"TIMESTAMP '{AS_OF}'"
W_SQL = "(VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168)) AS w(time_window, h)"


def phrased(t):
    p = t.v_phrases.groupBy("post_id").agg(F.sort_array(F.collect_list("phrase")).alias("key_phrases"))
    return t.v_sentiments.join(p, "post_id", "left")


def graph(t):
    """Entities and relations for the second pass, from the views."""
    coins = t.v_coins.select(
        F.concat(F.lit("coin:"), "symbol").alias("id"), F.lit("coin").alias("entity_type"), F.col("symbol"),
        F.least(F.lit(1.0), F.lit(0.2) + F.col("market_cap_rank") / 100.0).alias("confidence"),
    )

    def cid(c):
        return F.concat(F.lit("coin:"), F.col(c))

    def rel(df, src, tgt, kind, weight, conf=None, impact=None):
        return df.select(
            src.alias("source_id"), tgt.alias("target_id"), F.lit(kind).alias("relation_type"),
            weight.cast("double").alias("weight"), (conf if conf is not None else F.lit(None)).cast("double").alias("confidence"),
            (impact if impact is not None else F.lit(None)).cast("string").alias("impact"),
        )

    rels = (
        rel(t.v_pairs, cid("src"), cid("tgt"), "correlates_with", F.col("weight") / 25.0)
        .unionByName(rel(t.v_members, cid("symbol"), F.col("narrative"), "part_of", F.lit(1)))
        .unionByName(rel(t.v_recommends, F.col("author"), cid("coin_symbol"), "recommends", F.col("weight"), F.col("confidence")))
        .unionByName(rel(t.v_impacts, F.col("event_name"), cid("coin_symbol"), "impacts", F.lit(1), None, F.col("impact")))
    )
    return coins, rels


COUNTS_SQL = f"""
  SELECT m.coin_symbol, w.time_window, w.h,
         sum(CASE WHEN m.created_at >= {T0} - to_hours(w.h) THEN m.mention_count ELSE 0 END) AS mentions,
         sum(CASE WHEN m.created_at >= {T0} - to_hours(2 * w.h) AND m.created_at < {T0} - to_hours(w.h)
                  THEN m.mention_count ELSE 0 END) AS prev_mentions
  FROM v_mentions m, {W_SQL} WHERE m.created_at <= {T0}
  GROUP BY ALL HAVING count(CASE WHEN m.created_at >= {T0} - to_hours(w.h) THEN 1 END) > 0"""

HIST_SQL = f"""
  SELECT coin_symbol, time_window, count(*) AS k, sum(b) AS s, sum(b * b) AS q FROM (
    SELECT m.coin_symbol, w.time_window,
           CAST(floor((epoch_us(m.created_at) - epoch_us({T0} - to_hours(11 * w.h))) / (w.h * 3600000000.0)) AS INT) AS bucket,
           sum(m.mention_count) AS b
    FROM v_mentions m, {W_SQL}
    WHERE m.created_at >= {T0} - to_hours(11 * w.h) AND m.created_at < {T0} - to_hours(w.h)
    GROUP BY ALL) x GROUP BY ALL"""


@query("a1_window_mentions", f"SELECT coin_symbol, time_window, CAST(mentions AS BIGINT) AS mentions FROM ({COUNTS_SQL}) c")
def a1(t):
    return G.window_counts(G.hourly_counts(t.v_mentions, AS_OF, 1), WINDOWS).select("coin_symbol", "time_window", "mentions")


@query("w5_velocity", f"""
SELECT coin_symbol, time_window, CAST(mentions AS BIGINT) AS mentions, CAST(prev_mentions AS BIGINT) AS prev_mentions,
       CASE WHEN prev_mentions > 0
            THEN floor((CAST(mentions AS DOUBLE) - prev_mentions) / prev_mentions * 10000 + 0.5) / 10000 ELSE 0.0 END AS velocity
FROM ({COUNTS_SQL}) c""")
def w5(t):
    c = G.window_counts(G.hourly_counts(t.v_mentions, AS_OF, 1), WINDOWS)
    return c.withColumn("velocity", js_round(G.velocity("mentions", "prev_mentions"), 4))


@query("l3_top_velocity", f"""
SELECT coin_symbol, CAST(mentions AS BIGINT) AS mentions,
       CASE WHEN prev_mentions > 0
            THEN floor((CAST(mentions AS DOUBLE) - prev_mentions) / prev_mentions * 10000 + 0.5) / 10000 ELSE 0.0 END AS velocity
FROM ({COUNTS_SQL}) c WHERE time_window = '24h' ORDER BY velocity DESC NULLS LAST, coin_symbol LIMIT 20""")
def l3v(t):
    c = G.window_counts(G.hourly_counts(t.v_mentions, AS_OF, 1), ["24h"])
    return c.select(
        "coin_symbol", "mentions", js_round(G.velocity("mentions", "prev_mentions"), 4).alias("velocity")
    ).orderBy(F.col("velocity").desc_nulls_last(), "coin_symbol").limit(20)


@query("a5_history_buckets", f"""
SELECT coin_symbol, time_window, CAST(k AS INT) AS hist_buckets, floor(CAST(s AS DOUBLE) / k * 1e6 + 0.5) / 1e6 AS hist_mean,
       floor(sqrt(CAST(k * q - s * s AS DOUBLE)) / k * 1e6 + 0.5) / 1e6 AS hist_std FROM ({HIST_SQL}) h""")
def a5(t):
    h = G.history_stats(G.hourly_counts(t.v_mentions, AS_OF), WINDOWS)
    return h.withColumns({c: js_round(c, 6) for c in ("hist_mean", "hist_std")})


@query("a6_z_scores", f"""
SELECT c.coin_symbol, c.time_window,
       floor((CASE WHEN h.k IS NULL OR h.k < 3 OR h.k * h.q - h.s * h.s = 0 THEN 0.0
         ELSE (CAST(c.mentions AS DOUBLE) - CAST(h.s AS DOUBLE) / h.k) / (sqrt(CAST(h.k * h.q - h.s * h.s AS DOUBLE)) / h.k) END) * 1000 + 0.5) / 1000 AS z_score
FROM ({COUNTS_SQL}) c LEFT JOIN ({HIST_SQL}) h ON h.coin_symbol = c.coin_symbol AND h.time_window = c.time_window""")
def a6(t):
    hourly = G.hourly_counts(t.v_mentions, AS_OF)
    j = G.window_counts(hourly, WINDOWS).join(G.history_stats(hourly, WINDOWS), ["coin_symbol", "time_window"], "left")
    z = S.z_score("mentions", F.coalesce("hist_buckets", F.lit(0)), "hist_mean", "hist_std")
    return j.select("coin_symbol", "time_window", js_round(z, 3).alias("z_score"))


# what each given phrase must count as, written out: class, change of the score and phrase; all other phrases count as nothing
EXPECTED_EVENTS = {
    "exchange_listing": (15, "Binance listing"), "security_incident": (-20, "rug pull"), "whale_buy": (10, "whale buy"), "whale_sell": (-10, "whale dump"),
    "regulatory_positive": (10, "ETF approved"), "regulatory_negative": (-15, "SEC lawsuit"), "partnership": (8, "Partnership"), "airdrop": (5, "airdrop"),
}
FLAG_SQL = ",\n".join(
    "max(CASE WHEN m.created_at >= {t0} - to_hours(w.h) AND ({c}) THEN 1 ELSE 0 END) AS ev_{n}".format(
        t0=T0, n=n, c=" OR ".join(f"k.ev_{n} = 1" for _ in [0]))
    for n in EXPECTED_EVENTS
)
PHRASE_FLAGS = ",\n".join(f"max(CASE WHEN phrase = '{phrase}' THEN 1 ELSE 0 END) AS ev_{n}" for n, (_, phrase) in EXPECTED_EVENTS.items())
CUR = f"m.created_at >= {T0} - to_hours(w.h)"
PREV = f"m.created_at >= {T0} - to_hours(2 * w.h) AND m.created_at < {T0} - to_hours(w.h)"
D3 = "CAST({} AS DECIMAL(20,3))"
FACTS_SQL = f"""
  SELECT m.coin_symbol, w.time_window,
    sum(CASE WHEN {CUR} THEN p.upvotes + 2 * p.num_comments + 5 * p.num_awards END) AS eng,
    count(DISTINCT CASE WHEN {CUR} THEN p.source END) AS source_count,
    count(CASE WHEN {CUR} AND s.sentiment_score >= 0 THEN 1 END) AS fomo_n,
    sum(CASE WHEN {CUR} AND s.sentiment_score >= 0 THEN {D3.format('s.sentiment_score')} END) AS fomo_s,
    sum(CASE WHEN {CUR} AND s.sentiment_score >= 0 THEN {D3.format('s.fomo_score')} END) AS fomo_d,
    count(CASE WHEN {CUR} AND s.sentiment_score > 0 THEN 1 END) AS fomo_bull,
    count(CASE WHEN {CUR} AND s.sentiment_score <= 0 THEN 1 END) AS fud_n,
    sum(CASE WHEN {CUR} AND s.sentiment_score <= 0 THEN {D3.format('s.sentiment_score')} END) AS fud_s,
    sum(CASE WHEN {CUR} AND s.sentiment_score <= 0 THEN {D3.format('s.fud_score')} END) AS fud_d,
    count(CASE WHEN {PREV} AND s.sentiment_score IS NOT NULL THEN 1 END) AS prev_n,
    sum(CASE WHEN {PREV} THEN {D3.format('s.sentiment_score')} END) AS prev_s,
    {FLAG_SQL}
  FROM v_mentions m LEFT JOIN v_posts p ON p.id = m.post_id LEFT JOIN v_sentiments s ON s.post_id = m.post_id
  LEFT JOIN (SELECT post_id, {PHRASE_FLAGS} FROM v_phrases GROUP BY post_id) k ON k.post_id = m.post_id, {W_SQL}
  WHERE m.created_at <= {T0} AND m.created_at >= {T0} - to_hours(2 * w.h) GROUP BY ALL"""

CLASS_SUM = " + ".join(f"ev_{n} * ({v[0]}.0E0)" for n, v in EXPECTED_EVENTS.items())
CLASS_NAMES = ", ".join(f"CASE WHEN ev_{n} = 1 THEN '{n}' END" for n in EXPECTED_EVENTS)
CAP_SQL = "SELECT coin_symbol, arg_max(market_cap, fetched_at) AS market_cap, arg_max(price_usd, fetched_at) AS price_usd FROM v_prices GROUP BY 1"


def cl(x, lo, hi):
    return f"greatest({lo}, least({hi}, {x}))"


BASE_SQL = f"""
  SELECT *, CAST({cl(CLASS_SUM, '-30.0', '25.0')} AS DOUBLE) AS event_modifier,
    ({cl('(velocity + 1) * 50', '0.0', '100.0')} * 0.25
      + CASE WHEN signal_type = 'fomo' THEN {cl('(avg_s + 1) * 50', '0.0', '100.0')}
             ELSE {cl('abs(least(avg_s, 0.0)) * 100', '0.0', '100.0')} END * 0.30
      + {cl('(trend + 1) * 50', '0.0', '100.0')} * 0.15
      + {cl('log10(eng_pm + 1) * 25', '0.0', '100.0')} * 0.20
      + {cl('avg_d * 100', '0.0', '100.0')} * 0.10)
    * {cl('mentions / 5.0E0', '0.0', '1.0')}
    * CASE WHEN market_cap > 0 THEN CASE WHEN market_cap <= 5e7 THEN 1.0 ELSE {cl('pow(5e7 / market_cap, 0.3)', '0.05', '1.0')} END
           WHEN market_cap_rank > 0 THEN {cl('0.15 + 0.85 * (log10(market_cap_rank) / log10(200))', '0.15', '1.0')} ELSE 1.0 END
    * CASE WHEN z <= 2 THEN 1.0 ELSE least(1 + (z - 2) * 0.25, 1.5) END
    * CASE WHEN source_count <= 1 THEN 0.7 WHEN source_count = 2 THEN 1.0 ELSE 1.3 END
    + {cl(CLASS_SUM, '-30.0', '25.0')} AS base_score
  FROM (SELECT *, CASE WHEN prev_n > 0 THEN avg_s - CAST(prev_s AS DOUBLE) / prev_n ELSE 0.0 END AS trend FROM (
    SELECT c.coin_symbol, c.time_window, ty.signal_type, CAST(c.mentions AS BIGINT) AS mentions,
      CASE WHEN c.prev_mentions > 0 THEN (CAST(c.mentions AS DOUBLE) - c.prev_mentions) / c.prev_mentions ELSE 0.0 END AS velocity,
      coalesce(CASE WHEN signal_type = 'fomo' THEN CAST(fomo_s AS DOUBLE) / fomo_n ELSE CAST(fud_s AS DOUBLE) / fud_n END, 0.0) AS avg_s,
      coalesce(CASE WHEN signal_type = 'fomo' THEN CAST(fomo_d AS DOUBLE) / fomo_n ELSE CAST(fud_d AS DOUBLE) / fud_n END, 0.0) AS avg_d,
      coalesce(CAST(f.eng AS DOUBLE), 0.0) / c.mentions AS eng_pm, f.prev_n, f.prev_s, f.source_count,
      CASE WHEN signal_type = 'fomo' THEN fomo_n ELSE fud_n END AS sn, CASE WHEN signal_type = 'fomo' THEN fomo_bull ELSE 0 END AS bull,
      CASE WHEN h.k IS NULL OR h.k < 3 OR h.k * h.q - h.s * h.s = 0 THEN 0.0
        ELSE (CAST(c.mentions AS DOUBLE) - CAST(h.s AS DOUBLE) / h.k) / (sqrt(CAST(h.k * h.q - h.s * h.s AS DOUBLE)) / h.k) END AS z,
      pr.market_cap, co.market_cap_rank, {', '.join(f'f.ev_{n}' for n in S.EVENT_CLASSES)}
    FROM ({COUNTS_SQL}) c JOIN ({FACTS_SQL}) f ON f.coin_symbol = c.coin_symbol AND f.time_window = c.time_window
    LEFT JOIN ({HIST_SQL}) h ON h.coin_symbol = c.coin_symbol AND h.time_window = c.time_window
    LEFT JOIN ({CAP_SQL}) pr ON pr.coin_symbol = c.coin_symbol LEFT JOIN v_coins co ON co.symbol = c.coin_symbol,
    (VALUES ('fomo'), ('fud')) AS ty(signal_type)) a) b"""

OUT_SQL = """
  coin_symbol, time_window, signal_type, mentions AS mention_count, floor(velocity * 10000 + 0.5) / 10000 AS mention_velocity,
  floor(avg_s * 1000 + 0.5) / 1000 AS avg_sentiment, floor(trend * 1000 + 0.5) / 1000 AS sentiment_trend,
  floor(score * 100 + 0.5) / 100 AS weighted_score, floor(eng_pm * 100 + 0.5) / 100 AS engagement_score,
  CASE WHEN score >= 80 THEN 'extremely_hot' WHEN score >= 60 THEN 'hot' WHEN score >= 40 THEN 'warm' WHEN score >= 20 THEN 'cool'
       ELSE 'cold' END AS signal_label,
  floor(z * 1000 + 0.5) / 1000 AS z_score, CAST(source_count AS INT) AS source_count,
  CASE WHEN sn >= 5 THEN CASE WHEN bull / CAST(sn AS DOUBLE) > 0.85 THEN 'potential_reversal'
       WHEN bull / CAST(sn AS DOUBLE) < 1 - 0.85 THEN 'potential_bounce' END END AS contrarian_warning,
  CASE WHEN sn >= 5 THEN floor(bull / CAST(sn AS DOUBLE) * 100 + 0.5) ELSE 50.0 END AS sentiment_skew,
  concat_ws(',', """ + CLASS_NAMES + """) AS detected_events, event_modifier"""
COLS = [
    "coin_symbol", "time_window", "signal_type", "mention_count", "mention_velocity", "avg_sentiment", "sentiment_trend",
    "weighted_score", "engagement_score", "signal_label", "z_score", "source_count", "contrarian_warning", "sentiment_skew",
    "event_modifier",
]


@query("p2_signals", f"SELECT {OUT_SQL} FROM (SELECT *, {cl('base_score', '0.0', '100.0')} AS score FROM ({BASE_SQL}) q) r")
def p2(t):
    s = G.generate_signals(t.v_mentions, t.v_posts, phrased(t), t.v_coins, t.v_prices, AS_OF)
    return s.select(*COLS, F.array_join("detected_events", ",").alias("detected_events"))


B10 = "CAST(base_score AS DECIMAL(28,10))"


@query("p2_signals_graph", f"""
WITH b AS MATERIALIZED ({BASE_SQL}),
edges AS (SELECT src AS coin_symbol, tgt AS peer, weight / 25.0E0 AS weight FROM v_pairs
          UNION ALL SELECT tgt, src, weight / 25.0E0 FROM v_pairs),
peers AS (SELECT coin_symbol, time_window, signal_type, sum(greatest(0.0, least(1.0, weight / 10.0)) * 5.0) AS pb, count(*) AS pn FROM (
    SELECT e.coin_symbol, h.time_window, h.signal_type, e.weight,
           row_number() OVER (PARTITION BY e.coin_symbol, h.time_window, h.signal_type ORDER BY e.weight DESC, e.peer) AS rn
    FROM edges e JOIN b h ON h.coin_symbol = e.peer WHERE h.base_score >= 60) x WHERE rn <= 3 GROUP BY ALL),
nav AS (SELECT coin_symbol, time_window, signal_type, CAST(sum({B10}) AS DOUBLE) / count(*) AS na FROM (
    SELECT DISTINCT m.symbol AS coin_symbol, q.coin_symbol AS peer, q.time_window, q.signal_type, q.base_score
    FROM v_members m JOIN v_members m2 ON m.narrative = m2.narrative AND m.symbol <> m2.symbol
    JOIN b q ON q.coin_symbol = m2.symbol WHERE q.base_score > 0) y GROUP BY ALL),
rec AS (SELECT coin_symbol, least(1.0, max(confidence * weight / 10)) AS rs FROM v_recommends WHERE weight > 0 GROUP BY 1),
imp AS (SELECT coin_symbol, count(CASE WHEN impact = 'positive' THEN 1 END) - count(CASE WHEN impact = 'negative' THEN 1 END) AS net
        FROM v_impacts GROUP BY 1)
SELECT coin_symbol, time_window, signal_type, floor(kg * 100 + 0.5) / 100 AS kg_boost, floor(mult * 1e6 + 0.5) / 1e6 AS kg_multiplier,
       floor(greatest(0.0, least(100.0, base_score * mult + kg)) * 100 + 0.5) / 100 AS weighted_score
FROM (SELECT b.*, {cl("coalesce(p.pb, 0.0) + coalesce((n.na - 50) / 50 * 4, 0.0) + coalesce(i.net, 0) * 3.0", '-15.0', '15.0')}
             * greatest(0.3, least(1.0, least(1.0, 0.2 + c.market_cap_rank / 100.0E0))) AS kg,
             CASE WHEN r.rs > 0 THEN 1 + 0.15 * r.rs ELSE 1.0 END AS mult
      FROM b LEFT JOIN peers p USING (coin_symbol, time_window, signal_type) LEFT JOIN nav n USING (coin_symbol, time_window, signal_type)
      LEFT JOIN rec r USING (coin_symbol) LEFT JOIN imp i USING (coin_symbol) LEFT JOIN v_coins c ON c.symbol = b.coin_symbol) z""")
def p2_graph(t):
    ents, rels = graph(t)
    s = G.generate_signals(t.v_mentions, t.v_posts, phrased(t), t.v_coins, t.v_prices, AS_OF, ents, rels)
    return s.select(
        "coin_symbol", "time_window", "signal_type", "kg_boost", js_round("kg_multiplier", 6).alias("kg_multiplier"), "weighted_score"
    )
