"""Why is a coin trending: the parts of one signal, anchored on its last computation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.plans.signals import latest_price
from tidemark.semantics import WINDOW_SECONDS, at, clamp, exact, js_round, mean, nz


class Explain:
    """Lazily planned frames for one (coin, window, type)."""

    def __init__(self, coin: str, window: str, kind: str, signals: DataFrame, mentions: DataFrame, posts: DataFrame,
                 sentiments: DataFrame, as_of):
        self.coin, self.kind = coin, kind
        s = signals.where((F.col("coin_symbol") == coin) & (F.col("time_window") == window) & (F.col("signal_type") == kind))
        anchor = F.coalesce(s.agg(F.max("computed_at")).scalar(), at(as_of))
        step = WINDOW_SECONDS[window] * 1_000_000
        m = mentions.where(F.col("coin_symbol") == coin).select("post_id", "mention_count", "created_at")
        t, a = F.unix_micros("created_at"), F.unix_micros(anchor)
        self.current = m.where((t >= a - step) & (t <= a))
        self.previous = m.where((t >= a - 2 * step) & (t < a - step))
        ids = self.current.select("post_id").distinct()
        self.posts = posts.join(ids, posts["id"] == ids["post_id"], "left_semi")
        self.sentiments = sentiments.join(ids, "post_id", "left_semi")

    def breakdown(self) -> DataFrame:
        """Score parts with the trend fixed at its neutral 50."""
        fud = self.kind == "fud"
        direction = exact(nz("fud_score" if fud else "fomo_score"))
        tot = self.current.agg(F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions"))
        prev = self.previous.agg(F.coalesce(F.sum("mention_count"), F.lit(0)).alias("prev_mentions"))
        eng = self.posts.agg(F.coalesce(F.sum((nz("upvotes") + nz("num_comments") * 2 + nz("num_awards") * 5).cast("long")), F.lit(0)).alias("eng"))
        sen = self.sentiments.agg(
            F.sum(exact("sentiment_score")).alias("_s"), F.sum(direction).alias("_d"), F.count("sentiment_score").alias("_n")
        )
        one = tot.withColumns({
            "prev_mentions": prev.scalar(), "eng": eng.scalar(),
            "avg_sentiment": sen.select(mean("_s", "_n")).scalar(), "avg_direction": sen.select(mean("_d", "_n")).scalar(),
        })
        cur, pre = F.col("mentions").cast("double"), F.col("prev_mentions").cast("double")
        one = one.withColumns({
            "velocity": F.when(pre > 0, (cur - pre) / pre).otherwise(F.lit(0.0)), "eng_pm": mean("eng", "mentions"),
        })
        w = S.WEIGHTS
        sent = S.fud_sentiment_norm("avg_sentiment") if fud else S.sentiment_norm("avg_sentiment")
        parts: dict[str, Column] = {
            "velocity_norm": S.velocity_norm("velocity"), "sentiment_norm": sent, "engagement_norm": S.engagement_norm("eng_pm"),
            "direction_norm": S.share_norm("avg_direction"), "mention_confidence": S.mention_confidence("mentions"),
        }
        one = one.withColumns(parts)
        raw = (
            F.col("velocity_norm") * w["velocity"] + F.col("sentiment_norm") * w["sentiment"] + F.lit(50.0) * w["trend"]
            + F.col("engagement_norm") * w["engagement"] + F.col("direction_norm") * w["direction"]
        )
        return one.withColumn("final_score", js_round(clamp(raw * F.col("mention_confidence"), 0, 100), 2))

    def top_posts(self, n: int = 5) -> DataFrame:
        s = self.sentiments.select("post_id", "sentiment_label", "fomo_score", "fud_score")
        top = self.posts.orderBy(F.col("score").desc_nulls_last(), "id").limit(n)
        return top.join(s, top["id"] == s["post_id"], "left").select(
            "id", "title", "channel", F.coalesce("source", F.lit("reddit")).alias("source"), "score",
            F.coalesce("sentiment_label", F.lit("neutral")).alias("sentiment_label"), nz("fomo_score").alias("fomo_score"),
            nz("fud_score").alias("fud_score"),
        )

    def sources(self) -> DataFrame:
        return source_breakdown(self.posts, self.sentiments)

    def phrases(self, exploded: DataFrame, n: int = 15) -> DataFrame:
        """Top phrases; ``exploded`` is (post_id, phrase)."""
        return phrase_counts(exploded.join(self.sentiments.select("post_id"), "post_id", "left_semi"), n)

    def themes(self, entities: DataFrame, relations: DataFrame, fixed: DataFrame, n: int = 5) -> DataFrame:
        """Narratives and events tied to the coin; fixed clusters when it has no narrative."""
        me = entities.where((F.col("entity_type") == "coin") & (F.col("symbol") == self.coin)).select(F.col("id").alias("me"))
        r = relations.where("weight > 0 AND relation_type IN ('part_of', 'impacts')")
        ends = (
            r.join(me, F.col("source_id") == F.col("me")).select(F.col("target_id").alias("id"))
            .union(r.join(me, F.col("target_id") == F.col("me")).select(F.col("source_id").alias("id"))).distinct()
        )
        e = entities.join(ends, "id", "left_semi")
        order = [F.col("mention_count").desc(), F.col("id")]
        nar = e.where("entity_type = 'narrative'").orderBy(*order).limit(n).select(F.lit("narrative").alias("kind"), "name")
        ev = e.where("entity_type = 'event'").orderBy(*order).limit(n).select(F.lit("event").alias("kind"), "name")
        none = nar.agg(F.count(F.lit(1))).scalar() == 0
        fb = fixed.where((F.col("coin_symbol") == self.coin) & none).select(F.lit("narrative").alias("kind"), F.col("narrative").alias("name"))
        return nar.unionByName(fb).unionByName(ev)

    def price(self, prices: DataFrame) -> DataFrame:
        return latest_price(prices.where(F.col("coin_symbol") == self.coin))


def phrase_counts(exploded: DataFrame, n: int, trim: bool = False) -> DataFrame:
    """Most frequent phrases, case folded; ``trim`` also trims and drops those under two characters."""
    p = F.lower(F.trim("phrase")) if trim else F.lower("phrase")
    d = exploded.select(p.alias("phrase"))
    d = d.where(F.char_length("phrase") >= 2) if trim else d
    return d.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "phrase").limit(n)


def source_breakdown(posts: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Posts and mean sentiment per platform; a post without sentiment counts as zero."""
    s = sentiments.select(F.col("post_id").alias("id"), exact("sentiment_score").alias("_s"))
    g = posts.join(s, "id", "left").groupBy(F.coalesce("source", F.lit("reddit")).alias("source")).agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce("_s", F.lit(0))).alias("_t")
    )
    share = F.col("posts") / g.agg(F.sum("posts")).scalar()
    return g.select("source", "posts", js_round(mean("_t", "posts"), 3).alias("avg_sentiment"), js_round(share * 100).alias("share_pct"))


def bucket_series(mentions: DataFrame, sentiments: DataFrame, prices: DataFrame, as_of, days: int = 7, hours: int = 6, coin: str | None = None) -> DataFrame:
    """Per coin and epoch-aligned bucket: mentions, mean sentiment and fomo, mean price; buckets of either side are kept."""
    lo = F.timestamp_micros(F.unix_micros(at(as_of)) - days * 86_400_000_000)
    size = hours * 3_600_000_000

    def bucket(ts: str) -> Column:
        return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(float(size))).cast("long") * size).alias("bucket")

    m, p = mentions.where(F.col("created_at") >= lo), prices.where(F.col("fetched_at") >= lo)
    if coin:
        m, p = m.where(F.col("coin_symbol") == coin), p.where(F.col("coin_symbol") == coin)
    s = sentiments.select("post_id", exact("sentiment_score").alias("_s"), exact(nz("fomo_score")).alias("_f"))
    a = m.join(s, "post_id", "left").groupBy("coin_symbol", bucket("created_at")).agg(
        F.sum("mention_count").alias("mentions"), F.sum("_s").alias("_s"), F.sum("_f").alias("_f"), F.count("_s").alias("_n"))
    b = p.groupBy("coin_symbol", bucket("fetched_at")).agg(F.sum(exact("price_usd", 8, 28)).alias("_p"), F.count("price_usd").alias("_k"))

    def avg(c: str, n: str) -> Column:
        return F.try_divide(F.col(c).cast("double"), F.col(n).cast("double"))

    return a.join(b, ["coin_symbol", "bucket"], "full_outer").select(
        "coin_symbol", "bucket", F.coalesce("mentions", F.lit(0)).alias("mentions"), js_round(avg("_s", "_n"), 3).alias("avg_sentiment"),
        js_round(avg("_f", "_n"), 3).alias("avg_fomo"), js_round(avg("_p", "_k"), 6).alias("price_usd"),
    )
