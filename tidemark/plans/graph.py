"""Knowledge graph of coins, influencers, narratives and events: refresh, decay and views.

Entities are keyed by (entity_type, name) and relations by (source_id,
target_id, relation_type); ids are hashes of the key, so no lookup is needed
to connect new edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.semantics import at, ago, js_trim
from tidemark.session import cut_lineage

# Allowed relations, their end types, and the fixed narrative clusters.
GRAMMAR = {
    "correlates_with": ("coin", "coin"),
    "mentions": ("influencer", "coin"),
    "part_of": ("coin", "narrative"),
    "recommends": ("influencer", "coin"),
    "impacts": ("event", "coin"),
}
CLUSTERS = {
    "Dog Coins": ["DOGE", "SHIB", "FLOKI", "BONK", "WIF", "MYRO"],
    "AI Tokens": ["FET", "AGIX", "TAO", "RNDR", "OCEAN", "WLD", "AI16Z", "VIRTUAL", "AIXBT"],
    "Meme Culture": ["PEPE", "BRETT", "MOG", "POPCAT", "MEME", "TURBO", "BOME", "MEW", "NEIRO"],
    "DeFi": ["AAVE", "CRV", "MKR", "SNX", "COMP", "SUSHI", "CAKE", "PENDLE", "JUP", "UNI"],
    "L2 & Infra": ["ARB", "OP", "STRK", "ZK", "BLAST", "BASE", "SUI", "SEI"],
    "Political Coins": ["TRUMP", "MELANIA"],
    "Solana Ecosystem": ["SOL", "BONK", "WIF", "JUP", "POPCAT", "BOME"],
}
EVENT_WORDS = [
    "listing", "delisting", "launch", "airdrop", "hack", "exploit", "regulation", "sec", "etf", "halving", "burn",
    "partnership", "upgrade", "fork", "mainnet", "testnet", "rug pull", "bankruptcy", "acquisition", "integration",
    "staking", "unlock", "vesting",
]
DELETED = "[deleted]"
RELATION_STALE_DAYS = 3
ENTITY_STALE_DAYS = 7


def entity_id(kind: str | Column, name) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat_ws("|", k, F.col(name) if isinstance(name, str) else name), 256), 1, 16)


def entity(df: DataFrame, kind: str, name: str, count: str, confidence: Column, **extra: Column) -> DataFrame:
    null = {"symbol": "string", "source_count": "int", "coins": "array<string>", "impact": "string", "origin": "string"}
    return df.select(
        entity_id(kind, name).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"),
        F.col(count).cast("long").alias("mention_count"), confidence.alias("confidence"),
        *[extra.get(c, F.lit(None)).cast(t).alias(c) for c, t in null.items()],
    )


def coin_entities(mentions: DataFrame, posts: DataFrame, as_of, names: DataFrame | None = None) -> DataFrame:
    """Mention total and platform spread per coin over a day."""
    m = mentions.where(F.col("created_at") >= ago(as_of, 86400))
    g = (
        m.join(posts.select(F.col("id").alias("post_id"), "source"), "post_id", "left")
        .groupBy("coin_symbol").agg(F.sum("mention_count").alias("n"), F.count_distinct("source").alias("k"))
    )
    if names is not None:
        g = g.join(names.groupBy(F.col("symbol").alias("coin_symbol")).agg(F.min("name").alias("_name")), "coin_symbol", "left")
    else:
        g = g.withColumn("_name", F.lit(None).cast("string"))
    g = g.withColumn("name", F.coalesce("_name", "coin_symbol"))
    return entity(g, "coin", "name", "n", S.entity_confidence("coin", "n", "k"), symbol=F.col("coin_symbol"), source_count=F.col("k"))


def influencer_counts(posts: DataFrame, as_of, min_score: int = 50, days: int = 7) -> DataFrame:
    return (
        posts.where(
            (F.col("posted_at") >= ago(as_of, days * 86400)) & (F.col("score") >= min_score)
            & F.col("author").isNotNull() & (F.col("author") != "") & (F.col("author") != DELETED)
        )
        .groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("source", F.lit("reddit"))).alias("k"))
        .where("n >= 3")
    )


def influencer_entities(posts: DataFrame, as_of) -> DataFrame:
    g = influencer_counts(posts, as_of)
    return entity(g, "influencer", "author", "n", S.entity_confidence("influencer", "n", "k"), source_count=F.col("k"))


def active_coins(mentions: DataFrame, as_of) -> DataFrame:
    return mentions.where(F.col("created_at") >= ago(as_of, 86400)).select("coin_symbol").distinct()


def clusters(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(n, c) for n, cs in {**CLUSTERS, **(extra or {})}.items() for c in cs]
    return spark.createDataFrame(rows, "narrative string, coin_symbol string")


def narrative_coins(outputs: DataFrame, mentions: DataFrame, as_of, fixed: DataFrame) -> DataFrame:
    """(narrative, coin_symbol, origin): model narratives first, fixed clusters where the model has no such name.

    ``outputs`` holds model results: narratives and mentioned_coins arrays with created_at.
    """
    active = active_coins(mentions, as_of)
    o = outputs.where(F.col("created_at") >= ago(as_of, 86400))
    named = o.select(F.explode("narratives").alias("n"), "mentioned_coins").withColumn("narrative", js_trim("n")).where("narrative <> ''")
    pairs = named.select("narrative", F.explode_outer("mentioned_coins").alias("c")).select("narrative", F.upper("c").alias("coin_symbol")).distinct()
    wide = pairs.where(F.col("coin_symbol").isNotNull())
    # at least two coins in the narrative and two of them active; active is a subset, so one test is enough
    live = wide.join(active, "coin_symbol", "left_semi").withColumn("origin", F.lit("model"))
    known = pairs.select("narrative").distinct()
    rest = fixed.join(known, "narrative", "left_anti").join(active, "coin_symbol", "left_semi").withColumn("origin", F.lit("fixed"))
    both = live.select("narrative", "coin_symbol", "origin").unionByName(rest.select("narrative", "coin_symbol", "origin"))
    enough = both.groupBy("narrative").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    return both.join(enough, "narrative", "left_semi")


def narrative_entities(members: DataFrame) -> DataFrame:
    g = members.groupBy("narrative", "origin").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("coin_symbol")).alias("coins"))
    conf = F.when(F.col("origin") == "model", S.entity_confidence("narrative_model", "n")).otherwise(S.entity_confidence("narrative_fixed", "n"))
    return entity(g, "narrative", "narrative", "n", conf, coins=F.col("coins"), origin=F.col("origin"))


def event_word(phrase) -> Column:
    low = F.lower(phrase)
    cond = F.lit(False)
    for w in EVENT_WORDS:
        cond = cond | low.contains(w)
    return cond


def event_coins(outputs: DataFrame, as_of) -> DataFrame:
    """(event_name, coin_symbol, impact, origin): model events, else key phrases that hold an event word.

    The first output (by created_at, post_id, position) that names an event decides its impact and origin.
    """
    o = outputs.where(F.col("created_at") >= ago(as_of, 86400))
    has = F.size(F.coalesce("events", F.array())) > 0
    coins = F.coalesce("mentioned_coins", F.array().cast("array<string>"))
    by_model = o.where(has).select("created_at", "post_id", coins.alias("_m"), F.posexplode("events").alias("pos", "e")).select(
        "created_at", "post_id", "pos", js_trim("e.name").alias("event_name"),
        F.when(F.coalesce("e.impact", F.lit("")) == "", "neutral").otherwise(F.col("e.impact")).alias("impact"),
        F.lit("model").alias("origin"), F.concat(F.coalesce("e.coins", F.array().cast("array<string>")), "_m").alias("coins"),
    ).where("event_name <> ''")
    by_word = o.where(~has & F.col("mentioned_coins").isNotNull()).select(
        "created_at", "post_id", F.col("mentioned_coins").alias("coins"), F.posexplode("key_phrases").alias("pos", "p")
    ).where(event_word("p")).select(
        "created_at", "post_id", "pos", js_trim("p").alias("event_name"), F.lit("neutral").alias("impact"), F.lit("keyword").alias("origin"), "coins"
    )
    rows = by_model.unionByName(by_word)
    first = rows.groupBy("event_name").agg(
        F.min_by(F.struct("impact", "origin"), F.struct("created_at", "post_id", "pos")).alias("f")
    )
    pairs = rows.select("event_name", F.explode("coins").alias("c")).select("event_name", F.upper("c").alias("coin_symbol")).distinct()
    return pairs.join(first, "event_name").select("event_name", "coin_symbol", "f.impact", "f.origin")


def event_entities(pairs: DataFrame) -> DataFrame:
    g = pairs.groupBy("event_name", "impact", "origin").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("coin_symbol")).alias("coins"))
    conf = F.when(F.col("origin") == "model", F.lit(0.75)).otherwise(F.lit(0.6))
    return entity(g, "event", "event_name", "n", conf, coins=F.col("coins"), impact=F.col("impact"), origin=F.col("origin"))


def co_mentions(mentions: DataFrame, min_weight: int = 3) -> DataFrame:
    """Coin pairs named together in at least ``min_weight`` posts.

    Posts with the same coin set are counted once with a multiplicity, and coins
    seen in fewer than ``min_weight`` multi-coin posts cannot reach the weight
    and are dropped first; only then is a set joined to itself. At ``min_weight``
    1 the result is all pairs by definition.
    """
    pc = mentions.select("post_id", "coin_symbol").distinct()
    sets = pc.groupBy("post_id").agg(F.array_sort(F.collect_set("coin_symbol")).alias("coins")).where(F.size("coins") >= 2)
    sets = sets.groupBy("coins").agg(F.count(F.lit(1)).alias("n"))
    often = sets.select(F.explode("coins").alias("coin_symbol"), "n").groupBy("coin_symbol").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_weight)
    of_set = cut_lineage(
        sets.select(F.md5(F.array_join("coins", "|")).alias("_set"), "n", F.explode("coins").alias("coin_symbol"))
        .join(often.select("coin_symbol"), "coin_symbol", "left_semi")
    )
    src, tgt = (of_set.select("_set", "n", F.col("coin_symbol").alias(c)) for c in ("src", "tgt"))
    pairs = src.join(tgt.drop("n"), "_set").where("src < tgt")
    return pairs.groupBy("src", "tgt").agg(F.sum("n").alias("weight")).where(F.col("weight") >= min_weight)


def influencer_posts(posts: DataFrame, mentions: DataFrame, sentiments: DataFrame, influencers: DataFrame, as_of) -> DataFrame:
    """High-score posts of known influencers x coins they mention x sentiment."""
    p = posts.where(
        (F.col("posted_at") >= ago(as_of, 7 * 86400)) & (F.col("score") >= 100) & F.col("author").isNotNull() & (F.col("author") != DELETED)
    ).select(F.col("id").alias("post_id"), "author", "score", "posted_at")
    p = p.join(influencers.select(F.col("name").alias("author")), "author", "left_semi")
    m = mentions.select("post_id", "coin_symbol").distinct()
    s = sentiments.select("post_id", "sentiment_label", "confidence")
    return p.join(m, "post_id").join(s, "post_id", "left")


def relation(df: DataFrame, kind: str, src: Column, tgt: Column, weight: Column, context: Column, confidence=None, impact=None) -> DataFrame:
    return df.select(
        src.alias("source_id"), tgt.alias("target_id"), F.lit(GRAMMAR[kind][0]).alias("source_type"), F.lit(GRAMMAR[kind][1]).alias("target_type"),
        F.lit(kind).alias("relation_type"), weight.cast("double").alias("weight"), context.alias("context"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        (F.lit(None) if impact is None else impact).cast("string").alias("impact"),
    )


def refresh(
    mentions: DataFrame, posts: DataFrame, sentiments: DataFrame, outputs: DataFrame, fixed: DataFrame, as_of, names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New entities and relations of one run, ready for upsert.

    What several entity and edge kinds share is worked out once and stored: the
    day's outputs, the coins, the influencers, the narrative members and the events.
    """
    outputs = cut_lineage(outputs.where(F.col("created_at") >= ago(as_of, 86400)))
    coins = cut_lineage(coin_entities(mentions, posts, as_of, names))
    infl = cut_lineage(influencer_entities(posts, as_of))
    members = cut_lineage(narrative_coins(outputs, mentions, as_of, fixed))
    ev = cut_lineage(event_coins(outputs, as_of))
    entities = coins.unionByName(infl).unionByName(narrative_entities(members)).unionByName(event_entities(ev))
    entities = entities.withColumn("last_seen_at", at(as_of))

    ids = coins.select("symbol", F.col("id").alias("coin_id"), F.col("name").alias("coin_name"))
    by_coin = ids.withColumnRenamed("symbol", "coin_symbol")
    co = co_mentions(mentions.where(F.col("created_at") >= ago(as_of, 86400)))
    co = co.join(ids.select(F.col("symbol").alias("src"), F.col("coin_id").alias("a")), "src").join(
        ids.select(F.col("symbol").alias("tgt"), F.col("coin_id").alias("b")), "tgt")
    ip = cut_lineage(influencer_posts(posts, mentions, sentiments, infl, as_of).join(by_coin, "coin_symbol"))
    latest = F.struct("posted_at", "post_id")
    said = ip.groupBy("author", "coin_id").agg(F.max_by("score", latest).alias("score"))
    rec = ip.where((F.col("sentiment_label") == "bullish") & (F.col("confidence") > 0.7)).groupBy("author", "coin_id").agg(
        F.max_by(F.struct("score", "confidence"), latest).alias("l"))
    who = entity_id("influencer", "author")
    nc = members.join(by_coin, "coin_symbol")
    ec = ev.join(by_coin, "coin_symbol")
    edges = [
        relation(co, "correlates_with", F.col("a"), F.col("b"), F.col("weight"), F.format_string("named together in %d posts", F.col("weight"))),
        relation(said, "mentions", who, F.col("coin_id"), F.lit(1), F.format_string("u/%s (score: %d)", "author", "score")),
        relation(rec, "recommends", who, F.col("coin_id"), F.col("l.score") / 100,
                 F.format_string("u/%s bullish (confidence: %s, score: %d)", F.col("author"), F.col("l.confidence").cast("string"), F.col("l.score")),
                 confidence=F.col("l.confidence")),
        relation(nc, "part_of", F.col("coin_id"), entity_id("narrative", "narrative"), F.lit(1), F.concat_ws(" → ", "coin_name", "narrative")),
        relation(ec, "impacts", entity_id("event", "event_name"), F.col("coin_id"), F.lit(1),
                 F.format_string("%s → %s (%s)", "event_name", "coin_symbol", "impact"), impact=F.col("impact")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return entities, valid_relations(out)[0].withColumn("updated_at", at(as_of))


def grammar_ok() -> Column:
    cond = F.lit(False)
    for kind, (s, t) in GRAMMAR.items():
        cond = cond | ((F.col("relation_type") == kind) & (F.col("source_type") == s) & (F.col("target_type") == t))
    return F.coalesce(cond, F.lit(False))


def valid_relations(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split edges into those the grammar allows and the rest."""
    return rel.where(grammar_ok()), rel.where(~grammar_ok())


def decay_relations(rel: DataFrame, as_of, days: float = RELATION_STALE_DAYS) -> DataFrame:
    """Weight 0 for edges not updated for three days."""
    stale = (F.col("updated_at") < ago(as_of, days * 86400)) & (F.col("weight") > 0)
    return rel.withColumn("weight", F.when(stale, F.lit(0.0)).otherwise(F.col("weight")))


def decay_entities(ent: DataFrame, as_of) -> DataFrame:
    """Lower the confidence of events and narratives not seen for a week, from their original confidence."""
    days = (F.unix_micros(at(as_of)) - F.unix_micros("last_seen_at")) / F.lit(86_400_000_000.0)
    hit = F.col("entity_type").isin("event", "narrative") & (days > ENTITY_STALE_DAYS)
    orig = F.col("original_confidence") if "original_confidence" in ent.columns else F.col("confidence")
    new = S.decayed_confidence(orig, days)
    return ent.withColumns({
        "confidence": F.when(hit, F.floor(new * 1000 + 0.5) / 1000).otherwise(F.col("confidence")),
        "decayed": F.when(hit, new < 0.15).otherwise(F.lit(False)),
        "original_confidence": orig,
    })


# --- views -------------------------------------------------------------------


def top_entities(ent: DataFrame, n: int = 30, search: str | None = None, kind: str | None = None) -> DataFrame:
    e = ent if kind is None else ent.where(F.col("entity_type") == kind)
    if search:
        e = e.where(F.col("name").ilike(f"%{search}%") | F.col("symbol").ilike(f"%{search}%"))
    return e.orderBy(F.col("mention_count").desc_nulls_last(), "id").limit(n)


def with_endpoints(rel: DataFrame, ent: DataFrame) -> DataFrame:
    """Edges with both end entities attached."""
    def side(p: str) -> DataFrame:
        return ent.select(F.col("id").alias(f"{p}_id"), F.col("entity_type").alias(f"{p}_kind"), F.col("name").alias(f"{p}_name"), F.col("symbol").alias(f"{p}_symbol"))

    return rel.join(side("source"), "source_id").join(side("target"), "target_id")


def touching(rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with at least one end in ``nodes`` (column id): two semi joins instead of an OR join."""
    ids = nodes.select("id").distinct()
    by_source = rel.join(ids, rel["source_id"] == ids["id"], "left_semi")
    by_target = rel.join(ids, rel["target_id"] == ids["id"], "left_semi").join(ids, F.col("source_id") == ids["id"], "left_anti")
    return by_source.unionByName(by_target)


def induced(rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("id").distinct()
    return rel.join(ids, rel["source_id"] == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")


def graph_view(ent: DataFrame, rel: DataFrame, signals: DataFrame, n: int = 30, window: str = "24h", kind: str = "fomo") -> tuple[DataFrame, DataFrame]:
    """Nodes (top entities with their latest signal) and the links among them."""
    top = top_entities(ent, n)
    s = signals.where((F.col("time_window") == window) & (F.col("signal_type") == kind))
    cols = ["avg_sentiment", "weighted_score", "signal_label", "mention_velocity"]
    last = s.groupBy(F.col("coin_symbol").alias("symbol")).agg(F.max_by(F.struct(*cols), "computed_at").alias("s"))
    nodes = top.join(last, "symbol", "left").select(
        "id", F.coalesce("symbol", "name").alias("name"), F.col("name").alias("full_name"), F.col("entity_type").alias("kind"),
        F.col("mention_count").alias("mentions"), F.coalesce("s.avg_sentiment", F.lit(0.0)).alias("sentiment"),
        F.coalesce("s.weighted_score", F.lit(0.0)).alias("score"), F.coalesce("s.signal_label", F.lit("neutral")).alias("label"),
        F.coalesce("s.mention_velocity", F.lit(0.0)).alias("velocity"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    links = induced(rel.where("weight > 0"), top).select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("kind"), "weight"
    )
    return nodes, links


def connected_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    return nodes.join(ends, "id", "left_semi")


def neighbours(links: DataFrame, node: str) -> DataFrame:
    a = links.where(F.col("source") == node).select(F.col("target").alias("id"))
    return a.union(links.where(F.col("target") == node).select(F.col("source").alias("id"))).distinct()


def event_timeline(ent: DataFrame, rel: DataFrame, as_of, days: int = 30, coin: str | None = None, limit: int = 50) -> DataFrame:
    """Events, newest first, with the coins they impact; the stored coin list where no relation exists."""
    ev = ent.where((F.col("entity_type") == "event") & (F.col("last_seen_at") >= ago(as_of, days * 86400)))
    ev = ev.orderBy(F.col("last_seen_at").desc(), "id").limit(limit)
    coins = ent.where("entity_type = 'coin'").select(F.col("id").alias("target_id"), F.col("symbol").alias("_sym"))
    r = rel.where("relation_type = 'impacts'").join(ev.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(coins, "target_id")
    ctx = F.coalesce("context", F.lit(""))
    side = F.when(ctx.contains("positive"), "positive").when(ctx.contains("negative"), "negative")
    g = r.groupBy(F.col("source_id").alias("id")).agg(
        F.array_sort(F.collect_set("_sym")).alias("_coins"), F.max_by(side, F.when(side.isNotNull(), F.col("_sym"))).alias("_impact")
    )
    out = ev.join(g, "id", "left").select(
        "id", "name", F.col("last_seen_at").alias("timestamp"), F.col("mention_count").alias("mentions"),
        F.when(F.col("_coins").isNotNull(), F.coalesce("_impact", F.lit("neutral"))).otherwise(F.coalesce("impact", F.lit("neutral"))).alias("impact"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("_coins", "coins", F.array().cast("array<string>")).alias("coins"), F.coalesce("origin", F.lit("keyword")).alias("origin"),
    )
    return out.where(F.array_contains("coins", coin)) if coin else out
