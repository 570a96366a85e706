"""Social and market sources: landed raw payloads to post, price and coin rows.

Each function takes a frame with a ``payload`` string column (JSON, XML or
HTML text as it was fetched) and returns typed rows; a payload that cannot be
read gives no rows.  Rows of all platforms share one layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import sanitize, strip_board_markup, title_and_body, truncate, view_count
from tidemark.functions.scores import trending_modifier
from tidemark.operators.keyed import exploded, first_per_key, top_k
from tidemark.operators.mentions import topic_related
from tidemark.semantics import at, col, squeeze

LISTING = (
    "struct<data:struct<children:array<struct<data:struct<name:string,title:string,selftext:string,author:string,permalink:string,ups:int,"
    "upvote_ratio:double,num_comments:int,total_awards_received:int,score:int,link_flair_text:string,created_utc:double,"
    "subreddit_subscribers:long>>>>>"
)
KEYWORD_POSTS = "struct<data:array<struct<id:string,text:string,media_type:string,permalink:string,timestamp:string,username:string>>>"
TWEETS = (
    "array<struct<id:string,text:string,full_text:string,created_at:string,username:string,favorite_count:int,retweet_count:int,"
    "reply_count:int,quote_count:int,user_verified:boolean,user_is_blue_verified:boolean,user_followers_count:long,is_retweet:boolean,"
    "hashtags:array<string>>>"
)
TRENDING = "struct<coins:array<struct<item:struct<id:string,name:string,symbol:string,slug:string,score:int,market_cap_rank:int>>>>"
CATALOG = "array<struct<threads:array<struct<no:long,sub:string,com:string,replies:int,last_modified:long>>>>"
THREAD = "struct<posts:array<struct<no:long,com:string,name:string,time:long,replies:int>>>"
MARKET = (
    "array<struct<id:string,symbol:string,name:string,image:string,current_price:double,market_cap:double,market_cap_rank:int,"
    "total_volume:double,price_change_24h:double,price_change_percentage_24h:double,circulating_supply:double>>"
)
# Chat channels that are read and those that are not.
CHAT_ALLOW = [
    "crypto", "memecoin", "meme", "trading", "signals", "degen", "alpha", "pump", "gem", "coin", "token", "defi", "solana", "general", "chat",
    "discussion",
]
CHAT_DENY = ["bot-commands", "rules", "announcements", "welcome", "intro", "roles", "verify", "mod", "admin", "log", "nsfw"]
MIN_MESSAGE = 20
MAX_THREADS, MIN_REPLIES = 30, 3


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one payload per file, with the file path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("path"))


def parsed(payloads: DataFrame, schema: str, *keep: str) -> DataFrame:
    return payloads.select(*keep, F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("j"))


def post_rows(df: DataFrame, **cols: Column) -> DataFrame:
    """Common post layout; anything not given is zero or null."""
    zero = {c: F.lit(0) for c in ("upvotes", "num_comments", "num_awards", "score")}
    null = {c: F.lit(None).cast("string") for c in ("body", "flair", "metadata", "permalink", "author")}
    all_ = {**zero, **null, "upvote_ratio": F.lit(0.0), **cols}
    types = {"upvotes": "int", "num_comments": "int", "num_awards": "int", "score": "int", "upvote_ratio": "double"}
    order = ["source", "source_id", "channel", "title", "body", "author", "permalink", "upvotes", "upvote_ratio", "num_comments", "num_awards",
             "score", "flair", "posted_at", "metadata"]
    return df.select(*[all_[c].cast(types[c]).alias(c) if c in types else all_[c].alias(c) for c in order])


def listing_posts(payloads: DataFrame) -> DataFrame:
    """Forum listing JSON with a ``channel`` column."""
    p = exploded(parsed(payloads, LISTING, "channel"), F.col("j.data.children.data"), "p", "channel")
    e = F.nullif(F.col("p.selftext"), F.lit(""))
    flair = F.nullif(F.col("p.link_flair_text"), F.lit(""))
    return post_rows(
        p, source=F.lit("reddit"), source_id=F.concat(F.lit("reddit_"), "p.name"), channel=F.col("channel"), title=sanitize("p.title"), body=sanitize(e),
        author=F.col("p.author"), permalink=F.concat(F.lit("https://reddit.com"), "p.permalink"), upvotes=F.col("p.ups"),
        upvote_ratio=F.col("p.upvote_ratio"), num_comments=F.col("p.num_comments"), num_awards=F.col("p.total_awards_received"), score=F.col("p.score"),
        flair=sanitize(flair), posted_at=F.timestamp_micros((F.col("p.created_utc") * 1_000_000).cast("long")),
        metadata=F.to_json(F.struct(F.col("p.subreddit_subscribers").alias("subreddit_subscribers")), {"ignoreNullFields": "false"}),
    )


def atom_posts(payloads: DataFrame) -> DataFrame:
    """Atom feed text with a ``channel`` column."""
    e = exploded(payloads, F.regexp_extract_all("payload", F.lit(r"<entry>([\s\S]*?)</entry>"), F.lit(1)), "e", "channel")

    def tag(p: str) -> Column:
        return F.regexp_extract("e", p, 1)

    def decode(x: Column, pairs: Sequence[tuple[str, str]]) -> Column:
        for a, b in pairs:
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    link, published = tag(r'<link\s+href="([^"]+)"'), tag("<updated>([^<]+)</updated>")
    title = decode(tag("<title>([^<]*)</title>"), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'), ("&#x200B;", "")])
    raw = F.nullif(tag(r"<content[^>]*>([\s\S]*?)</content>"), F.lit(""))
    content = squeeze(F.regexp_replace(decode(raw, [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')]), "<[^>]+>", " "))
    author = F.coalesce(F.nullif(F.regexp_replace(tag("<name>([^<]*)</name>"), "^/u/", ""), F.lit("")), F.lit("unknown"))
    post_id = F.coalesce(F.nullif(F.regexp_extract(link, "comments/([a-z0-9]+)", 1), F.lit("")), tag("<id>([^<]+)</id>"))
    e = e.where((tag("<id>([^<]+)</id>") != "") & (tag("<title>([^<]*)</title>") != ""))
    return post_rows(
        e, source=F.lit("reddit"), source_id=F.concat(F.lit("reddit_t3_"), post_id), channel=F.col("channel"), title=sanitize(title),
        body=truncate(content, 2000), author=sanitize(author),
        permalink=F.regexp_replace(F.replace(link, F.lit("https://www.reddit.com"), F.lit("")), r"[^\x20-\x7E/]", ""), posted_at=published.try_cast("timestamp"),
    )


def channel_page_posts(payloads: DataFrame, crawled_at) -> DataFrame:
    """Public channel page HTML: one block per message, marked by its data-post attribute."""
    blocks = F.split("payload", r'(?=<div[^>]*class="[^"]*\btgme_widget_message\b[^"]*"[^>]*data-post=)')
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    b = exploded(payloads, blocks, "b")
    dp = F.regexp_extract("b", 'data-post="([^"]+)"', 1)
    inner = F.regexp_extract("b", r'(?s)<div[^>]*class="[^"]*tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', 1)
    text = F.trim(strip_board_markup(F.regexp_replace(inner, "(?i)<br ?/?>", "")))
    views = view_count(F.regexp_extract("b", r'class="[^"]*tgme_widget_message_views[^"]*"[^>]*>([^<]*)<', 1))
    when = F.regexp_extract("b", r'<time[^>]*datetime="([^"]+)"', 1).try_cast("timestamp")
    b = b.select(dp.alias("dp"), sanitize(text, False).alias("text"), views.alias("views"), F.coalesce(when, at(crawled_at)).alias("ts"))
    b = b.where((F.col("text") != "") & F.element_at(F.split("dp", "/"), -1).rlike("^[1-9]"))
    title, body = title_and_body("text")
    ch = F.element_at(F.split("dp", "/"), 1)
    return post_rows(
        b, source=F.lit("telegram"), source_id=F.concat(F.lit("tg_"), F.regexp_replace("dp", "/", "_")), channel=ch, title=title, body=body, author=ch,
        permalink=F.concat(F.lit("https://t.me/"), "dp"), upvotes=F.col("views"), score=F.col("views"), posted_at=F.col("ts"),
        metadata=F.to_json(F.struct("views")),
    )


def keyword_posts(payloads: DataFrame) -> DataFrame:
    p = exploded(parsed(payloads, KEYWORD_POSTS), F.col("j.data"), "p").withColumn("text", sanitize(F.coalesce("p.text", F.lit("")), False))
    title, body = title_and_body("text", keep_whole=True)
    return post_rows(
        p, source=F.lit("threads"), source_id=F.concat(F.lit("threads_"), "p.id"), channel=F.concat(F.lit("@"), "p.username"), title=title, body=body,
        author=F.col("p.username"), permalink=F.col("p.permalink"), posted_at=F.col("p.timestamp").try_cast("timestamp"),
        metadata=F.to_json(F.struct(F.col("p.media_type").alias("media_type"))),
    )


def tweet_posts(payloads: DataFrame, crawled_at) -> DataFrame:
    """Tweets; hashtags come as strings or as objects with a tag."""
    p = exploded(parsed(payloads, TWEETS), F.col("j"), "p")
    p = p.withColumn("text", sanitize(F.coalesce(F.nullif("p.full_text", F.lit("")), "p.text", F.lit("")), False))
    title, body = title_and_body("text", keep_whole=True)
    tag = F.transform(F.coalesce("p.hashtags", F.array().cast("array<string>")), lambda h: F.coalesce(F.get_json_object(h, "$.tag"), F.when(~h.startswith("{"), h)))
    tags = F.filter(tag, lambda h: h.isNotNull() & (h != ""))
    meta = F.struct(
        F.coalesce("p.retweet_count", F.lit(0)).alias("retweet_count"), F.coalesce("p.quote_count", F.lit(0)).alias("quote_count"),
        F.coalesce("p.user_verified", F.lit(False)).alias("user_verified"), F.coalesce("p.user_is_blue_verified", F.lit(False)).alias("user_is_blue_verified"),
        F.coalesce("p.user_followers_count", F.lit(0)).alias("user_followers_count"), tags.alias("hashtags"),
        F.coalesce("p.is_retweet", F.lit(False)).alias("is_retweet"),
    )
    likes, rts = F.coalesce("p.favorite_count", F.lit(0)), F.coalesce("p.retweet_count", F.lit(0))
    return post_rows(
        p, source=F.lit("twitter"), source_id=F.concat(F.lit("twitter_"), "p.id"), channel=F.concat(F.lit("@"), F.coalesce("p.username", F.lit("unknown"))),
        title=title, body=body, author=F.col("p.username"), permalink=F.concat(F.lit("https://x.com/"), "p.username", F.lit("/status/"), "p.id"), upvotes=likes,
        num_comments=F.coalesce("p.reply_count", F.lit(0)), score=likes + rts * 2, posted_at=F.coalesce(F.col("p.created_at").try_cast("timestamp"), at(crawled_at)),
        metadata=F.to_json(meta),
    )


def trending_posts(payloads: DataFrame, as_of) -> DataFrame:
    """Trending list as one pseudo post per coin and hour."""
    p = exploded(parsed(payloads, TRENDING), F.col("j.coins.item"), "c").withColumn("rank", F.col("c.score") + 1)
    meta = F.struct(F.col("rank").alias("trending_rank"), F.col("c.id").alias("coingecko_id"), F.col("c.market_cap_rank").alias("market_cap_rank"))
    return post_rows(
        p, source=F.lit("coingecko"), source_id=F.concat(F.lit("cg_trending_"), "c.id", F.lit("_"), F.date_format(at(as_of), "yyyy-MM-dd'T'HH")),
        channel=F.lit("trending"), title=F.format_string("CoinGecko Trending #%d: %s (%s)", "rank", "c.name", F.upper("c.symbol")), author=F.lit("coingecko"),
        permalink=F.concat(F.lit("https://www.coingecko.com/en/coins/"), "c.slug"), score=trending_modifier("rank"),
        flair=F.concat(F.lit("rank_"), F.col("rank").cast("string")), posted_at=at(as_of), metadata=F.to_json(meta, {"ignoreNullFields": "false"}),
    )


def with_fallback_mentions(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of trending posts; a post the extractor found nothing in names its own coin.

    ``posts`` has id, title and metadata; ``mentions`` is the extractor's output for them.
    """
    rank = F.get_json_object("metadata", "$.trending_rank")
    note = F.concat(F.lit("CoinGecko Trending #"), rank)
    tail = posts.select("id", "title", note.alias("note"))
    found = mentions.join(tail.select("id", "note"), "id").withColumn("context", F.coalesce("context", "note")).drop("note")
    own = tail.join(mentions.select("id").distinct(), "id", "left_anti").select(
        "id", F.regexp_extract("title", r"\(([^()]*)\)$", 1).alias("coin_symbol"), F.regexp_extract("title", r"#\d+: (.*) \([^()]*\)$", 1).alias("coin_name"),
        F.lit(1).alias("mention_count"), F.col("note").alias("context"),
    )
    return found.select(*own.columns).unionByName(own)


def board_threads(catalogs: DataFrame, coin_words: list[str] | None = None, limit: int = MAX_THREADS) -> DataFrame:
    """Threads on topic with enough replies of catalogs (board, payload): the most recently changed ``limit`` of each board."""
    pages = exploded(parsed(catalogs, CATALOG, "board"), F.col("j"), "pg", "board")
    t = exploded(pages, F.col("pg.threads"), "t", "board").select("board", "t.*")
    plain = strip_board_markup(F.concat_ws(" ", F.coalesce("sub", F.lit("")), F.coalesce("com", F.lit(""))))
    t = t.where(topic_related(plain, coin_words) & (F.col("replies") >= MIN_REPLIES))
    return top_k(t, ["board"], [F.col("last_modified").desc(), F.col("no")], limit)


def board_posts(threads: DataFrame, coin_words: list[str] | None = None) -> DataFrame:
    """Thread payloads (thread_no, sub, payload): the opening post always, replies only on topic."""
    p = exploded(parsed(threads, THREAD, "thread_no", "sub"), F.col("j.posts"), "p", "thread_no", "sub", pos="pos")
    p = p.withColumn("text", sanitize(strip_board_markup(F.coalesce("p.com", F.lit(""))), False))
    op = F.col("pos") == 0
    p = p.where((F.char_length("text") >= 10) & (op | topic_related(F.col("text"), coin_words)))
    subject = F.nullif(F.col("sub"), F.lit(""))
    title, body = title_and_body("text")
    no = F.col("p.no").cast("string")
    thread = F.col("thread_no").cast("string")
    replies = F.when(op, F.coalesce("p.replies", F.lit(0))).otherwise(0)
    return post_rows(
        p, source=F.lit("4chan"), source_id=F.concat(F.lit("4chan_biz_"), no), channel=F.concat(F.lit("/biz/"), thread),
        title=F.when(op & subject.isNotNull(), truncate(sanitize(strip_board_markup(subject), False), 200)).otherwise(title), body=body,
        author=sanitize(F.coalesce(F.nullif("p.name", F.lit("")), F.lit("Anonymous")), False),
        permalink=F.concat(F.lit("https://boards.4chan.org/biz/thread/"), thread, F.lit("#p"), no), num_comments=replies, score=replies,
        posted_at=F.timestamp_seconds("p.time"),
        metadata=F.to_json(F.struct(F.lit("biz").alias("board"), F.col("thread_no"), op.alias("is_op"))),
    )


def chat_posts(messages: DataFrame, deny: Sequence[str] = tuple(CHAT_DENY), allow: Sequence[str] = tuple(CHAT_ALLOW)) -> DataFrame:
    """Chat messages (id, guild, guild_id, channel, channel_id, author, is_bot, content, created_at); works on streams too."""
    m = messages.where(~F.coalesce("is_bot", F.lit(False)) & (F.char_length("content") >= MIN_MESSAGE) & channel_allowed("channel", deny, allow))
    m = m.withColumn("text", sanitize("content", False))
    title, body = title_and_body("text")
    return post_rows(
        m, source=F.lit("discord"), source_id=F.concat(F.lit("discord_"), F.col("id").cast("string")),
        channel=sanitize(F.concat(F.coalesce("guild", F.lit("unknown")), F.lit("/#"), "channel"), False), title=title, body=body,
        author=sanitize("author", False), permalink=F.concat_ws("/", F.lit("https://discord.com/channels"), "guild_id", "channel_id", "id"),
        posted_at=F.col("created_at"),
    )


def market_rows(payloads: DataFrame, fetched_at) -> tuple[DataFrame, DataFrame]:
    """(price rows without null prices, coin updates) of a market snapshot."""
    i = exploded(parsed(payloads, MARKET), F.col("j"), "i")
    prices = i.where(F.col("i.current_price").isNotNull()).select(
        F.col("i.id").alias("coingecko_id"), F.col("i.current_price").alias("price_usd"), "i.market_cap", F.col("i.total_volume").alias("volume_24h"),
        "i.price_change_24h", F.col("i.price_change_percentage_24h").alias("price_change_pct_24h"), "i.circulating_supply", at(fetched_at).alias("fetched_at"),
    )
    return prices, i.select(F.col("i.id").alias("coingecko_id"), F.col("i.image").alias("image_url"), "i.market_cap_rank")


def sync_coins(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listing row per wanted coin: same symbol, exact name first, else the first of the listing (column ``pos``)."""
    l = listing.select(F.col("id").alias("coingecko_id"), F.upper("symbol").alias("symbol"), F.lower("name").alias("_name"), "pos")
    j = l.join(wanted.select(F.upper("symbol").alias("symbol"), "name"), "symbol")
    best = first_per_key(j, ["symbol", "name"], [(F.col("_name") == F.lower("name")).desc(), F.col("pos")])
    return best.select("coingecko_id", "symbol", "name", F.lit(True).alias("is_active"))


def admit(posts: DataFrame, channels: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Posts at or over their channel's minimum score and a 0.5 upvote ratio, first per name."""
    p = posts.join(channels, "channel").where(
        (F.col("score") >= F.col("min_score")) & (F.coalesce("upvote_ratio", F.lit(1.0)) >= 0.5)
    )
    return first_per_key(p, [key], order)


def channel_allowed(name, deny: Sequence[str], allow: Sequence[str]) -> Column:
    """Deny words win, then an allow word is needed."""
    low = F.lower(col(name))

    def any_of(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.coalesce(~any_of(deny) & any_of(allow), F.lit(False))
