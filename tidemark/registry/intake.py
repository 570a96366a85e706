"""Mention extraction, payload sources, sinks, exports and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidemark.operators import mentions as M
from tidemark.operators.keyed import first_per_key
from tidemark.plans import phases
from tidemark.plans import signals as G
from tidemark.registry.base import AS_OF, query
from tidemark.registry.feed import NAMES, PATH, SEG, TAGS_SQL, cats, tagged, trim_
from tidemark.semantics import js_round
from tidemark.session import cut_lineage
from tidemark.sources import exports as E
from tidemark.sources import feeds as SF
from tidemark.sources import sinks as K
from tidemark.sources import social as SO
from tidemark.sources import tables as TB
from tidemark.streaming import streams as ST

T0 = f"TIMESTAMP '{AS_OF}'"


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


# --- P1: coins are the words of the documents that occur often enough ----------------------

COIN_SQL = """SELECT upper(w) AS symbol, 'the ' || w AS name, w FROM (
 SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS w FROM documents) a WHERE length(w) BETWEEN 4 AND 8 GROUP BY 1) b WHERE n >= 40"""


def text_coins(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).where(F.char_length("w").between(4, 8))
    top = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")
    # coins are a stored table in practice; keep the derived one from being counted again per use
    return cut_lineage(top.select(F.upper("w").alias("symbol"), F.concat(F.lit("the "), "w").alias("name")))


def text_posts(t):
    """Documents as posts, with cashtags appended so that every pass has work."""
    tag = F.upper(F.regexp_extract("text", "([A-Za-z]{4,8})", 1))
    body = F.concat("text", F.lit(" $"), tag, F.lit(" and #"), tag)
    return t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("About "), tag).alias("title"), body.alias("body"))


POST_SQL = """SELECT doc_id AS id, 'About ' || tag AS title, text || ' $' || tag || ' and #' || tag AS body, tag FROM (
 SELECT doc_id, text, upper(regexp_extract(text, '([A-Za-z]{4,8})', 1)) AS tag FROM documents) x"""
MENTION_SQL = rf"""
WITH coins AS MATERIALIZED ({COIN_SQL}), posts AS MATERIALIZED (SELECT id, title, lower(title || chr(10) || body) AS low, title || chr(10) || body AS full_text FROM ({POST_SQL}) p),
words AS MATERIALIZED (SELECT DISTINCT id, unnest(regexp_extract_all(low, '([a-z0-9_]+)', 1)) AS w FROM posts),
al AS (SELECT d.id, c.symbol, 1 AS n FROM words d JOIN coins c ON c.w = d.w
  UNION ALL SELECT d.id, c.symbol, 1 FROM words d JOIN coins c ON c.w = d.w JOIN posts p ON p.id = d.id WHERE regexp_matches(p.low, '\b' || c.name || '\b')),
tk AS (SELECT id, upper(s) AS symbol, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(full_text, '[$#]([A-Za-z]{{2,10}})\b', 1)) AS s FROM posts) a GROUP BY 1, 2)
SELECT id, symbol AS coin_symbol, CAST(sum(n) AS INT) AS mention_count FROM (SELECT * FROM al UNION ALL SELECT k.* FROM tk k JOIN coins c ON c.symbol = k.symbol) u GROUP BY 1, 2"""


@query("p1_mentions", MENTION_SQL)
def p1(t):
    return M.extract_mentions(text_posts(t), text_coins(t), context=False).select("id", "coin_symbol", "mention_count")


@query("p1_mentions_strict", r"""
WITH coins AS MATERIALIZED (""" + COIN_SQL + r"""), posts AS MATERIALIZED (SELECT id, lower(title || chr(10) || body) AS low, title || chr(10) || body AS full_text FROM (""" + POST_SQL + r""") p),
words AS (SELECT DISTINCT id, unnest(regexp_extract_all(low, '([a-z0-9_]+)', 1)) AS w FROM posts),
al AS (SELECT d.id, c.symbol, 1 AS n FROM words d JOIN coins c ON c.w = d.w WHERE length(c.w) >= 8
  UNION ALL SELECT d.id, c.symbol, 1 FROM words d JOIN coins c ON c.w = d.w JOIN posts p ON p.id = d.id WHERE length(c.name) >= 8 AND regexp_matches(p.low, '\b' || c.name || '\b')),
tk AS (SELECT id, upper(s) AS symbol, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(full_text, '[$#]([A-Za-z]{2,10})\b', 1)) AS s FROM posts) a GROUP BY 1, 2)
SELECT id, symbol AS coin_symbol, CAST(sum(n) AS INT) AS mention_count FROM (SELECT * FROM al UNION ALL SELECT k.* FROM tk k JOIN coins c ON c.symbol = k.symbol) u GROUP BY 1, 2""")
def p1s(t):
    return M.extract_mentions(text_posts(t), text_coins(t), strict=True, context=False).select("id", "coin_symbol", "mention_count")


def around(at, n):
    return f"substr(full_text, greatest({at} - 30, 0) + 1, least({at} + {n} + 30, length(full_text)) - greatest({at} - 30, 0))"


@query("h16_mention_context", rf"""
WITH coins AS MATERIALIZED ({COIN_SQL}), posts AS MATERIALIZED (SELECT id, lower(title || chr(10) || body) AS low, title || chr(10) || body AS full_text FROM ({POST_SQL}) p),
named AS (SELECT d.id, c.symbol, c.name, c.w FROM (SELECT DISTINCT id, unnest(regexp_extract_all(low, '([a-z0-9_]+)', 1)) AS w FROM posts) d JOIN coins c ON c.w = d.w),
tk AS (SELECT DISTINCT id, upper(s) AS symbol FROM (SELECT id, unnest(regexp_extract_all(full_text, '[$#]([A-Za-z]{{2,10}})\b', 1)) AS s FROM posts) a),
hit AS (SELECT coalesce(n.id, t.id) AS id, coalesce(n.symbol, t.symbol) AS symbol, n.name, n.w, t.id IS NOT NULL AS tick FROM named n FULL JOIN (SELECT tk.* FROM tk JOIN coins USING (symbol)) t ON t.id = n.id AND t.symbol = n.symbol),
pl AS (SELECT h.*, p.full_text, length(regexp_extract(p.full_text, '(?is)^(.*?)[$#]' || h.symbol || '\b', 1)) AS at_tick,
  length(regexp_extract(p.low, '(?s)^(.*?)\b' || h.name || '\b', 1)) AS at_name, regexp_matches(p.low, '\b' || h.name || '\b') AS has_name, length(regexp_extract(p.low, '(?s)^(.*?)\b' || h.w || '\b', 1)) AS at_word
  FROM hit h JOIN posts p ON p.id = h.id)
SELECT id, symbol AS coin_symbol, nullif({trim_("replace(CASE WHEN tick THEN " + around("at_tick", "length(symbol) + 1") + " WHEN has_name THEN " + around("at_name", "length(name)") + " ELSE " + around("at_word", "length(w)") + " END, chr(10), ' ')")}, '') AS context FROM pl""")
def h16(t):
    return M.extract_mentions(text_posts(t), text_coins(t)).select("id", "coin_symbol", "context")


@query("p1_mentions_loose", r"""
WITH coins AS MATERIALIZED (""" + COIN_SQL + r"""), posts AS MATERIALIZED (SELECT id, lower(title || chr(10) || body) AS low, title || chr(10) || body AS full_text FROM (""" + POST_SQL + r""") p),
al AS (SELECT p.id, c.symbol, CASE WHEN contains(p.low, c.name) THEN 2 ELSE 1 END AS n FROM posts p JOIN coins c ON contains(p.low, c.w)),
tk AS (SELECT id, upper(s) AS symbol, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(full_text, '[$#]([A-Za-z]{2,10})\b', 1)) AS s FROM posts) a GROUP BY 1, 2)
SELECT id, symbol AS coin_symbol, CAST(sum(n) AS INT) AS mention_count FROM (SELECT * FROM al UNION ALL SELECT k.* FROM tk k JOIN coins c ON c.symbol = k.symbol) u GROUP BY 1, 2""")
def p1l(t):
    return M.extract_mentions_loose(text_posts(t), text_coins(t))


# written out, so that a lost word of the library shows
TOPIC_RE = (
    "crypto|cryptocurrency|blockchain|defi|nft|token|memecoin|meme coin|shitcoin|altcoin|pump|dump|moon|hodl|wagmi|ngmi|degen|rug|rugpull|airdrop|staking|yield|swap|dex|cex|"
    r"binance|coinbase|kraken|uniswap|raydium|jupiter|solana|ethereum|bitcoin|base chain|arbitrum|pump\.fun|pumpfun|bonding curve|market cap"
)


@query("b15_topic_predicate", rf"SELECT id FROM ({POST_SQL}) p WHERE regexp_matches(title, '\$[A-Z]{{2,10}}\b') OR regexp_matches(lower(title || ' ' || left(body, length(body) - length(tag) * 2 - 8)), '{TOPIC_RE}')")
def b15(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("About "), F.upper(F.regexp_extract("text", "([A-Za-z]{4,8})", 1)), F.lit(" "), "text").alias("x"))
    return d.where(M.topic_related(F.col("x"))).select("id")


# --- payload sources: raw payloads are rebuilt from the tables -----------------------


def js(x):
    return F.to_json(x)


@query("s1_listing", "SELECT 'reddit_t3_' || event_id AS source_id, 'ch' || (user_id % 12) AS channel, event_type AS title, CASE WHEN event_id % 2 = 0 THEN props END AS body, CAST(floor(value) AS INT) AS score, epoch_us(date_trunc('second', ts)) AS posted_us FROM events")
def s1(t):
    e = t.events
    post = F.struct(
        F.concat(F.lit("t3_"), F.col("event_id").cast("string")).alias("name"), F.concat("event_type", F.lit("\u0007")).alias("title"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("").alias("selftext"), F.lit("a").alias("author"), F.lit("/r/x").alias("permalink"),
        F.floor("value").cast("int").alias("score"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("created_utc"))
    p = e.select(F.concat(F.lit("ch"), (F.col("user_id") % 12).cast("string")).alias("channel"), F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))).alias("payload"))
    return SO.listing_posts(p).select("source_id", "channel", "title", "body", "score", us("posted_at").alias("posted_us"))


@query("s2_atom_feed", "SELECT 'reddit_t3_p' || doc_id AS source_id, source AS channel, lang || ' & ' || source AS title, 'user' || doc_id AS author, substr(trim(regexp_replace(replace(replace(replace(text, '<', ' '), '>', ' '), '&', ' '), '\\s+', ' ', 'g')), 1, 2000) AS body FROM documents")
def s2(t):
    plain = F.translate("text", "<>&", "   ")
    i = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("<entry><id>t3_"), i, F.lit("</id><title>"), F.col("lang"), F.lit(" &amp; "), F.col("source"), F.lit("</title><author><name>/u/user"), i,
        F.lit('</name></author><link href="https://www.reddit.com/r/x/comments/p'), i, F.lit('/t/"/><updated>2024-01-01T00:00:00+00:00</updated><content type="html">&lt;p&gt;'), plain,
        F.lit("&lt;/p&gt;</content></entry>"))
    p = t.documents.select(F.col("source").alias("channel"), F.concat(F.lit("<feed>"), entry, F.lit("</feed>")).alias("payload"))
    return SO.atom_posts(p).select("source_id", "channel", "title", "author", "body")


@query("s3_channel_page", "SELECT 'tg_ch' || (user_id % 12) || '_' || (event_id + 1) AS source_id, event_type || ' ' || props AS title, CAST(floor(round(value, 1) * 1000 + 0.5) AS INT) AS score, epoch_us(date_trunc('second', ts)) AS posted_us FROM events")
def s3(t):
    block = F.concat(
        F.lit('<div class="tgme_widget_message js" data-post="ch'), (F.col("user_id") % 12).cast("string"), F.lit("/"), (F.col("event_id") + 1).cast("string"),
        F.lit('"><div class="tgme_widget_message_text js">'), F.col("event_type"), F.lit(" <b>"), F.replace("props", F.lit('"'), F.lit("&quot;")), F.lit('</b></div><span class="tgme_widget_message_views">'),
        F.format_string("%.1fK", F.round("value", 1)), F.lit('</span><time datetime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00">x</time></div>'))
    return SO.channel_page_posts(t.events_spread.select(F.concat(F.lit("<html>"), block, F.lit("</html>")).alias("payload")), AS_OF).select(
        "source_id", "title", "score", us("posted_at").alias("posted_us"))


@query("s4_keyword_posts", "SELECT 'threads_' || doc_id AS source_id, '@' || lang AS channel, substr(text, 1, 200) AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 2000) ELSE nullif(text, '') END AS body FROM documents")
def s4(t):
    post = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.lit("TEXT").alias("media_type"), F.col("lang").alias("username"))
    return SO.keyword_posts(t.documents.select(js(F.struct(F.array(post).alias("data"))).alias("payload"))).select("source_id", "channel", "title", "body")


@query("s5_tweets", """SELECT 'twitter_' || event_id AS source_id, '@' || event_type AS channel, props AS title, CAST(event_id * 7 % 200 + 2 * (event_id % 50) AS INT) AS score,
 '["' || event_type || '","t' || (event_id % 3) || '"]' AS hashtags FROM events""")
def s5(t):
    e = F.col("event_id")
    tags = F.array(F.col("event_type"), F.concat(F.lit('{"tag":"t'), (e % 3).cast("string"), F.lit('"}')), F.lit(""))
    body = js(F.struct(e.cast("string").alias("id"), F.col("props").alias("full_text"), F.col("event_type").alias("username"), (e * 7 % 200).cast("int").alias("favorite_count"),
                       (e % 50).cast("int").alias("retweet_count")))
    raw = F.concat(F.lit("["), F.regexp_replace(body, r"\}$", ""), F.lit(',"hashtags":["'), F.col("event_type"), F.lit('",{"tag":"t'), (e % 3).cast("string"), F.lit('"},""]}]'))
    p = SO.tweet_posts(t.events_spread.select(raw.alias("payload")), AS_OF)
    return p.select("source_id", "channel", "title", "score", F.get_json_object("metadata", "$.hashtags").alias("hashtags"))


@query("s6_trending", f"SELECT 'cg_trending_c' || event_id || '_2024-01-30T00' AS source_id, 'CoinGecko Trending #' || (event_id % 15 + 1) || ': Coin ' || event_type || ' (C' || (user_id % 40) || ')' AS title, CAST(CASE WHEN event_id % 15 + 1 <= 3 THEN 12 WHEN event_id % 15 + 1 <= 7 THEN 8 ELSE 5 END AS INT) AS score FROM events")
def s6(t):
    item = F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("Coin "), "event_type").alias("name"),
                    F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("symbol"), (F.col("event_id") % 15).cast("int").alias("score"))
    return SO.trending_posts(t.events.select(js(F.struct(F.array(F.struct(item.alias("item"))).alias("coins"))).alias("payload")), AS_OF).select("source_id", "title", "score")


@query("s7_board_threads", """SELECT board, no FROM (SELECT 'b' || user_id % 3 AS board, event_id AS no, CASE WHEN event_type IN ('click', 'error') THEN 'bitcoin ' || props ELSE props END AS x, event_id % 9 AS replies, epoch_us(ts) AS lm FROM events) e
 WHERE contains(x, 'bitcoin') AND replies >= 3 QUALIFY row_number() OVER (PARTITION BY board ORDER BY lm DESC, no) <= 30""")
def s7(t):
    th = F.struct(F.col("event_id").alias("no"), F.when(F.col("event_type").isin("click", "error"), F.lit("bitcoin")).alias("sub"), F.concat(F.lit("<b>"), "props", F.lit("</b>")).alias("com"),
                  (F.col("event_id") % 9).cast("int").alias("replies"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_modified"))
    board = F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("board")
    return SO.board_threads(t.events.select(board, js(F.array(F.struct(F.array(th).alias("threads")))).alias("payload"))).select("board", "no")


@query("s7_board_posts", """SELECT '4chan_biz_' || (conv_id * 1000 + turn) AS source_id, CASE WHEN turn = 0 THEN 'subject ' || conv_id ELSE substr(trim(text), 1, 200) END AS title FROM (
 SELECT conv_id, turn, replace(replace(text, '<', ' '), '&', ' ') AS text FROM conversations) c
 WHERE length(trim(text)) >= 10 AND (turn = 0 OR regexp_matches(lower(text), '""" + TOPIC_RE + """') OR regexp_matches(text, '\\$[A-Z]{2,10}\\b'))""")
def s7p(t):
    post = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("no"), F.translate("text", "<&", "  ").alias("com"), F.lit(0).alias("time"), F.lit(5).alias("replies"))
    th = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]).alias("posts"))
    pay = th.select(F.col("conv_id").alias("thread_no"), F.concat(F.lit("subject "), F.col("conv_id").cast("string")).alias("sub"), js(F.struct("posts")).alias("payload"))
    return SO.board_posts(pay).select("source_id", "title")


@query("s8_chat_posts", "SELECT 'discord_' || (conv_id * 1000 + turn) AS source_id, 'g' || conv_id || '/#chat-' || role AS channel, substr(text, 1, 200) AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 2000) END AS body FROM conversations WHERE role = 'user' AND length(text) >= 20")
def s8(t):
    return SO.chat_posts(chat(t.conversations)).select("source_id", "channel", "title", "body")


def chat(c):
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("guild"), F.col("conv_id").cast("string").alias("guild_id"),
        F.concat(F.lit("chat-"), "role").alias("channel"), F.lit("1").alias("channel_id"), F.col("role").alias("author"), (F.col("role") == "assistant").alias("is_bot"),
        F.when(F.col("role") == "system", F.lit("short")).otherwise(F.col("text")).alias("content"), F.lit(AS_OF).cast("timestamp").alias("created_at"))


@query("s9_market_prices", "SELECT 'c' || p_partkey AS coingecko_id, p_retailprice AS price_usd, p_size * 1.0E6 AS market_cap FROM part WHERE p_size <= 40")
def s9(t):
    i = F.struct(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") <= 40, F.col("p_retailprice")).alias("current_price"), (F.col("p_size") * 1.0e6).alias("market_cap"),
                 F.col("p_size").alias("market_cap_rank"))
    return SO.market_rows(t.part.select(js(F.array(i)).alias("payload")), AS_OF)[0].select("coingecko_id", "price_usd", "market_cap")


@query("s9_coin_updates", "SELECT 'c' || p_partkey AS coingecko_id, p_size AS market_cap_rank FROM part")
def s9u(t):
    i = F.struct(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("market_cap_rank"))
    return SO.market_rows(t.part.select(js(F.array(i)).alias("payload")), AS_OF)[1].select("coingecko_id", "market_cap_rank")


@query("s10_coin_sync", """SELECT coingecko_id, symbol FROM (SELECT 'p' || p_partkey AS coingecko_id, upper('s' || (p_partkey % 60)) AS symbol,
 row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY CASE WHEN lower(p_name) = 'red widget' THEN 0 ELSE 1 END, p_partkey) AS rn FROM part WHERE p_partkey % 60 < 25) x WHERE rn = 1""")
def s10(t):
    listing = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("p_partkey") % 60).cast("string")).alias("symbol"),
                            F.upper("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    wanted = t.nation.select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit("Red Widget").alias("name"))
    return SO.sync_coins(listing, wanted).select("coingecko_id", "symbol")


@query("s11_rss_items", f"""SELECT event_id, 'event ' || event_type || ' of user' || user_id AS title, 'https://x.example.com/a/' || event_id || '?p=1' AS link, 'by' || user_id AS author, epoch_us(date_trunc('second', ts)) AS published_us
 FROM events WHERE ts >= {T0} - INTERVAL 20 DAY""")
def s11(t):
    e = F.col("event_id").cast("string")
    ts = F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(
        F.lit("<item><title><![CDATA[<b>event "), "event_type", F.lit("</b> of user"), F.col("user_id").cast("string"), F.lit("]]></title><link>https://x.example.com/a/"), e,
        F.lit("?utm_source=f&amp;p=1&amp;ref=q</link><dc:creator>by"), F.col("user_id").cast("string"), F.lit("</dc:creator><pubDate>"), ts, F.lit("</pubDate></item>"))
    p = t.events_spread.select(F.col("event_type").alias("source_name"), F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("payload"))
    r = SF.rss_items(p, AS_OF, max_age_days=20)
    return r.select(F.regexp_extract("link", r"/a/(\d+)", 1).cast("long").alias("event_id"), "title", "link", "author", us("published_at").alias("published_us"))


@query("s12_sitemap_entries", "SELECT url AS loc, epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 60 AS INT))) AS mod_us FROM pages WHERE page_id % 5 <> 2")
def s12(t):
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("page_id") % 5 + 1).cast("int"))
    sub = F.concat(F.lit("https://x.example.com/"), name, F.lit("-"), F.col("page_id").cast("string"), F.lit(".xml"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")
    leaf = t.pages.select(sub.alias("url"), F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc><lastmod>"), day, F.lit("</lastmod></url></urlset>")).alias("payload"))
    index = t.pages.select(F.concat(F.lit("https://x.example.com/index-"), F.col("page_id").cast("string")).alias("url"),
                           F.concat(F.lit("<sitemapindex><sitemap><loc>"), sub, F.lit("</loc></sitemap></sitemapindex>")).alias("payload"))
    return SF.sitemap_entries(leaf.unionByName(index)).select("loc", us("lastmod").alias("mod_us"))


@query("s13_api_items", f"""SELECT 'item ' || event_type || ' ' || user_id AS title, 'https://x.example.com/post/' || event_id || '/' || event_type AS link, CASE WHEN event_id % 2 = 0 THEN 'w' || user_id END AS author
 FROM events WHERE ts >= {T0} - INTERVAL 10 DAY""")
def s13(t):
    it = F.struct(F.struct(F.concat(F.lit("item "), "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("t")).alias("head"), F.col("event_id").cast("string").alias("id"),
                  F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("w"), F.col("user_id").cast("string"))).alias("who"),
                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))
    p = t.events_spread.select(F.lit("s").alias("source_name"), F.lit("https://x.example.com/api/list").alias("url"), js(F.struct(F.struct(F.array(it).alias("rows")).alias("out"))).alias("payload"))
    m = {"items": "out.rows", "title": "head.t", "link": "id", "author": "who", "date": "at"}
    return SF.api_items(p, AS_OF, m, "https://x.example.com/post/{id}/{1}", ["id", "kind"], max_age_days=10).select("title", "link", "author")


@query("h46_json_items", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def h46(t):
    fenced = F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json(SF.json_block(fenced)), "$.k", "string").alias("k"))


@query("h47_mapping_valid", "SELECT CAST(conv_id AS VARCHAR) AS source_name, count(*) >= 2 AND count(CASE WHEN turn < 5 AND role <> 'assistant' AND text <> '' THEN 1 END) / CAST(least(count(*), 5) AS DOUBLE) >= 0.5 AS valid FROM conversations GROUP BY 1")
def h47(t):
    it = F.struct("turn", F.struct(F.when(F.col("role") != "assistant", F.col("text")).alias("title"), F.col("role").alias("link")).alias("i"))
    g = t.conversations.groupBy(F.col("conv_id").cast("string").alias("source_name")).agg(F.transform(F.array_sort(F.collect_list(it)), lambda x: x["i"]).alias("items"))
    return SF.mapping_valid(g.select("source_name", js(F.struct("items")).alias("payload")), {"items": "items", "title": "title", "link": "link"})


def answers(t):
    """Model answers per batch of ten posts, the last of each batch missing."""
    s = t.v_sentiments.withColumn("batch_id", F.floor(F.col("post_id") / 10.0)).withColumn("pos", (F.col("post_id") % 10).cast("int"))
    asked = s.select("batch_id", F.row_number().over(Window.partitionBy("batch_id").orderBy("post_id")).alias("pos"), "post_id").withColumn("pos", F.col("pos") - 1)
    r = F.struct(F.when(F.col("post_id") % 2 == 0, F.col("post_id").cast("string")).alias("id"), F.col("sentiment_score").cast("string").alias("sentiment_score"),
                 F.when(F.col("post_id") % 3 > 0, F.col("sentiment_label")).alias("sentiment_label"), F.lit("n/a").alias("confidence"))
    j = s.select("post_id", r.alias("r")).join(asked, "post_id").where("pos < 7")
    pay = j.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias("results"))
    return pay.select("batch_id", F.concat(F.lit("```json\n"), js(F.struct("results")), F.lit("\n```")).alias("payload")), asked.withColumn("post_id", F.col("post_id").cast("string"))


@query("s15_model_results", """SELECT CAST(post_id AS VARCHAR) AS post_id, rn < 7 AS success, CASE WHEN rn < 7 THEN sentiment_score ELSE 0.0 END AS sentiment_score,
 CASE WHEN rn < 7 AND post_id % 3 > 0 THEN sentiment_label ELSE 'neutral' END AS sentiment_label, 0.0E0 AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY post_id // 10 ORDER BY post_id) - 1 AS rn FROM v_sentiments) x""")
def s15(t):
    a, asked = answers(t)
    return SF.model_results(a, asked).select("post_id", "success", "sentiment_score", "sentiment_label", "confidence")


@query("s16_scan_predicates", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 12 AND l_linenumber IN (1, 2)")
def s16(t):
    f = (F.col("l_returnflag") == "R") & F.col("l_quantity").between(10, 12) & F.col("l_linenumber").isin(1, 2)
    return t.lineitem.where(f).select("l_orderkey", "l_linenumber", "l_quantity")


# --- sinks ---------------------------------------------------------------------------


@query("s17_upsert", "SELECT channel, id, score FROM (SELECT *, row_number() OVER (PARTITION BY channel, author ORDER BY posted_at DESC, id) AS rn FROM v_posts) x WHERE rn = 1")
def s17(t):
    p = t.v_posts.select("channel", "author", "id", "score", "posted_at")
    old, new = t.v_posts.where("source IN ('click', 'view')").select(*p.columns), p
    base = first_per_key(old, ["channel", "author"], [F.col("posted_at").desc(), F.col("id")])
    return K.upsert(base, new, ["channel", "author"], [F.col("posted_at").desc(), F.col("id")]).select("channel", "id", "score")


@query("s18_replace_mentions", "SELECT post_id, coin_symbol, mention_count FROM v_mentions WHERE post_id NOT IN (SELECT id FROM v_posts WHERE source = 'click') UNION ALL SELECT id, 'NEW', 1 FROM v_posts WHERE source = 'click'")
def s18(t):
    new = t.v_posts.where("source = 'click'").select(F.col("id").alias("post_id"), F.lit("NEW").alias("coin_symbol"), F.lit(1).alias("mention_count"))
    return K.replace_by_key(t.v_mentions.select("post_id", "coin_symbol", "mention_count"), new, "post_id")


@query("s19_append", "SELECT id, player, trade_size FROM v_trades UNION ALL SELECT id + 1000000, player, initial_size FROM v_positions WHERE status = 'open'")
def s19(t):
    new = t.v_positions.where("status = 'open'").select((F.col("id") + 1000000).alias("id"), "player", F.col("initial_size").alias("trade_size"))
    folder = ST.stream_folder(t.spark, "append")
    K.append(t.v_trades.select("id", "player", "trade_size"), folder)
    K.append(new, folder)
    return t.spark.read.parquet(folder)


@query("s20_conditional_update", "SELECT id, coin_symbol FROM v_positions WHERE status = 'open' AND remaining_size > 0.01 AND id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def s20(t):
    ch = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("closed").alias("status"), F.lit(0.0).alias("remaining_size"))
    return K.update_if(t.v_positions, ch, "id", (F.col("status") == "open") & (F.col("remaining_size") > 0.01))[1].select("id", "coin_symbol")


@query("s21_retention", f"SELECT event_id FROM events WHERE ts >= {T0} - INTERVAL 20 DAY")
def s21(t):
    return K.retain(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", AS_OF, 20).select("event_id")


@query("s22_relabel", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'extremely_hot' WHEN 'O' THEN 'warm' ELSE 'other' END AS signal_label, CAST(o_orderkey AS VARCHAR) AS slug FROM orders")
def s22(t):
    lab = F.when(F.col("o_orderstatus") == "F", "strong_buy").when(F.col("o_orderstatus") == "O", "neutral").otherwise("other")
    d = t.orders.select(F.col("o_orderkey").alias("id"), lab.alias("signal_label"), F.lit(None).cast("string").alias("slug"))
    return K.backfill(K.relabel(d), slug="id")


@query("s23_category_rename", "SELECT id, CASE category WHEN 'src1' THEN 'news' ELSE category END AS category FROM v_articles WHERE category <> 'src2'")
def s23(t):
    ren = t.nation.where("n_nationkey = 1").select(F.lit("src1").alias("old"), F.lit("news").alias("new"))
    gone = t.nation.where("n_nationkey = 2").select(F.lit("src2").alias("name"))
    return K.delete_category(K.rename_category(t.v_articles, ren), gone).select("id", "category")


@query("s23_config_rename", """SELECT id, CASE WHEN contains(config, '"cat1"') THEN 'moved' ELSE json_extract_string(config, '$.category') END AS category FROM v_sources""")
def s23c(t):
    ren = t.nation.where("n_nationkey = 1").select(F.lit("cat1").alias("old"), F.lit("moved").alias("new"))
    return K.rename_config_category(t.v_sources, ren).select("id", F.get_json_object("config", "$.category").alias("category"))


@query("s23_reorder", "SELECT n_nationkey AS id, 26 - rn AS display_order FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation) x")
def s23r(t):
    c = t.nation.select(F.col("n_nationkey").alias("id"), F.lit(0).alias("display_order"))
    return K.reorder_categories(c, c.agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))).select("id", F.col("display_order").cast("long").alias("display_order"))


@query("s24_copy_articles", """SELECT source_url FROM (SELECT * FROM v_articles WHERE source_name = 'feed3' AND user_id <> 'u1' ORDER BY crawled_at DESC, id LIMIT 10) x""")
def s24(t):
    a = t.v_articles.withColumn("source_id", F.sha2("source_url", 256)).withColumn("published_at", F.col("crawled_at")).withColumn("id", F.col("id").cast("string"))
    return K.copy_from_others(a, "feed3", "u1").select("source_url")


@query("s25_register_sources", """SELECT base_url, action FROM (SELECT 'https://site' || (c_custkey * 2) || '.example.com' AS base_url,
 CASE WHEN s.s_suppkey IS NULL THEN 'insert' WHEN 'cat' || (c.c_nationkey % 5) <> 'cat' || (s.s_nationkey % 5) THEN 'update' ELSE 'skip' END AS action
 FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey * 2) x""")
def s25(t):
    inc = t.customer.select(
        F.concat(F.lit("https://site"), (F.col("c_custkey") * 2).cast("string"), F.lit(".example.com")).alias("base_url"), F.col("c_name").alias("name"),
        F.concat(F.lit("cat"), (F.col("c_nationkey") % 5).cast("string")).alias("category"), F.lit("AUTO").alias("crawler_type"), F.lit(None).cast("string").alias("resolved_type"),
        F.lit(None).cast("string").alias("selectors"))
    return K.register_sources(t.v_sources, inc).select("base_url", "action")


@query("s28_group_category", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, max(CASE WHEN lang = 'en' THEN source END) OVER (PARTITION BY doc_id // 5)) AS category FROM documents")
def s28(t):
    p = t.documents.select("doc_id", F.col("lang").alias("language"), F.floor(F.col("doc_id") / 5).alias("translation_group_id"), F.when(F.col("lang") == "en", F.col("source")).alias("category"))
    return K.fill_group_category(p, "en").select("doc_id", "category")


@query("s29_delete_titles", "SELECT id FROM v_articles WHERE NOT (source_name = 'feed1' AND title IN ('The', 'Das', ''))")
def s29(t):
    return K.delete_titles(t.v_articles, "feed1", ["The", "Das", ""]).select("id")


@query("j30_recommendations", """SELECT url FROM (SELECT url, pos FROM (SELECT page_id AS pos, url, lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) AS h FROM pages) c
 WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 9 = 0) AND h NOT IN (SELECT lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)) FROM pages WHERE page_id % 9 = 0) ORDER BY pos LIMIT 8) x
 UNION ALL SELECT 'https://news.example.com/rss'""")
def j30(t):
    c = t.pages.select("url", F.col("page_id").alias("pos"), F.lit("n").alias("name"))
    return K.recommendations(c, t.pages.where("page_id % 9 = 0").select("url"), 8, "https://news.example.com/rss").select("url")


@query("u1_union_dedup", "SELECT channel, min(id) AS id FROM v_posts WHERE score >= 50 OR source = 'click' GROUP BY 1")
def u1(t):
    a = t.v_posts.where("score >= 50").unionByName(t.v_posts.where("source = 'click'"))
    return first_per_key(a, ["channel"], [F.col("id")]).select("channel", "id")


@query("u2_distinct", "SELECT DISTINCT coin_symbol FROM v_mentions")
def u2(t):
    return t.v_mentions.select("coin_symbol").distinct()


@query("u3_except", "SELECT DISTINCT category AS name FROM v_articles EXCEPT SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey < 10")
def u3(t):
    have = cats(t).where("display_order < 10").select("name")
    return t.v_articles.select(F.col("category").alias("name")).distinct().exceptAll(have)


@query("u7_url_merge", "SELECT url FROM pages WHERE page_id % 2 = 0 UNION SELECT base_url FROM v_sources")
def u7(t):
    return K.merge_urls(t.pages.where("page_id % 2 = 0"), t.v_sources.select(F.col("base_url").alias("url")))


def blog(t):
    return t.documents.select(
        F.concat(F.lit("post-"), F.col("doc_id").cast("string")).alias("slug"), F.substring_index("text", ".", 1).alias("title"), F.col("source").alias("description"), (F.col("n_chars") > 500).alias("published"),
        F.when(F.col("lang") == "en", "ko").otherwise(F.col("lang")).alias("language"), F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 60_000_000).alias("published_at"))


@query("s26_feed_rows", """SELECT part, link, category FROM (
 SELECT 0 AS part, 'https://x.example.com/ko/blog/post-' || doc_id AS link, '블로그' AS category FROM documents WHERE n_chars > 500 AND lang = 'en' ORDER BY doc_id DESC LIMIT 10) a
 UNION ALL SELECT part, link, category FROM (SELECT 1 AS part, 'https://x.example.com/ko/articles/' || id AS link, category FROM v_articles WHERE is_active ORDER BY crawled_at DESC, id LIMIT 20) b""")
def s26(t):
    return feed(t).select("part", "link", "category")


def feed(t):
    a = t.v_articles.withColumns({"slug": F.lit(None).cast("string"), "title_ko": F.col("title"), "published_at": F.lit(None).cast("timestamp")})
    return E.feed_rows(blog(t), a, "https://x.example.com", F.lit(AS_OF).cast("timestamp"))


def esc(x):
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("s26_feed_xml", f"""SELECT part, tie, '<item><title>' || {esc('title')} || '</title><link>' || {esc('link')} || '</link><guid isPermaLink="true">' || {esc('link')} || '</guid><pubDate>' || strftime(pub, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>'
  || coalesce('<description>' || {esc('description')} || '</description>', '') || coalesce('<category>' || {esc('category')} || '</category>', '') || '</item>' AS xml FROM (
 SELECT * FROM (SELECT 0 AS part, 'post-' || doc_id AS tie, split_part(text, '.', 1) AS title, 'https://x.example.com/ko/blog/post-' || doc_id AS link, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS pub, source AS description, '블로그' AS category
  FROM documents WHERE n_chars > 500 AND lang = 'en' ORDER BY doc_id DESC LIMIT 10) a
 UNION ALL SELECT * FROM (SELECT 1, CAST(id AS VARCHAR), coalesce(nullif(title, ''), 'Untitled'), 'https://x.example.com/ko/articles/' || id, crawled_at, nullif(summary, ''), nullif(category, '') FROM v_articles WHERE is_active ORDER BY crawled_at DESC, id LIMIT 20) b) c""")
def s26x(t):
    return E.feed_items(feed(t))


@query("u6_feed_union", """SELECT part, count(*) AS n FROM (SELECT 0 AS part FROM (SELECT 1 FROM documents WHERE n_chars > 500 AND lang = 'en' LIMIT 10) a UNION ALL SELECT 1 FROM (SELECT 1 FROM v_articles WHERE is_active LIMIT 20) b) c GROUP BY 1""")
def u6(t):
    return feed(t).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


LC = "(VALUES ('ko'), ('en'), ('vi'), ('zh'), ('ja')) AS l(lc)"


@query("s27_url_set", f"""SELECT 'https://x.example.com/' || lc || p AS url FROM (
 SELECT unnest(['', '/landing', '/topics', '/tags', '/sources', '/blog', '/authors', '/terms']) AS p UNION ALL SELECT DISTINCT '/topics/' || category FROM v_articles
 UNION ALL SELECT '/tags/' || tag FROM (SELECT trim(tag) AS tag, count(*) AS n FROM ({TAGS_SQL}) g WHERE is_active AND trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50) z
 UNION ALL SELECT DISTINCT '/sources/' || source_name FROM v_articles WHERE is_active UNION ALL SELECT * FROM (SELECT '/authors/' || author FROM v_articles WHERE is_active GROUP BY author ORDER BY count(*) DESC, author LIMIT 100) a
 UNION ALL SELECT '/articles/s-' || id FROM v_articles WHERE is_active) x, {LC}
 UNION ALL SELECT 'https://x.example.com/' || CASE WHEN lang = 'en' THEN 'ko' ELSE lang END || '/blog/post-' || doc_id FROM documents WHERE n_chars > 500""")
def s27(t):
    from tidemark.plans import feed as A
    act = t.v_articles.where("is_active")
    c = t.v_articles.select(F.col("category").alias("name")).distinct()
    tags = A.tag_counts(tagged(t), 50).select(F.col("tag").alias("name"))
    return E.url_set(c, tags, A.value_counts(t.v_articles, "source_name"), A.value_counts(t.v_articles, "author", 100), blog(t).where("published"),
                     act.select(F.concat(F.lit("s-"), F.col("id").cast("string")).alias("slug")), "https://x.example.com").select("url")


CHANGED_SQL = f"""SELECT '/' || lc || p AS url FROM (SELECT unnest(['/landing', '/topics', '/tags', '/sources', '/authors', '/blog']) AS p
 UNION ALL SELECT DISTINCT '/sources/site' || source_id FROM v_crawl_logs WHERE status = 'completed' AND articles_new > 0
 UNION ALL SELECT * FROM (SELECT '/articles/s-' || id FROM v_articles WHERE is_active ORDER BY crawled_at DESC, id LIMIT (SELECT sum(articles_new) FROM v_crawl_logs)) a) x, {LC}"""


@query("s27_changed_urls", CHANGED_SQL)
@query("s27_changed_urls_all", CHANGED_SQL)
def s27c(t):
    r = t.v_crawl_logs.select((F.col("status") == "completed").alias("success"), "articles_new", F.concat(F.lit("site"), F.col("source_id").cast("string")).alias("source_name"))
    return E.changed_urls(r, t.v_articles.withColumn("slug", F.concat(F.lit("s-"), F.col("id").cast("string"))))


@query("h44_array_ops", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z]+)', 1)))[1:5], ',') AS words FROM documents")
def h44(t):
    w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))))
    return t.documents.select("doc_id", F.array_join(F.slice(w, 1, 5), ",").alias("words"))


@query("h45_map_overlay", """SELECT id, CASE WHEN priority = 3 THEN 'top' ELSE json_extract_string(config, '$.category') END AS category, 'x' AS extra FROM v_sources""")
def h45(t):
    base = F.from_json("config", "map<string,string>")
    over = F.when(F.col("priority") == 3, F.create_map(F.lit("category"), F.lit("top"), F.lit("extra"), F.lit("x"))).otherwise(F.create_map(F.lit("extra"), F.lit("x")))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return t.v_sources.select("id", merged["category"].alias("category"), merged["extra"].alias("extra"))


# --- streams -------------------------------------------------------------------------

EVENT_SCHEMA = Ty.StructType([
    Ty.StructField("event_id", Ty.LongType()), Ty.StructField("ts", Ty.TimestampNTZType()), Ty.StructField("user_id", Ty.LongType()),
    Ty.StructField("event_type", Ty.StringType()), Ty.StructField("value", Ty.DoubleType()), Ty.StructField("props", Ty.StringType()),
])


def mention_stream(t):
    e = ST.file_stream(t.spark, t.dir, "events.parquet", EVENT_SCHEMA)
    j = F.explode(F.sequence(F.lit(0), F.col("event_id") % 3))
    return e.select("event_id", "user_id", "ts", j.alias("j")).select(
        F.col("event_id").alias("post_id"), F.concat(F.lit("C"), ((F.col("user_id") + 7 * F.col("j")) % 40).cast("string")).alias("coin_symbol"),
        (1 + (F.col("event_id") + F.col("j")) % 3).cast("int").alias("mention_count"), F.col("ts").cast("timestamp").alias("created_at"))


@query("t4_tumbling_six_hours", """SELECT coin_symbol, b AS bucket_us, CAST(n AS BIGINT) AS n FROM (SELECT coin_symbol, epoch_us(created_at) // 21600000000 * 21600000000 AS b, sum(mention_count) AS n FROM v_mentions GROUP BY 1, 2) x
 WHERE b + 21600000000 <= (SELECT max(epoch_us(created_at)) FROM v_mentions) - 3600000000""")
def t4(t):
    s = ST.tumbling(mention_stream(t), "created_at", ["coin_symbol"], {"n": F.sum("mention_count")})
    folder = ST.stream_folder(t.spark, "tumbling")
    ST.drain(s, folder)
    return t.spark.read.parquet(f"{folder}/out").select("coin_symbol", us("bucket").alias("bucket_us"), "n")


@query("t3_sliding_six_hours", """SELECT coin_symbol, s AS start_us, CAST(sum(mention_count) AS BIGINT) AS n FROM (
 SELECT *, unnest(range(epoch_us(created_at) // 3600000000 * 3600000000 - 5 * 3600000000, epoch_us(created_at) // 3600000000 * 3600000000 + 1, 3600000000)) AS s FROM v_mentions) x
 WHERE s + 21600000000 <= (SELECT max(epoch_us(created_at)) FROM v_mentions) - 3600000000 GROUP BY 1, 2""")
def t3(t):
    s = ST.sliding(mention_stream(t), "created_at", ["coin_symbol"], {"n": F.sum("mention_count")}, "6 hours", "1 hour")
    folder = ST.stream_folder(t.spark, "sliding")
    ST.drain(s, folder)
    return t.spark.read.parquet(f"{folder}/out").select("coin_symbol", us("bucket").alias("start_us"), "n")


def partials(t):
    folder = ST.stream_folder(t.spark, "hourly")
    ST.drain(ST.hourly_partials(mention_stream(t)), folder)
    return t.spark.read.parquet(f"{folder}/out")


TICK = "2024-01-29 12:00:00"
TK = f"TIMESTAMP '{TICK}'"


@query("t3_windows_from_partials", f"""SELECT coin_symbol, time_window, CAST(mentions AS BIGINT) AS mentions, CAST(prev AS BIGINT) AS prev_mentions FROM (
 SELECT m.coin_symbol, w.time_window, sum(CASE WHEN m.created_at >= {TK} - to_hours(w.h) THEN m.mention_count ELSE 0 END) AS mentions, sum(CASE WHEN m.created_at < {TK} - to_hours(w.h) THEN m.mention_count ELSE 0 END) AS prev,
 count(CASE WHEN m.created_at >= {TK} - to_hours(w.h) THEN 1 END) AS c FROM v_mentions m, (VALUES ('1h', 1), ('6h', 6), ('24h', 24), ('7d', 168)) AS w(time_window, h)
 WHERE m.created_at < {TK} AND m.created_at >= {TK} - to_hours(2 * w.h) GROUP BY 1, 2) x WHERE c > 0""")
def t3p(t):
    return ST.windows_from_partials(partials(t), TICK).select("coin_symbol", "time_window", "mentions", "prev_mentions")


@query("t5_rolling_history", f"""SELECT coin_symbol, CAST(count(*) AS INT) AS hist_buckets, floor(CAST(sum(b) AS DOUBLE) / count(*) * 1e6 + 0.5) / 1e6 AS hist_mean FROM (
 SELECT coin_symbol, (epoch_us({TK}) - 1 - epoch_us(created_at)) // 21600000000 AS k, sum(mention_count) AS b FROM v_mentions WHERE created_at < {TK} GROUP BY 1, 2) x WHERE k BETWEEN 1 AND 10 GROUP BY 1""")
def t5(t):
    h = partials(t).select("coin_symbol", G.slot("bucket", TICK).alias("slot"), "n").where("slot < 0")
    return G.history_stats(h, ["6h"]).select("coin_symbol", "hist_buckets", js_round("hist_mean", 6).alias("hist_mean"))


@query("t2_stream_upsert", "SELECT channel, id FROM (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY posted_at DESC, id) AS rn FROM v_posts) x WHERE rn = 1")
def t2(t):
    e = ST.file_stream(t.spark, t.dir, "events.parquet", EVENT_SCHEMA)
    rows = e.select(F.concat(F.lit("ch"), (F.col("user_id") % 12).cast("string")).alias("channel"), F.col("event_id").alias("id"), "ts")
    folder = ST.stream_folder(t.spark, "upsert")
    ST.upsert_stream(rows, folder, ["channel"], [F.col("ts").desc(), F.col("id")])
    return TB.read_log(t.spark, folder, ["channel"]).select("channel", "id")


@query("t6_late_data", """SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE epoch_us(ts) // 86400000000 * 86400000000 + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 43200000000 GROUP BY 1""")
def t6(t):
    e = ST.file_stream(t.spark, t.dir, "events.parquet", EVENT_SCHEMA).withColumn("created_at", F.col("ts").cast("timestamp"))
    folder = ST.stream_folder(t.spark, "late")
    ST.drain(ST.tumbling(e, "created_at", ["user_id"], {"n": F.count(F.lit(1))}, "1 day", "12 hours"), folder)
    return t.spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.sum("n").alias("n"))


CONV_SCHEMA = Ty.StructType([Ty.StructField("conv_id", Ty.LongType()), Ty.StructField("turn", Ty.LongType()), Ty.StructField("role", Ty.StringType()), Ty.StructField("text", Ty.StringType())])


@query("t1_chat_stream", """SELECT 'discord_' || (conv_id * 1000 + turn) AS source_id, w.word AS coin_symbol FROM conversations c, (VALUES ('TION', 'tion'), ('THE', 'the'), ('AUX', 'aux')) AS w(word, a)
 WHERE role = 'user' AND length(text) >= 20 AND contains(lower(CASE WHEN length(text) > 200 THEN substr(text, 1, 2000) ELSE substr(text, 1, 200) END), w.a)""")
def t1(t):
    coins = t.spark.createDataFrame([("TION", "tion"), ("THE", "the"), ("AUX", "aux")], "symbol string, name string")
    folder = ST.stream_folder(t.spark, "chat")
    ST.chat_ingest(chat(ST.file_stream(t.spark, t.dir, "conversations.parquet", CONV_SCHEMA)), coins, folder)
    return ST.read_chat(t.spark, folder)[1].select("source_id", "coin_symbol").distinct()


@query("t7_alert_fanout", """SELECT CAST(n_nationkey AS VARCHAR) AS guild_id, coin_symbol, weighted_score FROM nation, (SELECT * FROM (SELECT coin_symbol, weighted_score FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo'
 AND computed_at = (SELECT max(computed_at) FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo') ORDER BY weighted_score DESC, coin_symbol LIMIT 3) x WHERE weighted_score >= 60) a""")
def t7(t):
    ch = t.nation.select(F.col("n_nationkey").cast("string").alias("guild_id"), F.lit("1").alias("channel_id"))
    return ST.alert_rows(t.v_signals, ch).select("guild_id", "coin_symbol", "weighted_score")


@query("t11_phase_chain")
def t11(t):
    from tidemark.registry.social import fixed, outputs
    new = t.v_posts.where("source = 'click'").withColumn("body", F.concat(F.lit("$C"), (F.col("id") % 40).cast("string")))
    tables = {
        "posts": t.v_posts.where("source <> 'click'"), "new_posts": new, "mentions": t.v_mentions, "coins": t.v_coins, "prices": t.v_prices, "sentiments": t.v_sentiments.withColumn("key_phrases", F.array().cast("array<string>")),
        "signals": t.v_signals, "positions": t.v_positions, "trades": t.v_trades, "outputs": outputs(t), "clusters": fixed(t),
    }
    r = phases.run(tables, AS_OF)
    return r["backtest"].select("coin_symbol", "time_window", "signal_type", "lookup_window", us("signal_at").alias("signal_us"), "price_at_signal", "price_after")
