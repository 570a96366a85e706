"""Feeds, sitemaps and exports through Spark's XML functions; substring search that skips blocks; landed payload files."""

from pyspark.sql import functions as F

from tidemark.functions.text import xml_escape
from tidemark.operators import blocks as BL
from tidemark.plans import feed as A
from tidemark.registry.base import AS_OF, query
from tidemark.registry.feed import NAMES
from tidemark.registry.intake import us
from tidemark.sources import feed_xml as X
from tidemark.sources import landed as LA
from tidemark.streaming.streams import stream_folder

T0 = f"TIMESTAMP '{AS_OF}'"


def feeds(t):
    """Per event a feed: RSS 2.0 with CDATA, Atom, RSS 1.0 with declared namespaces, or a file that was cut."""
    e, user, title = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.concat(F.lit("event "), "event_type", F.lit(" of user"), F.col("user_id").cast("string"))
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rfc, iso = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.concat(F.lit("https://x.example.com/a/"), e, F.lit("?utm_source=f&amp;p=1"))
    rss = F.concat(F.lit("<rss><channel><title>c</title><item><title><![CDATA["), title, F.lit("]]></title><link>"), link, F.lit("</link><dc:creator>by&amp;"), user, F.lit("</dc:creator><pubDate>"),
                   rfc, F.lit("</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">'), title, F.lit('</title><link rel="self" href="https://x.example.com/self"/><link href="'), link,
                    F.lit('"/><author><name>by&#38;'), user, F.lit("</name></author><updated>"), iso, F.lit("</updated></entry></feed>"))
    rdf = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://r" xmlns:dc="http://d"><channel><title>c</title></channel><item><title>'), title, F.lit("</title><link>"), link, F.lit("</link><dc:creator>by&amp;"), user,
                   F.lit("</dc:creator><dc:date>"), iso, F.lit("</dc:date></item></rdf:RDF>"))
    kind = F.col("event_id") % 4
    payload = F.when(kind == 0, rss).when(kind == 1, atom).when(kind == 2, rdf).otherwise(F.concat(F.lit("<rss><channel><item><title>"), title))
    return t.events_spread.select(e.alias("source_name"), payload.alias("payload"))


@query("s11_feed_xml", f"""SELECT CAST(event_id AS VARCHAR) AS source_name, event_id % 4 = 3 AS broken, CASE WHEN event_id % 4 < 3 THEN 'event ' || event_type || ' of user' || user_id END AS title,
 CASE WHEN event_id % 4 < 3 THEN 'https://x.example.com/a/' || event_id || '?p=1' END AS link, CASE WHEN event_id % 4 < 3 THEN 'by&' || user_id END AS author,
 CASE WHEN event_id % 4 < 3 THEN epoch_us(date_trunc('second', ts)) END AS published_us FROM events WHERE event_id % 4 = 3 OR ts >= {T0} - INTERVAL 20 DAY""")
def s11_xml(t):
    p = feeds(t)
    good = X.feed_items(p, AS_OF, max_age_days=20).select("source_name", F.lit(False).alias("broken"), "title", "link", "author", us("published_at").alias("published_us"))
    return good.unionByName(X.broken(p, X.FEED, "source_name").withColumn("broken", F.lit(True)), allowMissingColumns=True)


@query("s12_sitemap_xml", """SELECT url AS loc, epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 60 AS INT))) AS mod_us, false AS broken FROM pages WHERE page_id % 5 <> 2 AND page_id % 7 <> 3
 UNION ALL SELECT 'https://x.example.com/leaf-' || page_id, NULL, true FROM pages WHERE page_id % 7 = 3""")
def s12_xml(t):
    i = F.col("page_id").cast("string")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("page_id") % 5 + 1).cast("int"))
    cut = F.col("page_id") % 7 == 3
    leaf_url = F.when(cut, F.concat(F.lit("https://x.example.com/leaf-"), i)).otherwise(F.concat(F.lit("https://x.example.com/"), name, F.lit("-"), i, F.lit(".xml")))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")
    leaf = F.concat(F.lit('<urlset xmlns="http://s"><url><loc> '), xml_escape("url"), F.lit(" </loc><lastmod>"), day, F.when(cut, "</last").otherwise("</lastmod><image:image><image:loc>i</image:loc></image:image></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), leaf_url, F.lit("</loc></sitemap></sitemapindex>"))
    files = t.pages.select(leaf_url.alias("url"), leaf.alias("payload")).unionByName(t.pages.select(F.concat(F.lit("https://x.example.com/index-"), i).alias("url"), index.alias("payload")))
    good = X.sitemap_locations(files).select("loc", us("lastmod").alias("mod_us"), F.lit(False).alias("broken"))
    return good.unionByName(X.broken(files, X.SITEMAP, "url").select(F.col("url").alias("loc"), F.lit(None).cast("long").alias("mod_us"), F.lit(True).alias("broken")))


def esc(x):
    return f"replace(replace({x}, '&', '&amp;'), '<', '&lt;')"


@query("s26_items_to_xml", f"""SELECT id, '<item>' || coalesce('<title>' || {esc('title')} || '</title>', '') || '<link>' || link || '&amp;v=1</link><guid isPermaLink="true">' || link || '&amp;v=1</guid><pubDate>'
  || strftime(crawled_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>' || coalesce('<description>' || {esc('summary')} || ' &lt;b></description>', '') || '<category>' || {esc('category')} || '</category></item>' AS xml
 FROM (SELECT *, source_url || '?a=' || id AS link FROM v_articles) a""")
def s26_xml(t):
    link = F.concat("source_url", F.lit("?a="), F.col("id").cast("string"), F.lit("&v=1"))
    return t.v_articles.select("id", X.item_xml(F.col("title"), link, F.col("crawled_at"), F.concat("summary", F.lit(" <b>")), F.col("category")).alias("xml"))


@query("b3_block_search", """SELECT 'common' AS needle, id FROM v_articles WHERE is_active AND (title ILIKE '%tion%' OR summary ILIKE '%tion%' OR content ILIKE '%tion%')
 UNION ALL SELECT 'rare', id FROM v_articles WHERE is_active AND contains(lower(content), (SELECT lower(substr(content, 20, 30)) FROM v_articles WHERE is_active AND length(content) >= 60 ORDER BY id LIMIT 1))""")
def b3_blocks(t):
    """The search of ``b3_text_search`` for a common run and for thirty characters of the first long article."""
    path = stream_folder(t.spark, "blocks")
    BL.create(t.v_articles, path, "id", ["title", "summary", "content"], 64)
    rare = t.v_articles.where("is_active AND char_length(content) >= 60").agg(F.min_by(F.substring("content", 20, 30), "id")).first()[0] or "tion"
    found = [A.select_articles(BL.candidates(t.spark, path, x), search=x).select(F.lit(n).alias("needle"), "id") for n, x in (("common", "tion"), ("rare", rare))]
    return found[0].unionByName(found[1])


def landed(t, path, rows):
    """Events as payload lines in the folders of their type and day."""
    payload = F.to_json(F.struct("event_id", "user_id", F.col("value").cast("string").alias("v")))
    d = rows.select(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day"), payload.alias("value"))
    d.repartition("source", "day").write.mode("append").partitionBy("source", "day").text(path)
    LA.register(t.spark)


READ = "event_id long, user_id long, v string"


@query("s16_landed_payloads", """SELECT event_type AS source, CAST(ts AS DATE) AS day, event_id, user_id, value FROM events
 WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16' AND user_id % 2 = 0""")
def s16_landed(t):
    path = stream_folder(t.spark, "landed")
    landed(t, path, t.events)
    r = t.spark.read.format("landed").load(path).where("source IN ('click', 'purchase') AND day >= DATE'2024-01-10' AND day < DATE'2024-01-16'")
    j = r.select("source", "day", F.from_json("payload", READ).alias("j")).select("source", "day", "j.event_id", "j.user_id", F.col("j.v").cast("double").alias("value"))
    return j.where("user_id % 2 = 0")
