"""Feeds and sitemaps through Spark's XML functions: one parse a payload, broken payloads set apart, items written back as XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import titles as T
from tidemark.functions import urls as U
from tidemark.functions.dates import MAX_ARTICLE_AGE_DAYS, parse_date, within_days
from tidemark.functions.pages import body_text
from tidemark.functions.text import preview
from tidemark.operators.keyed import exploded
from tidemark.sources.exports import http_date
from tidemark.sources.feeds import first_image, rfc822

CORRUPT = "_corrupt_record"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

IMAGE = "struct<_url:string,_type:string>"
ITEM = (
    "struct<title:string,link:string,description:string,`content:encoded`:string,`dc:creator`:string,author:string,pubDate:string,`dc:date`:string,"
    f"category:array<string>,`media:thumbnail`:{IMAGE},`media:content`:array<{IMAGE}>,enclosure:array<{IMAGE}>>"
)
ENTRY = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,author:struct<name:string>,updated:string,"
    f"published:string,category:array<struct<_term:string>>,`media:thumbnail`:{IMAGE}>"
)
# the three places of items: RSS 2.0 under channel, RSS 1.0 under the root, Atom as entries
FEED = f"struct<channel:struct<item:array<{ITEM}>>,item:array<{ITEM}>,entry:array<{ENTRY}>,{CORRUPT}:string>"
LOCATION = "array<struct<loc:string,lastmod:string>>"
SITEMAP = f"struct<sitemap:{LOCATION},url:{LOCATION},{CORRUPT}:string>"


def parsed(payloads: DataFrame, schema: str, *keep: str) -> DataFrame:
    """(keep, x): the payload as one struct; a null payload counts as an empty one, which is broken."""
    return payloads.select(*keep, F.from_xml(F.coalesce("payload", F.lit("")), schema, OPTIONS).alias("x"))


def broken(payloads: DataFrame, schema: str, *keep: str) -> DataFrame:
    """(keep) of the payloads that are no well-formed XML, such as cut, empty and null ones; ``feeds.rss_items`` reads what is left of them."""
    return parsed(payloads, schema, *keep).where(F.col(f"x.{CORRUPT}").isNotNull()).select(*keep)


def _rss(i: Column) -> Column:
    images = F.filter(F.coalesce(i["enclosure"], F.array().cast(f"array<{IMAGE}>")), lambda e: e["_type"].startswith("image/"))
    content = F.coalesce(i["content:encoded"], i["description"])
    return F.struct(
        i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["dc:creator"], i["author"]).alias("author"), F.coalesce(i["pubDate"], i["dc:date"]).alias("date_text"),
        content.alias("content"), F.coalesce(i["media:thumbnail"]["_url"], F.get(i["media:content"], 0)["_url"], F.get(images, 0)["_url"]).alias("thumbnail"),
        F.coalesce(i["category"], F.array().cast("array<string>")).alias("tags"),
    )


def _atom(e: Column) -> Column:
    own = F.filter(e["link"], lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    return F.struct(
        e["title"].alias("title"), F.coalesce(F.get(own, 0)["_href"], F.get(e["link"], 0)["_href"]).alias("link"), e["author"]["name"].alias("author"),
        F.coalesce(e["published"], e["updated"]).alias("date_text"), F.coalesce(e["content"], e["summary"]).alias("content"), e["media:thumbnail"]["_url"].alias("thumbnail"),
        F.coalesce(F.transform(e["category"], lambda c: c["_term"]), F.array().cast("array<string>")).alias("tags"),
    )


def feed_items(payloads: DataFrame, as_of, drop: Sequence[str] = tuple(U.TRACKING["feed"]), max_age_days: float | None = MAX_ARTICLE_AGE_DAYS) -> DataFrame:
    """Items of RSS 2.0, RSS 1.0 and Atom payloads (source_name, payload): title, clean link, thumbnail, author, published_at, content, tags.

    The parser unwraps CDATA, decodes entities and keeps namespace prefixes in the names. Items without a valid title or link are left out,
    as are those older than ``max_age_days``; items without a readable date stay.
    """
    x = parsed(payloads, FEED, "source_name")
    every = F.concat(
        F.coalesce(F.transform("x.channel.item", _rss), F.array()), F.coalesce(F.transform("x.item", _rss), F.array()), F.coalesce(F.transform("x.entry", _atom), F.array()))
    i = exploded(x, every, "i", "source_name", pos="pos")
    d = i.select(
        "source_name", "pos", T.process_title("i.title").alias("title"), U.normalize("i.link", list(drop)).alias("link"),
        F.coalesce("i.thumbnail", first_image(F.col("i.content"))).alias("thumbnail"), F.col("i.author").alias("author"), F.col("i.date_text").alias("date_text"),
        preview(body_text(F.col("i.content"))).alias("content"), F.col("i.tags").alias("tags"),
    ).where("title IS NOT NULL AND link IS NOT NULL")
    d = d.withColumn("published_at", F.coalesce(rfc822(F.col("date_text")), F.try_to_timestamp("date_text"), parse_date("date_text", as_of)))
    return d if max_age_days is None else d.where(within_days("published_at", max_age_days, as_of))


def sitemap_locations(files: DataFrame) -> DataFrame:
    """(sitemap, loc, lastmod) of sitemap files (url, payload); index files lead to the files they list with a non-negative name score."""
    x = parsed(files, SITEMAP, "url")
    listed = x.select(F.explode("x.sitemap").alias("s")).select(F.trim("s.loc").alias("url")).where("url IS NOT NULL").distinct()
    shunned = listed.where(U.sitemap_file_score("url") < 0)
    e = x.join(shunned, "url", "left_anti").select(F.col("url").alias("sitemap"), F.explode("x.url").alias("e"))
    return e.select("sitemap", F.trim("e.loc").alias("loc"), F.coalesce(F.trim("e.lastmod").try_cast("timestamp"), F.try_to_timestamp(F.trim("e.lastmod"))).alias("lastmod")).where(
        F.col("loc").startswith("http"))


def item_xml(title: Column, link: Column, pub: Column, description: Column, category: Column) -> Column:
    """One ``<item>`` on one line, escaped by the writer; null parts are left out, characters that XML 1.0 forbids are dropped."""
    def clean(c: Column) -> Column:
        return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")

    guid = F.struct(clean(link).alias("_VALUE"), F.when(link.isNotNull(), "true").alias("_isPermaLink"))
    item = F.struct(
        clean(title).alias("title"), clean(link).alias("link"), F.when(link.isNotNull(), guid).alias("guid"), http_date(pub).alias("pubDate"),
        clean(description).alias("description"), clean(category).alias("category"))
    return F.rtrim(F.to_xml(item, {"rowTag": "item", "indent": ""}), F.lit("\n"))
