"""Feed and URL-set exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import xml_escape
from tidemark.operators.keyed import row_numbers

# Locales and static pages with change frequency and priority.
LOCALES = ["ko", "en", "vi", "zh", "ja"]
STATIC = [
    ("", "daily", 1.0), ("/landing", "monthly", 0.9), ("/topics", "weekly", 0.8), ("/tags", "weekly", 0.7), ("/sources", "weekly", 0.7),
    ("/blog", "weekly", 0.8), ("/authors", "weekly", 0.7), ("/terms", "yearly", 0.3),
]
NOTIFY = ["/landing", "/topics", "/tags", "/sources", "/authors", "/blog"]


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def feed_rows(blog: DataFrame, articles: DataFrame, site: str, as_of: Column) -> DataFrame:
    """Ten latest blog posts, then twenty latest articles, in order (part, pos)."""
    b = blog.where(F.col("published") & (F.col("language") == "ko")).orderBy(F.col("published_at").desc_nulls_last(), "slug").limit(10).select(
        F.lit(0).alias("part"), F.col("published_at").alias("sort_at"), F.col("slug").alias("tie"), F.col("title"),
        F.concat(F.lit(f"{site}/ko/blog/"), "slug").alias("link"), F.coalesce("published_at", as_of).alias("pub"), F.col("description"), F.lit("블로그").alias("category"),
    )
    a = articles.where("is_active").orderBy(F.col("crawled_at").desc_nulls_last(), "id").limit(20).select(
        F.lit(1).alias("part"), F.col("crawled_at").alias("sort_at"), F.col("id").cast("string").alias("tie"),
        F.coalesce(F.nullif("title_ko", F.lit("")), F.lit("Untitled")).alias("title"),
        F.concat(F.lit(f"{site}/ko/articles/"), F.coalesce(F.nullif("slug", F.lit("")), F.col("id").cast("string"))).alias("link"),
        F.coalesce("published_at", "crawled_at").alias("pub"), F.nullif("summary", F.lit("")).alias("description"), F.nullif("category", F.lit("")).alias("category"),
    )
    return b.unionByName(a).orderBy("part", F.col("sort_at").desc_nulls_last(), "tie")


def feed_items(rows: DataFrame) -> DataFrame:
    """One escaped XML item per feed row."""
    def opt(tag: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>"), xml_escape(c), F.lit(f"</{tag}>"))).otherwise(F.lit(""))

    link = xml_escape("link")
    xml = F.concat(
        F.lit("<item><title>"), xml_escape("title"), F.lit("</title><link>"), link, F.lit('</link><guid isPermaLink="true">'), link, F.lit("</guid><pubDate>"),
        http_date(F.col("pub")), F.lit("</pubDate>"), opt("description", "description"), opt("category", "category"), F.lit("</item>"),
    )
    return rows.select("part", "tie", xml.alias("xml"))


def enc(x: Column) -> Column:
    """URL-encode as browsers encode a path part."""
    e = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for a, b in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def localized(paths: DataFrame, site: str, locales: Sequence[str] = tuple(LOCALES)) -> DataFrame:
    """One row per locale for (path, freq, priority) rows."""
    return paths.select(F.explode(F.array(*[F.lit(x) for x in locales])).alias("lc"), "path", "freq", "priority").select(
        F.concat(F.lit(f"{site}/"), "lc", "path").alias("url"), "freq", "priority")


def url_set(categories: DataFrame, tags: DataFrame, sources: DataFrame, authors: DataFrame, blog: DataFrame, articles: DataFrame, site: str) -> DataFrame:
    """All public URLs; the first four frames have a ``name``, blog has slug and language, articles have slug."""
    spark = categories.sparkSession

    def part(df: DataFrame, prefix: str, freq: str, pr: float, c: str = "name", encode: bool = True) -> DataFrame:
        x = enc(F.col(c)) if encode else F.col(c)
        return df.where(F.col(c).isNotNull()).select(F.concat(F.lit(prefix), x).alias("path"), F.lit(freq).alias("freq"), F.lit(pr).alias("priority"))

    paths = spark.createDataFrame(STATIC, "path string, freq string, priority double")
    for df, prefix, freq, pr in [(categories, "/topics/", "daily", 0.7), (tags, "/tags/", "daily", 0.6), (sources, "/sources/", "weekly", 0.6), (authors, "/authors/", "daily", 0.6)]:
        paths = paths.unionByName(part(df, prefix, freq, pr))
    paths = paths.unionByName(part(articles, "/articles/", "daily", 0.6, "slug", False))
    own = blog.select(F.concat(F.lit(f"{site}/"), "language", F.lit("/blog/"), "slug").alias("url"), F.lit("weekly").alias("freq"), F.lit(0.7).alias("priority"))
    return localized(paths, site).unionByName(own)


def changed_urls(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Paths to announce after a run with new articles: list pages, sources with news, and as many newest articles."""
    spark = results.sparkSession
    total = results.agg(F.coalesce(F.sum("articles_new"), F.lit(0))).scalar()
    base = spark.createDataFrame([(p,) for p in NOTIFY], "path string").where(total > 0)
    src = results.where("success AND articles_new > 0").select(F.concat(F.lit("/sources/"), enc(F.col("source_name"))).alias("path")).distinct()
    rank = articles.where("is_active AND slug IS NOT NULL").select("slug", "crawled_at", "id")
    new = newest(rank, total).select(F.concat(F.lit("/articles/"), "slug").alias("path"))
    paths = base.unionByName(src).unionByName(new)
    each = paths.select(F.explode(F.array(*[F.lit(x) for x in LOCALES])).alias("lc"), "path")
    return each.select(F.concat(F.lit("/"), "lc", "path").alias("url"))


def newest(df: DataFrame, n: Column) -> DataFrame:
    """The ``n`` newest rows, where n is a scalar only known at run time."""
    r = row_numbers(df.withColumn("_k", F.lit(1)), ["_k"], [F.col("crawled_at").desc(), F.col("id")], "_rn")
    return r.where(F.col("_rn") <= n)
