"""Article feed: list pages, search, facets, related articles and source reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import top_k
from tidemark.plans.queues import page
from tidemark.semantics import js_trim, ratio

def newest() -> list[Column]:
    return [F.col("crawled_at").desc_nulls_last(), F.col("id")]


def matching(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over any of the columns; % and _ act as wildcards, as in the source."""
    if not text:
        return df
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.where(cond)


def select_articles(
    articles: DataFrame, user: str | None = None, category: str | None = None, source: str | None = None, search: str | None = None,
    tag: str | None = None, author: str | None = None, slug: str | None = None,
) -> DataFrame:
    """Active articles by equality filters and search; plain predicates, so they reach the scan."""
    cond = F.col("is_active")
    for c, v in (("user_id", user), ("category", category), ("source_name", source), ("author", author), ("slug", slug)):
        if v:
            cond = cond & (F.col(c) == v)
    a = articles.where(cond)
    if tag:
        a = a.where(F.array_contains("summary_tags", tag))
    return matching(a, search, ["title", "summary", "content"])


def page_size(asked: int, most: int = 50) -> int:
    """Page size a request may have; for the edge of an API, operators take any size."""
    return max(1, min(asked, most))


def list_page(articles: DataFrame, number: int = 1, size: int = 12, columns: Sequence[str] | None = None, **filters) -> DataFrame:
    """One page, newest first, without the heavy text column, with total and has_more."""
    a = select_articles(articles, **filters)
    keep = columns or [c for c in articles.columns if c not in ("content", "content_preview")]
    return page(a.select(*keep), newest(), number, size)


def home_feed(articles: DataFrame, categories: DataFrame, user: str, size: int = 12) -> DataFrame:
    """First page of the user's first category by display order."""
    c = categories.where(F.col("user_id") == user).orderBy(F.col("display_order").asc_nulls_last(), "name").limit(1)
    first = c.select("name").scalar()
    a = select_articles(articles, user=user).where((F.col("category") == first) | first.isNull())
    return page(a.select("id", "title", "category", "crawled_at"), newest(), 1, size)


def ordered_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy(F.col("display_order").asc_nulls_last(), "name")


def tag_counts(articles: DataFrame, limit: int | None = 50) -> DataFrame:
    t = articles.where("is_active").select(F.explode("summary_tags").alias("_t")).select(js_trim("_t").alias("tag"))
    g = t.where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag")
    return g.limit(limit) if limit else g


def value_counts(articles: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Active articles per trimmed, non-empty value of a column, most first."""
    v = articles.where("is_active").select(js_trim(column).alias("name")).where("name <> ''")
    g = v.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name")
    return g.limit(limit) if limit else g


def category_counts(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category with its number of active articles, zero included."""
    n = articles.where("is_active").groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(n, "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


def source_names(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("source_name").isNotNull()).select("source_name").distinct().orderBy("source_name")


def related(articles: DataFrame, n: int = 5) -> DataFrame:
    """(id, related_id, pos): the newest articles of the same category, for every article at once.

    Only the n + 1 newest per category can be related to anything, so each
    article joins to one short list instead of to its whole category.
    """
    a = articles.where("is_active AND category IS NOT NULL")
    item = F.struct(F.col("_r"), F.col("id"))
    best = top_k(a.where("slug IS NOT NULL").select("id", "category", "crawled_at"), ["category"], newest(), n + 1, "_r")
    lists = best.groupBy("category").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    own = a.select("id", "category").join(lists, "category")
    others = F.transform(F.filter("_l", lambda x: x["id"] != F.col("id")), lambda x: x["id"])
    return own.select("id", F.posexplode(F.slice(others, 1, n)).alias("pos", "related_id")).select("id", "related_id", (F.col("pos") + 1).alias("pos"))


def translations(posts: DataFrame) -> DataFrame:
    """Language to slug map per translation group (a group holds one post per language)."""
    p = posts.where(F.col("published") & F.col("translation_group_id").isNotNull())
    one = p.groupBy("translation_group_id", "language").agg(F.max("slug").alias("slug"))
    return one.groupBy("translation_group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "slug")))).alias("slugs"))


# --- sources and runs ------------------------------------------------------------


def crawl_set(sources: DataFrame, category: str | None = None, user: str | None = None) -> DataFrame:
    """Active sources in crawl order; script pages go to their own lane."""
    s = sources.where("is_active")
    if user:
        s = s.where(F.col("user_id") == user)
    if category:
        s = s.where(F.get_json_object("config", "$.category") == category)
    lane = F.when(F.col("crawler_type") == "SPA", "serial").otherwise("parallel")
    return s.withColumn("lane", lane).orderBy(F.col("priority").desc(), "id")


def recent_logs(logs: DataFrame, sources: DataFrame, n: int = 20) -> DataFrame:
    top = logs.orderBy(F.col("started_at").desc(), "id").limit(n)
    return top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def batch_progress(logs: DataFrame) -> DataFrame:
    """Progress of the running batch: logs started within an hour before the newest running one, or later."""
    run = logs.where("status = 'running'").agg(F.max("started_at")).scalar()
    b = logs.where(F.unix_micros("started_at") >= F.unix_micros(run) - 3_600_000_000).where(F.col("status").isin("running", "completed", "failed"))
    return b.agg(
        F.count(F.lit(1)).alias("total_sources"), F.count_if(F.col("status").isin("completed", "failed")).alias("completed_sources"),
        F.coalesce(F.sum("articles_new"), F.lit(0)).cast("long").alias("new_articles"),
    )


def run_summary(results: DataFrame, by: str = "status") -> DataFrame:
    """Found, new and row counts per outcome with a total row (null key)."""
    return results.rollup(by).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("articles_found"), F.lit(0)).cast("long").alias("found"),
        F.coalesce(F.sum("articles_new"), F.lit(0)).cast("long").alias("new"),
    )


def detection_summary(detected: DataFrame) -> DataFrame:
    """How often each (method, type) was chosen, its share and mean confidence."""
    g = detected.groupBy("method", "crawler_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(20,4)")).alias("_c"))
    return g.select("method", "crawler_type", "n", ratio("_c", "n").alias("mean_confidence"), (F.col("n") / g.agg(F.sum("n")).scalar()).alias("share"))
