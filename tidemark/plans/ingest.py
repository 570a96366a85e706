"""Article ingest: batch validation, change detection, duplicate removal and conversion to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import titles as T
from tidemark.functions import urls as U
from tidemark.functions.dates import extract_date_text, parse_date
from tidemark.functions.dom import page_elements, page_items, page_lists, page_text
from tidemark.functions.text import preview
from tidemark.operators.keyed import first_per_key, top_k
from tidemark.semantics import col, js_trim, ratio
from tidemark.session import cut_lineage

PER_SOURCE = 3
MIN_TITLE_KEY = 10


def lowered(c) -> Column:
    return js_trim(F.lower(col(c)))


def quality_stats(items: DataFrame, key: str = "source_name") -> DataFrame:
    """Per source: total, garbage and valid counts, garbage ratio, distinct titles and links."""
    g = items.withColumn("_g", T.is_garbage("title", "link")).groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_g").alias("garbage"),
        F.count_distinct(lowered("title")).alias("unique_titles"), F.count_distinct(lowered("link")).alias("unique_urls"),
    )
    return g.withColumns({"valid": F.col("total") - F.col("garbage"), "garbage_ratio": F.coalesce(ratio("garbage", "total"), F.lit(0.0))})


def validate(items: DataFrame, sources: DataFrame | None = None, key: str = "source_name") -> DataFrame:
    """First failed rule per source, with its number; sources without items fail too."""
    q = quality_stats(items, key)
    if sources is not None:
        q = sources.select(key).distinct().join(q, key, "left")

    def pct(c: Column) -> Column:
        return F.format_string("%.1f%%", c * 100)

    titles, urls = ratio("unique_titles", "total"), ratio("unique_urls", "total")
    reason = (
        F.when(F.coalesce("total", F.lit(0)) == 0, "No items found")
        .when(F.col("garbage_ratio") > 0.5, F.concat(F.lit("High garbage ratio: "), pct(F.col("garbage_ratio"))))
        .when(F.col("valid") < 2, F.concat(F.lit("Insufficient valid items: "), F.col("valid").cast("string")))
        .when(titles < 0.5, F.concat(F.lit("Low title diversity: "), pct(titles)))
        .when(urls < 0.5, F.concat(F.lit("Low URL diversity: "), pct(urls)))
    )
    return q.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def newest_items(items: DataFrame, n: int = PER_SOURCE, key: str = "source_name") -> DataFrame:
    return top_k(items, [key], [F.col("pos"), F.col("link")], n)


def url_set_hash(items: DataFrame, key: str = "source_name") -> DataFrame:
    """Order-independent hash of a source's selected links; feed it the few newest items per source."""
    urls = F.array_join(F.sort_array(F.collect_list("link")), "|")
    return items.groupBy(key).agg(F.substring(F.sha2(urls, 256), 1, 16).alias("url_hash"))


def changed(items: DataFrame, state: DataFrame, key: str = "source_name") -> DataFrame:
    """Items of sources whose link set differs from the stored hash (or that have none)."""
    now = url_set_hash(items, key)
    same = now.join(state.select(key, "url_hash"), [key, "url_hash"], "left_semi").select(key)
    return items.join(same, key, "left_anti")


def to_articles(items: DataFrame, as_of) -> DataFrame:
    """Raw items (source_name, user_id, title, link, author, date_text, content, category) to article rows."""
    aid = F.sha2(F.concat_ws("|", F.coalesce("user_id", F.lit("")), "link"), 256)
    return items.select(
        F.substring(aid, 1, 32).alias("id"), U.source_id("link").alias("source_id"), F.substring("source_name", 1, 100).alias("source_name"),
        F.col("link").alias("source_url"), "title", F.col("content").alias("content_preview"), F.substring("author", 1, 100).alias("author"),
        parse_date("date_text", as_of).alias("published_at"), F.substring("category", 1, 50).alias("category"), "user_id", "pos",
    ).withColumn("slug", T.article_slug("title", "id"))


def drop_known(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Without articles the user already has."""
    return articles.join(stored.select("source_id", "user_id").distinct(), ["source_id", "user_id"], "left_anti")


def drop_same_title(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Without articles whose normalised title (10 characters or more) is stored already, from any source."""
    key = F.when(F.char_length(T.normalize_title("title")) >= MIN_TITLE_KEY, T.normalize_title("title"))
    have = stored.select(key.alias("_key")).where("_key IS NOT NULL").distinct()
    return articles.withColumn("_key", key).join(have, "_key", "left_anti").drop("_key")


def first_in_batch(articles: DataFrame) -> DataFrame:
    """One row per (user, link) and per (user, normalised title) within a batch."""
    order = [F.col("pos"), F.col("source_name"), F.col("source_id")]
    a = first_per_key(articles, ["user_id", "source_id"], order)
    norm = T.normalize_title("title")
    key = F.when(F.char_length(norm) >= MIN_TITLE_KEY, norm).otherwise(F.col("source_id"))
    return first_per_key(a.withColumn("_key", key), ["user_id", "_key"], order).drop("_key")


def ingest(items: DataFrame, stored: DataFrame, state: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """New article rows and the new per-source hash state.

    Cheap tests come first: three items per source, unchanged sources out,
    failed batches out, known ids out; only then conversion and title checks.
    """
    top = newest_items(items)
    live = changed(top, state)
    ok = validate(live).where("passed").select("source_name")
    fresh = to_articles(live.join(ok, "source_name", "left_semi"), as_of)
    fresh = drop_known(fresh, stored)
    fresh = fresh.where(~T.is_garbage("title", "source_url"))
    return first_in_batch(drop_same_title(fresh, stored)), url_set_hash(top)


def duplicate_groups(articles: DataFrame) -> DataFrame:
    """Normalised titles shared by two or more articles."""
    n = articles.withColumn("title_key", T.normalize_title("title")).where(F.char_length("title_key") >= MIN_TITLE_KEY)
    return n.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_name").alias("sources")).where("n >= 2")


def title_digests(articles: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, digest of the normalised title, null for titles too short to compare); each title is normalised once.

    The rows are stored before anything filters on the digest: a filter would be pushed below and repeat the whole rule chain.
    """
    key = F.when(F.char_length("_title") >= MIN_TITLE_KEY, F.sha2("_title", 256))
    n = articles.select(*keep, T.normalize_title("title").alias("_title")).select(*keep, key.alias("title_digest"))
    return cut_lineage(n)


def title_keepers(digests: DataFrame, ts: str) -> DataFrame:
    """(id) of the oldest article of each title; a min per digest, combined map side."""
    return digests.where("title_digest IS NOT NULL").groupBy("title_digest").agg(F.min_by("id", F.struct(ts, "id")).alias("id")).select("id")


def duplicates_to_remove(articles: DataFrame, ts: str = "crawled_at") -> DataFrame:
    """(id, title_digest) of all but the oldest article of each duplicate title.

    Only ids, times and digests are stored and shuffled. The rest of a title is an anti join on the unique
    id, so a title that a third of all rows share is no hot key.
    """
    n = title_digests(articles, "id", ts)
    return n.where("title_digest IS NOT NULL").join(title_keepers(n, ts), "id", "left_anti").select("id", "title_digest")


def without_duplicates(articles: DataFrame, *keep: str, ts: str = "crawled_at") -> DataFrame:
    """The articles that stay, with the columns ``keep``: the oldest of each title and all with short titles, from one scan."""
    n = title_digests(articles, "id", ts, *keep)
    oldest = n.join(title_keepers(n, ts), "id", "left_semi")
    return oldest.unionByName(n.where("title_digest IS NULL")).select("id", *keep)


# --- pages -------------------------------------------------------------------------


def page_articles(pages: DataFrame, strategy: str | dict = "static", link_template: str | None = None, drop: list[str] | None = None,
                  container: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """List items of HTML pages as raw items: (page_id, pos, title, link, thumbnail, author, date_text)."""
    raw = pages.select("page_id", "url", page_items(F.col("html"), strategy, container, exclude).alias("items"))
    return raw_articles(raw, link_template, drop)


def page_articles_each(pages: DataFrame, strategies: list[str], link_template: str | None = None, drop: list[str] | None = None) -> DataFrame:
    """``page_articles`` by each of the named strategies, with ``strategy`` in front; a page is parsed once for all."""
    lists = pages.select("page_id", "url", F.posexplode(page_lists(F.col("html"), strategies)).alias("k", "items"))
    names = F.array(*[F.lit(s) for s in strategies])
    return raw_articles(lists.withColumn("strategy", F.get(names, F.col("k"))), link_template, drop, "strategy")


def raw_articles(raw: DataFrame, link_template: str | None, drop: list[str] | None, *keep: str) -> DataFrame:
    """The raw items of rows (page_id, url, items) with the columns ``keep``, one row each."""
    e = raw.select(*keep, "page_id", "url", F.posexplode("items").alias("pos", "i")).select(*keep, "page_id", "url", "pos", "i.*")
    script = F.col("href").startswith("javascript:")
    bare = (F.col("href") == "#") | (F.col("href").startswith("#") & (F.char_length("href") <= 10))
    call = F.when(script, F.col("href")).when(bare, F.col("onclick"))
    filled = U.fill_template(F.lit(link_template), call) if link_template else F.lit(None).cast("string")
    href = F.when(call.isNotNull(), filled).otherwise(F.col("href"))
    base = U.origin("url")
    thumb = F.when(F.col("thumb").startswith("http"), F.col("thumb")).otherwise(U.absolute("thumb", F.concat(base, F.lit("/"))))
    return e.select(
        *keep, "page_id", "pos", T.process_title("title").alias("title"),
        U.normalize(U.absolute(href, F.concat(base, F.lit("/"))), drop or U.TRACKING["static"], True).alias("link"),
        thumb.alias("thumbnail"), "author", F.coalesce("date", extract_date_text("text")).alias("date_text"),
    ).where("title IS NOT NULL AND link IS NOT NULL AND link <> ''")


def page_texts(pages: DataFrame, own: str | None = None) -> DataFrame:
    """Main text and preview per page."""
    t = pages.select("page_id", "url", page_text(F.col("html"), own).alias("content"))
    return t.withColumn("content_preview", preview("content"))


# Fixed value: class prefixes of utility style sheets, which say nothing about structure.
UTILITY = (
    r"^(box-|flex|grid|block|inline|hidden|relative|absolute|fixed|sticky|overflow|p[xytblr]?-|m[xytblr]?-|w-|h-|min-|max-|gap-|space-|"
    r"border|rounded|shadow|bg-|text-|font-|leading-|tracking-)"
)


def structure_groups(pages: DataFrame) -> DataFrame:
    """Scored groups of repeated linked elements per page; features come from the group's first element."""
    e = pages.select("page_id", F.explode(page_elements(F.col("html"))).alias("e")).select("page_id", "e.*")
    lead = F.struct("title", "date", "thumb", "tag")
    g = e.groupBy("page_id", "kind", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by(lead, "seq").alias("f")).where("n >= 3 AND f.title")
    score = F.lit(0.6) + F.when(F.col("f.date"), 0.2).otherwise(0) + F.when(F.col("f.thumb"), 0.1).otherwise(0) + F.when(F.col("n") >= 5, 0.1).otherwise(0)
    score = F.least(score, F.lit(1.0))
    by_class = F.col("kind") == "class"
    first_class = F.element_at(F.split("grp", r"\."), 2)
    score = score + F.when(by_class & (F.col("f.tag") == "article"), 0.15).otherwise(0) - F.when(
        by_class & (F.col("f.tag") == "div") & first_class.rlike(UTILITY), 0.2).otherwise(0)
    order = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "list", 1).otherwise(2)
    return g.select("page_id", "kind", "grp", "n", "seq", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), order.alias("_o"))


def best_structure(pages: DataFrame) -> DataFrame:
    """Best group per page; ties go to tables, then lists, then the earlier group."""
    g = structure_groups(pages)
    key = F.struct(F.col("score"), -F.col("_o"), -F.col("seq"))
    return g.groupBy("page_id").agg(F.max_by(F.struct("kind", "grp", "n", "score"), key).alias("b")).select("page_id", "b.*")
