"""Feed, sitemap, JSON list and model-output sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import titles as T
from tidemark.functions import urls as U
from tidemark.functions.dates import MAX_ARTICLE_AGE_DAYS, parse_date, within_days
from tidemark.functions.pages import body_text
from tidemark.functions.text import preview
from tidemark.operators.keyed import exploded, top_k
from tidemark.semantics import js_trim

ITEM_FIELDS = ["title", "link", "thumbnail", "author", "date", "content"]
# Default paths of a JSON list and the keys tried when none is given.
DEFAULT_MAPPING = {"items": "data", "title": "title", "link": "url", "thumbnail": "thumbnail", "author": "author", "date": "created_at", "content": "content"}
ARRAY_KEYS = ["data", "items", "results", "posts"]


def _tag(item: Column, *names: str) -> Column:
    """Text of the first tag present, CDATA unwrapped and basic entities decoded."""
    out = []
    for n in names:
        raw = F.regexp_extract(item, rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)
        cdata = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
        out.append(F.nullif(js_trim(F.when(cdata != "", cdata).otherwise(T.decode_entities(raw))), F.lit("")))
    return F.coalesce(*out)


def _attr(item: Column, tag: str, name: str, extra: str = "") -> Column:
    return F.nullif(F.regexp_extract(item, rf'<{tag}\b(?=[^>]*{extra})[^>]*\b{name}="([^"]*)"', 1), F.lit(""))


def first_image(html: Column) -> Column:
    src = F.regexp_extract(html, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1)
    return F.when((src != "") & ~src.startswith("data:"), src)


def rss_items(payloads: DataFrame, as_of, drop: Sequence[str] = tuple(U.TRACKING["feed"]), max_age_days: float | None = MAX_ARTICLE_AGE_DAYS) -> DataFrame:
    """Items of RSS payloads (source_name, payload): valid title, clean link, newest-first order kept in ``pos``."""
    i = exploded(payloads, F.regexp_extract_all("payload", F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1)), "item", "source_name", pos="pos")
    it = F.col("item")
    encoded, plain = _tag(it, "content:encoded", "content"), _tag(it, "description", "summary")
    content = F.coalesce(encoded, plain)
    thumb = F.coalesce(
        _attr(it, "media:thumbnail", "url"), _attr(it, "media:content", "url"), _attr(it, "enclosure", "url", 'type="image/'), first_image(F.coalesce(encoded, plain)))
    d = i.select(
        "source_name", "pos", T.process_title(_tag(it, "title")).alias("title"), U.normalize(_tag(it, "link"), list(drop)).alias("link"), thumb.alias("thumbnail"),
        _tag(it, "dc:creator", "author").alias("author"), _tag(it, "pubDate", "dc:date").alias("date_text"), preview(body_text(content)).alias("content"),
    ).where("title IS NOT NULL AND link IS NOT NULL")
    d = d.withColumn("published_at", F.coalesce(rfc822(F.col("date_text")), parse_date("date_text", as_of)))
    return d if max_age_days is None else d.where(within_days("published_at", max_age_days, as_of))


def rfc822(x: Column) -> Column:
    """'Mon, 15 Jan 2024 10:30:00 GMT' as feeds write it."""
    t = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|UT|Z)$", " +0000")
    return F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Entries (loc, lastmod) of sitemap files (url, payload).

    Index files lead one level down, to files with a non-negative name score.
    """
    is_index = F.col("payload").rlike("<sitemapindex")
    subs = files.where(is_index).select("url", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))).alias("sub"))
    good = subs.where(U.sitemap_file_score("sub") >= 0).select(F.col("sub").alias("url")).distinct()
    listed = subs.select(F.col("sub").alias("url")).distinct()
    plain = files.where(~is_index)
    use = plain.join(good, "url", "left_semi").unionByName(plain.join(listed, "url", "left_anti"))
    e = exploded(use, F.regexp_extract_all("payload", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)), "e", "url")
    loc = js_trim(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1))
    mod = F.regexp_extract("e", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1)
    return e.select(F.col("url").alias("sitemap"), loc.alias("loc"), F.coalesce(mod.try_cast("timestamp"), F.try_to_timestamp(mod)).alias("lastmod")).where(F.col("loc").startswith("http"))


def sitemap_order(tie: Sequence[Column] = ()) -> list[Column]:
    """Dated entries newest first, then undated ones by article likelihood."""
    score = F.when(F.col("lastmod").isNull(), U.sitemap_entry_score("loc"))
    return [F.col("lastmod").desc_nulls_last(), score.desc_nulls_last(), *(tie or [F.col("loc")])]


def sitemap_selection(entries: DataFrame, base_url: Column, as_of, days: float = MAX_ARTICLE_AGE_DAYS, include: Sequence[str] = (), exclude: Sequence[str] = (), n: int = 15, site: str = "site", tie: Sequence[Column] = ()) -> DataFrame:
    """Entries to fetch of each site: under its base path, young enough, passing the filters, the best ``n``."""
    e = entries.where(U.under_prefix("loc", base_url) & within_days("lastmod", days, as_of) & U.url_filter("loc", include, exclude))
    return top_k(e, [site], sitemap_order(tie), n)


def json_path(path: str) -> str:
    return "$." + path


def api_items(payloads: DataFrame, as_of, mapping: dict[str, str] | None = None, link_template: str | None = None, link_fields: Sequence[str] = (),
              base_url: str | None = None, thumbnail_prefix: str | None = None, max_age_days: float | None = MAX_ARTICLE_AGE_DAYS) -> DataFrame:
    """Items of JSON list payloads (source_name, url, payload) by dotted paths, with link templates."""
    m = {**DEFAULT_MAPPING} if mapping is None else mapping
    v = payloads.select("source_name", "url", F.try_parse_json("payload").alias("v"))

    def as_items(path: str) -> Column:
        return F.try_variant_get("v", path, "array<variant>")

    if m.get("items"):
        arr = as_items(json_path(m["items"]))
    else:
        arr = F.coalesce(as_items("$"), *[as_items(json_path(k)) for k in ARRAY_KEYS])
    i = exploded(v, arr, "i", "source_name", "url", pos="pos")

    def field(path: str | None) -> Column:
        return F.nullif(F.try_variant_get("i", json_path(path), "string"), F.lit("")) if path else F.lit(None).cast("string")

    link = field(m["link"])
    if link_template and link_fields:
        link = F.when(link.isNotNull(), U.fill_fields(link_template, {f: field(f) for f in link_fields}))
    elif link_template:
        link = F.when(link.isNotNull(), F.regexp_replace(F.lit(link_template), F.lit(r"\{[^}]+\}"), F.regexp_replace(link, r"([\\$])", r"\\$1")))
    origin = F.lit(base_url) if base_url else U.origin("url")

    def rooted(x: Column, root: Column) -> Column:
        return F.when(x.startswith("http"), x).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(root, F.lit("/"), x))

    thumb = rooted(field(m.get("thumbnail")), F.lit(thumbnail_prefix) if thumbnail_prefix else U.origin("url"))
    d = i.select(
        "source_name", "pos", T.process_title(field(m["title"])).alias("title"), U.normalize(rooted(link, origin), U.TRACKING["api"]).alias("link"), thumb.alias("thumbnail"),
        field(m.get("author")).alias("author"), field(m.get("date")).alias("date_text"), preview(field(m.get("content"))).alias("content"),
    ).where("title IS NOT NULL AND link IS NOT NULL")
    return d if max_age_days is None else d.where(within_days(parse_date("date_text", as_of), max_age_days, as_of))


def mapping_valid(payloads: DataFrame, mapping: dict[str, str], probe: int | None = 5) -> DataFrame:
    """(source_name, valid): at least two items, and half of the first ``probe`` (None: of all) have a title and a link."""
    v = payloads.select("source_name", F.try_parse_json("payload").alias("v"))
    arr = F.coalesce(F.try_variant_get("v", json_path(mapping["items"]) if mapping.get("items") else "$", "array<variant>"), F.array().cast("array<variant>"))
    head = arr if probe is None else F.slice(arr, 1, probe)
    good = F.filter(head, lambda i: (F.coalesce(F.try_variant_get(i, json_path(mapping["title"]), "string"), F.lit("")) != "") & F.try_variant_get(i, json_path(mapping["link"]), "string").isNotNull())
    ok = (F.size(arr) >= 2) & (F.size(good).cast("double") / F.greatest(F.size(head), F.lit(1)) >= 0.5)
    return v.select("source_name", F.coalesce(ok, F.lit(False)).alias("valid"))


def json_block(text) -> Column:
    """JSON part of a model answer: a fenced block, else the outermost braces, else the text."""
    t = F.col(text) if isinstance(text, str) else text
    fence = F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)
    brace = F.regexp_extract(t, r"(\{[\s\S]*\})", 1)
    return F.trim(F.when(fence != "", fence).when(brace != "", brace).otherwise(t))


RESULT = (
    "struct<id:string,sentiment_score:string,sentiment_label:string,confidence:string,mentioned_coins:array<string>,key_phrases:array<string>,"
    "fomo_score:string,fud_score:string,reasoning:string,narratives:array<string>,events:array<struct<name:string,coins:array<string>,impact:string>>>"
)


def model_results(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Sentiment rows from batch answers.

    ``answers`` is (batch_id, payload); ``asked`` is (batch_id, pos, post_id), the
    posts of each batch in order. Results match by id, else by position; a post
    without result gets a failed row of defaults.
    """
    schema = f"struct<results:array<{RESULT}>>"
    wrapped = F.from_json(json_block("payload"), schema)["results"]
    bare = F.from_json(F.trim("payload"), f"array<{RESULT}>")
    r = exploded(answers, F.coalesce(wrapped, bare), "r", "batch_id", pos="pos")
    r = r.join(asked.select("batch_id", "pos", F.col("post_id").alias("_by_pos")), ["batch_id", "pos"], "left")
    r = r.select("batch_id", "pos", F.coalesce(F.nullif("r.id", F.lit("")), "_by_pos").alias("post_id"), "r").where("post_id IS NOT NULL")
    last = r.groupBy("batch_id", "post_id").agg(F.max_by("r", "pos").alias("r"))
    j = asked.select("batch_id", "post_id").distinct().join(last, ["batch_id", "post_id"], "left")

    def num(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(f"r.{c}").try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)

    def arr(c: str, t: str = "array<string>") -> Column:
        return F.coalesce(F.col(f"r.{c}"), F.array().cast(t)).alias(c)

    return j.select(
        "batch_id", "post_id", F.col("r").isNotNull().alias("success"), num("sentiment_score"),
        F.coalesce(F.nullif("r.sentiment_label", F.lit("")), F.lit("neutral")).alias("sentiment_label"), num("confidence"), num("fomo_score"), num("fud_score"),
        arr("mentioned_coins"), arr("key_phrases"), F.coalesce("r.reasoning", F.lit("")).alias("reasoning"), arr("narratives"),
        arr("events", "array<struct<name:string,coins:array<string>,impact:string>>"),
    )


def valid_sentiments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows inside the stored domains and the rest."""
    ok = (
        F.col("sentiment_score").between(-1, 1) & F.col("sentiment_label").isin("bullish", "bearish", "neutral") & F.col("confidence").between(0, 1)
        & F.col("fomo_score").between(0, 1) & F.col("fud_score").between(0, 1)
    )
    ok = F.coalesce(ok, F.lit(False))
    return rows.where(ok), rows.where(~ok)
