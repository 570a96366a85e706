"""Keyed writes as DataFrame transformations, plus thin writers.

The transformations return the next state of a table.  ``write_batch`` keeps a
log of batches that replays safely, which ``tables.read_log`` reads from its last
snapshot; on a table format with MERGE, ``merge_into`` does the same in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.titles import article_slug
from tidemark.functions.urls import host
from tidemark.operators.keyed import first_per_key, row_numbers, top_k
from tidemark.semantics import ago

# Merge keys of the stored tables, and the label migration.
KEYS = {
    "posts": ["source_id"], "coins": ["coingecko_id"], "sentiments": ["post_id"],
    "signals": ["coin_symbol", "time_window", "signal_type", "computed_at"], "entities": ["entity_type", "name"],
    "relations": ["source_id", "target_id", "relation_type"],
    "backtest": ["coin_symbol", "time_window", "signal_type", "signal_at", "lookup_window"], "portfolio": ["snapshot_date", "player"],
    "alert_channels": ["guild_id"],
}
RELABEL = {"strong_buy": "extremely_hot", "buy": "hot", "neutral": "warm", "sell": "cool", "strong_sell": "cold"}


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Base rows without a newer version, then the last delta row per key in ``order`` (not needed for unique keys).

    The base is anti joined with the delta's distinct keys, so it is neither
    sorted nor regrouped; a small delta makes this a broadcast filter.
    """
    keys = list(keys)
    last = first_per_key(delta, keys, order) if order else delta.dropDuplicates(keys)
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def insert_missing(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First wins: only delta rows whose key the base does not have."""
    keys = list(keys)
    return base.unionByName(first_per_key(delta.join(base.select(*keys).distinct(), keys, "left_anti"), keys, order), allowMissingColumns=True)


def replace_by_key(base: DataFrame, rows: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """Drop all base rows of the touched keys, then add the new rows."""
    t = (touched if touched is not None else rows).select(key).distinct()
    return base.join(t, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update_if(base: DataFrame, changes: DataFrame, key: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Apply changes only to base rows that still meet the condition; also returns the rows that changed."""
    cols = [c for c in changes.columns if c != key]
    c = changes.select(key, F.lit(True).alias("_hit"), *[F.col(x).alias(f"_n_{x}") for x in cols])
    j = base.withColumn("_ok", F.coalesce(condition, F.lit(False))).join(c, key, "left")
    hit = F.coalesce(F.col("_hit") & F.col("_ok"), F.lit(False))
    j = j.withColumn("_hit", hit).withColumns({x: F.when(hit, F.col(f"_n_{x}")).otherwise(F.col(x)) for x in cols})
    return j.select(*base.columns), j.where("_hit").select(*base.columns)


def retain(df: DataFrame, ts: str, as_of, days: float = 30) -> DataFrame:
    """Without rows older than ``days``; rows without a time stay."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= ago(as_of, days * 86400)))


def relabel(df: DataFrame, column: str = "signal_label", mapping: Mapping[str, str] = RELABEL) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def backfill(df: DataFrame, **defaults: str) -> DataFrame:
    """Fill nulls of a column from another: ``backfill(df, slug="id")``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.col(src).cast(df.schema[c].dataType)) for c, src in defaults.items()})


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten on replay."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def merge_into(delta: DataFrame, table: str, keys: Sequence[str], condition: Column | None = None) -> None:
    """Upsert into a table whose format supports MERGE."""
    d = delta.dropDuplicates(list(keys)).alias("d")
    on = None
    for k in keys:
        e = F.col(f"d.{k}") == F.col(f"{table}.{k}")
        on = e if on is None else on & e
    m = d.mergeInto(table, on)
    (m.whenMatched(condition) if condition is not None else m.whenMatched()).updateAll().whenNotMatched().insertAll().merge()


# --- categories and sources ---------------------------------------------------------


def rename_category(df: DataFrame, renames: DataFrame, column: str = "category") -> DataFrame:
    """Rewrite a category column by (old, new) pairs, per user when both sides have user_id."""
    on = ["old"] + (["user_id"] if "user_id" in renames.columns and "user_id" in df.columns else [])
    j = df.withColumn("old", F.col(column)).join(renames, on, "left")
    return j.withColumn(column, F.coalesce("new", column)).select(*df.columns)


def rename_config_category(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """The same inside the JSON config of sources; other keys stay as they are."""
    conf = F.from_json("config", "map<string,string>")
    j = sources.withColumn("old", conf["category"]).join(renames.select("old", "new"), "old", "left")
    changed = F.to_json(F.map_concat(F.map_filter(conf, lambda k, v: k != "category"), F.create_map(F.lit("category"), F.col("new"))))
    return j.withColumn("config", F.when(F.col("new").isNotNull(), changed).otherwise(F.col("config"))).select(*sources.columns)


def delete_category(df: DataFrame, names: DataFrame, column: str = "category") -> DataFrame:
    return df.join(names.select(F.col("name").alias(column)), column, "left_anti").select(*df.columns)


def reorder_categories(categories: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` is one row with an array of ids; display_order becomes its place."""
    o = order.select(F.posexplode("ids").alias("pos", "id"))
    return categories.join(o, "id", "left").withColumn("display_order", F.coalesce(F.col("pos") + 1, "display_order")).select(*categories.columns)


def add_categories(categories: DataFrame, names: DataFrame, user: str) -> DataFrame:
    """New category rows for names the user lacks, ordered after the highest display_order."""
    have = categories.where(F.col("user_id") == user)
    new = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().join(have.select("name"), "name", "left_anti")
    top = F.coalesce(categories.agg(F.max("display_order")).scalar(), F.lit(0))
    n = row_numbers(new.withColumn("_all", F.lit(1)), ["_all"], [F.col("name")], "_n")
    return n.select("name", F.lit(user).alias("user_id"), (top + F.col("_n")).cast("int").alias("display_order"))


def copy_from_others(articles: DataFrame, source_name: str, user: str, category: str | None = None, n: int = 10) -> DataFrame:
    """The latest articles of a source owned by others that the user lacks, as the user's rows."""
    others = articles.where((F.col("source_name") == source_name) & (F.col("user_id") != user))
    last = others.orderBy(F.col("published_at").desc_nulls_last(), "id").limit(n)
    own = articles.where(F.col("user_id") == user).select("source_id")
    new_id = F.substring(F.sha2(F.concat_ws("|", F.lit(user), "source_id"), 256), 1, 32)
    c = first_per_key(last.join(own, "source_id", "left_anti"), ["source_id"], [F.col("published_at").desc_nulls_last(), F.col("id")]).withColumns({
        "user_id": F.lit(user), "id": new_id, "category": F.coalesce(F.lit(category), "category") if category else F.col("category"),
    })
    return c.withColumn("slug", article_slug("title", "id"))


def register_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge plan per URL: action (insert, update or skip) with the merged type and config.

    ``incoming`` has base_url, name, category, crawler_type (null or AUTO when
    open) and, where it was analysed, resolved_type and selectors (JSON).
    Selectors already stored are kept.
    """
    i = first_per_key(incoming.where(F.coalesce("base_url", F.lit("")) != ""), ["base_url"], [F.col("name"), F.col("category")])
    e = existing.select("base_url", F.col("id").alias("_id"), F.col("crawler_type").alias("_type"), F.col("config").alias("_config"))
    j = i.join(e, "base_url", "left")
    old = F.coalesce(F.from_json("_config", "map<string,string>"), F.create_map().cast("map<string,string>"))
    picked = F.when(~F.coalesce(F.col("crawler_type"), F.lit("AUTO")).isin("AUTO", ""), F.col("crawler_type"))
    kind = F.coalesce(picked, "resolved_type", "_type", F.lit("SPA"))
    add_sel = F.col("selectors").isNotNull() & ~F.array_contains(F.map_keys(old), "selectors")
    extra = F.map_filter(
        F.map_from_arrays(F.array(F.lit("category"), F.lit("selectors")), F.array(F.col("category"), F.when(add_sel, F.col("selectors")))),
        lambda k, v: v.isNotNull(),
    )
    keep = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(keep, extra))))
    before = F.map_from_entries(F.array_sort(F.map_entries(old)))
    same = (F.to_json(merged) == F.to_json(before)) & (kind == F.col("_type")) & F.col("resolved_type").isNull()
    action = F.when(F.col("_id").isNull(), "insert").when(same, "skip").otherwise("update")
    return j.select("base_url", F.col("_id").alias("id"), "name", "category", kind.alias("crawler_type"), F.to_json(merged).alias("config"), action.alias("action"))


def fill_group_category(posts: DataFrame, from_language: str = "ko") -> DataFrame:
    """Copy the category of one language to the other posts of a translation group that have none."""
    lead = posts.where((F.col("language") == from_language) & F.col("category").isNotNull() & F.col("translation_group_id").isNotNull())
    lead = lead.groupBy("translation_group_id").agg(F.max("category").alias("_c"))
    j = posts.join(lead, "translation_group_id", "left")
    return j.withColumn("category", F.coalesce("category", "_c")).select(*posts.columns)


def delete_titles(articles: DataFrame, source: str, titles: Sequence[str]) -> DataFrame:
    """Without articles of a source whose title is in a list."""
    return articles.where(~F.coalesce((F.col("source_name") == source) & F.col("title").isin(list(titles)), F.lit(False)))


def recommendations(candidates: DataFrame, registered: DataFrame, slots: int, default_url: str, default_name: str = "news feed") -> DataFrame:
    """Candidates on neither a registered URL nor host, best first, up to the free slots; a default feed leads unless known."""
    from tidemark.functions.urls import host

    c = candidates.join(registered.select("url").distinct(), "url", "left_anti")
    c = c.withColumn("_h", host("url")).join(registered.select(host("url").alias("_h")).distinct(), "_h", "left_anti").drop("_h")
    c = c.orderBy("pos").limit(slots).select("url", "name", F.col("pos").cast("int").alias("pos"))
    d = registered.where(F.col("url") == default_url).agg(F.when(F.count(F.lit(1)) == 0, F.lit(default_url)).alias("url")).where("url IS NOT NULL")
    return d.select("url", F.lit(default_name).alias("name"), F.lit(-1).alias("pos")).unionByName(c)


def merge_urls(stored: DataFrame, supplied: DataFrame) -> DataFrame:
    return stored.select("url").union(supplied.select("url")).distinct()


def latest(df: DataFrame, keys: Sequence[str], ts: str, n: int = 1) -> DataFrame:
    return top_k(df, keys, [F.col(ts).desc_nulls_last()], n)
