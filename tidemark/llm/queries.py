"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    line_dedup,
    merkle,
    mixing,
    quality,
    simhash,
    token_counts,
    token_output,
    toxicity,
    url_filter,
    warc,
)
from tidemark.llm.common import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


#: Fixed values of the contract.
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


@query("op1_url_filter", r"""
    WITH p AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    o AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
    names AS (
      SELECT *, CASE WHEN two IN ('example.com', 'example.net', 'example.org', 'co.uk', 'com.au', 'com.br', 'co.jp') THEN two ELSE one END AS suffix,
             CASE WHEN two IN ('example.com', 'example.net', 'example.org', 'co.uk', 'com.au', 'com.br', 'co.jp') THEN three ELSE two END AS domain
      FROM (SELECT DISTINCT host, regexp_extract(host, '[^.]*$', 0) AS one, regexp_extract(host, '([^.]*\.)?[^.]*$', 0) AS two,
                   regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$', 0) AS three FROM p)),
    h AS (SELECT p.host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(bad) AS y
          FROM p JOIN o ON o.doc_id = p.page_id JOIN names ON names.host = p.host GROUP BY p.host),
    d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY domain),
    s AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM d GROUP BY suffix),
    g AS (SELECT (coalesce(sum(y), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM s),
    s1 AS (SELECT s.*, m AS parent FROM s, g),
    s2 AS (SELECT 1 / least(0.5, greatest(0.0001, coalesce(sum(pow(y - n * parent, 2) - n * parent * (1 - parent))
                  / nullif(sum(n * (n - 1.0) * parent * (1 - parent)), 0), 0.0001))) - 1 AS k FROM s1),
    s3 AS (SELECT suffix, (y + k * parent) / (n + k) AS rate FROM s1, s2),
    d1 AS (SELECT d.*, rate AS parent FROM d JOIN s3 USING (suffix)),
    d2 AS (SELECT 1 / least(0.5, greatest(0.0001, coalesce(sum(pow(y - n * parent, 2) - n * parent * (1 - parent))
                  / nullif(sum(n * (n - 1.0) * parent * (1 - parent)), 0), 0.0001))) - 1 AS k FROM d1),
    d3 AS (SELECT domain, (y + k * parent) / (n + k) AS rate FROM d1, d2),
    h1 AS (SELECT h.*, rate AS parent FROM h JOIN d3 USING (domain)),
    h2 AS (SELECT 1 / least(0.5, greatest(0.0001, coalesce(sum(pow(y - n * parent, 2) - n * parent * (1 - parent))
                  / nullif(sum(n * (n - 1.0) * parent * (1 - parent)), 0), 0.0001))) - 1 AS k FROM h1),
    rated AS (
      SELECT names.host, coalesce(h.n, 0) + k AS total,
             (coalesce(h.y, 0) + k * coalesce(d3.rate, s3.rate, g.m)) / (coalesce(h.n, 0) + k) AS rate
      FROM names LEFT JOIN h ON h.host = names.host LEFT JOIN d3 ON d3.domain = names.domain LEFT JOIN s3 ON s3.suffix = names.suffix, h2, g),
    fit AS (
      SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM p)
    SELECT page_id, fit.host, path, rule,
           CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) > 0.25 THEN 'block' ELSE 'allow' END AS verdict
    FROM fit JOIN rated ON rated.host = fit.host""")
def op1(spark, table):
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table("labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge_urls(table("pages"), outcomes, ALLOW, BLOCK)


@query("op2_source_mix")
def op2(spark, table):
    return mixing.mix_copies(table("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_line_dedup", r"""
    WITH l AS (SELECT doc_id, i - 1 AS line, x[i] AS t, len(x) AS n FROM
                 (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i)),
    w AS (SELECT doc_id, line, t AS a, lead(t) OVER d AS b, lead(t, 2) OVER d AS c, n FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
    later AS (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, line) AS k FROM w WHERE line <= n - 3) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, line + k AS line FROM later, range(0, 3) AS r(k))
    SELECT l.doc_id, CAST(max(n) AS INT) AS n_lines, CAST(count(gone.line) AS INT) AS n_removed,
           coalesce(string_agg(CASE WHEN gone.line IS NULL THEN t END, chr(10) ORDER BY l.line), '') AS text
    FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id""")
def op3(spark, table):
    return line_dedup.remove_repeated_lines(table("documents"))


@query("op4_token_files")
def op4(spark, table):
    path = shared_path(spark, "tokens")
    token_output.write_tokens(table("documents"), path)
    return token_output.read_documents(spark, path)


@query("op5_decontamination", r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
    bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM iw, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
    size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
    SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_found, CAST(max(n) AS INT) AS n_shingles
    FROM ds JOIN bs USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * max(n)""")
def op5(spark, table):
    return decontaminate.find_leaks(table("documents"), table("benchmark"))


@query("op6_near_duplicates")
def op6(spark, table):
    return simhash.near_duplicates(table("documents"))


@query("op7_exact_dedup", """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x""")
def op7(spark, table):
    return exact_dedup.exact_duplicates(table("documents"))


@query("op8_toxicity")
def op8(spark, table):
    return toxicity.score_toxicity(table("documents"), table("labels"))


@query("op9_quality")
def op9(spark, table):
    return quality.score_quality(table("documents"), table("labels"))


@query("op10_token_counts")
def op10(spark, table):
    return token_counts.count_tokens(table("documents"))


@query("op11_warc_archives", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
    d AS (SELECT *, CAST(CAST(unhex(sha1(x)) AS BIT) AS VARCHAR) AS bits FROM p)
    SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 160, 5), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(
             list_transform(string_split(substr(bits, CAST(i AS INT) + 1, 5), ''), lambda b: CAST(b AS INT)), lambda a, b: 2 * a + b)]), '') AS payload_digest,
           CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
    FROM d""")
def op11(spark, table):
    path = shared_path(spark, "warc")
    warc.write_pages(table("pages"), path)
    return warc.read_pages(spark, path)


@query("op12_filter_audit", r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
    w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
    f AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
    abc AS (SELECT unnest(string_split('ABCDE', '')) AS c),
    o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM abc a, abc b, abc c, abc d, abc e
          WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
    s AS (SELECT filter_order, CAST(i AS INT) AS step, filter_order[i] AS own, left(filter_order, i - 1) AS before FROM o, range(1, 6) AS r(i)),
    g AS (
      SELECT part, filter_order, step, own, contains(fails, own) AS here, translate(before, fails, '') = before AS alive, fails = own AS only_here, n, good, toxic FROM m, s),
    a AS (
      SELECT part, filter_order, step, own, CAST(sum(CASE WHEN alive AND NOT here THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN alive AND here THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN NOT alive AND here THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN only_here THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN alive AND here THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN alive AND here THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g GROUP BY part, filter_order, step, own)
    SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a""")
def op12(spark, table):
    return filter_audit.audit_filters(table("documents"), table("labels"))


def merkle_sql(levels: int = 26) -> str:
    """Level by level, as many as the documents of one language can have (2 to the 26th)."""

    def parents(of: str, tree: str) -> str:
        return f"""SELECT {tree}p // 2 AS p, CAST(ceil(n / 2) AS BIGINT) AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
                   FROM {of} GROUP BY {tree}p // 2, n"""

    def step(k: int, before: str, nodes: str, on: str) -> str:
        """One level up: the sibling, if any, joins the path; the folded digest takes it in on its side."""
        mine = "concat(coalesce(CASE WHEN b.p % 2 = 1 THEN s.h END, ''), {}, coalesce(CASE WHEN b.p % 2 = 0 THEN s.h END, ''))"
        return f"""SELECT b.* REPLACE (b.p // 2 AS p, CAST(ceil(b.n / 2) AS BIGINT) AS n, b.sibs || coalesce(s.h, '') AS sibs,
                     CASE WHEN b.n = 1 THEN b.fold ELSE sha256({mine.format('b.fold')}) END AS fold)
                   FROM {before} b LEFT JOIN {nodes} s ON {on} s.p = (CASE WHEN b.p % 2 = 0 THEN b.p + 1 ELSE b.p - 1 END) AND b.n > 1"""

    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    ctes = [
        """crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
                   FROM range(0, 256) AS r(i))""",
        f"""leaves AS (SELECT doc_id, '=' || lang AS tree, {leaf('n_chars')} AS leaf,
              CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AND n_chars IS NOT NULL
                   THEN {leaf('n_chars + 1')} END AS tampered FROM documents, crc)""",
        """l0 AS (SELECT coalesce(tree, '') AS tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n,
                  leaf AS h, leaf, doc_id, coalesce(tampered, leaf) AS fold, '' AS sibs FROM leaves)""",
        "n0 AS (SELECT tree, p, n, h FROM l0)",
    ]
    ctes += [f"n{k + 1} AS MATERIALIZED (SELECT tree, p, n, h FROM ({parents(f'n{k}', 'tree, ')}))" for k in range(levels)]
    ctes += [f"l{k + 1} AS MATERIALIZED ({step(k, f'l{k}', f'n{k}', 's.tree = b.tree AND')})" for k in range(levels)]
    ctes += [
        f"t0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n, h FROM n{levels})",
        f"u0 AS (SELECT b.doc_id, b.leaf, b.fold, b.sibs, t0.p, t0.n, t0.h AS subroot FROM l{levels} b JOIN t0 ON t0.tree = b.tree)",
    ]
    top = 12
    ctes += [f"t{k + 1} AS MATERIALIZED (SELECT p, n, h FROM ({parents(f't{k}', '')}))" for k in range(top)]
    ctes += [f"u{k + 1} AS MATERIALIZED ({step(k, f'u{k}', f't{k}', '')})" for k in range(top)]
    return "WITH " + ",\n".join(ctes) + f"""
    SELECT doc_id, leaf, subroot, t{top}.h AS root, sha256(sibs) AS proof_sha256, fold AS folded_root, fold = t{top}.h AS verified FROM u{top}, t{top}"""


@query("op13_merkle_manifest", merkle_sql())
def op13(spark, table):
    return merkle.manifest(table("documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
