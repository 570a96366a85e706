"""Feed, text, URL and page queries over documents, pages, suppliers and conversations."""

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import dom
from tidemark.functions import pages as P
from tidemark.functions import text as X
from tidemark.functions import titles as T
from tidemark.functions import urls as U
from tidemark.plans import feed as A
from tidemark.plans import ingest as I
from tidemark.plans import queues as Q
from tidemark.plans import reports as R
from tidemark.registry.base import AS_OF, query
from tidemark.semantics import ago, at, js_round
from tidemark.sources import feeds as SF
from tidemark.sources import social as SO

T0 = f"TIMESTAMP '{AS_OF}'"
# the same whitespace class for the RE2 engine
W = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def rr(x, pat, to=""):
    pat = pat.replace("'", "''")
    return f"regexp_replace({x}, '{pat}', '{to}', 'g')"


def squeeze(x):
    return f"trim({rr(x, W + '+', ' ')}, ' ')"


def trim_(x):
    return rr(x, f"^{W}+|{W}+$")


def ents(x):
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({rr(x, '&#0?39;', chr(39) * 2)}, '&nbsp;', ' ')"


def clean_title_sql(x, new=r"NEW\b"):
    x = squeeze(ents(rr(f"coalesce({x}, '')", "<[^>]+>")))
    for p, to in [
        (r"^공지\s+", ""), (r"\s+공지$", ""), (r"(?i)\d+\s*(min|분)\s*(read|읽는 시간|소요)", ""), (r"\b\d{4}[-./]\d{1,2}[-./]\d{1,2}\b", ""),
        (r"\b\d{1,2}[-./]\d{1,2}\b", ""), (r"\b\d{1,2}:\d{2}(:\d{2})?\b", ""), (r"\[.*?\]", ""), (r"[․·•\-_|]+", " "),
        (rf"(?i)\b(?:{new}|업데이트|수정|신규|추가)" + W + "*", ""),
    ]:
        x = rr(x, p, to)
    return squeeze(x)


def norm_title_sql(x):
    x = rr(x, W + r"*[|｜\-–—]" + W + r"*[^|｜\-–—]*$")
    return squeeze(rr(x, r"[…]+|\.{3,}$"))


@query("h1_clean_title", f"SELECT doc_id, {clean_title_sql('text')} AS title FROM documents")
def h1(t):
    return t.documents.select("doc_id", T.clean_title("text").alias("title"))


@query("h1_clean_title_exact", f"SELECT page_id, {clean_title_sql('html', 'NEW')} AS title FROM pages")
def h1x(t):
    return t.pages.select("page_id", T.clean_title("html", exact=True).alias("title"))


VALID = """length({t}) >= 3 AND regexp_matches({t}, '[a-zA-Z가-힣ぁ-んァ-ヶ一-龯]') AND lower({t}) NOT IN ('top', 'best', '홈', '검색', '순위')
  AND NOT (length({t}) < 15 AND regexp_matches({t}, '순위$'))"""


@query("h2_title_valid", f"SELECT id, {VALID.format(t='title')} AS valid FROM v_articles")
def h2(t):
    return t.v_articles.select("id", T.title_valid("title").alias("valid"))


@query("h3_normalize_title", f"SELECT doc_id, {norm_title_sql('text')} AS title FROM documents")
def h3(t):
    return t.documents.select("doc_id", T.normalize_title("text").alias("title"))


SLUG = "substr(" + rr(rr(rr(rr("lower({t})", r"[^\p{L}\p{N}" + W[1:-1] + "-]"), W + "+", "-"), "-+", "-"), "^-|-$") + ", 1, 50)"
SLUG = SLUG.replace("{1680}", "{{1680}}").replace("{0B}", "{{0B}}").replace("{A0}", "{{A0}}").replace("{2000}", "{{2000}}").replace("{200A}", "{{200A}}").replace(
    "{2028}", "{{2028}}").replace("{2029}", "{{2029}}").replace("{202F}", "{{202F}}").replace("{205F}", "{{205F}}").replace("{3000}", "{{3000}}").replace(
    "{FEFF}", "{{FEFF}}").replace("{L}", "{{L}}").replace("{N}", "{{N}}")


@query("h4_article_slug", f"SELECT id, CASE WHEN s <> '' THEN s || '-' || substr(CAST(id AS VARCHAR), 1, 4) ELSE substr(CAST(id AS VARCHAR), 1, 4) END AS slug FROM (SELECT id, {SLUG.format(t='content')} AS s FROM v_articles) x")
def h4(t):
    return t.v_articles.select("id", T.article_slug("content", "id").alias("slug"))


@query("h5_source_id", "SELECT page_id, substr(sha256(url), 1, 16) AS source_id FROM pages")
def h5(t):
    return t.pages.select("page_id", U.source_id("url").alias("source_id"))


@query("h6_sanitize", r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]', '', 'g') AS text FROM documents")
def h6(t):
    return t.documents.select("doc_id", X.sanitize("text").alias("text"))


@query("h7_title_body_split", "SELECT doc_id, substr(text, 1, 200) AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 2000) END AS body FROM documents")
def h7(t):
    a, b = X.title_and_body("text")
    return t.documents.select("doc_id", a.alias("title"), b.alias("body"))


@query("h8_strip_html", f"SELECT page_id, {trim_(rr('html', '<[^>]*>'))} AS text FROM pages")
def h8(t):
    return t.pages.select("page_id", X.strip_html("html").alias("text"))


def board_sql(x):
    for p, to in [
        (r"(?i)<br\s*/?>", chr(10)), (r"(?i)<wbr\s*/?>", ""), (r'(?i)<a[^>]*class="quotelink"[^>]*>[^<]*</a>', ""), (r"(?i)<s>[^<]*</s>", "[spoiler]"),
        (r"<[^>]+>", ""), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&#039;", "''"), ("&[^;]+;", " ")]:
        x = rr(x, p, to)
    return trim_(x)


@query("h8_board_markup", f"SELECT page_id, {board_sql('html')} AS text FROM pages")
def h8b(t):
    return t.pages.select("page_id", X.strip_board_markup("html").alias("text"))


@query("h9_clean_text", f"SELECT doc_id, {squeeze('text')} AS text FROM documents")
def h9(t):
    return t.documents.select("doc_id", X.clean_text("text").alias("text"))


def last(ch):
    return f"CASE WHEN strpos(reverse(h), '{ch}') > 0 THEN length(h) - strpos(reverse(h), '{ch}') + 1 ELSE 0 END"


@query("h10_preview", f"""SELECT doc_id, CASE WHEN length(c) <= 500 THEN c WHEN s - 1 > 250 THEN substr(h, 1, s) WHEN sp - 1 > 400 THEN substr(h, 1, sp - 1) || '...'
 ELSE h || '...' END AS preview FROM (SELECT *, greatest({last('.')}, {last('?')}, {last('!')}) AS s, {last(' ')} AS sp FROM (
 SELECT doc_id, c, substr(c, 1, 500) AS h FROM (SELECT doc_id, {squeeze('text')} AS c FROM documents) a) b) d""")
def h10(t):
    return t.documents.select("doc_id", X.preview("text").alias("preview"))


@query("h11_fallback_summary", f"""SELECT doc_id, array_to_string(CASE WHEN len(g) = 0 THEN [source, '', ''] ELSE list_transform(g[1:3],
 lambda s: CASE WHEN length(trim(s, ' ')) > 60 THEN substr(trim(s, ' '), 1, 57) || '...' ELSE trim(s, ' ') END) END, '|') AS summary FROM (
 SELECT doc_id, source, list_filter(regexp_split_to_array({rr('text', W + '+', ' ')}, '[.!?] +'), lambda s: length(trim(s, ' ')) > 20) AS g FROM documents) x""")
def h11(t):
    return t.documents.select("doc_id", F.array_join(X.fallback_summary("source", "text"), "|").alias("summary"))


@query("h12_split_summary", """SELECT doc_id, CASE WHEN p > 0 THEN substr(s, 1, p - 1) END AS hook, CASE WHEN p > 0 THEN substr(s, p + 2) ELSE s END AS detail FROM (
 SELECT doc_id, s, strpos(s, chr(10) || chr(10)) AS p FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS s FROM documents) a) b""")
def h12(t):
    s = F.when(F.col("n_chars") % 2 == 0, X.join_summary("source", "text")).otherwise(F.col("text"))
    d = t.documents.select("doc_id", X.split_summary(s).alias("x"))
    return d.select("doc_id", "x.hook", "x.detail")


@query("h13_xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM pages")
def h13(t):
    return t.pages.select("page_id", X.xml_escape("html").alias("xml"))


@query("h14_like_escape", r"SELECT page_id, replace(replace(html, '%', '\%'), '_', '\_') AS pattern FROM pages")
def h14(t):
    return t.pages.select("page_id", X.like_escape("html").alias("pattern"))


@query("h15_view_count", """SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN floor(round(value / 10, 1) * 1000 + 0.5) WHEN 1 THEN floor(round(value / 10, 1) * 1000000 + 0.5) ELSE floor(value) END AS BIGINT) AS views FROM events""")
def h15(t):
    v = F.round(F.col("value") / 10, 1)
    txt = F.when(F.col("event_id") % 3 == 0, F.concat(v.cast("string"), F.lit("K"))).when(F.col("event_id") % 3 == 1, F.concat(v.cast("string"), F.lit("m"))).otherwise(
        F.format_string("%.2f", "value"))
    return t.events.select("event_id", X.view_count(txt).alias("views"))


AGO = """CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago'
 WHEN s // 604800 < 4 THEN (s // 604800) || 'w ago' WHEN s // 86400 // 30 < 12 THEN (s // 86400 // 30) || ' mo ago' ELSE (s // 86400 // 365) || 'y ago' END"""


AGO_SQL = f"""SELECT id, {AGO} AS en FROM (SELECT event_id AS id, (epoch_us({T0}) - epoch_us(ts)) // 1000000 AS s FROM events
 UNION ALL SELECT o_orderkey + 1000000000, (epoch_us({T0}) - epoch_us(o_orderdate)) // 1000000 FROM orders) x"""


@query("h17_time_ago", AGO_SQL)
@query("h17_time_ago_all", AGO_SQL)
def h17(t):
    e = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    o = t.orders.select((F.col("o_orderkey") + 1000000000).alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return e.unionByName(o).select("id", X.time_ago("ts", AS_OF, "en").alias("en"))


@query("h18_parse_date", f"""SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN epoch_us(date_trunc('minute', ts)) WHEN event_id % 10 <= 7 THEN epoch_us(date_trunc('day', ts))
 WHEN event_id % 10 = 8 THEN epoch_us({T0} - to_hours(user_id)) ELSE epoch_us({T0} - to_days(CAST(user_id AS INT))) END AS parsed_us FROM events""")
def h18(t):
    def f(p):
        return F.date_format("ts", p)

    k = F.col("event_id") % 10
    txt = (
        F.when(k == 0, f("yyyy-MM-dd'T'HH:mm")).when(k == 1, F.concat(f("yyyy-MM-dd HH:mm"), F.lit(":00Z"))).when(k == 2, f("yyyy.M.d")).when(k == 3, f("MM/dd/yyyy"))
        .when(k == 4, f("dd.MM.yyyy")).when(k == 5, f("yyyy년 M월 d일")).when(k == 6, f("MMMM d, yyyy")).when(k == 7, f("d MMM yyyy"))
        .when(k == 8, F.concat(F.col("user_id").cast("string"), F.lit("시간 전"))).otherwise(F.concat(F.lit("about "), F.col("user_id").cast("string"), F.lit(" days ago"))))
    return t.events_spread.select("event_id", F.unix_micros(D.parse_date(txt, AS_OF)).alias("parsed_us"))


@query("h19_extract_date", r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\d{4}[-./]\d{1,2}[-./]\d{1,2}\s+\d{1,2}:\d{2})', 1), ''),
 nullif(regexp_extract(text, '(\d{4}[-./]\d{1,2}[-./]\d{1,2})', 1), ''), nullif(regexp_extract(text, '(\d{4}년\s*\d{1,2}월\s*\d{1,2}일)', 1), '')) AS found FROM (
 SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' 2024-0' || (1 + doc_id % 9) || '-1' || (doc_id % 9) || ' 08:30' ELSE text END AS text FROM documents) x""")
def h19(t):
    i = F.col("doc_id")
    tail = F.concat(F.lit(" 2024-0"), (1 + i % 9).cast("string"), F.lit("-1"), (i % 9).cast("string"), F.lit(" 08:30"))
    d = t.documents.withColumn("text", F.when(i % 2 == 0, F.concat("text", tail)).otherwise(F.col("text")))
    return d.select("doc_id", D.extract_date_text("text").alias("found"))


@query("h20_latest_date", r"""SELECT page_id, epoch_us(CAST(max(d) AS TIMESTAMP)) AS latest_us FROM (
 SELECT page_id, unnest(list_transform(regexp_extract_all(html, '\d{4}[-./]\d{1,2}[-./]\d{1,2}'), lambda s: CAST(make_date(CAST(regexp_split_to_array(s, '[-./]')[1] AS INT), 1, 1)
  + to_months(CAST(regexp_split_to_array(s, '[-./]')[2] AS INT) - 1) AS DATE) + CAST(regexp_split_to_array(s, '[-./]')[3] AS INT) - 1)) AS d FROM (
  SELECT page_id, html || ' published ' || (2019 + page_id % 8) || '/' || (1 + page_id % 14) || '/' || (1 + page_id % 28) AS html FROM pages) p) x
 WHERE d <= DATE '2024-01-30' AND d >= DATE '2000-01-01' GROUP BY 1""")
def h20(t):
    i = F.col("page_id")
    tail = F.concat(F.lit(" published "), (2019 + i % 8).cast("string"), F.lit("/"), (1 + i % 14).cast("string"), F.lit("/"), (1 + i % 28).cast("string"))
    p = t.pages.select("page_id", F.unix_micros(D.latest_date(F.concat("html", tail), AS_OF)).alias("latest_us"))
    return p.where("latest_us IS NOT NULL")


@query("h21_buckets", f"""SELECT event_id, CAST(epoch_us(ts) // 21600000000 AS BIGINT) AS six_hours, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H') AS hour FROM events""")
def h21(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.floor(F.unix_micros(ts) / 21_600_000_000.0).cast("long").alias("six_hours"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
                           F.date_format(ts, "yyyy-MM-dd'T'HH").alias("hour"))


PARTS = "lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS o, regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS p0, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q0, regexp_extract(url, '(#.*)$', 1) AS f"
TRACK = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref'"


@query("h22_normalize_url", f"""SELECT page_id, o || CASE WHEN q = '' AND f = '' AND p <> '/' THEN regexp_replace(p, '/$', '') ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END || f AS url FROM (
 SELECT page_id, o, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS p, f, array_to_string(list_filter(string_split(q0, '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({TRACK})), '&') AS q
 FROM (SELECT page_id, {PARTS} FROM pages) a) b""")
def h22(t):
    return t.pages.select("page_id", U.normalize("url", U.TRACKING["static"], True).alias("url"))


@query("h23_link_template", """SELECT event_id, 'https://x.example.com/view/' || user_id || '/' || event_type || '?k={2}' AS link FROM events""")
def h23(t):
    call = F.concat(F.lit("javascript:go('"), F.col("user_id").cast("string"), F.lit("', '"), F.col("event_type"), F.lit("')"))
    return t.events.select("event_id", U.fill_template(F.lit("https://x.example.com/view/{0}/{1}?k={2}"), call).alias("link"))


TYPE_SQL = r"""CASE WHEN contains(u, 'sitemap') AND (contains(u, '.xml') OR u LIKE '%sitemap') THEN 'SITEMAP'
 WHEN regexp_matches(u, '/rss(/|$|\?|#)') OR regexp_matches(u, '/feed(/|$|\?|#)') OR contains(u, '.xml') OR contains(u, 'atom') THEN 'RSS'
 WHEN contains(u, 'blog.naver.com') THEN 'PLATFORM_NAVER' WHEN contains(u, 'brunch.co.kr') THEN 'PLATFORM_KAKAO'
 WHEN contains(u, 'stibee.com') OR contains(u, 'substack.com') OR contains(u, 'mailchimp.com') OR contains(u, 'campaign-archive') THEN 'NEWSLETTER'
 WHEN contains(u, '/api/') OR contains(u, '.json') OR contains(u, 'graphql') THEN 'API' ELSE 'SPA' END"""
TAILS = ["", "/rss", "/feed/x", "/sitemap.xml", "/api/list", "/data.json", "/blog.naver.com", "/brunch.co.kr", "/substack.com/p", "/go.kr"]
TAIL_SQL = "lower(url) || CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TAILS)) + " END"


def tailed(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("page_id") % 10 + 1).cast("int"))
    return t.pages.withColumn("url", F.concat(F.lower("url"), tail))


@query("h24_crawler_type", f"SELECT page_id, {TYPE_SQL} AS crawler_type FROM (SELECT page_id, {TAIL_SQL} AS u FROM pages) x")
def h24(t):
    return tailed(t).select("page_id", U.crawler_type("url").alias("crawler_type"))


@query("h24_crawler_type_scored", f"""SELECT page_id, CASE WHEN k = 'SPA' AND contains(u, '.go.kr') THEN 'SPA' ELSE k END AS crawler_type,
 CASE WHEN k IN ('SITEMAP', 'RSS', 'PLATFORM_NAVER', 'PLATFORM_KAKAO') THEN 0.95E0 WHEN k = 'NEWSLETTER' THEN 0.9E0 WHEN k = 'API' THEN 0.85E0 WHEN contains(u, '.go.kr') THEN 0.95E0 ELSE 0.5E0 END AS confidence FROM (
 SELECT page_id, u, CASE WHEN contains(u, 'atom') AND NOT contains(u, '.xml') AND NOT regexp_matches(u, '/(rss|feed)(/|$|\\?|#)') THEN 'SPA' ELSE {TYPE_SQL} END AS k FROM (SELECT page_id, {TAIL_SQL} AS u FROM pages) x) y""")
def h24s(t):
    p = tailed(t).select("page_id", U.crawler_type_scored("url").alias("r"))
    return p.select("page_id", F.col("r.type").alias("crawler_type"), F.col("r.confidence").alias("confidence"))


@query("h25_rewrite_search", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'https://news.google.com/rss/search?q=' || s_name2 || '&hl=' || hl || '&gl=' || gl || '&ceid=' || gl || ':' || hl
 ELSE 'https://openapi.naver.com/v1/search/news.json?query=' || s_name2 || '&display=15&sort=' || CASE WHEN s_nationkey % 2 = 1 THEN 'date' ELSE 'sim' END END AS url FROM (
 SELECT *, replace(s_name, '#', '%23') AS s_name2, CASE s_nationkey % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE 'en' END AS hl,
 CASE s_nationkey % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'JP' WHEN 2 THEN 'CN' ELSE 'US' END AS gl FROM supplier) x""")
def h25(t):
    hl = F.element_at(F.array(*[F.lit(x) for x in ("ko", "ja", "zh", "en")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    q = F.replace(F.col("s_name"), F.lit("#"), F.lit("%23"))
    g = F.concat(F.lit("https://www.google.com/search?q="), q, F.lit("&hl="), hl)
    n = F.concat(F.lit("https://search.naver.com/search.naver?query="), q, F.lit("&sort="), (F.col("s_nationkey") % 2).cast("string"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), U.rewrite_search(F.when(F.col("s_suppkey") % 2 == 0, g).otherwise(n)).alias("url"))


SEG = "list_filter(string_split(p, '/'), lambda s: s <> '')"
PATH = "CASE WHEN regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) END"


@query("h26_article_score", rf"""SELECT page_id, CASE WHEN len(s) >= 3 THEN 1 ELSE 0 END + CASE WHEN len(s) <= 1 THEN -2 ELSE 0 END
 + CASE WHEN len(list_filter(s, lambda x: regexp_full_match(x, '\d+'))) > 0 THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(p, '/\d{{4}}/\d{{1,2}}(/|$)') OR regexp_matches(p, '/\d{{4}}-\d{{2}}') THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter(s, lambda x: length(x) > 20 AND contains(x, '-'))) > 0 THEN 1 ELSE 0 END AS score,
 CAST(CASE WHEN regexp_full_match(coalesce(s[len(s)], ''), '\d+') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(p, '\d{{4}}[/-]\d{{2}}') THEN 5 ELSE 0 END
 + CASE WHEN contains(coalesce(s[len(s)], ''), '-') AND length(s[len(s)]) > 10 THEN 3 ELSE 0 END + CASE WHEN length(coalesce(s[len(s)], '')) > 20 THEN 2 ELSE 0 END
 + least(len(s), 5) AS INT) AS entry_score FROM (SELECT page_id, p, {SEG} AS s FROM (SELECT page_id, {PATH} AS p FROM pages) a) b""")
def h26(t):
    return t.pages.select("page_id", U.article_score("url").alias("score"), U.sitemap_entry_score("url").alias("entry_score"))


NAMES = ["news", "post-sitemap", "author-tag", "blog-category", "page"]


@query("h27_sitemap_file_score", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN -4 WHEN 3 THEN 0 ELSE 0 END AS score FROM documents")
def h27(t):
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", U.sitemap_file_score(F.concat(F.lit("https://tag.example.com/feed/"), n, F.lit(".xml?tag=1"))).alias("score"))


@query("h28_spa_score")
def h28(t):
    return t.pages.select("page_id", js_round(P.spa_score(dom.page_signals(F.col("html"))), 4).alias("score"))


@query("h29_cms_and_names", r"""SELECT page_id, upper(substr(n, 1, 1)) || substr(n, 2) AS display_name, p IN ('/', '/index.html') AS main_page FROM (
 SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)), '^www\.', ''), '.')[1] AS n, lower(""" + PATH + """) AS p FROM pages) x""")
def h29(t):
    return t.pages.select("page_id", U.display_name("url").alias("display_name"), U.is_main_page("url").alias("main_page"))


def with_head(t, *tags):
    """Pages whose head holds one of the given pieces of markup by page_id, all other pages as they are."""
    piece = F.coalesce(F.get(F.array(*[F.lit(x) for x in tags]), (F.col("page_id") % (len(tags) + 2)).cast("int")), F.lit(""))
    return t.pages.select("page_id", F.replace("html", F.lit("</head>"), F.concat(piece, F.lit("</head>"))).alias("html"))


@query("h29_cms", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Tistory' WHEN 3 THEN 'Ghost' WHEN 4 THEN 'Medium' END AS cms,
 CASE page_id % 7 WHEN 0 THEN '/feed' WHEN 1 THEN '/feed' WHEN 2 THEN '/rss' WHEN 3 THEN '/rss' WHEN 4 THEN '/feed' END AS feed_path FROM pages""")
def h29c(t):
    p = with_head(
        t, '<meta name="generator" content="WordPress 6.1">', '<link rel="stylesheet" href="/wp-content/a.css">', '<script src="https://t1.example.com/tistory/x.js"></script>',
        '<meta content="Ghost 5" name="generator">', '<meta property="al:android:package" content="com.medium.reader">')
    return p.select("page_id", P.cms("html").alias("c")).select("page_id", "c.cms", "c.feed_path")


@query("h48_page_metadata", r"SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'OG' WHEN 1 THEN 'Named' WHEN 2 THEN 'OG2' ELSE nullif(" + trim_(r"regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1)") + """, '') END AS title,
 CASE page_id % 6 WHEN 0 THEN '/i.png' WHEN 1 THEN '/t.png' WHEN 2 THEN '/o.png' END AS image, CASE page_id % 6 WHEN 0 THEN 'A. B.' WHEN 3 THEN 'C' END AS author, CASE page_id % 6 WHEN 1 THEN '2024-01-02' WHEN 3 THEN '2024-03-04' END AS published,
 CASE page_id % 6 WHEN 2 THEN 'og text' WHEN 3 THEN 'plain text' END AS description FROM pages""")
def h48(t):
    p = with_head(
        t, '<meta property="og:title" content="OG"><meta property="og:image" content="/i.png"><meta name="author" content="A. B.">',
        '<meta content="Named" name="title"><meta name="twitter:image" content="/t.png"><meta property="article:published_time" content="2024-01-02">',
        '<meta name="title" content="No"><meta property="og:title" content="OG2"><meta name="twitter:image" content="/x.png"><meta property="og:image" content="/o.png"><meta name="description" content="no"><meta property="og:description" content="og text">',
        '<meta property="article:author" content="C"><time datetime="2024-03-04">4 March</time><meta name="description" content="plain text">')
    return p.select("page_id", P.page_metadata("html").alias("m")).select("page_id", "m.title", "m.image", "m.author", "m.published", "m.description")


BODY = squeeze(rr(rr(rr(r"CASE WHEN regexp_matches(html, '(?i)<body[^>]*>[\s\S]*</body>') THEN regexp_extract(html, '(?i)<body[^>]*>([\s\S]*)</body>', 1) ELSE html END", r"(?i)<script[\s\S]*?</script>"), r"(?i)<style[\s\S]*?</style>"), "<[^>]+>", " "))


@query("h49_body_text", f"SELECT page_id, {BODY} AS body FROM pages")
def h49b(t):
    return t.pages.select("page_id", P.body_text("html").alias("body"))


DATES_SQL = r"""list_transform(regexp_extract_all(html, '\d{4}[-./]\d{1,2}[-./]\d{1,2}'), lambda s: CAST(make_date(CAST(regexp_split_to_array(s, '[-./]')[1] AS INT), 1, 1)
  + to_months(CAST(regexp_split_to_array(s, '[-./]')[2] AS INT) - 1) AS DATE) + CAST(regexp_split_to_array(s, '[-./]')[3] AS INT) - 1)"""


@query("h49_invalid_reason", f"""SELECT page_id, CASE WHEN contains(html, '서비스가 종료') THEN 'closed' WHEN length(body) < 200 THEN 'empty' WHEN regexp_matches(lower(regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)), '\\b(404|not found|error)\\b') THEN 'error'
 WHEN list_max(list_filter({DATES_SQL}, lambda d: d <= DATE '2024-01-30' AND d >= DATE '2000-01-01')) < DATE '2023-07-30' THEN 'stale' WHEN contains(html, 'CAPTCHA') THEN 'blocked'
 WHEN page_id % 7 = 3 AND len(regexp_extract_all(html, '(?i)<article[\\s>]')) < 3 THEN 'not_a_list' END AS reason FROM (
 SELECT page_id, html, {BODY} AS body FROM (SELECT page_id, replace(html, '</body>', CASE page_id % 7 WHEN 0 THEN ' posted 2020-02-03 ' WHEN 1 THEN ' CAPTCHA ' WHEN 2 THEN ' 서비스가 종료 ' ELSE '' END || '</body>') AS html FROM pages) a) b""")
def h49(t):
    piece = F.coalesce(F.get(F.array(F.lit(" posted 2020-02-03 "), F.lit(" CAPTCHA "), F.lit(" 서비스가 종료 ")), (F.col("page_id") % 7).cast("int")), F.lit(""))
    p = t.pages.select("page_id", F.replace("html", F.lit("</body>"), F.concat(piece, F.lit("</body>"))).alias("html"), F.when(F.col("page_id") % 7 == 3, "https://x.example.com/").otherwise("https://x.example.com/blog").alias("url"))
    return p.select("page_id", P.invalid_reason("html", "url", AS_OF).alias("reason"))


@query("h50_sniff", """SELECT page_id, regexp_matches(substr(html, 1, 2048), '(?i)<rss|<feed|<channel') AS is_feed FROM (
 SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<?xml version="1.0"?><rss>' ELSE '' END || html AS html FROM pages) x""")
def h50(t):
    h = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<?xml version="1.0"?><rss>'), "html")).otherwise(F.col("html"))
    return t.pages.select("page_id", P.is_feed(h).alias("is_feed"))


FLAG_SQL = """concat_ws(',', CASE WHEN length(text) < 10 THEN 'TOO_SHORT' END, CASE WHEN regexp_matches(text, '(?i)<[a-z]|&[a-z]+;') THEN 'HTML_REMNANT' END,
 CASE WHEN contains(text, chr(65533)) THEN 'BROKEN_UNICODE' END, CASE WHEN {rep} THEN 'SPAM_REPEAT' END,
 CASE WHEN regexp_matches(text, '(?i)(t\\.me/|discord\\.gg/|bit\\.ly/|join now|presale)') THEN 'SPAM_PROMO' END)"""
# RE2 has no back reference: look for 21 copies of each distinct character instead
REP = "len(list_filter(list_distinct(string_split(text, '')), lambda c: c <> chr(10) AND contains(text, repeat(c, 21)))) > 0"


@query("h51_quality_flags", "SELECT doc_id, " + FLAG_SQL.format(rep=REP) + " AS flags FROM documents")
def h51(t):
    return t.documents.select("doc_id", F.array_join(X.quality_flags("text"), ",").alias("flags"))


@query("a33_issue_counts", "SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(" + FLAG_SQL.format(rep=REP) + ", ',')) AS issue FROM documents) x WHERE issue <> '' GROUP BY 1")
def a33(t):
    return t.documents.select(F.explode(X.quality_flags("text")).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("a33_length_stats", """SELECT source, floor(sum(n) / CAST(count(*) AS DOUBLE) + 0.5) AS mean_chars, max(CASE WHEN rn = c // 2 + 1 THEN n END) AS median_chars FROM (
 SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS rn, count(*) OVER (PARTITION BY source) AS c FROM documents) x GROUP BY 1""")
def a33l(t):
    return R.length_stats(t.documents, "source", "text")


# --- feed ---------------------------------------------------------------------


@query("b1_list_projection", "SELECT id, source_name, title, category, author FROM v_articles WHERE is_active")
def b1(t):
    return A.select_articles(t.v_articles).select("id", "source_name", "title", "category", "author")


@query("b2_equality_filters", "SELECT id FROM v_articles WHERE is_active AND user_id = 'u1' AND category = 'src3' AND source_name = 'feed4'")
def b2(t):
    return A.select_articles(t.v_articles, user="u1", category="src3", source="feed4").select("id")


@query("b3_text_search", "SELECT id FROM v_articles WHERE is_active AND (title ILIKE '%tion%' OR summary ILIKE '%tion%' OR content ILIKE '%tion%')")
def b3(t):
    return A.select_articles(t.v_articles, search="tion").select("id")


@query("b4_time_ranges", f"""SELECT id, started_at >= {T0} - INTERVAL 7 DAY AND started_at <= {T0} AS current, started_at >= {T0} - INTERVAL 14 DAY AND started_at < {T0} - INTERVAL 7 DAY AS previous
 FROM v_crawl_logs WHERE started_at >= {T0} - INTERVAL 14 DAY AND started_at <= {T0}""")
def b4(t):
    lo, mid, hi = ago(AS_OF, 14 * 86400), ago(AS_OF, 7 * 86400), at(AS_OF)
    s = F.col("started_at")
    return t.v_crawl_logs.where(s.between(lo, hi)).select("id", s.between(mid, hi).alias("current"), ((s >= lo) & (s < mid)).alias("previous"))


@query("b5_json_field", "SELECT id, name FROM v_sources WHERE json_extract_string(config, '$.category') = 'cat2'")
def b5(t):
    return t.v_sources.where(F.get_json_object("config", "$.category") == "cat2").select("id", "name")


TAGS_SQL = "SELECT id, is_active, crawled_at, unnest([lang, ' ' || category || ' ', CASE WHEN n_chars > 2000 THEN 'long' ELSE '' END]) AS tag FROM v_articles"


def tagged(t):
    long = F.when(F.col("n_chars") > 2000, "long").otherwise("")
    return t.v_articles.withColumn("summary_tags", F.array(F.col("lang"), F.concat(F.lit(" "), F.col("category"), F.lit(" ")), long))


@query("b6_tag_contains", f"SELECT id FROM ({TAGS_SQL}) g WHERE is_active AND tag = 'long' ORDER BY crawled_at DESC, id LIMIT 20")
def b6(t):
    return A.select_articles(tagged(t), tag="long").orderBy(*A.newest()).limit(20).select("id")


@query("b7_null_tests", "SELECT id, author IS NOT NULL AS has_author FROM v_articles WHERE summary IS NULL")
def b7(t):
    return t.v_articles.where(F.col("summary").isNull()).select("id", F.col("author").isNotNull().alias("has_author"))


@query("b8_in_list", "SELECT id FROM v_crawl_logs WHERE source_id IN (44, 45, 46, 47) AND status IN ('running', 'failed')")
def b8(t):
    return t.v_crawl_logs.where(F.col("source_id").isin(44, 45, 46, 47) & F.col("status").isin("running", "failed")).select("id")


@query("b9_negative", "SELECT id FROM v_posts WHERE author IS NOT NULL AND author <> 'author1' AND source <> 'click'")
def b9(t):
    return t.v_posts.where(F.col("author").isNotNull() & (F.col("author") != "author1") & (F.col("source") != "click")).select("id")


# written out, so that a lost or changed pattern of the library shows
GARB = r"""(regexp_full_match(tt, '(?i)(login|logout|register|(previous|next|first|last)\s*page|prev|next|검색|search|홈|home|메인|main|메뉴|menu|닫기|close|terms\s*of\s*service|privacy\s*policy|공유하기|스크랩|좋아요|share|like|bookmark|목록|list|더\s*보기|more|view\s*all|see\s*more|top|맨위로|scroll\s*to\s*top|back\s*to\s*top)')
 OR regexp_full_match(tt, '(로그인|로그아웃|회원가입|Sign\s*[Ii]n|Sign\s*[Uu]p|(이전|다음|처음|마지막)\s*페이지|.{0,3}|\s*|[.,!?;:\-_]+|\d+)')
 OR regexp_matches(tt, '^(비밀번호|(페이스북|트위터|인스타)\s*새창)|블로그\s*새창으로\s*열기') OR regexp_matches(tt, '(?i)^(이용약관|개인정보|privacy|(facebook|twitter|instagram)\s*new\s*window)')
 OR regexp_matches(uu, '(?i)/login|/signup|/register|/auth/|/logout|^javascript:|/terms|/privacy|/policy|/admin|/settings|/config|/about/?$|/about-us/?$|/contact/?$|/contact-us/?$|/careers?/?$|/faq/?$|/services?/?$|/products?/?$|/pricing/?$|/portfolio/?$|/solutions?/?$|/legal|/cookie|/disclaimer|/sitemap|/feed/?$|/rss/?$|/search/?$|/404/?$|/account|/dashboard|/cart/?$|/checkout')
 OR regexp_matches(uu, '^#|^mailto:|^tel:') OR uu = '' OR tt = '')"""
WORDS = ["", "Login", "sign in", "Sign In", "다음 페이지", "more", "Privacy notes", "123", "abc", "...", "비밀번호 찾기", "A 블로그 새창으로 열기", "twitter New Window", "back to top"]
LINKS = ["", "/login", "/about/", "/products", "/a/privacy", "/a/x", "/Careers", "/cart/1", "/CART/", "/feeds", "/rss", "/404", "/x/dashboard"]
ITEM_SQL = ("SELECT id, source_name, CASE id % 20 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " ELSE title END AS title, source_url || CASE id % 18 "
            + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(LINKS)) + " ELSE '' END AS link FROM v_articles")
ITEM_SQL2 = f"SELECT id, source_name, title, link, {trim_('title')} AS tt, {trim_('link')} AS uu FROM ({ITEM_SQL}) i0"


def items(t):
    w = F.array(*[F.lit(x) for x in WORDS])
    u = F.array(*[F.lit(x) for x in LINKS])
    a = t.v_articles
    title = F.coalesce(F.try_element_at(w, (F.col("id") % 20 + 1).cast("int")), F.col("title"))
    tail = F.coalesce(F.try_element_at(u, (F.col("id") % 18 + 1).cast("int")), F.lit(""))
    return a.select("id", "source_name", title.alias("title"), F.concat("source_url", tail).alias("link"), "user_id", "author", "category", "content", F.col("id").alias("pos"),
                    F.date_format("crawled_at", "yyyy-MM-dd HH:mm").alias("date_text"))


@query("b10_garbage_item", f"SELECT id, {GARB} AS garbage FROM ({ITEM_SQL2}) i")
def b10(t):
    return items(t).select("id", T.is_garbage("title", "link").alias("garbage"))


@query("b11_drop_garbage", f"SELECT id FROM ({ITEM_SQL2}) i WHERE NOT {GARB}")
def b11(t):
    return T.drop_garbage(items(t)).select("id")


@query("b13_age_filter", f"SELECT event_id FROM events WHERE event_type = 'click' OR ts > {T0} OR ts >= {T0} - INTERVAL 10 DAY")
def b13(t):
    txt = F.when(F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.lit("soon"))
    return t.events_spread.where(D.within_days(D.parse_date(txt, AS_OF), 10, AS_OF)).select("event_id")


CHANNELS = [("ch0", 10, 1.0), ("ch1", 50, 1.2), ("ch2", 5, 0.8), ("ch3", 100, 1.0)]


@query("b14_post_admission", """SELECT id FROM (SELECT p.id, row_number() OVER (PARTITION BY p.author, p.channel ORDER BY p.id) AS rn FROM v_posts p
 JOIN (VALUES ('ch0', 10), ('ch1', 50), ('ch2', 5), ('ch3', 100)) AS c(channel, min_score) ON c.channel = p.channel
 WHERE p.score >= c.min_score AND coalesce(CASE WHEN p.num_awards > 0 THEN p.upvotes / 200.0E0 END, 1) >= 0.5) x WHERE rn = 1""")
def b14(t):
    conf = t.spark.createDataFrame(CHANNELS, "channel string, min_score int, weight double")
    p = t.v_posts.withColumn("upvote_ratio", F.when(F.col("num_awards") > 0, F.col("upvotes") / 200.0)).withColumn("name", F.concat_ws("/", "author", "channel"))
    return SO.admit(p, conf, "name", [F.col("id")]).select("id")


@query("b16_channel_rule", "SELECT DISTINCT conv_id FROM conversations WHERE NOT regexp_matches(lower(role), 'system|bot') AND regexp_matches(lower(role), 'user|chat')")
def b16(t):
    return t.conversations.where(SO.channel_allowed("role", ["system", "bot"], ["user", "chat"])).select("conv_id").distinct()


@query("b17_path_prefix", f"""SELECT page_id FROM (SELECT page_id, url, {PATH} AS p, lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS o FROM pages) x
 WHERE (o <> 'http://ththre.example.com' OR starts_with(p, '/fr')) AND NOT contains(url, 'page=3')""")
def b17(t):
    return t.pages.where(U.under_prefix("url", F.lit("http://ththre.example.com/fr/")) & U.url_filter("url", exclude=["page=3"])).select("page_id")


@query("b18_feed_scope", f"""SELECT page_id, CASE WHEN r = '' AND q = '' THEN true WHEN r <> '' AND q IS NOT NULL AND len(s) <= 2 AND NOT (len(s) = 2 AND s[1] IN ('tag', 'category')) THEN true
 WHEN r = '' AND q <> '' THEN true ELSE false END AS ok FROM (SELECT page_id, r, q, list_filter(string_split(r, '/'), lambda x: x <> '') AS s FROM (
 SELECT page_id, regexp_replace({PATH}, '/+$', '') AS r, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({TRACK})), '&') AS q FROM pages) a) b""")
def b18(t):
    return t.pages.select("page_id", U.feed_in_scope("url", F.concat(U.origin("url"), F.lit("/feed"))).alias("ok"))


@query("b20_trending_filter", """SELECT coin_symbol, time_window, signal_type, epoch_us(computed_at) AS at_us, mention_velocity FROM v_signals WHERE mention_velocity > 0.5 AND weighted_score >= 50
 ORDER BY mention_velocity DESC, coin_symbol, time_window, signal_type, computed_at LIMIT 10""")
def b20(t):
    order = [F.col("coin_symbol"), F.col("time_window"), F.col("signal_type"), F.col("computed_at")]
    return R.trending(t.v_signals, order).select("coin_symbol", "time_window", "signal_type", us("computed_at").alias("at_us"), "mention_velocity")


LAST = "(SELECT max(computed_at) FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo')"


@query("b21_hot_of_top3", f"SELECT * FROM (SELECT coin_symbol, weighted_score FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo' AND computed_at = {LAST} ORDER BY weighted_score DESC, coin_symbol LIMIT 3) x WHERE weighted_score >= 60")
def b21(t):
    return R.hot_alerts(t.v_signals).select("coin_symbol", "weighted_score")


@query("l3_latest_snapshot", f"SELECT coin_symbol, weighted_score, signal_label FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo' AND computed_at = {LAST} ORDER BY weighted_score DESC, coin_symbol LIMIT 50")
def l3(t):
    return R.top_signals(t.v_signals, limit=50).select("coin_symbol", "weighted_score", "signal_label")


@query("l4_all_snapshots", "SELECT coin_symbol, epoch_us(computed_at) AS at_us, weighted_score FROM v_signals WHERE time_window = '24h' AND signal_type = 'fomo' ORDER BY weighted_score DESC, coin_symbol, computed_at DESC LIMIT 10")
def l4(t):
    return R.top_signals(t.v_signals, limit=10, latest_only=False).select("coin_symbol", us("computed_at").alias("at_us"), "weighted_score")


@query("a36_page_with_count", "SELECT id, (SELECT count(*) FROM v_articles WHERE is_active AND user_id = 'u2') AS total, 36 < (SELECT count(*) FROM v_articles WHERE is_active AND user_id = 'u2') AS has_more FROM v_articles WHERE is_active AND user_id = 'u2' ORDER BY crawled_at DESC, id LIMIT 12 OFFSET 24")
def a36(t):
    return A.list_page(t.v_articles, 3, user="u2").select("id", "total", "has_more")


@query("l1_page", "SELECT id, title FROM v_articles WHERE is_active ORDER BY crawled_at DESC, id LIMIT 20 OFFSET 40")
def l1(t):
    return A.list_page(t.v_articles, 3, 20).select("id", "title")


@query("l2_limit_clamp", "SELECT id FROM v_articles WHERE is_active ORDER BY crawled_at DESC, id LIMIT 50")
def l2(t):
    return A.list_page(t.v_articles, 1, A.page_size(500)).select("id")


@query("l6_category_order", "SELECT n_name AS name, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS display_order FROM nation ORDER BY 2 ASC NULLS LAST, 1 LIMIT 12")
def l6(t):
    return A.ordered_categories(t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("display_order"))).limit(12)


@query("l7_sitemap_order", f"""SELECT page_id, site FROM (SELECT page_id, 's' || page_id % 4 AS site, page_id % 3 AS m, least(len({SEG}), 5) + CASE WHEN regexp_full_match(coalesce({SEG}[len({SEG})], ''), '\\d+') THEN 10 ELSE 0 END AS k
 FROM (SELECT page_id, {PATH} AS p FROM pages) a) b QUALIFY row_number() OVER (PARTITION BY site ORDER BY CASE WHEN m > 0 THEN page_id * 7 % 100 END DESC NULLS LAST, CASE WHEN m = 0 THEN k END DESC NULLS LAST, page_id) <= 15""")
def l7(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 100).cast("int"))
    site = F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("site")
    e = t.pages.select("page_id", site, F.col("url").alias("loc"), F.when(F.col("page_id") % 3 > 0, day.cast("timestamp")).alias("lastmod"))
    return SF.sitemap_selection(e, F.lit(""), AS_OF, 10_000, tie=[F.col("page_id")]).select("page_id", "site")


@query("l8_sub_sitemap_order", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 2 THEN -4 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 2 END AS score FROM supplier WHERE s_suppkey % 5 <> 2")
def l8(t):
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), U.sitemap_file_score(F.concat(F.lit("https://x.example.com/"), n, F.lit(".xml"))).alias("score"))
    return s.where("score >= 0")


@query("l9_label_order", "SELECT signal_label, count(*) AS n FROM v_backtest GROUP BY 1 ORDER BY CASE signal_label WHEN 'extremely_hot' THEN 0 WHEN 'hot' THEN 1 WHEN 'warm' THEN 2 WHEN 'cool' THEN 3 ELSE 4 END")
def l9(t):
    return R.by_label_order(t.v_backtest.groupBy("signal_label").agg(F.count(F.lit(1)).alias("n")))


@query("a15_tag_counts", f"SELECT trim(tag) AS tag, count(*) AS n FROM ({TAGS_SQL}) g WHERE is_active AND trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def a15(t):
    return A.tag_counts(tagged(t), 10)


@query("x2_popular_tags", f"SELECT trim(tag) AS tag, count(*) AS n FROM ({TAGS_SQL}) g WHERE is_active AND trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50")
def x2(t):
    return A.tag_counts(tagged(t), 50)


@query("a16_source_counts", "SELECT source_name AS name, count(*) AS n FROM v_articles WHERE is_active GROUP BY 1 ORDER BY n DESC, 1")
def a16(t):
    return A.value_counts(t.v_articles, "source_name")


@query("a16_author_counts", "SELECT author AS name, count(*) AS n FROM v_articles WHERE is_active GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def a16a(t):
    return A.value_counts(t.v_articles, "author", 20)


CATS = "(SELECT DISTINCT 'src' || n_nationkey AS name FROM nation)"


def cats(t):
    return t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("u1").alias("user_id"), F.col("n_nationkey").alias("display_order"))


@query("x2_category_counts", f"SELECT c.name, count(a.id) AS n FROM {CATS} c LEFT JOIN v_articles a ON a.category = c.name AND a.is_active GROUP BY 1")
def x2c(t):
    return A.category_counts(t.v_articles, cats(t))


@query("a17_source_names", "SELECT DISTINCT source_name FROM v_articles ORDER BY 1")
def a17(t):
    return A.source_names(t.v_articles)


@query("j28_related_articles", """SELECT id, related_id, CAST(pos AS INT) AS pos FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.crawled_at DESC, b.id) AS pos
 FROM v_articles a JOIN v_articles b ON a.category = b.category AND a.id <> b.id WHERE a.is_active AND b.is_active) x WHERE pos <= 5""")
def j28(t):
    return A.related(t.v_articles.withColumn("slug", F.lit("s")))


@query("j29_translation_map", """SELECT translation_group_id, string_agg(language || '=' || slug, ',' ORDER BY language) AS slugs FROM (
 SELECT doc_id // 7 AS translation_group_id, lang AS language, max('p' || doc_id) AS slug FROM documents GROUP BY 1, 2) x GROUP BY 1""")
def j29(t):
    p = t.documents.select(F.floor(F.col("doc_id") / 7).alias("translation_group_id"), F.col("lang").alias("language"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("slug"), F.lit(True).alias("published"))
    m = A.translations(p)
    e = F.transform(F.map_entries("slugs"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return m.select("translation_group_id", F.array_join(e, ",").alias("slugs"))


@query("p18_home_feed", "SELECT id, title, (SELECT count(*) FROM v_articles WHERE is_active AND user_id = 'u1' AND category = 'src0') AS total FROM v_articles WHERE is_active AND user_id = 'u1' AND category = 'src0' ORDER BY crawled_at DESC, id LIMIT 12")
def p18(t):
    return A.home_feed(t.v_articles, cats(t), "u1").select("id", "title", "total")


@query("a30_quality_stats", f"""SELECT source_name, count(*) AS total, count(CASE WHEN {GARB} THEN 1 END) AS garbage, count(CASE WHEN NOT {GARB} THEN 1 END) AS valid,
 floor(count(CASE WHEN {GARB} THEN 1 END) / CAST(count(*) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS garbage_ratio, count(DISTINCT {trim_('lower(title)')}) AS unique_titles, count(DISTINCT {trim_('lower(link)')}) AS unique_urls FROM ({ITEM_SQL2}) i GROUP BY 1""")
def a30(t):
    return I.quality_stats(items(t)).withColumn("garbage_ratio", js_round("garbage_ratio", 6))


@query("p14_batch_validation", f"""SELECT source_name, g / t > 0.5 AS high_garbage, CASE WHEN g / t > 0.5 THEN 'High garbage ratio' WHEN t - g < 2 THEN 'Insufficient valid items' WHEN ut / t < 0.5 THEN 'Low title diversity'
 WHEN uu / t < 0.5 THEN 'Low URL diversity' END AS reason FROM (SELECT source_name, CAST(count(*) AS DOUBLE) AS t, CAST(count(CASE WHEN {GARB} THEN 1 END) AS DOUBLE) AS g,
 count(DISTINCT {trim_('lower(title)')}) AS ut, count(DISTINCT {trim_('lower(link)')}) AS uu FROM (SELECT id, CASE WHEN id % 9 < 5 THEN source_name ELSE author0 END AS source_name, title, link, tt, uu FROM (
 SELECT i.*, 'by' || (id % 30) AS author0 FROM ({ITEM_SQL2}) i) k) i GROUP BY 1) x""")
def p14(t):
    i = items(t).withColumn("source_name", F.when(F.col("id") % 9 < 5, F.col("source_name")).otherwise(F.concat(F.lit("by"), (F.col("id") % 30).cast("string"))))
    return I.validate(i).select("source_name", (F.col("garbage_ratio") > 0.5).alias("high_garbage"), F.nullif(F.regexp_extract("reason", "^([^:]*)", 1), F.lit("")).alias("reason"))


@query("w11_top3_per_source", f"SELECT source_name, id FROM (SELECT source_name, id, row_number() OVER (PARTITION BY source_name ORDER BY id, link) AS rn FROM ({ITEM_SQL2}) i) x WHERE rn <= 3")
def w11(t):
    return I.newest_items(items(t)).select("source_name", "id")


HASH_SQL = f"SELECT source_name, substr(sha256(string_agg(link, '|' ORDER BY link)), 1, 16) AS url_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY id, link) AS rn FROM ({ITEM_SQL2}) i) x WHERE rn <= 3 GROUP BY 1"


@query("a34_url_set_hash", HASH_SQL)
def a34(t):
    return I.url_set_hash(I.newest_items(items(t)))


@query("t8_changed_sources", f"SELECT source_name, count(*) AS items FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY id, link) AS rn FROM ({ITEM_SQL2}) i) x WHERE rn <= 3 AND source_name > 'feed4' GROUP BY 1")
def t8(t):
    top = I.newest_items(items(t))
    state = I.url_set_hash(top).where("source_name <= 'feed4'")
    return I.changed(top, state).groupBy("source_name").agg(F.count(F.lit(1)).alias("items"))


@query("a37_duplicate_titles", f"SELECT title_key, count(*) AS n, count(DISTINCT source_name) AS sources FROM (SELECT source_name, {norm_title_sql('content')} AS title_key FROM v_articles) x WHERE length(title_key) >= 10 GROUP BY 1 HAVING count(*) >= 2")
def a37(t):
    return I.duplicate_groups(t.v_articles.drop("title").withColumnRenamed("content", "title"))


DUP_SQL = f"SELECT id FROM (SELECT id, title_key, row_number() OVER (PARTITION BY title_key ORDER BY crawled_at, id) AS rn FROM (SELECT id, crawled_at, {norm_title_sql('content')} AS title_key FROM v_articles) x WHERE length(title_key) >= 10) y WHERE rn > 1"


@query("w3_keep_oldest", DUP_SQL)
def w3(t):
    return I.duplicates_to_remove(t.v_articles.drop("title").withColumnRenamed("content", "title")).select("id")


@query("p16_cross_source_dedup", f"SELECT id, source_name FROM v_articles WHERE id NOT IN ({DUP_SQL})")
def p16(t):
    return I.without_duplicates(t.v_articles.drop("title").withColumnRenamed("content", "title"), "source_name")


@query("j20_title_anti_join", f"SELECT id FROM v_articles WHERE lang = 'en' AND (length({norm_title_sql('title')}) < 10 OR {norm_title_sql('title')} NOT IN (SELECT {norm_title_sql('title')} FROM v_articles WHERE lang <> 'en' OR id < 300))")
def j20(t):
    return I.drop_same_title(t.v_articles.where("lang = 'en'"), t.v_articles.where("lang <> 'en' OR id < 300")).select("id")


@query("j21_known_ids", "SELECT id FROM v_articles WHERE user_id = 'u1' AND id NOT IN (SELECT id FROM v_articles WHERE user_id = 'u1' AND is_active)")
def j21(t):
    a = t.v_articles.withColumn("source_id", U.source_id("source_url"))
    return I.drop_known(a.where("user_id = 'u1'"), a.where("is_active")).select("id")


def ing(t):
    i = items(t).withColumn("source_name", F.concat_ws("-", "source_name", "category"))
    stored = I.to_articles(i.where("content LIKE 'E%'"), AS_OF)
    state = I.url_set_hash(I.newest_items(i)).where("source_name < 'feed2'")
    return I.ingest(i, stored, state, AS_OF)[0]


@query("p15_article_ingest")
def p15(t):
    return ing(t).select("id", "source_id", "source_name", "title", "slug", us("published_at").alias("published_us"))


@query("p20_recent_logs", "SELECT l.id, l.source_id, s.name AS source_name, l.status FROM v_crawl_logs l LEFT JOIN v_sources s ON s.id = l.source_id ORDER BY l.started_at DESC, l.id LIMIT 20")
def p20(t):
    return A.recent_logs(t.v_crawl_logs, t.v_sources).select("id", "source_id", "source_name", "status")


@query("j10_log_source_name", "SELECT l.id, s.name AS source_name FROM v_crawl_logs l LEFT JOIN v_sources s ON s.id = l.source_id")
def j10(t):
    return t.v_crawl_logs.join(t.v_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left").select("id", "source_name")


@query("a31_batch_progress", "SELECT count(*) AS total_sources, count(CASE WHEN status IN ('completed', 'failed') THEN 1 END) AS completed_sources, CAST(sum(articles_new) AS BIGINT) AS new_articles FROM v_crawl_logs WHERE started_at >= (SELECT max(started_at) FROM v_crawl_logs WHERE status = 'running') - INTERVAL 1 HOUR")
def a31(t):
    return A.batch_progress(t.v_crawl_logs)


@query("a32_run_summary", "SELECT status, count(*) AS runs, CAST(sum(articles_found) AS BIGINT) AS found, CAST(sum(articles_new) AS BIGINT) AS new FROM v_crawl_logs GROUP BY ROLLUP (status)")
def a32(t):
    return A.run_summary(t.v_crawl_logs)


@query("p21_crawl_set", "SELECT id, crawler_type, CASE WHEN crawler_type = 'SPA' THEN 'serial' ELSE 'parallel' END AS lane FROM v_sources WHERE is_active AND json_extract_string(config, '$.category') = 'cat1' ORDER BY priority DESC, id")
def p21(t):
    return A.crawl_set(t.v_sources, "cat1").select("id", "crawler_type", "lane")


@query("t10_due_sources", f"SELECT id FROM v_sources s LEFT JOIN (SELECT source_id, max(started_at) AS m FROM v_crawl_logs GROUP BY 1) l ON l.source_id = s.id WHERE m IS NULL OR m <= {T0} - INTERVAL 6 HOUR")
def t10(t):
    return Q.due(t.v_sources, t.v_crawl_logs, AS_OF).select("id")


@query("p12_page_text")
def p12(t):
    return I.page_texts(t.pages).select("page_id", "content", "content_preview")


@query("p13_best_structure")
def p13(t):
    # navigation counts as chrome; as plain sections its lists are the repeated structure of these pages
    return I.best_structure(t.pages.withColumn("html", F.replace("html", F.lit("nav>"), F.lit("section>"))))


@query("s14_page_items")
def s14(t):
    return I.page_articles(t.pages, "newsletter")
