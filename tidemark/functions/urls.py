"""URL expressions: parts, clean-up, rewriting, classification and scoring. No Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.semantics import col, let

# Tracking parameters by strategy.
TRACKING = {
    "feed": ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "ref"],
    "static": ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref"],
    "api": ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref"],
}
SCOPE_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]
CATEGORY_PREFIXES = [
    "category", "categories", "cat", "tag", "tags", "topic", "topics", "section", "type", "genre", "subject", "group",
]
SITEMAP_GOOD = ["news", "post", "article", "blog", "content", "story", "magazine", "feed", "press", "insight"]
SITEMAP_BAD = ["question", "qa", "community", "forum", "author", "user", "profile", "tag", "category", "comment"]
NEWSLETTERS = ["stibee.com", "substack.com", "mailchimp.com", "campaign-archive"]
MAIN_PAGES = ["/", "/index.html", "/index.htm", "/index.php"]
NAV_PATHS = ["blog", "article", "news", "post", "stories", "insights", "magazine", "journal", "press", "content", "archive"]
NAV_TEXTS = [
    "blog", "article", "news", "post", "stories", "insights", "블로그", "아티클", "뉴스", "콘텐츠", "소식", "매거진", "인사이트",
]
NAV_SKIP_PATHS = [
    "newsletter", "subscribe", "subscription", "mailing", "login", "signin", "signup", "register", "auth", "oauth", "account",
    "profile", "mypage", "about", "contact", "faq", "help", "support", "intro", "privacy", "terms", "policy", "legal", "cookie",
    "consent", "shop", "store", "cart", "checkout", "order", "pricing", "plan", "payment", "search", "download", "install",
    "setting", "preference", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "linkedin.com", "feed", "rss", "atom",
]
NAV_SKIP_TEXTS = [
    "newsletter", "뉴스레터", "subscribe", "구독", "구독하기", "구독신청", "login", "sign in", "sign up", "로그인", "회원가입",
    "마이페이지", "소개", "회사소개", "서비스소개", "문의", "연락처", "고객센터", "이용약관", "개인정보", "쿠키", "쇼핑", "장바구니",
    "결제", "주문", "검색", "다운로드", "설정", "도움말",
]
FEED_ROOT = r"(?i)^/(feed|rss|atom|feed\.xml|rss\.xml|atom\.xml|index\.xml)/?$"
SITEMAP_ROOT = r"(?i)^/(sitemap\.xml|sitemap_index\.xml|sitemap)/?$"


def source_id(url) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 16)


def origin(u) -> Column:
    return F.lower(F.regexp_extract(col(u), "(?i)^(https?://[^/?#]+)", 1))


def host(u) -> Column:
    return F.lower(F.regexp_extract(col(u), r"(?i)^https?://(?:[^@/?#]*@)?([^/:?#]+)", 1))


def path(u) -> Column:
    p = F.regexp_extract(col(u), "(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(u) -> Column:
    return F.regexp_extract(col(u), r"^[^?#]*\?([^#]*)", 1)


def fragment(u) -> Column:
    return F.regexp_extract(col(u), "(#.*)$", 1)


def is_http(u) -> Column:
    return F.coalesce(col(u).rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def segments(u) -> Column:
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def params(u, drop: Sequence[str] = ()) -> Column:
    """Query parts as written, without the named parameters."""
    return F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(list(drop) or [""]))


def param(u, name: str) -> Column:
    """First value of a parameter, URL-decoded; null when absent or empty."""
    hits = F.filter(params(u), lambda p: p.startswith(f"{name}="))
    value = F.regexp_replace(F.try_element_at(hits, F.lit(1)), "^[^=]*=", "")
    return F.nullif(F.try_url_decode(value), F.lit(""))


def resolve_path(p) -> Column:
    """Remove '.' and '..' segments."""
    segs = F.split(col(p), "/")
    return F.array_join(
        F.aggregate(
            segs, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
        ), "/",
    )


def absolute(href, base) -> Column:
    """``href`` against ``base``; absolute and protocol-relative links stay as they are."""
    h, b = col(href), col(base)
    folder = F.regexp_replace(path(b), "[^/]*$", "")
    rel = F.concat(origin(b), resolve_path(F.concat(folder, h)))
    return (
        F.when(h.rlike("(?i)^https?:"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.startswith("/"), F.concat(origin(b), h)).when(h.startswith("?"), F.concat(origin(b), path(b), h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h)).otherwise(rel)
    )


def normalize(url, drop: Sequence[str], strip_slash: bool = False) -> Column:
    """Lower-case host, tracking parameters removed, other parts kept; non-http links unchanged."""
    def parts(u: Column) -> Column:
        q = F.array_join(params(u, drop), "&")
        tail = F.concat(F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")), fragment(u))
        p = path(u)
        whole = let(tail, lambda t: F.concat(F.when((t == "") & (p != "/"), F.regexp_replace(p, "/$", "")).otherwise(p), t)) if strip_slash else F.concat(p, tail)
        return F.when(is_http(u), F.concat(origin(u), whole)).otherwise(u)

    return let(url, parts)


def replace_first(x: Column, token: Column, value: Column) -> Column:
    at = F.position(token, x)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), value, F.substring(x, at + F.char_length(token), F.char_length(x)))).otherwise(x)


def fill_template(template, source) -> Column:
    """Put the call arguments of a script link ('fn('a', 2)') into {0}, {1}, ...; null without a call."""
    call = F.regexp_extract(col(source), r"\(([^)]*)\)", 1)
    args = F.transform(F.split(call, ","), lambda a: F.regexp_replace(F.trim(a), "['\"]", ""))
    numbered = F.transform(args, lambda a, i: F.struct(F.concat(F.lit("{"), i.cast("string"), F.lit("}")).alias("token"), a.alias("value")))
    out = F.aggregate(numbered, col(template), lambda acc, x: replace_first(acc, x["token"], x["value"]))
    return F.when(col(source).rlike(r"\([^)]*\)"), out)


def fill_fields(template: str, values: dict[str, Column]) -> Column:
    """Put field values into {0}, {1}, ... and {name}; null values leave their marks."""
    out = F.lit(template)
    for i, (name, v) in enumerate(values.items()):
        v = v.cast("string")
        for token in (f"{{{i}}}", f"{{{name}}}"):
            out = F.when(v.isNotNull(), F.replace(out, F.lit(token), v)).otherwise(out)
    return out


def _has(x: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def crawler_type(url) -> Column:
    """Basic type by URL pattern."""
    u = F.lower(col(url))
    return (
        F.when(u.contains("sitemap") & (u.contains(".xml") | u.endswith("sitemap")), "SITEMAP")
        .when(u.rlike(r"/rss(/|$|\?|#)") | u.rlike(r"/feed(/|$|\?|#)") | u.contains(".xml") | u.contains("atom"), "RSS")
        .when(u.contains("blog.naver.com"), "PLATFORM_NAVER").when(u.contains("brunch.co.kr"), "PLATFORM_KAKAO")
        .when(_has(u, NEWSLETTERS), "NEWSLETTER").when(_has(u, ["/api/", ".json", "graphql"]), "API").otherwise("SPA")
    )


def crawler_type_scored(url) -> Column:
    """Struct(type, confidence) by URL pattern, with CMS and portal hints."""
    u = F.lower(col(url))

    def r(kind: str, conf: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))

    return (
        F.when(u.contains("news.google.com/rss"), r("RSS", 0.95)).when(u.contains("openapi.naver.com"), r("API", 0.95))
        .when(u.contains("sitemap") & (u.contains(".xml") | u.endswith("sitemap")), r("SITEMAP", 0.95))
        .when(u.rlike(r"/rss(/|$|\?|#)") | u.rlike(r"/feed(/|$|\?|#)") | u.contains(".xml"), r("RSS", 0.95))
        .when(u.contains("blog.naver.com"), r("PLATFORM_NAVER", 0.95)).when(u.contains("brunch.co.kr"), r("PLATFORM_KAKAO", 0.95))
        .when(_has(u, NEWSLETTERS), r("NEWSLETTER", 0.9)).when(_has(u, ["/api/", ".json", "graphql"]), r("API", 0.85))
        .when(_has(u, ["wp-content", "wp-includes", "wordpress", "tistory.com", "medium.com", "/ghost/"]), r("STATIC", 0.75))
        .when(_has(u, [".go.kr", ".or.kr", "nipa.kr"]), r("SPA", 0.95))
        .when(_has(u, ["react-app", "vue-app", "angular"]), r("SPA", 0.7)).otherwise(r("SPA", 0.5))
    )


def rewrite_search(url) -> Column:
    """Search-result pages to their feed or API form; null when the URL is no such page."""
    u = col(url)
    q, hl = param(u, "q"), F.coalesce(param(u, "hl"), F.lit("ko"))
    gl = F.when(hl == "ko", "KR").when(hl == "ja", "JP").when(hl == "zh", "CN").otherwise("US")

    def enc(x: Column) -> Column:
        return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))

    news = F.concat(F.lit("https://news.google.com/rss/search?q="), enc(q), F.lit("&hl="), hl, F.lit("&gl="), gl, F.lit("&ceid="), gl, F.lit(":"), hl)
    nq = param(u, "query")
    sort = F.when(param(u, "sort") == "1", "date").otherwise("sim")
    api = F.concat(F.lit("https://openapi.naver.com/v1/search/news.json?query="), enc(nq), F.lit("&display=15&sort="), sort)
    return F.when(host(u).isin("www.google.com", "google.com") & (path(u) == "/search") & q.isNotNull(), news).when(
        (host(u) == "search.naver.com") & (path(u) == "/search.naver") & nq.isNotNull(), api
    )


def article_score(url) -> Column:
    """Likelihood that a URL is an article, by depth, numbers, dates and slugs; at least 1 means yes."""
    s, p = segments(url), path(url)

    def one(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    score = (
        one(F.size(s) >= 3, 1) + one(F.size(s) <= 1, -2) + one(F.exists(s, lambda x: x.rlike(r"^\d+$")), 1)
        + one(p.rlike(r"/\d{4}/\d{1,2}(/|$)") | p.rlike(r"/\d{4}-\d{2}"), 1)
        + one(F.exists(s, lambda x: (F.char_length(x) > 20) & x.contains("-")), 1)
    )
    return F.when(is_http(url), score).otherwise(F.lit(0))


def sitemap_entry_score(url) -> Column:
    """Order of undated sitemap entries: the higher, the more like an article."""
    s, p = segments(url), path(url)
    last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))

    def one(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    score = (
        one(last.rlike(r"^\d+$"), 10) + one(p.rlike(r"\d{4}[/-]\d{2}"), 5) + one(last.contains("-") & (F.char_length(last) > 10), 3)
        + one(F.char_length(last) > 20, 2) + F.least(F.size(s), F.lit(5))
    )
    return F.when(is_http(url), score).otherwise(F.lit(0))


def sitemap_file_score(url) -> Column:
    """+2 per article word and -2 per non-article word in the file name."""
    name = F.lower(F.element_at(F.split(F.element_at(F.split(col(url), "/"), -1), r"\?"), 1))
    score = F.lit(0)
    for w in SITEMAP_GOOD:
        score = score + F.when(name.contains(w), 2).otherwise(0)
    for w in SITEMAP_BAD:
        score = score - F.when(name.contains(w), 2).otherwise(0)
    return score


def _bare_path(u) -> Column:
    return F.regexp_replace(path(u), "/+$", "")


def feed_in_scope(registered, feed, root: str = FEED_ROOT, strict: bool = True) -> Column:
    """Whether a found feed belongs to the registered page.

    ``strict`` adds two rules: a meaningful query is not a site root, and a root
    feed does not cover a category page.
    """
    reg, rss = _bare_path(registered), _bare_path(feed)
    segs = F.filter(F.split(reg, "/"), lambda s: s != "")
    whole = reg == ""
    root_ok = F.size(segs) <= 2
    if strict:
        whole = whole & (F.size(params(registered, SCOPE_TRACKING)) == 0)
        root_ok = root_ok & ~((F.size(segs) == 2) & F.lower(F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit(""))).isin(CATEGORY_PREFIXES))
    inside = (rss == reg) | rss.startswith(F.concat(reg, F.lit("/")))
    ok = F.when(whole, True).when(inside, True).when(path(feed).rlike(root), root_ok).otherwise(False)
    return F.when(is_http(registered) & is_http(feed), ok).otherwise(F.lit(True))


def under_prefix(loc, base) -> Column:
    """Sitemap entry under the base path; other origins pass."""
    b = _bare_path(base)
    return (b == "") | (origin(loc) != origin(base)) | ~is_http(loc) | path(loc).startswith(b)


def url_filter(loc, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    ok = ~_has(col(loc), exclude)
    return ok & _has(col(loc), include) if include else ok


def newsletter_platform(url) -> Column:
    u = F.lower(col(url))
    return (
        F.when(u.contains("stibee.com"), "stibee").when(u.contains("substack.com"), "substack")
        .when(u.contains("mailchimp.com") | u.contains("campaign-archive"), "mailchimp").otherwise("generic")
    )


def blog_id(url) -> Column:
    """Author id of a hosted blog URL, from the path or the blogId parameter."""
    seg = F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit(""))
    return F.coalesce(param(url, "blogId"), F.nullif(F.when(~seg.endswith(".naver"), seg), F.lit("")))


def author_handle(url) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"brunch\.co\.kr/@([^/?#]+)", 1), F.lit(""))


def magazine_name(url) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"brunch\.co\.kr/magazine/([^/?#]+)", 1), F.lit(""))


def display_name(url) -> Column:
    """Site name for a URL: host without www, first label capitalised."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    first = F.element_at(F.split(h, r"\."), 1)
    return F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 200))


def is_main_page(url) -> Column:
    return F.lower(path(url)).isin(MAIN_PAGES)


def is_content_link(href, text) -> Column:
    """Navigation link that leads to a list of articles."""
    h, t = F.lower(col(href)), F.lower(F.trim(col(text)))
    ok = (h != "") & (t != "") & ~_has(h, NAV_SKIP_PATHS) & ~_has(t, NAV_SKIP_TEXTS) & (_has(h, NAV_PATHS) | _has(t, NAV_TEXTS))
    return F.coalesce(ok, F.lit(False))
