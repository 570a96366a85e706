"""Titles, dates, URLs and text rules on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import evaluate
from tidemark.functions import dates as D
from tidemark.functions import pages as P
from tidemark.functions import text as X
from tidemark.functions import titles as T
from tidemark.functions import urls as U

NOW = "2024-03-31 12:00:00"


@pytest.mark.parametrize("raw, cleaned", [
    ("<b>Big</b> &quot;news&quot; &amp; more", 'Big "news" & more'),
    ("공지 \n 새 글 7 min read", "새 글"),
    ("Report 2024-01-15 [event] at 10:30", "Report at"),
    ("a | b_c - d", "a b c d"),
    ("NEW Story", "Story"),
    ("News today", "News today"),
    ("", ""),
    (None, ""),
])
def test_clean_title(spark, raw, cleaned):
    assert evaluate(spark, T.clean_title("x"), [raw]) == [cleaned]


def test_clean_title_exact_keeps_the_quirk(spark):
    assert evaluate(spark, T.clean_title("x", exact=True), ["News today"]) == ["s today"]


def test_title_valid(spark):
    got = evaluate(spark, T.title_valid("x"), ["ab", "abc", "12345", "더보기", "TOP", "리테일 순위", "2024년 상반기 앱 사용 순위", None])
    assert got == [False, True, False, False, False, False, True, False]


def test_normalize_title_and_slug(spark):
    assert evaluate(spark, T.normalize_title("x"), ["A story… - Paper", "Foo... | Pub", "Foo...", "plain  text"]) == ["A story", "Foo", "Foo", "plain text"]
    assert evaluate(spark, T.article_slug("x", F.lit("abcdef")), ["Hello,  World!", "한글 제목", "!!!"]) == ["hello-world-abcd", "한글-제목-abcd", "abcd"]


def test_garbage(spark):
    rows = [("Login", "https://a/b"), ("A real title", "https://a/login"), ("A real title", "https://a/b"), (None, "u"), ("A real title", ""), ("123456", "https://a/b")]
    assert evaluate(spark, T.is_garbage("t", "l"), rows, "t string, l string") == [True, True, False, True, True, True]


def day(y, m, d, h=0, mi=0, s=0):
    return dt.datetime(y, m, d, h, mi, s)


@pytest.mark.parametrize("text, want", [
    ("2024-01-15T10:30:00Z", day(2024, 1, 15, 10, 30)), ("2024-01-15T10:30:00+09:00", day(2024, 1, 15, 1, 30)), ("2024-01-15 10:30", day(2024, 1, 15, 10, 30)),
    ("2024-01-15", day(2024, 1, 15)), ("15.03.2024", day(2024, 3, 15)), ("03/15/2024", day(2024, 3, 15)), ("24.3.5", day(2024, 3, 5)),
    ("20240305", day(2024, 3, 5)), ("2024년 3월 5일", day(2024, 3, 5)), ("Mar 5, 2024", day(2024, 3, 5)), ("5 March 2024", day(2024, 3, 5)),
    ("2024.13.01", day(2025, 1, 1)), ("어제", day(2024, 3, 30, 12)), ("3시간 전", day(2024, 3, 31, 9)), ("2주 넘게 전", day(2024, 3, 17, 12)),
    ("1개월 전", day(2024, 3, 2, 12)), ("about 2 days 전", day(2024, 3, 29, 12)), ("5 minutes ago", day(2024, 3, 31, 11, 55)), ("yesterday", day(2024, 3, 30, 12)),
    ("just now", day(2024, 3, 31, 12)), ("soon", None), ("", None), (None, None), ("99999999999999999 days ago", None),
])
def test_parse_date(spark, text, want):
    assert evaluate(spark, D.parse_date("x", NOW), [text]) == [want]


def test_age_filters(spark):
    rows = [None, "2024-04-02 00:00:00", "2024-03-01 12:00:00", "2024-03-01 11:59:59"]
    t = F.col("x").cast("timestamp")
    assert evaluate(spark, D.within_days(t, 30, NOW), rows) == [True, True, True, False]
    assert evaluate(spark, D.within_days_strict(t, 30, NOW), rows) == [False, True, True, False]


def test_preview(spark):
    long_sentence = "a" * 300 + ". " + "b" * 400
    words = ("word " * 200).strip()
    got = evaluate(spark, X.preview("x"), ["short", long_sentence, words, "c" * 600])
    assert got[0] == "short" and got[1] == "a" * 300 + "."
    assert got[2].endswith("word...") and len(got[2]) <= 502
    assert got[3] == "c" * 500 + "..."


def test_small_text_rules(spark):
    assert evaluate(spark, X.view_count("x"), ["1.2K", "3M", "17", "1.9", "none"]) == [1200, 3000000, 17, 1, 0]
    assert evaluate(spark, X.strip_board_markup("x"), ['<a href="#" class="quotelink">&gt;&gt;1</a>hi<br>a <s>b</s> &amp; c']) == ["hi\na [spoiler] & c"]
    assert evaluate(spark, X.quality_flags("x"), ["short", "x" * 30, "join now for the <b>presale"]) == [["TOO_SHORT"], ["SPAM_REPEAT"], ["HTML_REMNANT", "SPAM_PROMO"]]
    t = F.col("x").cast("timestamp")
    assert evaluate(spark, X.time_ago(t, NOW, "en"), ["2024-03-31 11:59:30", "2024-03-31 11:00:00", "2024-03-01 12:00:00", "2022-01-01"]) == ["just now", "1h ago", "1 mo ago", "2y ago"]


def test_urls(spark):
    n = U.normalize("x", U.TRACKING["static"], True)
    assert evaluate(spark, n, ["HTTP://A.com/b/?utm_source=x#t", "https://a.com/b/?utm_source=x&p=1", "https://a.com", "https://a.com/b/", "mailto:x"]) == [
        "http://a.com/b/#t", "https://a.com/b/?p=1", "https://a.com/", "https://a.com/b", "mailto:x"]
    a = U.absolute("x", F.lit("https://a.com/d/e?q=1"))
    assert evaluate(spark, a, ["/x", "x", "../x", "//b.com/y", "https://c.com", "?z=2"]) == [
        "https://a.com/x", "https://a.com/d/x", "https://a.com/x", "https://b.com/y", "https://c.com", "https://a.com/d/e?z=2"]
    assert evaluate(spark, U.fill_template(F.lit("/v/{0}/{1}"), "x"), ["javascript:go('7', 2)", "no call"]) == ["/v/7/2", None]
    s = U.feed_in_scope("r", "f")
    rows = [("https://a.com/", "https://a.com/feed"), ("https://a.com/blog", "https://a.com/feed"), ("https://a.com/tag/x", "https://a.com/feed"),
            ("https://a.com/a/b/c", "https://a.com/feed"), ("https://a.com/blog", "https://a.com/blog/feed"), ("https://a.com/blog", "https://a.com/mag/feed"), ("x", "y")]
    assert evaluate(spark, s, rows, "r string, f string") == [True, True, False, False, True, False, True]
    assert evaluate(spark, U.rewrite_search("x"), ["https://www.google.com/search?q=a%20b&hl=ko", "https://a.com/search?q=1"]) == [
        "https://news.google.com/rss/search?q=a%20b&hl=ko&gl=KR&ceid=KR:ko", None]


def test_page_rules(spark):
    body = "<body>" + "text " * 60 + "</body>"
    rows = [("<title>404</title>" + body, "https://a.com/blog"), ("서비스 종료" + body, "https://a.com/blog"), ("<body>x</body>", "https://a.com/blog"),
            ("2020-01-01" + body, "https://a.com/blog"), ("captcha" + body, "https://a.com/blog"), (body, "https://a.com/"), (body, "https://a.com/blog")]
    assert evaluate(spark, P.invalid_reason("h", "u", NOW), rows, "h string, u string") == ["error", "closed", "empty", "stale", "blocked", "not_a_list", None]
    m = evaluate(spark, P.page_metadata("x"), ['<meta content="T" property="og:title"><title>t</title><meta name="author" content="me"><time datetime="2024-01-01">'])[0]
    assert (m.title, m.author, m.published) == ("T", "me", "2024-01-01")
    xml = "".join(f"<loc>https://a.com/2024/01/{i}</loc>" for i in range(3)) + "<loc>https://a.com/</loc>"
    assert evaluate(spark, P.is_article_sitemap("x"), [xml, "<loc>https://a.com/</loc>", ""]) == [True, False, False]


def test_large_relative_counts(spark):
    values = ["3000000 minutes ago", "2000 years ago", "999999999999 years ago", "99999999999999999999 days ago"]
    got = evaluate(spark, F.year(D.parse_date(F.col("x"), "2024-01-30 00:00:00")), values)
    assert got == [2018, 24, None, None]
