"""Nine list strategies over one parse of a page."""

from tidemark.functions import dom
from tidemark.plans import ingest as I

HTML = (
    "<body><article><h2>First story here</h2><a href='/a/1'>x</a><time datetime='2024-01-01'>d</time></article>"
    "<ul><li class='campaign-item'><a href='/a/2' class='title'>Second story here</a></li><li><a href='/a/3'>Third story here</a></li></ul></body>"
)


def test_every_strategy_from_one_parse(spark):
    df = spark.createDataFrame([(1, "https://x.example.com/l", HTML), (2, "https://y.example.com/", None)], "page_id long, url string, html string")
    names = [*dom.LISTS]
    got = sorted(map(str, I.page_articles_each(df, names).collect()))
    want = [str(r) for n in names for r in I.page_articles(df, n).selectExpr(f"'{n}' AS strategy", "*").collect()]
    assert got == sorted(want) and len(want) > 5


def test_a_selector_is_read_once():
    dom.compiled.cache_clear()
    for _ in range(3):
        dom.list_items(HTML, dom.LISTS["static"])
    assert dom.compiled.cache_info().misses <= len(dom.LISTS["static"]) + 2
