"""HTML jobs on hand-made pages."""

from pyspark.sql import functions as F

from tests.helpers import evaluate
from tidemark.functions import dom
from tidemark.functions.pages import spa_score
from tidemark.plans import ingest as I

LIST = """<html><body><nav><a href="/x">menu entry</a></nav><div class="wrap">
<article class="card"><h2>First story here</h2><a href="/a/1?utm_source=q">go</a><img src="/i.png"><time datetime="2024-01-02">x</time><span class="author">Ann</span></article>
<article class="card"><h2>Second story here</h2><a href="javascript:view('7','b')">go</a></article>
<article class="card"><h2>Third story here</h2><a href="#" onclick="view(9)">go</a><p>on 2024.01.05</p></article>
<aside><article class="card"><h2>Advert story here</h2><a href="/ad">go</a></article></aside>
<article class="card"><h2>더보기</h2><a href="/more">go</a></article></div></body></html>"""


def pages(spark, html, url="https://s.com/list"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_static_items(spark):
    rows = I.page_articles(pages(spark, LIST), link_template="/view/{0}", exclude=["aside"]).orderBy("pos").collect()
    assert [(r.title, r.link) for r in rows] == [
        ("First story here", "https://s.com/a/1"), ("Second story here", "https://s.com/view/7"), ("Third story here", "https://s.com/view/9")]
    assert (rows[0].thumbnail, rows[0].author, rows[0].date_text, rows[2].date_text) == ("https://s.com/i.png", "Ann", "2024-01-02", "2024.01.05")


def test_script_links_without_template_are_dropped(spark):
    assert [r.title for r in I.page_articles(pages(spark, LIST), exclude=["aside"]).collect()] == ["First story here"]


def test_unclosed_list_items(spark):
    html = "<ul class=list><li class=post><h3>One two three</h3><a href=/1>x</a><li class=post><h3>Four five six</h3><a href=/2>x</a></ul>"
    got = I.page_articles(pages(spark, html), "newsletter").orderBy("pos").collect()
    assert [(r.title, r.link) for r in got] == [("One two three", "https://s.com/1"), ("Four five six", "https://s.com/2")]


def test_main_text(spark):
    html = "<body><nav>menu</nav><div class='ad-box'>buy</div><article>" + "text " * 40 + "</article><p>rest</p></body>"
    assert evaluate(spark, dom.page_text(F.col("x")), [html, "<body>tiny<script>x</script></body>", None]) == [("text " * 40).strip(), "tiny", ""]


def test_extraction_markup_retries_when_little_is_left():
    form = "<body><form>" + "word " * 200 + "</form></body>"
    assert "word" in dom.extraction_markup(form)
    assert dom.extraction_markup("<body><form>gone</form>" + "word " * 200 + "</body>").find("gone") < 0


def test_structure(spark):
    best = I.best_structure(pages(spark, LIST)).collect()[0]
    assert (best.kind, best.grp, best.n) == ("class", "article.card", 4)
    assert abs(best.score - 1.0) < 1e-9


def test_spa_score(spark):
    s = spa_score(dom.page_signals(F.col("x")))
    app = '<body><div id="root"></div><script src="main.chunk.js"></script></body>'
    rich = "<body>" + "<article>" + "word " * 250 + "</article>" * 1 + "<article>" + "word " * 250 + "</article><article>" + "word " * 250 + "</article></body>"
    assert evaluate(spark, s, [app, rich]) == [1.0, 0.0]
