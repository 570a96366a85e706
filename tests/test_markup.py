"""XML sources and exports round trip, broken payloads are set apart, and block search misses nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan, ts
from tidemark.operators import blocks as BL
from tidemark.plans import feed as A
from tidemark.sources import feed_xml as X

AS_OF = "2024-01-30 00:00:00"


def test_kinds_of_feeds(spark):
    rows = [
        ("rss", "<rss><channel><item><title><![CDATA[A long <b>bold</b> title & more]]></title><link>https://a.example.com/1</link><category>x</category><category>y</category>"
                "<enclosure url='https://i/s.mp3' type='audio/mpeg'/><enclosure url='https://i/p.png' type='image/png'/><description>first &lt;p&gt;text&lt;/p&gt;</description></item>"
                "<item><title>Second title of the feed</title><link>https://a.example.com/2</link></item><item><title>No link at all here</title></item></channel></rss>"),
        ("atom", "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>An entry with two links</title><link rel='self' href='https://a.example.com/s'/><link rel='alternate' href='https://a.example.com/h'/>"
                 "<updated>2024-01-05T00:00:00Z</updated><category term='t'/></entry></feed>"),
        ("cut", "<rss><channel><item><title>cut"), ("null", None), ("empty", ""), ("text", "no markup"), ("none", "<rss><channel/></rss>"),
    ]
    p = spark.createDataFrame(rows, "source_name string, payload string")
    got = {(r.source_name, r.link): r for r in X.feed_items(p, AS_OF, max_age_days=None).collect()}
    assert set(got) == {("rss", "https://a.example.com/1"), ("rss", "https://a.example.com/2"), ("atom", "https://a.example.com/h")}
    first = got["rss", "https://a.example.com/1"]
    assert first.thumbnail == "https://i/p.png" and first.tags == ["x", "y"] and "bold" in first.title and "<" not in first.title
    assert got["atom", "https://a.example.com/h"].tags == ["t"] and str(got["atom", "https://a.example.com/h"].published_at) == "2024-01-05 00:00:00"
    assert {r[0] for r in X.broken(p, X.FEED, "source_name").collect()} == {"cut", "null", "empty", "text"}
    assert X.feed_items(p.limit(0), AS_OF).count() == 0


def test_items_written_are_read_back(spark):
    rows = [(1, "a < b & \"c\" 'd' ]]> e\x01", "https://x/?a=1&b=2", "line one\nline two", "cät"), (2, None, "https://y", None, None), (3, "", None, "", "")]
    d = spark.createDataFrame(rows, "id int, title string, link string, description string, category string")
    xml = d.select("id", X.item_xml(F.col("title"), F.col("link"), ts("2024-01-02 03:04:05"), F.col("description"), F.col("category")).alias("payload"))
    schema = "struct<title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,description:string,category:string,_corrupt_record:string>"
    got = {r.id: r.x for r in X.parsed(xml, schema, "id").collect()}
    assert all(g["_corrupt_record"] is None and g.pubDate == "Tue, 02 Jan 2024 03:04:05 GMT" for g in got.values())
    assert got[1].title == rows[0][1].replace("\x01", "") and got[1].link == got[1].guid["_VALUE"] == rows[0][2] and got[1].description == rows[0][3] and got[1].category == "cät"
    assert got[2].title is None and got[2].description is None and got[3].link is None and got[3].guid is None


@pytest.fixture(scope="module")
def blocked(spark, tmp_path_factory):
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("blocks") / "b")
    words = ["alpha", "Beta", "GAMMA", "straße", "ΟΔΟΣ", "日本語のテキスト", "🙂🙃", "a_b", "50%", "x\ny"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), None if i % 3 else f"nr{i}") for i in range(300)]
    rows += [(300, "y" * 70_000 + "Needle" + "z" * 70_000, None), (301, None, None), (302, "", ""), (303, "q" * (BL.PIECE - 2) + "EdgeWord", None)]
    df = spark.createDataFrame(rows, "id int, title string, summary string").withColumn("content", F.lit(None).cast("string"))
    BL.create(df, path, "id", ["title", "summary", "content"], 32)
    return df, path


@pytest.mark.parametrize("needle", ["gamma", "beta alpha", "straße", "οδος", "のテキ", "🙂🙃", "nr17", "needle", "edgeword", "al%ma", "a_b", "x\ny", "zz", "absent word", "nr2_"])
def test_block_search_equals_a_full_scan(spark, blocked, needle):
    df, path = blocked
    cols = ["title", "summary", "content"]
    want = sorted(r.id for r in A.matching(df, needle, cols).collect())
    assert sorted(r.id for r in A.matching(BL.candidates(spark, path, needle), needle, cols).collect()) == want


def test_blocks_that_cannot_match_are_not_opened(spark, blocked):
    df, path = blocked
    found = BL.candidates(spark, path, "needle")
    assert len(BL.matching_blocks(spark, path, "needle")) == 1 and "PartitionFilters: [isnotnull(block" in plan(found)
    assert 0 < found.count() < df.count() / 8
    assert BL.candidates(spark, path, "absent word").count() == 0
    assert BL.matching_blocks(spark, path, "zz") is None and BL.candidates(spark, path, "zz").count() == df.count()
