from pyspark.sql import functions as F

from tests.helpers import evaluate
from tidemark.llm import url_filter as u

URLS = ["http://A.example.org:80/p/q?x#y", "x://h?z/q", "http://h#f", "http://h/a#b?c", "none/at/all", None, "", "a://b://c/d", "http:///p"]


def test_host_and_path(spark):
    assert evaluate(spark, u.url_host(F.col("x")), URLS) == ["a.example.org:80", "h", "h", "h", "", "", "", "b:", ""]
    assert evaluate(spark, u.url_path(F.col("x")), URLS) == ["/p/q", "", "", "/a", "", "", "", "//c/d", "/p"]


def split(spark, hosts, rules):
    got = u.split_hosts(spark.createDataFrame([(h,) for h in hosts], "host string"), u.suffix_table(spark, rules)).collect()
    return {r.host: (r.suffix, r.domain) for r in got}


def test_levels(spark):
    hosts = ["www.a.example.com", "a.example.com", "example.com", "b.c.org", "c.org", "org", "", "x.y.co.uk", "org", None]
    got = split(spark, hosts, u.SHARED_SUFFIXES)
    assert [got[h][0] for h in hosts[:8]] == ["example.com"] * 3 + ["org"] * 3 + ["", "co.uk"] and len(got) == 8
    assert [got[h][1] for h in hosts[:8]] == ["a.example.com", "a.example.com", "example.com", "c.org", "c.org", "org", "", "y.co.uk"]


def test_wildcards_and_exceptions(spark):
    rules = ["ck", "*.ck", "!www.ck", "a.b.c.jp", "jp", " CO.jp ", None, "", "jp"]
    want = {
        "x.y.ck": ("y.ck", "x.y.ck"), "w.x.y.ck": ("y.ck", "x.y.ck"), "y.ck": ("y.ck", "y.ck"), "ck": ("ck", "ck"), "www.ck": ("ck", "www.ck"),
        "z.www.ck": ("ck", "www.ck"), "q.a.b.c.jp": ("a.b.c.jp", "q.a.b.c.jp"), "b.c.jp": ("jp", "c.jp"), "n.co.jp": ("co.jp", "n.co.jp"),
        "none": ("none", "none"), "p.none": ("none", "p.none"), ".": ("", "."), "l." * 3000 + "jp": ("jp", "l.jp"),
    }
    assert split(spark, want, rules) == want
    assert split(spark, ["a.co.uk"], []) == {"a.co.uk": ("uk", "co.uk")}


def plain_split(host, rules):
    """The rules applied one by one to the labels of one host."""
    labels, best, excepted = host.split("."), 1, False
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        tail = labels[-len(parts):]
        if len(tail) == len(parts) and all(p in ("*", x) for p, x in zip(parts, tail, strict=True)):
            if rule.startswith("!"):
                best, excepted = len(parts) - 1, True
            elif not excepted:
                best = max(best, len(parts))
    return ".".join(labels[-best:]), ".".join(labels[-best - 1:])


def test_many_suffixes(spark):
    """Thousands of rules and hosts against a plain version."""
    tops = [f"t{i}" for i in range(50)]
    rules = tops + [f"s{j}.t{i}" for i in range(50) for j in range(i)] + [f"*.w.t{i}" for i in range(0, 50, 2)] + [f"!x.w.t{i}" for i in range(0, 50, 6)]
    hosts = {f"{a}{b}{c}.t{i}" for i in range(60) for a in ("", "n.") for b in ("", "m.", "x.") for c in ("w", "s3", "s40", "k")}
    assert split(spark, hosts, rules) == {h: plain_split(h, rules) for h in hosts}


def test_suffixes_decide_who_pools(spark):
    """Two strangers under a shared suffix: with the suffix known, one's bad outcomes do not reach the other's new host."""
    outcomes = spark.createDataFrame([("a.bad.hosting.io", 1)] * 30 + [("b.fine.hosting.io", 0)] * 30 + [(f"h{i}.c.com", 0) for i in range(40)], "host string, bad int")
    hosts = outcomes.select("host").union(spark.createDataFrame([("new.fine.hosting.io",)], "host string"))
    rate = [{r.host: r.bad_rate for r in u.host_reputation(hosts.distinct(), outcomes, suffixes=t).collect()}["new.fine.hosting.io"]
            for t in (u.suffix_table(spark, ["io"]), u.suffix_table(spark, ["io", "hosting.io"]))]
    assert rate[1] < 0.1 < rate[0]


def test_longest_rule_wins(spark):
    rules = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    cases = [("www.example.org", "/es/5"), ("example.org", "/en/12"), ("example.org", "/en/2"), ("notexample.org", "/es/"), ("org", "/"), ("x.com", "/fr/"), ("com", "/de/x"), ("x.com", "/fr"), ("a.org", ""), ("xorg", "/")]
    got = evaluate(spark, u.matching_rule(F.col("h"), F.col("p"), rules), cases, "h string, p string")
    assert got == ["example.org/es/", "example.org/en/1", "org/", "org/", "org/", "com/fr/", "com/de/", None, None, None]


def test_reputation_shrinks_and_inherits(spark):
    bad = [("spam.a.net", 1)] * 40 + [("ham.a.net", 0)] * 40 + [("one.b.net", 1)] + [(f"h{i}.c.com", 0) for i in range(40)]
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in bad} | {"new.a.net", "new.zz"}], "host string")
    r = {x.host: x for x in u.host_reputation(hosts, outcomes).collect()}
    assert r["spam.a.net"].bad_low > 0.8 and r["ham.a.net"].bad_rate < 0.1
    assert 0.3 < r["new.a.net"].bad_rate < 0.7 and r["new.a.net"].n == 0  # no evidence of its own: its domain's rate
    assert r["one.b.net"].bad_low < r["spam.a.net"].bad_low  # one outcome proves little
    assert r["new.zz"].bad_rate == r["new.zz"].bad_rate


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i < 30 else 'ham'}.a.net/p") for i in range(60)] + [(60, "http://spam.a.net/ok/1")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in u.judge_urls(pages, outcomes, ["a.net/ok/"], []).collect()}
    assert all(got[i] == "block" for i in range(30)) and all(got[i] == "allow" for i in range(30, 61))
