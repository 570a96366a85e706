"""URL filter by host reputation: labelled outcomes shrunk from host to registered domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, stored

#: Suffixes of more than one label under which anybody can register a name, where no table is given.
SHARED_SUFFIXES = ("example.com", "example.net", "example.org", "co.uk", "com.au", "com.br", "co.jp")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without a scheme or for null."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a scheme or for null."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix_table(spark: SparkSession, rules: Sequence[str] = SHARED_SUFFIXES) -> DataFrame:
    """Suffix rules as the table (rule) that the operators take."""
    return spark.createDataFrame([(r,) for r in rules], "rule string")


def split_hosts(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Suffix and registered domain (the suffix and one label before it) of distinct hosts: host, domain, suffix.

    ``suffixes`` has rules as in the public list: ``co.uk`` is a suffix, ``*.ck`` makes every name directly under ck one,
    ``!www.ck`` excepts a name from that.  An exception goes before all others, then the longest rule wins; without a rule the
    last label is the suffix.  Rules are joined on the ends of a host, at most as many of its labels as the longest rule has,
    so neither the number of rules nor a long host matters.  A host that is a suffix is its own domain.  Null, empty and
    repeated rules do nothing; a null host gives nothing.
    """
    r = suffixes.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> ''")
    bare = F.regexp_replace("rule", r"^(!|\*\.)", "")
    more = F.when(F.startswith("rule", F.lit("!")), -1).when(F.startswith("rule", F.lit("*.")), 1).otherwise(0)
    r = r.select(bare.alias("ending"), more.alias("more")).distinct()
    deepest = r.agg(F.coalesce(F.max(F.size(F.split("ending", r"\."))), F.lit(1))).scalar()
    h = hosts.select("host").where("host IS NOT NULL").distinct()
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    ends = h.withColumn("labels", labels).withColumn("k", F.explode(F.sequence(F.lit(1), F.least("labels", deepest).cast("int"))))
    ends = ends.withColumn("ending", F.expr("substring_index(host, '.', -k)"))
    hits = ends.join(r, "ending").where(F.col("k") + F.col("more") <= F.col("labels"))
    best = hits.groupBy("host").agg(F.max(F.struct((F.col("more") < 0).alias("excepted"), (F.col("k") + F.col("more")).alias("s")))["s"].alias("s"))
    found = h.join(best, "host", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    return found.select("host", F.expr("substring_index(host, '.', -(s + 1))").alias("domain"), F.expr("substring_index(host, '.', -s)").alias("suffix"))


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (``host/path``) that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def spread(counts: DataFrame) -> Column:
    """Prior strength of a level by moments: groups with n outcomes, y bad, around the rate ``parent`` expected of them.

    With correlation r inside a group, (y - n m)^2 is n m (1 - m) (1 + (n - 1) r)
    on average; r is held in [0.0001, 0.5] and the strength is 1 / r - 1.
    """
    v = F.col("parent") * (1 - F.col("parent"))
    over = F.sum(F.pow(F.col("y") - F.col("n") * F.col("parent"), 2) - F.col("n") * v)
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * v)
    r = F.least(F.lit(0.5), F.greatest(F.lit(1e-4), F.coalesce(F.try_divide(over, pairs), F.lit(1e-4))))
    return counts.agg((1 / r - 1).alias("m")).scalar()


def shrunk(counts: DataFrame, strength: Column) -> Column:
    return (F.col("y") + strength * F.col("parent")) / (F.col("n") + strength)


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of the bad rate of each host: host, n, bad_rate, bad_low (rate less z deviations).

    ``hosts`` has the distinct hosts to judge, ``outcomes`` has host and bad (0/1)
    per labelled page of one of them; ``suffixes`` is the table of ``split_hosts``.  Counts are reduced host by host first, so a host with a
    third of all pages costs one row a task.  The rate of a suffix is shrunk to
    the overall rate, that of a domain to its suffix, that of a host to its domain,
    each with the strength that the level shows in the labelled data.  A host
    without labels has its domain's rate, and so on.
    """
    names = stored(split_hosts(hosts, suffix_table(hosts.sparkSession) if suffixes is None else suffixes), "host-names")
    by_host = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("y"))
    by_host = stored(by_host.join(names, "host").select("host", "domain", "suffix", "n", "y"), "host-counts")
    by_domain = by_host.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("y").alias("y"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    overall = by_suffix.agg((F.coalesce(F.sum("y"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).scalar()

    s = stored(by_suffix.withColumn("parent", overall), "suffixes")
    s = s.select("suffix", shrunk(s, spread(s)).alias("suffix_rate"))
    d = stored(by_domain.join(s, "suffix").withColumnRenamed("suffix_rate", "parent"), "domains")
    d = d.select("domain", shrunk(d, spread(d)).alias("domain_rate"))
    h = stored(by_host.join(d, "domain").withColumnRenamed("domain_rate", "parent"), "hosts")

    every = names.join(h.select("host", "n", "y"), "host", "left").join(d, "domain", "left").join(s, "suffix", "left")
    every = every.select(
        "host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0)).alias("y"),
        F.coalesce("domain_rate", "suffix_rate", overall).alias("parent"), spread(h).alias("strength"),
    )
    a = F.col("y") + F.col("strength") * F.col("parent")
    total = F.col("n") + F.col("strength")
    rate = a / total
    return every.select("host", "n", rate.alias("bad_rate"), (rate - z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("bad_low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, allow: Sequence[str], block: Sequence[str], limit: float = 0.25, z: float = 1.645,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Verdict for the url of every page: page_id, host, path, rule, verdict (allow or block).

    ``outcomes`` has page_id and bad (0/1); a page with several outcomes is bad if
    one is, and null outcomes do not count.  Lists of ``host/path`` rules come
    first, the longest wins (on both lists: block).  Otherwise a page is blocked
    when the lower posterior bound of its host's bad rate is above ``limit``, so a
    host with little evidence follows its domain and suffix.  The bound is the
    beta posterior's mean less ``z`` standard deviations.  ``suffixes`` (see ``split_hosts``) are ``SHARED_SUFFIXES`` unless given.

    Null urls and urls without a scheme have an empty host and path, and the empty
    host is judged like any other.  Repeated rows are judged alike; without any
    outcome the overall rate is one half with no evidence, and rules alone block.
    """
    rated = F.col("bad").isNotNull() & F.col("page_id").isNotNull()
    p = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    o = outcomes.where(rated).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    rep = host_reputation(p.select("host").distinct(), p.join(o, "page_id").select("host", "bad"), z, suffixes)
    blocked = stored(rep.where(F.col("bad_low") > limit).select("host"), "blocked").withColumn("bad_host", F.lit(True))
    fit = p.withColumn("rule", matching_rule(F.col("host"), F.col("path"), [*allow, *block]))
    verdict = F.when(F.col("rule").isin(*block), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("bad_host"), "block").otherwise("allow")
    return fit.join(blocked, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
