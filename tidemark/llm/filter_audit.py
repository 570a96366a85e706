"""Filter interaction audit: what each filter removes in every order of the filters, by Lehmer ranks."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored

MEASURES = ("kept", "removed", "redundant", "unique_fails")


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Rank of the first of all orders of ``n`` filters that begin with ``prefix``, in lexicographic order.

    The Lehmer code counts, at each place, the unused filters smaller than the one there.
    """
    return sum((f - sum(g < f for g in prefix[:k])) * factorial(n - 1 - k) for k, f in enumerate(prefix))


def rank_intervals(n: int) -> list[tuple[int, int, str, int, int]]:
    """(mask, step, measure, first rank, rank after the last) of all failure masks of ``n`` filters.

    All orders with one prefix are neighbours in rank.  A row that fails the filters of ``mask`` is removed at a step by the
    orders whose prefix ends in its first failing filter, so each prefix is one interval; intervals that touch are merged.
    """
    spans: dict[tuple[int, int, str], list[list[int]]] = {}
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            low = lehmer_rank(prefix, n)
            for mask in range(2**n):
                last, earlier = mask >> prefix[-1] & 1, any(mask >> f & 1 for f in prefix[:-1])
                measures = (["redundant"] if earlier else ["removed"]) if last else [] if earlier else ["kept"]
                if mask == 1 << prefix[-1]:
                    measures.append("unique_fails")
                for measure in measures:
                    ends = spans.setdefault((mask, step, measure), [])
                    if ends and ends[-1][1] == low:  # prefixes come in the order of their ranks
                        ends[-1][1] += factorial(n - step)
                    else:
                        ends.append([low, low + factorial(n - step)])
    return [(*key, low, high) for key, ends in spans.items() for low, high in ends]


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Totals of every part, order and step from rows counted by failure mask.

    ``counts`` has part, mask (bit k: fails the k-th filter), n, good and toxic, one row or several per part and mask.
    Each mask meets its rank intervals; its counts are added at the first rank of an interval and taken off after the last,
    and a running sum over the ranks gives the totals of all orders at once.  Rows do not grow with the documents from
    here on: a part has at most a fixed number of interval ends, 2 to the number of filters masks and n! n cells.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    A part without any row of a measure has zeros; without counts there are no parts and no rows.
    """
    n, spark = len(filters), counts.sparkSession
    # sizes fixed by the number of filters
    spans = F.broadcast(spark.createDataFrame(rank_intervals(n), "mask int, step int, measure string, low int, high int"))
    orders = [(rank, "".join(order)) for rank, order in enumerate(permutations(filters))]
    orders = F.broadcast(spark.createDataFrame(orders, "rank int, filter_order string"))

    end = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    ends = counts.join(spans, "mask").select("part", "step", "measure", "n", "good", "toxic", end.alias("end")).select("*", "end.*")
    cells = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    cells = cells.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))

    def of(measure: str, value: str) -> Column:
        return F.when(F.col("measure") == measure, F.col(value) * F.col("sign")).otherwise(0)

    added = {m: of(m, "n") for m in MEASURES} | {"good_lost": of("removed", "good"), "toxic_lost": of("removed", "toxic")}
    steps = ends.select("part", "step", "rank", *[c.cast("long").alias(name) for name, c in added.items()])
    steps = steps.unionByName(cells.select("*", *[F.lit(0).cast("long").alias(name) for name in added]))
    steps = steps.groupBy("part", "step", "rank").agg(*[F.sum(name).alias(name) for name in added]).where(F.col("rank") < factorial(n))
    # n! ranks in a window, and as many steps of one filter
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = steps.select("part", "step", "rank", *[F.sum(name).over(upto).alias(name) for name in added])
    totals = totals.join(orders, "rank")
    shapley = F.sum("removed").over(Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1))))
    return totals.select("part", "filter_order", "step", *added, shapley.alias("shapley"))


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang) and mask of each document for the five filters of ``audit_filters``."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    t = t.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    t = t.select("*", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    fails = [
        F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.char_length("text"), F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    slim = stored(t.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    # only the row of a text's smallest id meets it again, so copies do not gather in one task
    first = slim.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = slim.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of five filters over whole texts, by language: see ``audit`` for the columns.

    Words are runs of anything but ASCII white space, case counts.  A text fails A with under 100 words, B with distinct
    words under 80 % of its words, C with over 10 % of its code points in A-Z, D with any of ``#$%&*|``, E when a smaller
    doc_id has the identical text (compared by SHA-256), whatever the other filters do.  ``labels`` says which
    documents are good (quality 1 in any row of the id) and toxic (toxic 1 in any row).

    A null text is empty (fails A only), a null lang is the part of the empty string.  A row without id never fails E, is
    no smaller id for others and has no label; rows that repeat an id and text are not copies of one another.  Documents
    without a label, or with null labels, are neither good nor toxic.  An empty table gives no rows.
    """
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counts = failure_masks(docs).join(rated, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return audit(stored(counts, "masks"))

