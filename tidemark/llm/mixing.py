"""Mixing sources to target weights by entropy balancing, rates rounded into copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_name, stored
from tidemark.operators.keyed import null_safe_join, row_numbers


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Target of each source: source, source_size, target.

    ``sizes`` has source and source_size.  Sources in order of their code points,
    null last, get the weights in turn and share the whole size by them; where a
    share is over ``most`` times the source's size it stops there, and the
    rest is shared anew by weight among the others until none is above.
    Each round is an aggregate over the sources; a round ends at least one source.
    """
    null = F.col("source").isNull()
    s = row_numbers(sizes.withColumn("one", F.lit(1)).withColumn("last", null), ["one"], [F.col("last"), F.col("source").cast("binary")], "at").drop("one", "last")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("at") - 1, F.lit(len(weights))).cast("int"))
    s = stored(s.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total, level, full = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], None, -1
    while True:
        stop = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        n, held, free = s.agg(
            F.count_if(stop), F.coalesce(F.sum(F.when(stop, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stop, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == full or not free:
            break
        full, level = n, (total - held) / free
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level or 0.0)).alias("target"))


def entropy_balance(classes: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Rates of document classes that meet each source's token target: ``classes`` with ``rate``.

    ``classes`` has source, size, n (documents of that size), target and base (their rate before balancing).  The rates
    r minimise the sum of n (r log(r / base) - r) subject to, for each source, sum(n r size) =
    target and sum(n r) = the same share of its documents, so lengths keep their
    mean.  The dual is convex with two variables a source; its optimum gives
    r = base exp(a + b size / mean).  A Newton round sums gradient and Hessian per
    source (combined before the shuffle) and solves two by two; the step is
    bounded so that an overshoot costs a few rounds only.  Sources without
    words or with no target have rate zero.
    """
    x = F.col("size") / F.col("mean")
    of_source = classes.groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words"), F.first("target").alias("target")
    ).where("words > 0 and target > 0")
    dual = stored(
        of_source.select(
            "source", "docs", (F.col("words") / F.col("docs")).alias("mean"), (F.col("target") / F.col("words")).alias("share"),
            F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("gap"),
        ), "dual",
    )
    slim = classes.select("source", "size", "n", "base")
    for _ in range(rounds):
        r = F.col("n") * F.col("base") * F.exp(F.col("a") + F.col("b") * x)
        sums = null_safe_join(slim, dual, ["source"]).groupBy("source").agg(F.sum(r).alias("s0"), F.sum(r * x).alias("s1"), F.sum(r * x * x).alias("s2"))
        now = null_safe_join(dual, sums, ["source"])
        want = F.col("docs") * F.col("share")
        g0, g1 = F.col("s0") - want, F.col("s1") - want
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        flat = det <= 1e-12 * F.col("s0") * F.col("s2")  # documents of one length: one variable is enough
        da = F.when(flat, g1 / F.col("s1")).otherwise((F.col("s2") * g0 - F.col("s1") * g1) / det)
        db = F.when(flat, 0.0).otherwise((F.col("s0") * g1 - F.col("s1") * g0) / det)
        scale = F.least(F.lit(1.0), F.lit(2.0) / F.greatest(F.abs(da) + F.abs(db), F.lit(1e-300)))
        gap = F.greatest(F.abs(g0), F.abs(g1)) / want
        done = gap <= tolerance
        dual = stored(
            now.select(
                "source", "docs", "mean", "share", F.when(done, F.col("a")).otherwise(F.col("a") - da * scale).alias("a"),
                F.when(done, F.col("b")).otherwise(F.col("b") - db * scale).alias("b"), gap.alias("gap"),
            ), "dual",
        )
        if (dual.agg(F.coalesce(F.max("gap"), F.lit(0.0))).first()[0]) <= tolerance:
            break
    found = null_safe_join(classes, dual.select("source", "mean", "a", "b"), ["source"], "left")
    rate = F.col("base") * F.exp(F.col("a") + F.col("b") * x)
    return found.withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("mean", "a", "b")


def token_tilt(classes: DataFrame, most: float = 3.0, rounds: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """Rates of document classes that meet each source's token target: ``classes`` with ``rate``, at most ``most``.

    ``classes`` has source, size, n and target (at most ``most`` times the source's words).  The rates r minimise the sum of
    n (r log r - r) with sum(n r size) = target and r <= most, so r = min(most, exp(a size / mean)): a source that is cut
    down loses its long documents first, one that is repeated repeats them first.  The dual has one variable a source.  A
    Newton round on the logarithm of the words taken sums value and slope per source (combined before the shuffle); a step
    that leaves the bracket known so far is replaced by its middle.  Without a target or without words a rate is zero.
    """
    words, x = F.sum(F.col("n") * F.col("size")), F.col("size") / F.col("mean")
    of_source = classes.where("size > 0").groupBy("source").agg(
        words.alias("words"), (words / F.sum("n")).alias("mean"), F.first("target").alias("target"), F.min("size").alias("shortest")
    ).where("target > 0")
    # a bracket: here every document is at the limit, or the shortest one's rate alone would take less than the target
    grows, least = F.col("target") >= F.col("words"), F.col("shortest") / F.col("mean")
    high = F.when(grows, F.log(F.lit(float(most))) / least).otherwise(0.0)
    low = F.when(grows, 0.0).otherwise(F.log(F.col("target") / F.col("words")) / least)
    full = F.col("target") >= F.col("words") * float(most) * (1 - 1e-12)
    tilt = stored(of_source.select("source", "mean", "target", low.alias("low"), high.alias("high"), F.when(full, high).otherwise(0.0).alias("a")), "tilt")
    slim = classes.where("size > 0").select("source", "size", "n")
    for _ in range(rounds):
        free = F.exp(F.col("a") * x)
        taken = F.col("n") * F.col("size") * F.least(free, F.lit(float(most)))
        slope = F.when(free < most, F.col("n") * F.col("size") * x * free).otherwise(0.0)
        sums = null_safe_join(slim, tilt, ["source"]).groupBy("source").agg(F.sum(taken).alias("s"), F.sum(slope).alias("d"))
        now = null_safe_join(tilt, sums, ["source"]).withColumn("over", F.log(F.col("s") / F.col("target")))
        now = now.withColumns({
            "low": F.when(F.col("over") < 0, F.col("a")).otherwise(F.col("low")), "high": F.when(F.col("over") > 0, F.col("a")).otherwise(F.col("high")),
            "step": F.col("a") - F.try_divide(F.col("over") * F.col("s"), F.col("d")),
        })
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        a = F.when(F.abs("over") <= tolerance, F.col("a")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        tilt = stored(now.select("source", "mean", "target", "low", "high", a.alias("a"), F.abs("over").alias("gap")), "tilt")
        if tilt.agg(F.coalesce(F.max("gap"), F.lit(0.0))).first()[0] <= tolerance:
            break
    found = null_safe_join(classes, tilt.select("source", "mean", "a"), ["source"], "left")
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.col("a") * x), F.lit(float(most))))
    return found.withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("mean", "a")


def class_copies(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Copies of each class of one source, longest documents first, what rounding misses carried to the next class."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, carry, out = part.sort_values("size", ascending=False), 0.0, []
        for size, n, rate in zip(part["size"], part["n"], part["rate"], strict=True):
            want = n * min(rate, most) * size + carry
            k = 0 if size == 0 else int(min(max(round(want / size), 0), most * n))
            carry = want - k * size
            out.append(k)
        return part.assign(copies=out)[["source", "size", "n", "copies"]]

    return run


def mix_copies(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, more: Sequence[str] = ()) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, row (xxhash64 of the text), copies, and the columns ``more``.

    Size is the number of words.  Each source's target follows ``target_sizes``.
    Rates are tilted by size (``token_tilt``).  Documents of one source and size are a class: rates, rounding and their
    carries need only the classes, whose number in one source is at
    most about the root of twice its words.  Inside a class the copies are dealt evenly, one more to
    those first in order of a hash of the id; no document has more than ``most``.
    The order of classes and ids is fixed, so reruns agree.

    Null texts and ids count like any other (size 0 is never taken); a null source is a source.  Rows that
    repeat a doc_id and text are dealt like other rows of their class.  An empty table gives an empty result.
    """
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row")), "sizes"
    )
    classes = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    targets = stored(target_sizes(classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "targets")
    balanced = token_tilt(stored(null_safe_join(classes, targets, ["source"]), "classes"), most)
    kind = docs.schema["source"].dataType.simpleString()
    dealt = balanced.select("source", "size", "n", "rate").groupBy("source").applyInPandas(
        class_copies(most), f"source {kind}, size long, n long, copies long"
    )
    dealt = stored(null_safe_join(dealt, targets, ["source"]), "copies")
    order = [F.xxhash64("doc_id", "row"), F.col("doc_id"), F.col("row")]
    placed = null_safe_join(row_numbers(sized, ["source", "size"], order, "at"), dealt, ["source", "size"])
    n = F.expr("copies div n") + F.when(F.col("at") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return placed.select(
        "doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), "row", n.cast("int").alias("copies"), *more
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Documents are dealt by id, source and text.  Rows that repeat all three lie side by side in their class, so all of them
    have the same number of copies but for at most one such group a class; only those groups are numbered, by a sort
    across the cluster.  Null ids, sources and texts match each other; an empty table gives an empty result.
    """
    row, rank, low, more, copies, copy = (free_name(docs, c) for c in ("row_key", "same_no", "least_copies", "one_more", "n_copies", "copy_no"))
    key = ["doc_id", "source", row]
    taken = mix_copies(docs.select("doc_id", "text", "source"), weights, most, ["source"]).withColumnRenamed("row", row)
    taken = taken.groupBy(*key).agg(F.min("copies").alias(low), F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rank))
    taken = stored(taken.where(F.col(copies) > 0).select(*key, low, (F.col(copies) - F.col(low) * F.col(rank)).alias(more)), "taken")
    # a table of its own: its files' size tells the planner whether the documents must move for it
    uneven = stored(taken.where(F.col(more) > 0), "uneven")
    keyed = docs.withColumn(row, F.xxhash64("text"))
    even = null_safe_join(keyed, taken.where(F.col(more) == 0), key).withColumn(copies, F.col(low))
    mixed = null_safe_join(keyed, uneven, key)
    order = [F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "source", "text") and "map<" not in kind]
    mixed = row_numbers(mixed, key, order, rank).withColumn(copies, F.col(low) + F.when(F.col(rank) <= F.col(more), 1).otherwise(0))
    found = even.select(*docs.columns, copies).unionByName(mixed.select(*docs.columns, copies)).where(F.col(copies) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
