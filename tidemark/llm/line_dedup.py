"""Removal of repeated lines by overlapping windows of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts
from tidemark.operators.keyed import null_safe_join


def window_hashes(first: Column, width: int) -> Column:
    """Hash of every ``width`` consecutive entries of an array of line hashes."""
    last = F.size(first) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(first, i + k) for k in range(width)]))


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """Later occurrences of line windows: doc_id, version, line (first line of the window, from 0).

    ``docs`` has doc_id, version and text.  Lines are compared as they are.  A
    window is known by two independent 64-bit hashes of its lines.  Of the places
    (doc_id, line) of a window the first stays.
    """
    rows = F.split("text", "\n")
    hashed = docs.select(
        "doc_id", "version",
        F.transform(rows, lambda x: F.xxhash64(x)).alias("a"), F.transform(rows, lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
    )
    windows = hashed.select(
        "doc_id", "version", F.posexplode(F.arrays_zip(window_hashes(F.col("a"), width).alias("a"), window_hashes(F.col("b"), width).alias("b"))).alias("line", "w")
    ).select("doc_id", "version", "line", "w.a", "w.b")
    place = F.struct("doc_id", "line")
    common = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # stored, so that a window with a large share of all places can be split by the join
    common = stored(common.select("a", "b", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")), "windows")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line")))
    return windows.join(common, ["a", "b"]).where(other).select("doc_id", "version", "line")


def remove_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Documents without the later occurrences of repeated windows of ``width`` lines.

    A text is cut at line feeds into overlapping windows of consecutive lines.
    Where a window has occurred at an earlier place, in order of doc_id and line,
    its lines are removed; overlapping windows are merged, so a long repeated
    passage goes as a whole.  Texts with fewer lines have no window and stay.

    Columns: doc_id, n_lines, n_removed, text, one row per input row.  A null
    text is empty and has one line.  Rows that share a doc_id are versions of one
    document: a window at the same line of two of them is one place.  Nulls in
    doc_id come first in the order.  An empty table gives an empty result.
    """
    t = texts(docs).withColumn("version", F.xxhash64("text"))
    later = repeated_windows(t, width).groupBy("doc_id", "version").agg(F.collect_set("line").alias("starts"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + width - 1))))
    lines = t.select("doc_id", "version", F.split("text", "\n").alias("lines"))
    found = null_safe_join(lines, later.select("doc_id", "version", gone.alias("gone")), ["doc_id", "version"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return found.select(
        "doc_id", F.size("lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.array_join(kept, "\n").alias("text"),
    )
