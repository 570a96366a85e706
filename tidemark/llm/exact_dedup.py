"""Exact deduplication by recipes of content-defined chunks (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, stored, texts

#: Where a chunk may end, over the bytes of UTF-8 as pairs of hexadecimal digits: after six ASCII characters, or three characters of
#: two or of three bytes, whose last digits are all 0, 5 or A.  In text of any script that is one place in some hundreds of bytes.
ENDS = r"(?:(?:[2-7][05A]){6}|(?:[CD].[89AB][05A]){3}|(?:E.[89AB].[89AB][05A]){3})"
#: A chunk has about 768 to 8,192 bytes; a text without such a place is cut before byte 8,192, where a character ends (the digits 8, 9,
#: A and B go on with one).  What is left at the end is a chunk of its own.
CHUNK = r"(?:..){760,8180}?" + ENDS + r"|(?:..){1,8192}(?![89AB])"


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The text cut into consecutive chunks whose ends depend on its bytes alone; an empty text has none."""
    parts = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(pattern), F.lit(0))
    return F.transform(parts, lambda c: F.decode(F.unhex(c), "UTF-8"))


def clashing_digests(docs: DataFrame, text: str, digest: Callable[[Column], Column], pattern: str) -> DataFrame:
    """Chunks reduced to distinct texts; one row with the digests that stand for more than one text."""
    part = docs.select(F.explode(chunks(F.col(text), pattern)).alias("chunk"))
    distinct = part.select(digest(F.col("chunk")).alias("digest"), "chunk").groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashes = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return clashes.agg(F.collect_set("digest").alias("digests"))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = F.md5, pattern: str = CHUNK) -> DataFrame:
    """Which document of each group of equal texts stays.

    Texts are compared after lower-casing A-Z only.  Each text becomes a recipe,
    the ordered list of its chunks' identifiers.  An identifier is the digest of
    the chunk, proven to stand for one text: all chunks are grouped by digest and
    text, and where a digest has two texts (none is known for MD5 without intent)
    the chunk's text is appended to it.  Equal recipes are then equal texts, and
    only recipes move when documents are compared and joined to their group.

    Columns: doc_id, keep_id (largest doc_id of the group), group_size (rows),
    kept, text_sha256 (of the lower-cased text), one row per input row.
    A null text is an empty one, and all empty texts are one group.  Rows that
    repeat a doc_id with the same text are the same document: each is counted and
    has the same decision.  A null doc_id is smaller than any other; a group of
    only null ids keeps them.  An empty table gives an empty result.
    """
    t = texts(docs).select("doc_id", lower_ascii(F.col("text")).alias("text"))
    bad = clashing_digests(t, "text", digest, pattern).scalar()

    def exact(c: Column) -> Column:
        return F.when(F.array_contains("bad", digest(c)), F.concat(digest(c), F.lit(":"), F.length(c), F.lit(":"), c)).otherwise(digest(c))

    part = chunks(F.col("text"), pattern)
    ids = F.when(F.size("bad") == 0, F.transform(part, digest)).otherwise(F.transform(part, exact))
    slim = stored(
        t.withColumn("bad", bad).select("doc_id", F.array_join(ids, ",").alias("recipe"), F.sha2("text", 256).alias("text_sha256")), "recipes"
    )
    groups = slim.groupBy("recipe").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = slim.join(stored(groups, "groups"), "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
