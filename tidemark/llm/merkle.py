"""Merkle manifest of a dataset: leaves, roots and membership proofs by pivoting children into slots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.operators.keyed import row_numbers

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings; missing ones add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: its length in UTF-8 bytes and itself, so that neighbouring values cannot run together."""
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def stepped_up(members: Column, left: Column, right: Column) -> Column:
    """Members of a child with one step more: the siblings on both sides of the child."""
    step = F.struct(left.alias("left"), right.alias("right"))
    return F.transform(members, lambda m: F.struct(m["item"].alias("item"), F.array_append(m["path"], step).alias("path")))


def block_rows(nodes: DataFrame, fanout: int, levels: int, members: bool) -> DataFrame:
    """``levels`` levels of every tree worked out block by block: tree, block, n (nodes left in the tree), digest.

    ``nodes`` has tree, pos, n (nodes of the tree at this level), digest and item.  A block is the nodes under one node
    ``levels`` higher up, so rows are dealt once by (tree, block) and all levels run in the same tasks.  Each level groups
    by parent; conditional aggregates spread the children into one column per slot.  The slots in order hash to the
    parent, the slots but the own one are a child's siblings.  A tree of one node is not hashed again.  With ``members``
    a row also has all its nodes' items with their path in the block, bottom up: at most fanout ** levels.
    """
    n, slots = F.col("n"), range(fanout)
    start = [F.array(F.struct("item", F.array().cast(STEP).alias("path"))).alias("members")] if members else []
    df = nodes.select("tree", F.expr(f"pos div {fanout**levels}").alias("block"), "pos", "n", "digest", *start).repartition("tree", "block")
    for level in range(levels):
        slot = F.col("pos") % fanout
        spread = [F.max(F.when(slot == k, F.col("digest"))).alias(f"s{k}") for k in slots]
        spread += [F.first(F.when(slot == k, F.col("members")), ignorenulls=True).alias(f"m{k}") for k in slots if members]
        df = df.groupBy("tree", "block", "n", F.expr(f"pos div {fanout}").alias("up")).agg(*spread)
        hashed = n > fanout**level
        children = [F.col(f"s{k}") for k in slots]
        out = [F.when(hashed, digest(*children)).otherwise(F.col("s0")).alias("digest")]
        if members:
            stepped = [
                stepped_up(F.col(f"m{k}"), F.concat_ws("", F.lit(""), *children[:k]), F.concat_ws("", F.lit(""), *children[k + 1 :])) for k in slots
            ]
            every = F.flatten(F.array_compact(F.array(*stepped)))
            out.append(F.when(hashed, every).otherwise(F.col("m0")).alias("members"))
        df = df.select("tree", "block", "n", F.col("up").alias("pos"), *out)
    size = fanout**levels
    return df.select("tree", "block", F.expr(f"(n + {size - 1}) div {size}").alias("n"), "digest", *(["members"] if members else []))


def proofs(nodes: DataFrame, most: int, fanout: int, levels: int, beyond: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The way up of every node: tree, item, path (siblings left and right at each level, bottom up), subroot, top.

    ``most`` is the largest tree's number of nodes.  Blocks of at most ``levels`` levels are reduced to their digests, these are
    the nodes of the next pass, and the path of a block is joined to the block, not to its nodes.  Passes are log(most) /
    log(fanout ** levels).  ``beyond`` gives the way from the trees' tops (tree, digest) further up: tree, path, top.
    """
    deep = 1
    while deep < levels and fanout**deep < most:
        deep += 1
    size = fanout**deep
    over = stored(block_rows(nodes, fanout, deep, False), "merkle-level")
    if most > size:
        up = proofs(over.select("tree", F.col("block").alias("pos"), "n", "digest", F.col("block").alias("item")), -(-most // size), fanout, levels, beyond)
        up = up.withColumnRenamed("item", "block")
    elif beyond is None:
        up = over.select("tree", "block", F.array().cast(STEP).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("top"))
    else:
        up = over.join(beyond(over.select("tree", "digest")), "tree").select("tree", "block", "path", F.col("digest").alias("subroot"), "top")
    up = stored(up, "merkle-paths").withColumnRenamed("path", "above")
    rows = block_rows(nodes, fanout, deep, True).join(up, ["tree", "block"])
    rows = rows.select("tree", F.explode("members").alias("m"), "above", "subroot", "top")
    return rows.select("tree", "m.item", F.concat("m.path", "above").alias("path"), "subroot", "top")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def with_proofs(leaves: DataFrame, tree: str, order: list[Column], fanout: int = 2, levels: int = 5) -> DataFrame:
    """Rows of ``leaves`` (with a column leaf) as item, with path, subroot of their tree and root of all trees' subroots.

    Trees are ordered by the non-null string column ``tree``, leaves of a tree by ``order``.  Positions are exact however
    large a tree is: rows are sorted across the cluster and numbered part by part.
    """
    kept = [c for c in leaves.columns if c != tree]
    at = row_numbers(leaves.withColumnRenamed(tree, "tree"), ["tree"], order, "pos")
    sizes = stored(at.groupBy("tree").agg(F.max("pos").alias("n")), "merkle-sizes")
    nodes = at.join(sizes, "tree").select("tree", (F.col("pos") - 1).alias("pos"), "n", F.col("leaf").alias("digest"), F.struct(*kept).alias("item"))
    n_trees, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()

    def over_trees(tops: DataFrame) -> DataFrame:
        at = row_numbers(tops.withColumn("one", F.lit("")), ["one"], [F.col("tree")], "pos")
        at = at.select(F.col("one").alias("tree"), (F.col("pos") - 1).alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest", F.col("tree").alias("item"))
        return proofs(at, n_trees, fanout, levels).select(F.col("item").alias("tree"), "path", "top")

    return proofs(nodes, most, fanout, levels, over_trees).select("item", "path", "subroot", F.col("top").alias("root"))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = 2, levels: int = 5) -> DataFrame:
    """Manifest and proof check of every document.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each with its length before it (null: ``-``).  Leaves
    of a language ascend by doc_id and are reduced ``fanout`` at a time to the subroot; subroots ascend by language (null
    first, by UTF-8 bytes) and are reduced in the same way to the root.  The proof of a document is the list of its siblings on the
    way to the root.  Where ``tampered`` holds, the document is checked as if n_chars were one larger.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (of the siblings, bottom up, left to right), folded_root (what the
    possibly tampered leaf and the siblings lead to), verified (folded_root is the root), one row per input row.

    Nulls of any column are values of their own; a null n_chars cannot be tampered with.  A null doc_id comes before all
    others; rows that share a doc_id are ordered by their leaf, and rows equal in all five columns are leaves of their own.
    One document alone has itself as root and no siblings.  An empty table gives no rows.
    """
    changed = leaf_digest(n_chars=F.col("n_chars") + 1)
    wrong = F.lit(False) if tampered is None else tampered
    # texts are read and hashed once; from here on rows hold digests only
    leaves = stored(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), leaf_digest().alias("leaf"),
        F.when(wrong & F.col("n_chars").isNotNull(), changed).alias("tampered"),
    ), "leaves")
    rows = with_proofs(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], fanout, levels)
    rows = rows.select("item.*", "path", "subroot", "root")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
