"""SimHash near-duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, stored, text_column, texts
from tidemark.llm.components import components


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text, A-Z lower-cased, from the XXH64 of its word shingles, repeats included."""
    import xxhash

    w = text.encode().lower().split()  # bytes: exactly A-Z and the six ASCII white-space characters
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def text_key(text: Column) -> Column:
    """Tells apart the texts of one id; null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (the text's key) and fp (the fingerprint as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or "") for x in text_column(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], names=["doc_id", "row", "fp"])

    keyed = texts(docs, text_key(F.col("text")).alias("row"))
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp long")


def parts_code(counts: list) -> Column:
    code = F.lit(0)
    for c in counts:
        code = code * 32 + c
    return code


def population(fp: Column, parts: int = 4) -> list[Column]:
    """Bits set in each equal part of the fingerprint."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(mask)) for k in range(parts)]


def near_steps(radius: int, parts: int = 4) -> list[tuple[int, ...]]:
    """Differences of population counts that fingerprints within ``radius`` bits can have, one of each pair of opposites."""
    steps = product(range(-radius, radius + 1), repeat=parts)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * parts]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes 0 to n - 1 reduced to one link from each node to the smallest of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two tiles that differ in at most ``radius`` bits, every one compared with every one.

    More links than fingerprints are reduced to as many as keep the components.
    """
    rows, cols = [], []
    for k in range(0, len(a), 256):
        near = np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        rows.append(i + k)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    every = a if same else np.concatenate([a, b])
    node, root = forest(i, j if same else j + len(a), len(every))
    return every[node], every[root]


def tiles(distinct: DataFrame, size: int, parts: int) -> DataFrame:
    """Distinct fingerprints (fp) in tiles of about ``size``: cell (population counts of the parts), tile, fps."""
    d = stored(distinct.withColumn("cell", parts_code(population(F.col("fp"), parts))), "distinct")
    # at most 17^4 cells, whatever the number of fingerprints
    many = d.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / size).cast("int").alias("n_tiles"))
    dealt = d.join(F.broadcast(many), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int"))
    return dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))


def close_pairs(distinct: DataFrame, radius: int = 3, size: int = 2048, parts: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints within ``radius`` bits, enough of them to keep every component.

    Fingerprints are dealt into tiles by the population counts of their four
    16-bit parts.  Counts that differ by more than ``radius`` in all prove more
    differing bits, so such tile pairs are skipped; all others are compared
    exactly.  Tiles have a limited size, so no cell is compared in one task.
    """
    t = stored(tiles(distinct, size, parts), "tiles")
    cells = t.select("cell").distinct()
    steps = F.array(*[F.lit(sum(d * 32 ** (parts - 1 - k) for k, d in enumerate(s))) for s in near_steps(radius, parts)])
    # a step may run over a part's range into a cell that is not near; such pairs are compared in vain, never missed
    near = cells.select("cell", F.explode(steps).alias("step")).select("cell", (F.col("cell") + F.col("step")).alias("other"))
    near = near.join(cells.select(F.col("cell").alias("other")), "other")
    right = t.select(F.col("cell").alias("other"), F.col("tile").alias("tile_b"), F.col("fps").alias("b"))
    pairs = t.withColumnRenamed("fps", "a").join(near, "cell").join(right, "other")
    pairs = pairs.where((F.col("cell") != F.col("other")) | (F.col("tile") <= F.col("tile_b")))
    pairs = pairs.select("a", "b", ((F.col("cell") == F.col("other")) & (F.col("tile") == F.col("tile_b"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, out = batch.column(0), batch.column(1), []
            lv, rv = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            for k, same in enumerate(batch.column(2).to_pylist()):
                out.append(tile_links(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], same, radius))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 2048) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked: doc_id, fingerprint, component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable over links.  Documents with one fingerprint are one
    node from the start, so copies are never paired.  Comparisons of tiles grow
    with the square of the distinct fingerprints, less what population counts rule out.

    A null or empty text has fingerprint zero and links like any other; a text of
    one or two words is one shingle.  Repeated rows give repeated rows.  Null ids
    are ignored when the smallest is chosen; a group of only null ids has none.
    An empty table gives an empty result.
    """
    return grouped(docs, radius, size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, radius: int = 3, size: int = 2048) -> DataFrame:
    """doc_id, row (the text's key), fp, component_id and root (a fingerprint that names the group), one row per input row."""
    f = stored(fingerprints(docs), "fingerprints")
    first = stored(f.groupBy("fp").agg(F.min("doc_id").alias("first")), "by-fingerprint")
    group = components(close_pairs(first.select("fp"), radius, size))
    linked = first.join(group, first["fp"] == group["node"]).select("fp", "first", "root")
    smallest = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    of_fp = first.join(
        stored(linked.join(smallest, "root").select("fp", "root", "component_id"), "linked"), "fp", "left"
    ).select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return f.join(stored(of_fp, "members"), "fp").select("doc_id", "row", "fp", "component_id", "root")


def first_of_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each group, with all its columns: the smallest doc_id, null last, and of its texts the one with the smallest key.

    Of rows that repeat the kept id and text one stays; which one is open where they differ in other columns.  A group of
    only null ids keeps one row.  Null and empty texts are one group with all that is near fingerprint zero.

    Only ids and keys of texts are joined to the documents; documents themselves are moved where their id and text repeat,
    reduced to one row a task first.
    """
    id_, none, key = (free_name(docs, c) for c in ("id_key", "id_is_null", "row_key"))
    on = [id_, none, key]
    # keys without nulls, so that plain joins match them
    found = grouped(docs.select("doc_id", "text"), radius).select(
        "root", F.isnull("doc_id").alias(none), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("row").alias(key)
    )
    same = stored(found.groupBy("root", *on).agg(F.count(F.lit(1)).alias("n")), "same-rows")
    kept = same.groupBy("root").agg(F.min(F.struct(none, id_, key)).alias("kept"))
    this = (F.col(none) == F.col("kept")[none]) & (F.col(id_) == F.col("kept")[id_]) & (F.col(key) == F.col("kept")[key])
    fate = F.when(~this, "gone").when(F.col("n") > 1, "repeated")
    # tables of their own: their files' size tells the planner whether the documents must move at all
    marked = stored(same.join(kept, "root").select(*on, fate.alias("fate")).where("fate IS NOT NULL"), "fates")
    several = stored(marked.where("fate = 'repeated'").select(*on), "repeated")
    keyed = docs.withColumns({none: F.isnull("doc_id"), id_: F.coalesce("doc_id", F.lit(0)), key: text_key(F.col("text"))})
    single = keyed.join(marked, on, "left_anti")
    repeated = keyed.join(several, on, "left_semi").dropDuplicates(on)
    return single.unionByName(repeated).select(*docs.columns)
