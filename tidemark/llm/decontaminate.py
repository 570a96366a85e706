"""Benchmark decontamination: MinHash containment search by item size, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import text_column, text_groups, texts

#: Size classes hold items of more than half and at most so many shingles; each further class is twice as large.
#: Items of at most half the smallest in distinct shingles are searched with windows of one shingle.
LEAST = 16
#: Items of which at most this share of the shingles is distinct are searched by all of their hashes, like the smallest.
DISTINCT = 0.9
PERMUTATIONS = 64
FILTER_BITS = 16


def multipliers(n: int) -> np.ndarray:
    """Odd numbers: multiplying a 64-bit hash by one of them is a permutation."""
    return np.random.default_rng(5).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slot(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def filter_of(x: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    out[slot(x)] = True
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of ``k`` words; a shorter text is one shingle, an empty one has none."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))


def hashes(grams: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh64_intdigest, grams)), dtype=np.uint64)


class Items(NamedTuple):
    """A block of test items as the search holds it."""

    ids: list
    grams: list[frozenset]
    hashed: list[np.ndarray]  # distinct shingle hashes of each item
    tiny: tuple[np.ndarray, np.ndarray]  # all hashes of the items under the smallest class or with many repeats, and whose they are
    classes: dict[int, tuple[np.ndarray, np.ndarray]]  # by size: items, signatures (a row a permutation)


def prepare(rows: list[tuple], k: int, permutations: int) -> Items:
    kept = [(i, g) for i, t in rows if (g := shingles(words_of(t or ""), k))]
    hashed = [np.unique(hashes(g)) for _, g in kept]
    by_size: dict[int, list[int]] = {}
    tiny = []
    for n, (_, g) in enumerate(kept):
        if len(hashed[n]) <= max(LEAST // 2, DISTINCT * len(g)):
            tiny.append(n)
        else:
            by_size.setdefault(max(LEAST, 1 << (len(g) - 1).bit_length()), []).append(n)
    a = multipliers(permutations)[:, None]
    classes = {s: (np.array(m), np.stack([(hashed[n] * a).min(axis=1) for n in m], axis=1)) for s, m in sorted(by_size.items())}
    whose = np.repeat(np.array(tiny, dtype=np.int64), [len(hashed[n]) for n in tiny])
    flat = np.concatenate([hashed[n] for n in tiny]) if tiny else np.empty(0, dtype=np.uint64)
    return Items([i for i, _ in kept], [frozenset(g) for _, g in kept], hashed, (flat, whose), classes)


def cuts(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``step`` inside consecutive stretches of ``counts``, and how many each stretch has."""
    many = -(-counts // step)
    first = np.cumsum(counts) - counts
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(first, many) + inside * step, many


def matches(values: np.ndarray, doc: np.ndarray, keys: np.ndarray, whose: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) where a document's value is a key of the item."""
    near = np.flatnonzero(filter_of(keys)[slot(values)])
    if not len(near):
        return set()
    order = np.argsort(keys, kind="stable")
    sorted_keys, out = keys[order], set()
    lo, hi = np.searchsorted(sorted_keys, values[near], "left"), np.searchsorted(sorted_keys, values[near], "right")
    for d, a, b in zip(doc[near[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
        out.update((d, n) for n in whose[order[a:b]].tolist())
    return out


def candidates(h: np.ndarray, counts: np.ndarray, items: Items, permutations: int) -> set[tuple[int, int]]:
    """(document, item) that share a MinHash value in a window of the item's size class.

    ``h`` has the shingle hashes of several documents, ``counts`` how many each
    has (none has zero).  A document is cut into windows of twice the class size that overlap
    by half, so a passage of an item's length lies whole in one.  A window is less than four times the
    item, so that containment of 0.8 of distinct shingles is a Jaccard similarity of 0.19 or more: with
    64 bands of one row about one such passage in a million is missed.  An item down to nine tenths of distinct
    shingles keeps 0.17, about six in a million; one with more repeats is a candidate wherever any of its shingles is.
    """
    out = matches(h, np.repeat(np.arange(len(counts)), counts), *items.tiny) if len(items.tiny[0]) else set()
    if not items.classes:
        return out
    at, many = cuts(counts, LEAST)
    low = np.stack([np.minimum.reduceat(h * a, at) for a in multipliers(permutations)])
    size, most = LEAST, max(items.classes)
    while True:
        if size in items.classes:
            members, signatures = items.classes[size]
            after = np.arange(1, low.shape[1] + 1)
            after[np.cumsum(many) - 1] -= 1  # a document's last block has no further one
            window = np.minimum(low, low[:, after])
            doc = np.repeat(np.arange(len(many)), many)
            for p in range(permutations):
                out |= matches(window[p], doc, signatures[p], members)
        if size >= most:
            return out
        at, many = cuts(many, 2)
        low = np.minimum.reduceat(low, at, axis=1)
        size *= 2


def contained(group: list[str], items: Items, k: int, least: float, permutations: int) -> list[tuple]:
    """Items of which a text has at least ``least`` of the distinct shingles: index of the text, id, shingles found, shingles."""
    every = [shingles(words_of(x), k) for x in group]
    index = [i for i, g in enumerate(every) if g]
    grams = [every[i] for i in index]
    if not grams or not items.ids:
        return []
    counts = np.array([len(g) for g in grams])
    h = hashes([g for part in grams for g in part])
    ends, found = np.cumsum(counts), []
    for d, n in sorted(candidates(h, counts, items, permutations)):
        at = np.flatnonzero(np.isin(h[ends[d] - counts[d] : ends[d]], items.hashed[n]))
        same = len(items.grams[n].intersection(grams[d][i] for i in at.tolist()))
        if same >= least * len(items.grams[n]):
            found.append((index[d], items.ids[n], same, len(items.grams[n])))
    return found


def find_leaks(
    docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, block_items: int = 20_000, block_chars: int = 20_000_000,
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Test items found inside documents: doc_id, item_id, n_found, n_shingles, one row per pair.

    A document contains an item if it holds at least ``least`` of the item's
    distinct shingles of five words (A-Z lower-cased, white space as one space).
    Texts of fewer words are one shingle, as a whole; empty and null texts contain and match nothing.

    Items (item_id, text) are the stated query set: they are taken in blocks of about ``block_items`` and
    ``block_chars``, each sent to the tasks and searched in one pass over all documents, which are not shuffled.  Inside a task items are
    searched by size class, by MinHash signatures of the document's windows; every candidate
    is verified on the shingles themselves over the whole document.  Repeated documents give repeated rows, repeated
    items (equal ids) a row each; empty tables give an empty result.
    """
    kinds = [docs.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, n_found int, n_shingles int"
    arrow = [*map(to_arrow_type, kinds), pa.int32(), pa.int32()]
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in item_blocks(items, block_items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            ready = prepare(rows.value, words, permutations)
            for batch in batches:
                ids, base = batch.column(0).to_pylist(), 0
                for group in text_groups(text_column(batch), 500_000):
                    got = [(ids[base + i], *f) for i, *f in contained(group, ready, words, least, permutations)]
                    base += len(group)
                    cols = list(zip(*got, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names=["doc_id", "item_id", "n_found", "n_shingles"])

        out = out.union(texts(docs).mapInArrow(run, schema))
    return out


def item_blocks(items: DataFrame, block_items: int = 20_000, block_chars: int = 20_000_000) -> Iterator[Broadcast]:
    """The items in blocks of about so many rows and characters, one at a time on the driver."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_chars))
    named = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        rows = named.where(F.col("block") == block).select("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def clean_documents(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, permutations: int = PERMUTATIONS) -> DataFrame:
    """Documents that contain no test item, with all their columns; nothing is shuffled."""
    for rows in item_blocks(items):
        docs = docs.where(holds_none(rows, words, least, permutations)("text"))
    return docs


def holds_none(rows: Broadcast, words: int, least: float, permutations: int):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = prepare(rows.value, words, permutations)
        for batch in batches:
            out = []
            for group in text_groups(batch, 500_000):
                bad = {i for i, *_ in contained(group, ready, words, least, permutations)}
                out += [i not in bad for i in range(len(group))]
            yield pd.Series(out, dtype="bool")

    return clean
