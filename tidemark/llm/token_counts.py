"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced exactly."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_column, text_groups, texts

#: Between two characters where the pre-tokenizer of a byte-level BPE ends a piece whatever stands around: before a lone
#: space after a non-space, after a line feed before a non-space, between an ASCII letter and an ASCII digit.
STABLE = re.compile(r"(?<=\S)(?= \S)|(?<=\n)(?=\S)|(?<=[A-Za-z])(?=[0-9])")


@functools.cache
def tokenizer(name: str):
    """One tokenizer a worker process; its file comes with the public vocabularies on every machine."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def byte_level(name: str) -> bool:
    """Whether the vocabulary is a byte-level BPE of the kind whose pieces STABLE knows: no normaliser, the usual pattern, no prefix space."""
    spec = json.loads(tokenizer(name).to_str())
    before = spec.get("pre_tokenizer") or {}
    return (
        spec["model"].get("type") == "BPE" and spec.get("normalizer") is None and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space", False)
    )


def spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of ``chunk`` characters and ``overlap`` more; a text that fits into one has one."""
    out, start = [], 0
    while start + chunk + overlap < n:
        out.append((start, start + chunk + overlap))
        start += chunk
    return [*out, (start, n)]


def splice(text: str, cuts: list[tuple[int, int]], encoded: list, margin: int = 0) -> list | None:
    """Token ids of the text from those of its chunks; None if two neighbours have no common stable boundary.

    The chunks meet at a place inside their overlap where both have a token
    boundary and where STABLE proves that no token crosses it: what precedes it
    is encoded in full by the first chunk, what follows by the second.  The first
    chunk goes on for ``margin`` characters, so that a special string that begins there is seen by both.
    """
    starts = [np.array([a for a, _ in e.offsets], dtype=np.int64) + lo for e, (lo, _) in zip(encoded, cuts, strict=True)]
    out, begin = [], 0
    for k, e in enumerate(encoded[:-1]):
        lo, hi = cuts[k + 1][0] + 1, cuts[k][1] - 1 - margin
        both = set(starts[k].tolist()).intersection(starts[k + 1].tolist())
        at = next((m.start() for m in STABLE.finditer(text, lo, hi) if m.start() in both), None) if lo < hi else None
        if at is None:
            return None
        i, j = np.searchsorted(starts[k], (begin, at))
        out.append(e.ids[i:j])
        begin = at
    out.append(encoded[-1].ids[np.searchsorted(starts[-1], begin) :])
    return out


def encode(values: list[str], name: str, chunk: int = 16_384, overlap: int = 128) -> list[list[list[int]]]:
    """Token ids of each text, as a list of parts in order.

    Texts over ``chunk + overlap`` characters are encoded in overlapping chunks; where a splice fails, the text is
    encoded anew with twice the overlap, in the end as one chunk.  Texts of a vocabulary that is not a byte-level BPE are
    encoded whole, as nothing is proven of its pieces.
    """
    tok, out = tokenizer(name), [None] * len(values)
    if not byte_level(name):
        return [[e.ids] for e in tok.encode_batch(values, add_special_tokens=False)]
    margin = max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)
    todo = {i: overlap for i in range(len(values))}
    while todo:
        cuts = {i: spans(len(values[i]), chunk, o) for i, o in todo.items()}
        pieces = tok.encode_batch([values[i][a:b] for i, c in cuts.items() for a, b in c], add_special_tokens=False)
        k = 0
        for i, c in cuts.items():
            mine = pieces[k : k + len(c)]
            k += len(c)
            out[i] = [mine[0].ids] if len(c) == 1 else splice(values[i], c, mine, margin)
        todo = {i: todo[i] * 2 for i in todo if out[i] is None}
    return out


def count_tokens(
    docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = 16_384, overlap: int = 128
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per input row.

    The counts are those that the library gives for the whole text, without added
    special tokens; special strings inside texts are handled as its default.  A
    null text is empty and has none.  Nothing is shuffled; a task holds the
    encodings of half a megabyte of texts at a time, and those of a longer text
    chunk by chunk.  Repeated rows are counted each, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for group in text_groups(text_column(batch), 500_000):
                n += [sum(map(len, parts)) for parts in encode(group, name, chunk, overlap)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    t = texts(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
