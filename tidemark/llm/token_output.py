"""Token ids in files of fixed-width packed integers with block offsets."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_column, text_groups, texts
from tidemark.llm.token_counts import byte_level, encode, tokenizer

BLOCK_IDS = 4096
#: A file's rows are runs of whole documents: ids are packed block by block, each block starts on a byte.
FILE_SCHEMA = (
    "shard int, run int, first long, n_ids long, width int, block_ids int, block_offsets array<long>, payload binary, "
    "doc_ids array<{}>, doc_starts array<long>, doc_lengths array<long>"
)


def id_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, bytes]:
    """Block offsets (one more than blocks) and the packed bytes: ``width`` bits an id, lowest bit first."""
    blocks, offsets = [], [0]
    for k in range(0, len(ids), block_ids):
        part = ids[k : k + block_ids]
        if width in (8, 16, 32):  # the same bits
            packed = part.astype(f"<u{width // 8}").tobytes()
        else:
            bits = (part[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
            packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        blocks.append(packed)
        offsets.append(offsets[-1] + len(packed))
    return np.array(offsets, dtype=np.int64), b"".join(blocks)


def unpack(payload: bytes, offsets: np.ndarray, width: int, start: int, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """``n`` ids from position ``start`` on; only the blocks that hold them are touched."""
    if n == 0:
        return np.empty(0, dtype=np.uint32)
    first, last = start // block_ids, (start + n - 1) // block_ids
    raw = memoryview(payload)[offsets[first] : offsets[last + 1]]
    if width in (8, 16, 32):
        ids = np.frombuffer(raw, dtype=f"<u{width // 8}").astype(np.uint32)
    else:
        out = []
        for k in range(first, last + 1):
            bits = np.unpackbits(np.frombuffer(memoryview(payload)[offsets[k] : offsets[k + 1]], np.uint8), bitorder="little")
            bits = bits[: len(bits) // width * width].reshape(-1, width).astype(np.uint32)
            out.append((bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)[:block_ids])
        ids = np.concatenate(out)
    return ids[start - first * block_ids :][:n]


#: Bytes as the characters that a byte-level vocabulary is written in: printable ones are themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
#: Letters of the scripts whose words are one piece each; other pieces go through the whole tokenizer.
LAST_LETTER = "\u024f"


class PieceIds(dict):
    """Ids of pieces (four bytes each) as a worker meets them: words with the space before them, first words of lines.

    Emptied when it has ``most`` entries; the ids do not depend on it.
    """

    def __init__(self, name: str, most: int = 900_000):
        self.tok, self.most = tokenizer(name), most
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.line_feed = self.whole("\n")
        self.marks = {c: self.whole(c) for c in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        first, word = piece[0] == "\n", piece[1:] if piece[0] == "\n" else piece
        if word.isalpha() and max(word) <= LAST_LETTER:
            # one run of letters is one piece of the pre-tokenizer, so the model alone splits it
            named = (word if first else " " + word).encode().decode("latin-1").translate(BYTE_NAMES)
            ids = [x.id for x in self.tok.model.tokenize(named)]
            ids = struct.pack(f"<{len(ids)}I", *ids)
        elif word[-1] in self.marks and word[:-1].isalpha():  # letters end before a mark
            self[piece] = ids = self[piece[:-1]] + self.marks[word[-1]]
            return ids
        else:
            ids = self.whole(word if first else " " + word)
        self[piece] = ids = self.line_feed + ids if first else ids
        return ids


piece_ids = functools.cache(PieceIds)
#: White space other than the space and the line feed.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def irregular(text: str) -> bool:
    """Whether a text has white space that is not a lone space or line feed between other characters."""
    return (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        or any(c in text for c in OTHER_SPACE)
    )


def encode_regular(values: list[str], name: str) -> list[np.ndarray]:
    """Token ids of each text, word by word where its white space is regular.

    Before a lone space, and before and after a lone line feed, the pre-tokenizer
    of a byte-level BPE always ends a piece, so a text's ids are those of its words, each with
    the space before it; words met before are not encoded again.  Texts with other white space
    or with special strings are encoded as a whole, and so are all texts
    of a vocabulary of another kind.
    """
    if not byte_level(name):
        return [np.array([t for p in parts for t in p], dtype="<u4") for parts in encode(values, name)]
    memo, out, odd = piece_ids(name), [], []
    if len(memo) > memo.most:
        memo.clear()
    for i, x in enumerate(values):
        if x == "":
            out.append(np.empty(0, dtype="<u4"))
        elif irregular(x) or any(t in x for t in memo.special):
            odd.append(i)
            out.append(None)
        else:
            pieces = ("\n" + x.replace("\n", " \n")).split(" ")
            # without the line feed put before the first word
            out.append(np.frombuffer(b"".join(map(memo.__getitem__, pieces)), dtype="<u4")[1:])
    for i, parts in zip(odd, encode([values[i] for i in odd], name), strict=True):
        out[i] = np.array([t for p in parts for t in p], dtype="<u4")
    return out


def write_tokens(
    docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", end_id: int = 0, run_ids: int = 262_144
) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending doc_id order to ``path``.

    The files are Parquet, written by Spark's committer, so a repeated task
    leaves no second copy and any store will do.  A file is a shard (a range of
    doc_ids, ascending by shard number); its rows are runs of whole documents of
    about ``run_ids`` ids with the packed ids and where each document starts
    (counted in ids of the shard).  Ids take the bits that the vocabulary needs.
    Equal doc_ids are ordered by text, null ids come first, a null text is empty
    (only the end id).  An empty table gives files without rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        width = id_width(max(tokenizer(name).get_vocab_size(), end_id + 1))
        ids, doc_ids, size = [], [], 0
        schema = None

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            starts = first + np.cumsum(lengths) - lengths
            offsets, payload = pack(np.concatenate(ids), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([width], pa.int32()), pa.array([BLOCK_IDS], pa.int32()), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary()), pa.array([doc_ids], pa.list_(schema)), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64()))],
                names=["shard", "run", "first", "n_ids", "width", "block_ids", "block_offsets", "payload", "doc_ids", "doc_starts", "doc_lengths"],
            )

        for batch in batches:
            schema, keys, k = batch.schema.field(0).type, batch.column(0).to_pylist(), 0
            for group in text_groups(text_column(batch), 1_000_000):
                for x in encode_regular(group, name):
                    ids.append(np.append(x, np.uint32(end_id)))
                    doc_ids.append(keys[k])
                    size += len(x) + 1
                    k += 1
                    if size >= run_ids:
                        yield flush()
                        first, number = first + size, number + 1
                        ids, doc_ids, size = [], [], 0
        if ids:
            yield flush()

    t = texts(docs).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    t = t.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    t.mapInArrow(run, FILE_SCHEMA.format(kind)).write.parquet(path)


def read_runs(spark, path: str, kind: str = "bigint") -> DataFrame:
    """The rows of the files with ``base``, the number of ids in all earlier shards."""
    runs = spark.read.schema(FILE_SCHEMA.format(kind)).parquet(path)
    # one row a shard, so as many as writing tasks
    shards = runs.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return runs.join(F.broadcast(base), "shard")


def read_documents(spark, path: str, kind: str = "bigint") -> DataFrame:
    """What the files hold of each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind_of_id = batch.schema.field("doc_ids").type.value_type
            for r in batch.to_pylist():
                offsets, at = np.array(r["block_offsets"]), np.array(r["doc_starts"], dtype=np.int64) - r["first"]
                ids = unpack(r["payload"], offsets, r["width"], 0, r["n_ids"], r["block_ids"]).astype("<u4")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), r["doc_lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], kind_of_id), pa.array(at + r["first"] + r["base"]), pa.array(r["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read_runs(spark, path, kind).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_range(spark, path: str, start: int, n: int) -> np.ndarray:
    """``n`` consecutive ids of the whole output from position ``start`` on: random access by block."""
    at = F.col("base") + F.col("first")
    hit = read_runs(spark, path).where((at < start + n) & (at + F.col("n_ids") > start)).select(
        at.alias("at"), "n_ids", "width", "block_ids", "block_offsets", "payload"
    )
    out = []
    for r in sorted(hit.collect(), key=lambda r: r["at"]):
        lo, hi = max(start, r["at"]) - r["at"], min(start + n, r["at"] + r["n_ids"]) - r["at"]
        out.append(unpack(bytes(r["payload"]), np.array(r["block_offsets"]), r["width"], lo, hi - lo, r["block_ids"]))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)
