"""WARC archives in Zstandard: one frame per record behind a dictionary, written and read back with every length checked."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Fixed values of the file formats.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
#: A skippable frame without content; it stands between records, where Spark's text writer ends a line.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
FIELD_NAME = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"

RECORD_SCHEMA = (
    "archive string, offset long, type string, record_id string, uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, error string"
)


class Broken(Exception):
    """A frame or record that does not hold what its headers say."""


# --- writing --------------------------------------------------------------------------------


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(kind: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode()]
    head += [f"{name}: {value}".encode() for name, value in fields.items() if value is not None]
    return b"\r\n".join([*head, f"Content-Length: {len(block)}".encode(), b"", block, b"", b""])


def page_uri(page_id) -> str:
    return f"<{ID_PREFIX}{'' if page_id is None else quote(str(page_id), safe='')}>"


def page_record(page_id, url: str | None, html: str | None, sha1: str, n_bytes: int, refers_to, revisit: bool, date: str) -> bytes:
    """A response record with the page behind its HTTP header, or a revisit record with the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return warc_record("revisit" if revisit else "response", block if revisit else block + (html or "").encode(), {
        "WARC-Record-ID": page_uri(page_id), "WARC-Date": date, "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(sha1)}", "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": page_uri(refers_to) if revisit else None, "Content-Type": "application/http; msgtype=response",
    })


def trained(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; None where they are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


def archive_frames(records: Iterator[bytes], dictionary_bytes: int, sample_bytes: int, level: int) -> Iterator[bytes]:
    """The frames of one archive: the dictionary in a skippable frame, then a frame per record."""
    sample, size = [], 0
    for record in records:
        sample.append(record)
        size += len(record)
        if size >= sample_bytes:
            break
    if not sample:
        return
    learned = trained([x[:65_536] for x in sample], dictionary_bytes)
    if learned:
        data = learned.as_bytes()
        yield DICTIONARY_MAGIC + struct.pack("<I", len(data)) + data
    packer = zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=True, write_content_size=True)
    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    yield packer.compress(warc_record("warcinfo", info, {"WARC-Record-ID": "<urn:archive>", "Content-Type": "application/warc-fields"}))
    for record in chain(sample, records):
        yield packer.compress(record)


def resolved_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (only of responses), sha1, n_bytes, refers_to, revisit of each page.

    Ids and digests alone find the page that stands for equal payloads; texts then leave out the revisits by an anti join
    on id and digest, so copies do not gather, and move once at most.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    slim = stored(p.select("page_id", "url", "digest", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("n_bytes")), "payloads")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "payload-groups")
    again = slim.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = stored(again, "revisits")
    gone = again.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone")).distinct()
    first = p.join(gone, p["page_id"].eqNullSafe(F.col("gone_id")) & (p["digest"] == F.col("gone")), "left_anti")
    nobody = F.lit(None).cast(pages.schema["page_id"].dataType)
    first = first.select(
        "page_id", "url", "html", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("n_bytes"), nobody.alias("refers_to"), F.lit(False).alias("revisit")
    )
    return first.unionByName(again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "n_bytes", "refers_to", F.lit(True).alias("revisit")))


def write_pages(
    pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", dictionary_bytes: int = 32_768, sample_bytes: int = 2_000_000, level: int = 3
) -> None:
    """Write a WARC record per row of ``pages`` (page_id, url, html) to Zstandard archives in the folder ``path``.

    A task writes one archive through Spark's text writer and committer, so a repeated task leaves no second copy and any
    store will do.  An archive begins with the dictionary, learned from its first ``sample_bytes`` of records (none where
    these are too few), and a warcinfo record; every record is a frame of its own with content size and checksum.

    Of pages with equal payloads (compared by SHA-256) the largest page_id is a response record, the others are revisit
    records of it, without the payload.  A null html is an empty payload, and empty payloads are equal too; a null url has
    no target field.  A null page_id is smaller than any other; a group of only null ids are all responses, as are rows that
    repeat the largest page_id with its payload.  An empty table gives a folder without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                        yield page_record(*row, date)

        held, size = [], 0
        for frame in archive_frames(records(), dictionary_bytes, sample_bytes, level):
            held.append(frame)
            size += len(frame)
            if size >= 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    frames = resolved_records(pages).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


# --- reading --------------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and its blocks' sizes alone."""
    if len(data) - at < 8:
        raise Broken("cut off inside a frame header")
    if data[at + 1 : at + 4] == DICTIONARY_MAGIC[1:] and 0x50 <= data[at] <= 0x5F:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    else:
        if data[at : at + 4] != FRAME_MAGIC:
            raise Broken("no frame starts here")
        head = bytes(data[at : at + 18])
        end, last = at + zstandard.frame_header_size(head), False
        while not last:
            if end + 3 > len(data):
                raise Broken("cut off inside a frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise Broken("reserved block type")
            end += 3 + (1 if kind == 1 else size)  # type 1 repeats one byte
        end += 4 if zstandard.get_frame_parameters(head).has_checksum else 0
    if end > len(data):
        raise Broken("cut off inside a frame")
    return end


def leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The archive's dictionary, plain or compressed itself, and where its frames begin."""
    if data[:4] != DICTIONARY_MAGIC:
        return None, 0
    end = frame_end(data, 0)
    raw = bytes(data[8:end])
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), end


class Record(NamedTuple):
    type: str
    record_id: str | None
    uri: str | None
    refers_to: str | None
    payload_digest: str | None
    payload_bytes: int | None
    payload: bytes | None


def split_fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(FIELD_NAME, name):
            raise Broken(f"no header line: {line[:60]!r}")
        out.setdefault(name.lower(), value.strip())
    return out


def counted(fields: dict[str, str], where: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise Broken(f"{where} has no Content-Length")
    return int(value)


def parse_record(data: bytes) -> Record:
    """One record with all headers, lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise Broken("no WARC header")
    fields = split_fields(lines)
    kind, size = fields.get("warc-type", ""), counted(fields, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken(f"block of {max(len(rest) - 4, 0)} bytes where {size} are declared")
    where = [fields.get(x) for x in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
    if not kind or not where[0]:
        raise Broken("type or record id is missing")
    if kind not in ("response", "revisit"):
        return Record(kind, *where, fields.get("warc-payload-digest"), size, rest[:size])
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise Broken("no HTTP header")
    n, (name, _, value) = counted(split_fields(lines), "HTTP header"), fields.get("warc-payload-digest", "").partition(":")
    if name != "sha1" or not re.fullmatch("[A-Z2-7]{32}", value):
        raise Broken("no SHA-1 payload digest")
    if kind == "revisit":
        if payload or not where[2]:
            raise Broken("revisit with a payload or without the record it refers to")
        return Record(kind, *where, value, n, None)
    if len(payload) != n:
        raise Broken(f"payload of {len(payload)} bytes where {n} are declared")
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != value:
        raise Broken("payload does not have its digest")
    return Record(kind, *where, value, n, payload)


def archive_records(content: bytes) -> Iterator[tuple[int, Record | None, str | None]]:
    """(offset, record, error) of each frame of an archive, in order.

    A record that fails a check is an error row and reading goes on at the next frame; where no frame can be made out any
    more, one error row stands for the rest of the archive.  Skippable frames after the first are passed over.
    """
    data, at = memoryview(content), 0
    try:
        words, at = leading_dictionary(data)
        unpacker = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
        while at < len(data):
            end = frame_end(data, at)
            if data[at : at + 4] == FRAME_MAGIC:
                try:
                    frame = bytes(data[at:end])
                    about = zstandard.get_frame_parameters(frame)
                    if about.dict_id and about.dict_id != (words.dict_id() if words else 0):
                        raise Broken(f"needs dictionary {about.dict_id}")
                    # without a declared size the frame is unpacked as a stream; a false size fails
                    known = about.content_size != zstandard.CONTENTSIZE_UNKNOWN
                    yield at, parse_record(unpacker.decompress(frame) if known else unpacker.decompressobj().decompress(frame)), None
                except (Broken, zstandard.ZstdError, UnicodeDecodeError) as wrong:
                    yield at, None, str(wrong)
            at = end
    except (Broken, zstandard.ZstdError) as wrong:
        yield at, None, f"rest of the archive: {wrong}"


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of archives given as rows (path, content), as Spark's binaryFile source reads them.

    Columns: archive, offset, type, record_id, uri, refers_to, payload_digest (SHA-1 in base 32), payload_bytes (of the full
    payload, for revisits too), payload (null unless ``payloads``, and for revisits), error.  A row with an error has only
    archive, offset and error; see ``archive_records``.  An empty or null content has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
        ])
        nothing = Record(None, None, None, None, None, None, None)  # type: ignore[arg-type]
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                rows, size = [], 0
                for offset, record, error in archive_records(content):
                    r = record or nothing
                    rows.append((path, offset, *r[:-1], r.payload if payloads else None, error))
                    size += 200 + len(rows[-1][-2] or b"")
                    if size >= 1_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return archives.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def read_folder(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    return read_records(spark.read.format("binaryFile").load(path), payloads)


def read_pages(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """What the archives of ``write_pages`` hold of each page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``kind`` is the type of page_id.  A record that fails a check ends the job, so a result is whole or none.
    """

    def named(uri: str) -> Column:
        return F.nullif(F.url_decode(F.regexp_extract(uri, f"^<{ID_PREFIX}(.*)>$", 1)), F.lit("")).cast(kind)

    found = read_folder(spark, path)
    failed = F.concat(F.col("archive"), F.lit(" at "), F.col("offset"), F.lit(": "), F.col("error"))
    kept = found.where(F.when(F.col("error").isNotNull(), F.raise_error(failed).cast("boolean")).otherwise(F.col("type").isin("response", "revisit")))
    return kept.select(
        named("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), named("refers_to").alias("refers_to")
    )
