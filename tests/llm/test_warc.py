"""WARC archives: exact round trip, dictionaries, and damage that must be found."""

import base64
import hashlib
import struct

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm.common import shared_path

PAGES = [(i, f"http://h{i % 5}.example.com/{i}?a=b cé\n", f"<html><p>{'page ' * (i % 40)}{i % 30}</p>你</html>") for i in range(200)] + [
    (500, None, None), (501, "x", ""), (502, "x", "only once"), (502, "x", "only once"), (None, "n", "only once"), (None, "n", "nobody"), (None, None, "nobody"),
    (503, "long", "many words " * 300_000), (504, "long", "many words " * 300_000),
]


def digest(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def expected(rows):
    groups = {}
    for i, _, x in rows:
        groups.setdefault(x or "", []).append(i)
    last = {x: max((i for i in g if i is not None), default=None) for x, g in groups.items()}
    out = []
    for i, _, x in rows:
        first = last[x or ""] == i
        out.append((i, len((x or "").encode()), digest(x), "response" if first else "revisit", None if first else last[x or ""]))
    return sorted(out, key=repr)


def frame(pages, spark):
    return spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS gone", "2 AS n", "'y' AS revisit")


def test_round_trip(spark):
    path = shared_path(spark, "warc-test")
    warc.write_pages(frame(PAGES, spark).repartition(3), path)
    got = warc.read_pages(spark, path)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(PAGES)
    whole = warc.read_folder(spark, path, payloads=True).collect()
    texts = {r.payload_digest: r.payload.decode() for r in whole if r.type == "response"}
    assert texts == {digest(x): x or "" for _, _, x in PAGES}
    assert {r.payload for r in whole if r.type == "revisit"} == {None}
    assert {r.error for r in whole} == {None} and sum(r.type == "warcinfo" for r in whole) == len({r.archive for r in whole})


def test_empty_table(spark):
    path = shared_path(spark, "warc-test")
    warc.write_pages(frame(PAGES, spark).limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


def test_record_ids_of_other_kinds(spark):
    path = shared_path(spark, "warc-test")
    rows = [("a b>%+", "u", "x"), ("é", "u", "x"), ("z", None, "y")]
    warc.write_pages(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_pages(spark, path, "string").collect()}
    assert got == {("a b>%+", "revisit", "é"), ("é", "response", None), ("z", "response", None)}


def records(n=60):
    return [warc.page_record(i, f"u{i}", f"page {i} with the same words over and over " * (1 + i % 3), hashlib.sha1((f"page {i} with the same words over and over " * (1 + i % 3)).encode()).hexdigest(),
                             len(f"page {i} with the same words over and over " * (1 + i % 3)), None, False, "2024-01-01T00:00:00Z") for i in range(n)]


def parsed(data):
    return list(warc.archive_records(data))


def test_dictionary_leads_and_is_needed():
    frames = list(warc.archive_frames(iter(records(400)), 4096, 10**6, 3))
    assert frames[0][:4] == warc.DICTIONARY_MAGIC and all(f[:4] == warc.FRAME_MAGIC for f in frames[1:])
    assert [r.record_id for _, r, _ in parsed(b"".join(frames))[1:]] == [f"<urn:page:{i}>" for i in range(400)]
    # the same archive with its dictionary compressed
    raw = zstandard.ZstdCompressor().compress(frames[0][8:])
    packed = warc.DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw
    assert [r for _, r, _ in parsed(packed + b"".join(frames[1:]))] == [r for _, r, _ in parsed(b"".join(frames))]
    assert all("needs dictionary" in e for _, _, e in parsed(b"".join(frames[1:])))


def test_too_few_records_for_a_dictionary():
    frames = list(warc.archive_frames(iter(records(2)), 4096, 10**6, 3))
    assert len(frames) == 3 and [e for _, _, e in parsed(b"".join(frames))] == [None] * 3
    assert list(warc.archive_frames(iter([]), 4096, 10**6, 3)) == [] and parsed(b"") == []


def test_damage_is_found_and_reading_goes_on():
    packer = zstandard.ZstdCompressor()
    good = records(3)
    wrong = {
        "block of": good[0][:-5] + good[0][-4:], "no WARC": b"WARC/9" + good[0][6:], "no SHA-1": good[0].replace(b"sha1:", b"md5:"),
        "does not have its digest": good[0].replace(b"page 0", b"page 9"), "no Content-Length": good[0].replace(b"Content-Length", b"Content-Size"),
        "type or record id": good[0].replace(b"WARC-Record-ID", b"WARC-Record-XX"), "no header line": good[0].replace(b"WARC-Date:", b"WARC-Date"),
    }
    for message, record in wrong.items():
        rows = parsed(b"".join(packer.compress(x) for x in (good[1], record, good[2])))
        assert [r.record_id if r else None for _, r, _ in rows] == ["<urn:page:1>", None, "<urn:page:2>"]
        assert message in rows[1][2], rows[1]
    frames = [packer.compress(x) for x in good]
    # unknown sizes are fine, cut archives are not
    stream = zstandard.ZstdCompressor(write_content_size=False)
    assert [e for _, _, e in parsed(b"".join(stream.compress(x) for x in good))] == [None] * 3
    cut = b"".join(frames)[:-7]
    rows = parsed(cut)
    assert [e is None for _, _, e in rows] == [True, True, False] and rows[-1][2].startswith("rest of the archive")
    assert parsed(frames[0] + b"junk" + frames[1])[1][2].startswith("rest of the archive")
    flipped = bytearray(b"".join(frames))
    flipped[len(frames[0]) + len(frames[1]) - 12] ^= 0xFF
    assert any(e for _, _, e in parsed(bytes(flipped)))


def test_broken_archive_stops_the_query(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(records(1)[0][:-1]))
    rows = warc.read_folder(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and "declared" in rows[0].error
    with pytest.raises(Exception, match="declared"):
        warc.read_pages(spark, str(tmp_path)).collect()
