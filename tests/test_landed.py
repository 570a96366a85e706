"""The landed-file source: which folders filters open, splits, odd lines."""

import datetime as dt
import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from tidemark.sources import landed as LA


def put(root, source, day, name, data):
    folder = f"{root}/source={source}/day={day}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "in")
    put(r, "a", "2024-01-01", "f1", b"x\ny")
    put(r, "a", "2024-01-02", "f1", b"\n\nz\n")
    put(r, "a", "2024-01-02", "_SUCCESS", b"no payload")
    put(r, "b%20c", "2024-01-02", "f1", "ü\r\nbad \xff".encode("latin-1") + b"\n")
    put(r, "b%20c", "2024-01-03", "empty", b"")
    return r


def test_rows_of_all_files(spark, root):
    LA.register(spark)
    got = sorted((r.source, str(r.day), r.line, r.payload) for r in spark.read.format("landed").load(root).collect())
    assert got == [("a", "2024-01-01", 0, "x"), ("a", "2024-01-01", 1, "y"), ("a", "2024-01-02", 0, ""), ("a", "2024-01-02", 1, ""), ("a", "2024-01-02", 2, "z"),
                   ("b c", "2024-01-02", 0, "�\r"), ("b c", "2024-01-02", 1, "bad �")]
    assert spark.read.format("landed").load(root + "/missing").count() == 0


def test_filters_open_their_folders_only(spark, root):
    r = LA.LandedReader({"path": root})
    other = IsNotNull(("payload",))
    assert list(r.pushFilters([EqualTo(("source",), "b c"), GreaterThanOrEqual(("day",), dt.date(2024, 1, 3)), other])) == [other]
    assert [f.path.rsplit("/", 1)[1] for p in r.partitions() for f in p.files] == ["empty"]
    LA.register(spark)
    d = spark.read.format("landed").load(root).where("source IN ('a', 'q') AND day > DATE'2024-01-01' AND payload <> ''")
    assert [(r.payload, r.line) for r in d.collect()] == [("z", 2)]
    assert LA.holds(In(("source",), ("a", "q")), "q") and not LA.holds(In(("source",), ("a",)), "b")


def test_splits_and_long_lines(tmp_path):
    r = str(tmp_path / "in")
    for i, n in enumerate((10, 10, 50, 10)):
        put(r, "a", "2024-01-01", f"f{i}", b"k" * n)
    assert [[f.size for f in s.files] for s in LA.splits(LA.listing(r), 25)] == [[10, 10], [50], [10]]
    put(r, "long", "2024-01-01", "f", b"q" * 3_000_000 + b"\nlast")
    (split,) = LA.splits([f for f in LA.listing(r) if f.source == "long"], 1)
    assert [len(x) for b in LA.read_split(r, split) for x in b.column("payload").to_pylist()] == [3_000_000, 4]
