"""Exact and line dedup against plain Python."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_dedup


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    out = []
    for d, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(i, ("Same text %d. " % (i % 7)) * (1 + i % 5) + ("\u00c9" if i % 3 else "\u00e9")) for i in range(60)] + [
    (60, "Word rest and " * 3000), (61, "word REST and " * 3000), (62, "word rest and " * 2999 + "word rest end "), (63, None), (64, ""), (None, "Same text 1. \u00c9")
]


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_exact(make_docs):
    assert got(exact_dedup.exact_duplicates(make_docs(ROWS))) == expected_exact(ROWS)


def test_exact_with_clashing_digests(make_docs):
    weak = exact_dedup.exact_duplicates(make_docs(ROWS), digest=lambda c: F.substring(F.md5(c), 1, 1))
    assert got(weak) == expected_exact(ROWS)


def test_chunks_cover_the_text(spark):
    text = "\n".join(f"Line {i} rest and more ending a word." for i in range(3000)) + "x" * 20_000
    parts = spark.range(1).select(exact_dedup.chunks(F.lit(text)).alias("c")).first().c
    assert "".join(parts) == text and max(map(len, parts)) <= 8192 and len(parts) > 10
    # an insertion near the start leaves most later chunks as they were
    moved = spark.range(1).select(exact_dedup.chunks(F.lit("Inserted words. " + text)).alias("c")).first().c
    assert len(set(parts) & set(moved)) > len(parts) / 2


def expected_lines(rows):
    places, out = {}, []
    lines = {d: (t or "").split("\n") for d, t in rows}
    for d in sorted(lines):
        for i in range(len(lines[d]) - 2):
            places.setdefault(tuple(lines[d][i : i + 3]), []).append((d, i))
    gone = defaultdict(set)
    for p in places.values():
        for d, i in p[1:]:
            gone[d].update((i, i + 1, i + 2))
    for d, ls in lines.items():
        out.append((d, len(ls), len(gone[d]), "\n".join(x for i, x in enumerate(ls) if i not in gone[d])))
    return sorted(out, key=repr)


def test_lines(make_docs):
    rows = [(i, "\n".join(f"l{(i * k) % 5}" for k in range(i % 9))) for i in range(80)]
    rows += [(100, "a\na\na\na\na"), (101, "p\nq\nr\ns\nt"), (102, "0\np\nq\nr\ns\nt\n1"), (103, None), (104, ""), (105, "\n\n\n")]
    assert got(line_dedup.remove_repeated_lines(make_docs(rows))) == expected_lines(rows)


def test_line_versions_of_one_document(make_docs):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\na\nb\nc")]
    assert [r.n_removed for r in line_dedup.remove_repeated_lines(make_docs(rows)).orderBy("n_lines").collect()] == [0, 0, 3]


def test_chunk_ends_follow_content_in_any_script(spark):
    import random

    r = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442", "".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0xAC00, 0xB000)))):
        text = " ".join("".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(12_000))
        both = spark.range(1).select(exact_dedup.chunks(F.lit(text)).alias("a"), exact_dedup.chunks(F.lit("x" + text)).alias("b")).first()
        assert "".join(both.a) == text and max(len(c.encode()) for c in both.a) <= 8192
        assert len({*both.a} & {*both.b}) > 0.9 * len(both.a) > 9
