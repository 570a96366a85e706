"""Filter audit against a walk through all 120 orders."""

import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest

from tidemark.llm import filter_audit as A


def test_lehmer_ranks():
    for n in (1, 3, 5):
        assert [A.lehmer_rank(p, n) for p in permutations(range(n))] == list(range(factorial(n)))
    assert A.lehmer_rank((2,), 5) == 48 and A.lehmer_rank((0, 4), 5) == 18


def test_intervals_do_not_touch():
    by = defaultdict(list)
    for mask, step, measure, low, high in A.rank_intervals(5):
        assert 0 <= low < high <= 120
        by[mask, step, measure].append((low, high))
    for ends in by.values():
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    # a row that fails one filter only is removed at the first step by 24 orders
    assert sum(h - lo for lo, h in by[4, 1, "removed"]) == 24


def expected(rows, labels):
    first, good, toxic = {}, defaultdict(int), defaultdict(int)
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in labels:
        if d is not None:
            good[d], toxic[d] = max(good[d], int(q == 1)), max(toxic[d], int(x == 1))
    out, own = defaultdict(Counter), defaultdict(int)
    for d, t, lang, *_ in rows:
        t, part = t or "", lang or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": d is not None and t in first and first[t] < d}
        g, x = (good[d], toxic[d]) if d is not None else (0, 0)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, "".join(order), step]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if gone:
                    c["redundant"] += fails[f]
                elif fails[f]:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += g
                    c["toxic_lost"] += x
                    own[part, f] += 1
                c["kept"] += not gone
    return sorted((*k, c["kept"], c["removed"], c["redundant"], c["unique_fails"], c["good_lost"], c["toxic_lost"], own[k[0], k[1][k[2] - 1]]) for k, c in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def label_rows():
    return [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 0, 1), (5, 1, 0), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (8, 0, 1), (9, 7, -1), (77, 1, 1)]


def test_awkward_rows(awkward, labels, label_rows):
    got = A.audit_filters(awkward, labels)
    assert got.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    assert sorted(map(tuple, got.collect())) == expected(rows, label_rows)


def test_mixed_texts(make_docs, labels, label_rows):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:120]), " ".join(words[:50] * 3), "A B C D " * 30, "a # b", " ".join(words[:99]) + " LOUD", "UP " * 200, "", " ".join(words[:120]).upper() + " $"]
    rows = [(i, texts[i * i % 8], "de" if i % 3 else None) for i in range(80)]
    assert sorted(map(tuple, A.audit_filters(make_docs(rows), labels).collect())) == expected(rows, label_rows)


def test_empty(awkward, labels):
    assert A.audit_filters(awkward.limit(0), labels).count() == 0
    got = A.audit_filters(awkward, labels.limit(0))
    assert got.count() == 600 * awkward.selectExpr("coalesce(lang, '')").distinct().count()
    assert got.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0:2] == (0, 0)
