import math
import random
from collections import defaultdict

import pytest

from tidemark.llm import mixing

rng = random.Random(2)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, resharing what is over the limit until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while len(stopped) < len(names):
        rest = total - sum(stopped.values())
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in stopped) for s in names if s not in stopped}
        over = {s: most * sizes[s] for s in share if share[s] > most * sizes[s]}
        if not over:
            return stopped | share
        stopped |= over
    return stopped


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1000, None: 50}, {"é": 10, "z": 10, "Z": 10, "aa": 0}, {"x": 7}, {f"s{i}": rng.randrange(1, 5000) for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.target_sizes(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(1500):
        source = rng.choice(["big"] * 6 + ["mid", "mid", "tiny", None])
        out.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, 40, 300])), "en", source))
    return out + [(5000, "w " * 30_000, "en", "big"), (5001, "a b c", "en", "alone"), (5001, "a b c", "en", "alone")]


def test_mix(make_docs, rows):
    docs = make_docs(rows)
    got = mixing.mix_copies(docs).collect()
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    text = {r[0]: r for r in rows}
    for r in got:
        source = text[r.doc_id][3]
        assert r.size == len(text[r.doc_id][1].split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[source] += r.size
        target[source] = r.target
        taken[source] += r.taken
    want = brute_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= max(3, 0.001 * want[s])
    assert all(r.source_size == sizes[text[r.doc_id][3]] for r in got)
    again = mixing.mix_copies(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in mixed} == {d: n for d, n in copies.items() if n}


def test_repeated_rows_share_their_copies(make_docs):
    """Rows that repeat id, source and text are as many as the copies dealt to them, however many they are, null ids included."""
    rows = [(None, "same words here", "en", "a")] * 70 + [(1, "same words here", "en", "a")] * 30 + [(k, f"w{k} " * (k % 9 + 1), "en", "b") for k in range(60)]
    rows += [(5, "x y", "en", None), (5, "x y", "en", "c"), (None, None, None, None)]
    docs = make_docs(rows, ["row", "same_no", "n_copies"])
    want, got = defaultdict(int), defaultdict(int)
    dealt = mixing.mix_copies(docs, most=3, more=["source"]).collect()
    for r in dealt:
        want[r.doc_id, r.source, r.size] += r.copies
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert len({r.copies for r in dealt if r.doc_id is None and r.source == "a"}) == 2  # the case that needs numbers


def test_newton_meets_the_constraints(spark):
    """With uneven base rates the optimum is no longer one rate a source: both constraints must still hold."""
    cls = [("a", s, n, 900.0, b) for s, n, b in [(1, 50, 1.0), (4, 30, 0.5), (20, 10, 2.0), (100, 3, 0.2)]] + [("b", 7, 10, 35.0, 1.0), ("c", 0, 5, 0.0, 1.0)]
    df = spark.createDataFrame(cls, "source string, size long, n long, target double, base double")
    rate = {(r.source, r["size"]): r.rate for r in mixing.entropy_balance(df).collect()}
    words = sum(n * s for c, s, n, *_ in cls if c == "a")
    count = sum(n for c, s, n, *_ in cls if c == "a")
    assert math.isclose(sum(n * s * rate[c, s] for c, s, n, *_ in cls if c == "a"), 900, rel_tol=1e-6)
    assert math.isclose(sum(n * rate[c, s] for c, s, n, *_ in cls if c == "a"), count * 900 / words, rel_tol=1e-6)
    assert math.isclose(rate["b", 7], 0.5, rel_tol=1e-9) and rate["c", 0] == 0
    # exponential tilt: log(rate / base) is linear in size
    logs = [(s, math.log(rate["a", s] / b)) for c, s, n, t, b in cls if c == "a"]
    slope = (logs[1][1] - logs[0][1]) / (logs[1][0] - logs[0][0])
    assert all(math.isclose(y, logs[0][1] + slope * (s - logs[0][0]), abs_tol=1e-9) for s, y in logs)


@pytest.mark.parametrize("share", [0.001, 0.07, 0.9, 1.0, 1.5, 2.9, 2.999, 3.0])
def test_tilt_meets_the_target(spark, share):
    sizes = [(0, 5), (1, 50), (4, 300), (20, 100), (100, 30), (3000, 4), (90_000, 1)]
    words = sum(n * s for s, n in sizes)
    df = spark.createDataFrame([(c, s, n, words * share) for c in ("a", None) for s, n in sizes], "source string, size long, n long, target double")
    got = {(r.source, r["size"]): r.rate for r in mixing.token_tilt(df.union(spark.createDataFrame([("z", 0, 3, 0.0)], df.schema))).collect()}
    assert got["z", 0] == 0
    for c in ("a", None):
        assert math.isclose(sum(n * s * got[c, s] for s, n in sizes), words * share, rel_tol=1e-6)
        logs = [(s, math.log(got[c, s])) for s, _ in sizes if s and 1e-300 < got[c, s] < 3 - 1e-9]
        assert all(math.isclose(y * logs[-1][0], logs[-1][1] * s, rel_tol=1e-6, abs_tol=1e-6) for s, y in logs)
        if share in (0.07, 1.5):
            assert len({round(got[c, s], 6) for s, _ in sizes if s}) > 2  # not one flat rate
