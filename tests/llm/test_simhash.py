import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.helpers import evaluate
from tidemark.llm import simhash as s
from tidemark.llm.components import components

rng = random.Random(11)


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def make_texts():
    base = [" ".join(rng.choice(["the", "of", "a", "cat", "dog", "É", "x9", "runs."]) for _ in range(n)) for n in (1, 2, 3, 4, 30, 200, 400, 800)]
    out = [None, "", " \n", "A b c\td", *base]
    for b in base[3:]:
        w = b.split()
        for _ in range(6):
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out + base + [b.upper() for b in base]


def test_against_brute_force(make_docs):
    rows = list(enumerate(make_texts()))
    fp = {d: plain_fingerprint(t) for d, t in rows}
    root = reachable([d for d, _ in rows], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    for size in (2048, 3):
        got = sorted(tuple(r) for r in s.near_duplicates(make_docs(rows), size=size).collect())
        assert got == [(d, f"{fp[d]:016x}", root[d]) for d, _ in rows]


def test_links_of_planted_fingerprints(spark):
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for k in range(1, 6):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), k)))
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    linked = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    want = {n: r for n, r in reachable(signed, linked).items()}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for size in (2, 500):
        got = {r.node: r.root for r in components(s.close_pairs(df, size=size)).collect()}
        assert {n: got.get(n, n) for n in signed} == want


def test_population_counts(spark):
    got = evaluate(spark, F.array(*s.population(F.col("x"))), [-1, 0, 1 << 16, -(2**63)], "x long")
    assert got == [[16] * 4, [0] * 4, [0, 1, 0, 0], [0, 0, 0, 1]]


def test_steps_cover_each_pair_once():
    steps = s.near_steps(3)
    assert len(steps) == 65 == len({max(x, tuple(-d for d in x)) for x in steps})
    assert all(sum(map(abs, x)) <= 3 for x in steps)


def test_forest_and_tiles():
    i, j = np.array([0, 1, 2, 5]), np.array([1, 2, 3, 6])
    node, root = s.forest(i, j, 8)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {1: 0, 2: 0, 3: 0, 6: 5}
    near = np.array([1 << k for k in range(64)], dtype=np.uint64)  # all within two bits
    a, b = s.tile_links(near, near, True, 3)
    assert len(a) == 63 and len(set(a.tolist()) | set(b.tolist())) == 64


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(5, 9), (9, 5), (7, 7), (8, 9)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = reachable(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert {r.node: r.root for r in components(df).collect()} == want


def test_first_of_group_stays(make_docs):
    """One row of each group, also where ids repeat or are null."""
    a, b, c = "one two three four", "something else here now", "quite another text about nothing at all"
    rows = [(3, a), (1, a), (2, b), (None, a), (1, a), (None, c), (None, c), (None, None), (None, ""), (2, b), (7, b)]
    got = sorted((r.doc_id or 0, r.text or "") for r in s.first_of_group(make_docs(rows, ["row", "row_key", "n"])).collect())
    assert got == [(0, ""), (0, c), (1, a), (2, b)]


def test_other_text_of_a_removed_id_stays(make_docs):
    rows = [(1, "one two three four"), (5, "one two three four"), (5, "something else here now"), (6, None)]
    got = sorted((r.doc_id, r.text or "") for r in s.first_of_group(make_docs(rows)).collect())
    assert got == [(1, "one two three four"), (5, "something else here now"), (6, "")]
