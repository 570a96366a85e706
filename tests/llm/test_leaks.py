import random

import pytest

from tidemark.llm import decontaminate as d

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def sample(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def lower_words(x):
    return (x or "").encode().lower().split()


def grams(x):
    w = lower_words(x)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def case():
    items = [(i, sample(n)) for i, n in enumerate([1, 3, 4, 5, 6, 8, 12, 13, 20, 21, 36, 37, 60, 70, 140, 300, 700])]
    items += [(90, "rep eat " * 30), (91, None), (92, "")]
    docs = []
    for i, t in items:
        for k in range(12):
            w = (t or "").split()
            if k % 3 == 1 and len(w) > 40:  # a changed word costs five shingles
                w[rng.randrange(len(w))] = "other"
            if k % 4 == 3:  # too little of it
                w = w[: len(w) // 2]
            docs.append(" ".join([sample(rng.choice([0, 3, 50, 2000])), *w, sample(rng.choice([0, 3, 50, 2000]))]).strip())
        docs.append((t or "").upper().replace(" ", "\n\t"))
    return items, list(enumerate(docs))


def brute_force(items, docs, least=0.8):
    out = []
    for k, t in docs:
        g = grams(t)
        for i, x in items:
            want = grams(x)
            if want and len(g & want) >= least * len(want):
                out.append((k, i, len(g & want), len(want)))
    return sorted(out)


def test_against_brute_force(spark, make_docs, case):
    items, docs = case
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute_force(items, docs)
    assert len(want) > 100
    for blocks in (20_000, 4):
        assert sorted(tuple(r) for r in d.find_leaks(make_docs(docs), frame, block_items=blocks).collect()) == want
    dirty = {k for k, *_ in want}
    assert sorted(r.doc_id for r in d.clean_documents(make_docs(docs), frame).collect()) == [k for k, _ in docs if k not in dirty]


def test_search_finds_scattered_items():
    """The candidate search alone: recall on passages that are cut in two."""
    items = [(i, sample(60)) for i in range(80)]
    ready = d.prepare(items, 5, d.PERMUTATIONS)
    texts = []
    for _, t in items:
        w = t.split()
        texts.append(" ".join([*w[:30], sample(300), *w[26:]]))
    found = {(k, i) for k, i, *_ in d.contained(texts, ready, 5, 0.8, d.PERMUTATIONS)}
    want = {(k, i) for k, i, *_ in brute_force(items, list(enumerate(texts)))}
    assert len(want) >= 70 and len(found & want) >= 0.9 * len(want) and not found - want


def test_windows_stay_inside_a_text():
    import numpy as np

    at, many = d.cuts(np.array([5, 1, 33]), 16)
    assert at.tolist() == [0, 5, 6, 22, 38] and many.tolist() == [1, 1, 3]


def test_long_repetitive_items_are_found():
    """Items of few distinct shingles, whole inside long varied texts."""
    items = [(i, " ".join(f"i{i}r{j % (6 + i % 6)}" for j in range(1040))) for i in range(20)]
    texts = [f"{sample(3000)} {t} {sample(3000)}" for _, t in items]
    ready = d.prepare(items, 5, d.PERMUTATIONS)
    found = {(k, i) for k, i, *_ in d.contained(texts, ready, 5, 0.8, d.PERMUTATIONS)}
    assert found == {(k, i) for k, i, *_ in brute_force(items, list(enumerate(texts)))} and len(found) == 20
