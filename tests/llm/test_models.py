"""The two classifiers: held-out accuracy on the given labels, and what they may depend on."""

import zlib

import numpy as np
import pytest

from tidemark.llm import quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    scored = toxicity.score_toxicity(docs, labels, rows=400).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in scored]), np.array([r.predicted for r in scored])
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    # in these data some toxic words are made of syllables that clean words have too
    assert (y == p).mean() > 0.96 and p[y == 1].mean() > 0.7 and p[y == 0].mean() < 0.01


def test_toxicity_of_a_misspelling():
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["apple", "river", "stone", "cloud", "table", "green"], 60)) for _ in range(300)]
    toxic = [" ".join([*t.split()[:30], str(rng.choice(["horriblest", "horribler", "horribles"])), *t.split()[30:]]) for t in clean[:150]]
    m = toxicity.train(toxic + clean[150:], np.array([True] * 150 + [False] * 150))
    scores = toxicity.score_texts(["river stone horriblxx table " * 4, "river stone cloud table " * 4, ""], m, toxicity.WordWorth(m.worth))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5


def test_toxicity_gradient_is_the_transpose():
    bags = toxicity.Bags.of([["a", "b", "c"] * 20, ["b"], ["x"] * 9])
    rng = np.random.default_rng(0)
    u, d = rng.normal(size=toxicity.BUCKETS), rng.normal(size=bags.many.sum())
    assert np.isclose(bags.windows(u) @ d, u @ bags.buckets(d))


def test_quality_held_out(tables):
    docs, labels = tables
    model = quality.train_quality(docs, labels, rows=300)
    used = 300
    scored = docs.select("doc_id", quality.quality_score(docs, model).alias("score")).join(labels, "doc_id").collect()
    y, p = np.array([r.quality for r in scored]), np.array([r.score >= 0.5 for r in scored])
    assert len(scored) > 5 * used and (y == p).mean() > 0.97 and p[y == 1].mean() > 0.98


def test_co_training_uses_both_views():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 2000)
    a, b = (y[:, None] * 2 - 1) * 0.8 + rng.normal(size=(2000, 2)), (y[:, None] * 2 - 1) * 0.8 + rng.normal(size=(2000, 2))
    known = np.where(np.arange(2000) < 60, y, -1)
    m = quality.co_train(a, b, known)
    both = ((m.score(a, b) >= 0.5) == y).mean()
    one = [((v.logit(x) >= 0) == y).mean() for v, x in ((m.content, a), (m.metadata, b))]
    assert both > max(one) and both > 0.9


def test_toxicity_sample_in_hash_order_whatever_the_length(spark, make_docs):
    texts = {i: "word " * (1 + 199 * (i % 2)) for i in range(400)}
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in texts], "doc_id long, toxic int")
    whole, odds = toxicity.labelled_sample(make_docs(list(texts.items())), labels, "toxic", 400, 10**9)
    part, same = toxicity.labelled_sample(make_docs(list(texts.items())), labels, "toxic", 400, 30_000)
    assert odds == same and 0 < sum(len(t) for t, _ in part) <= 60_000 < sum(len(t) for t, _ in whole)
    for y in (0, 1):
        long = [len(t) > 100 for t, k in part if k == y]
        assert 0.2 < sum(long) / len(long) < 0.8


def test_quality_level_does_not_depend_on_the_row_bound():
    """One population, labelled rows below and above the bound of rows a label: the same level of scores."""
    rng = np.random.default_rng(5)

    def views(y):
        return y[:, None] * 1.2 + rng.normal(size=(len(y), 3)), y[:, None] * 1.0 + rng.normal(size=(len(y), 2))

    truth = (rng.random(40_000) < 0.1).astype(float)
    a, b = views(truth)
    small = np.where(np.arange(40_000) < 3000, truth, -1)[:7000]
    few = quality.co_train(a[:7000], b[:7000], small)
    rows = np.concatenate([np.flatnonzero(truth == 1)[:2000], np.flatnonzero(truth == 0)[:2000]])
    odds = quality.log_odds((truth == 1).sum(), (truth == 0).sum())
    many = quality.co_train(a[rows], b[rows], truth[rows], prior=odds)
    fresh = (rng.random(20_000) < 0.1).astype(float)
    fa, fb = views(fresh)
    low, high = few.score(fa, fb), many.score(fa, fb)
    assert abs(low.mean() - 0.1) < 0.02 and abs(high.mean() - 0.1) < 0.02
    assert abs(((high >= 0.5) == (fresh == 1)).mean() - ((low >= 0.5) == (fresh == 1)).mean()) < 0.01


def test_quality_prior_counts_all_labelled_documents(spark):
    docs = spark.createDataFrame([(i, ("clean words and more of them %d. " % i) * 8 if i % 10 else "!!! ### buy $$$ %d " % i * 9, "en", "s", 100) for i in range(600)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 <> 0 as int) AS quality").union(spark.createDataFrame([(9999, 0)], "doc_id long, quality int"))
    for rows in (1000, 25):
        assert abs(quality.train_quality(docs, labels, rows=rows).prior - quality.log_odds(540, 60)) < 1e-9


def test_quality_score_row_by_row(spark):
    """The fitted model worked out again in plain Python, document by document."""
    docs = spark.createDataFrame([(i, None if i == 5 else ("word%d and. " % (i % 7)) * (i % 30), "en" if i % 3 else None, "s%d" % (i % 4), i if i % 5 else None) for i in range(200)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 30 > 9 as int) AS quality").where("doc_id % 2 = 0")
    model = quality.train_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    for r in docs.collect():
        total = -model.prior
        for view, x in ((model.content, quality.content(r.text)), (model.metadata, quality.metadata(r.text, r.n_chars, r.source, r.lang))):
            z = [min(8.0, max(-8.0, (v - m) / d)) for v, m, d in zip(x, view.mean, view.dev, strict=True)]
            raw = sum(b * v for b, v in zip(view.beta, [*z, *[v * v / 4 for v in z], 1.0], strict=True))
            total += min(12.0, max(-12.0, view.slope * raw + view.offset))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9
