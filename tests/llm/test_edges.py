"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_leaks import brute_force
from tests.llm.test_simhash import plain_fingerprint, reachable
from tidemark.llm import decontaminate, exact_dedup, line_dedup, mixing, quality, simhash, token_counts, token_output, toxicity, url_filter
from tidemark.llm.common import shared_path


def written(docs):
    path = shared_path(docs.sparkSession, "edge-tokens")
    token_output.write_tokens(docs, path)
    return token_output.read_documents(docs.sparkSession, path)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five six"), (2, None), (3, ""), (None, "only a TEXT"), (1, "two three four five six")], "item_id long, text string")


def per_document(items, labels):
    return {
        "op2": mixing.mix_copies,
        "op3": line_dedup.remove_repeated_lines,
        "op4": written,
        "op6": simhash.near_duplicates,
        "op7": exact_dedup.exact_duplicates,
        "op8": lambda d: toxicity.score_toxicity(d, labels, rows=5),
        "op9": lambda d: quality.score_quality(d, labels, rows=5),
        "op10": token_counts.count_tokens,
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_one_row_per_document(awkward, items, labels, name):
    out = per_document(items, labels)[name](awkward)
    got = out.collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r.doc_id or 0 for r in awkward.select("doc_id").collect())


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"])
def test_empty_table(awkward, items, labels, name):
    none = awkward.limit(0)
    assert per_document(items, labels)[name](none).count() == 0
    assert per_document(items, labels.limit(0))[name](none).count() == 0


@pytest.mark.parametrize("name", ["op8", "op9"])
def test_without_labels(awkward, items, labels, name):
    scores = [r.score for r in per_document(items, labels.limit(0))[name](awkward).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] <= 1


def test_leaks(awkward, items, labels):
    got = sorted((r.doc_id or 0, r.item_id or 0, r.n_found, r.n_shingles) for r in decontaminate.find_leaks(awkward, items).collect())
    hits = [(d, 1, 1, 1) for d in (1, 7, 8, 8) for _ in range(2)]
    assert got == sorted([*hits, (0, 0, 1, 1)])
    assert decontaminate.find_leaks(awkward.limit(0), items).count() == 0
    assert decontaminate.find_leaks(awkward, items.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example.org/x"), (1, "http://a.example.org/x"), (2, None), (3, "no scheme"), (None, "HTTP://B.C/é?q"), (4, "")], "page_id long, url string"
    ).selectExpr("*", "'x' AS host", "'y' AS path", "1 AS n", "'z' AS rule")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "page_id long, bad int")
    got = sorted((r.page_id or 0, r.host, r.path) for r in url_filter.judge_urls(pages, outcomes, ["org/"], []).collect())
    assert got == [(0, "b.c", "/é"), (1, "a.example.org", "/x"), (1, "a.example.org", "/x"), (2, "", ""), (3, "", ""), (4, "", "")]
    assert url_filter.judge_urls(pages, outcomes.limit(0), [], []).count() == 6
    assert url_filter.judge_urls(pages.limit(0), outcomes, [], []).count() == 0


def stage_inputs(awkward, labels, items, folder):
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")


def expected(name, docs, labels, items):
    """How many rows of each doc_id a stage must return, by a plain version of its rule."""
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    if name == "quality classifier":
        return Counter(r.doc_id for r in quality.score_quality(docs, labels).collect() if r.keep)
    if name == "SimHash near-dedup":
        fp = {k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)}
        groups = {}
        for k, root in reachable(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3).items():
            groups.setdefault(root, []).append(rows[k][0])
        return Counter(min(g, key=lambda d: (d is None, d or 0)) for g in groups.values())
    if name == "benchmark decontamination":
        dirty = {k for k, *_ in brute_force([(i, t or "") for i, t in items.collect()], [(k, t) for k, (_, t) in enumerate(rows)])}
        return Counter(d for k, (d, _) in enumerate(rows) if k not in dirty)
    copies = Counter()
    for r in mixing.mix_copies(docs).collect():
        copies[r.doc_id] += r.copies
    return +copies


def test_stages(spark, awkward, labels, items, tmp_path):
    stage_inputs(awkward, labels, items, tmp_path)
    for docs in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert Counter(r.doc_id for r in out.select("doc_id").collect()) == expected(name, docs, labels, items), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
