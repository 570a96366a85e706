"""The pipeline: each stage on its own input against a brute-force version, and the whole run."""

import pytest

import corpus_pipeline
from tests.llm.test_leaks import brute_force
from tests.llm.test_simhash import plain_fingerprint, reachable
from tidemark.llm import mixing, quality, token_counts


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(outputs):
    assert len(corpus_pipeline.STAGES) == 5
    for _, before, after in outputs[:-1]:
        assert after.columns == before.columns


def test_quality_stage(spark, sf_dir, outputs):
    _, before, after = outputs[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.keep for r in quality.score_quality(before, labels).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {d for d, k in scores.items() if k}


def test_near_duplicate_stage(outputs):
    _, before, after = outputs[1]
    fp = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
    root = reachable(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(root.values()))


def test_decontamination_stage(spark, sf_dir, outputs):
    _, before, after = outputs[2]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    dirty = {d for d, *_ in brute_force(items, docs)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_mixing_stage(outputs):
    _, before, after = outputs[3]
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == copies


def test_token_stage(outputs):
    _, before, after = outputs[4]
    texts = sorted((r.doc_id, r.text) for r in before.collect())
    n = [len(token_counts.tokenizer("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in after.collect())
    assert got == [(d, sum(n[:k]), n[k]) for k, (d, _) in enumerate(texts)]


def test_run(spark, sf_dir, outputs):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, outputs[-1][2].collect()))
