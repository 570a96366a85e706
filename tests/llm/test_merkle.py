"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def expected(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in by[x]), key=lambda y: y[:3]) for x in langs}
    trees = {x: tree([y[2] for y in order[x]], fanout) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], fanout)
    root, out = top[-1][0], []
    for k, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(order[x]):
            bad = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                bad[3] += 1
            at, siblings = leaf_of(bad), []
            for levels, p in ((trees[x], i), (top, k)):
                for nodes in levels[:-1]:
                    run, own = nodes[p // fanout * fanout :][:fanout], p % fanout
                    siblings += run[:own] + run[own + 1 :]
                    at = h(*run[:own], at, *run[own + 1 :])
                    p //= fanout
            out.append((r[0], leaf, trees[x][-1][0], root, h(*siblings), at, at == root))
    return sorted(out, key=repr)


def got(docs, fanout=2, levels=5):
    out = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fanout, levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_awkward_rows(awkward):
    assert got(awkward) == expected(rows_of(awkward), 2)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (3, 1), (4, 5)])
def test_shapes(make_docs, fanout, levels):
    """Trees of 1 to 40 leaves, passes of several sizes."""
    docs = make_docs([(100 * n + i, f"text {n} {i}", f"l{n}", "s") for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 40) for i in range(n)])
    found = got(docs, fanout, levels)
    assert found == expected(rows_of(docs), fanout)
    assert {x[-1] for x in found} == {True, False}


def test_one_document_is_its_own_root(make_docs):
    ((_, leaf, subroot, root, proof, folded, verified),) = got(make_docs([(1, "alone")]))
    assert leaf == subroot == root == folded and proof == h() and verified


def test_empty(awkward):
    assert got(awkward.limit(0)) == []


def test_change_of_any_field_shows(make_docs):
    base = [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "c", "de", "s")]
    roots = {got(make_docs(rows))[0][3] for rows in (base, base[:2], [*base[:2], (3, "c", "de", "t")], [*base[:2], (3, "c", "fr", "s")], [*base[:2], (4, "c", "de", "s")], [*base[:2], (3, "d", "de", "s")])}
    assert len(roots) == 6
