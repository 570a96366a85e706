import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_counts as c
from tidemark.llm import token_output as o
from tidemark.llm.common import shared_path

NAME = "byte_bpe_50k.json"
rng = random.Random(3)
WORDS = ["alpha", "it's", "é\u0301té", "1234", "x1y2", "...", "你好", "😀", "<|endoftext|>", "don't", "A" * 30, "\u00a0", "\x1c", "--", "'", "q!"]
GAPS = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\t", "", "\r\n", "\u2028"]
TEXTS = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n)) for n in [0, 1, 2, 3, 5, 8, 50, 400, 900] for _ in range(4)]
TEXTS += ["x" * 5000, " " * 700, "\n" * 700, "ab12" * 800, "é" * 3000, "word " * 1500, "<|endoftext|>" * 300]


def plain(x):
    return c.tokenizer(NAME).encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(16_384, 128), (300, 40), (64, 4), (7, 2)])
def test_spliced_ids_are_the_library_s(chunk, overlap):
    for x, parts in zip(TEXTS, c.encode(TEXTS, NAME, chunk, overlap), strict=True):
        assert [t for p in parts for t in p] == plain(x)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n\t'sé.<|>\u00a0\x1c你")), max_size=200), st.integers(2, 30), st.integers(1, 10))
def test_splice_any_text(x, chunk, overlap):
    assert [t for p in c.encode([x], NAME, chunk, overlap)[0] for t in p] == plain(x)


def test_word_by_word_ids_are_the_library_s():
    for _ in range(2):  # new pieces, then known ones
        for x, ids in zip(TEXTS, o.encode_regular(TEXTS, NAME), strict=True):
            assert ids.tolist() == plain(x)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n'sé.<|>你")), max_size=80))
def test_word_by_word_any_text(x):
    assert o.encode_regular([x], NAME)[0].tolist() == plain(x)


def test_counts(make_docs):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(900, None)]
    got = {r.doc_id: r for r in c.count_tokens(make_docs(rows), chunk=500, overlap=50).collect()}
    for i, x in rows:
        n = len(plain(x or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 512)


@settings(deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.data())
def test_packing(width, n, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), min_size=n, max_size=n)), dtype=np.uint32)
    offsets, payload = o.pack(ids, width, 16)
    assert len(payload) == offsets[-1] and len(payload) <= -(-n // 16) * -(-16 * width // 8)
    a = data.draw(st.integers(0, n))
    b = data.draw(st.integers(a, n))
    assert o.unpack(payload, offsets, width, a, b - a, 16).tolist() == ids[a:b].tolist()


def test_width():
    assert [o.id_width(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("run_ids", [50, 262_144])
def test_files(spark, make_docs, run_ids):
    rows = [(i * 7 % 100, TEXTS[i % len(TEXTS)]) for i in range(100)] + [(200, None), (201, ""), (150, "twice"), (150, "twice")]
    path = shared_path(spark, "test-tokens")
    o.write_tokens(make_docs(rows).repartition(5), path, run_ids=run_ids)
    want, at = [], 0
    every = []
    for d, x in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*plain(x or ""), 0], dtype="<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
        every.append(ids)
    assert sorted(tuple(r) for r in o.read_documents(spark, path).collect()) == want
    every = np.concatenate(every)
    for a, n in [(0, 10), (len(every) - 5, 50), (1234, 5000), (3, 0)]:
        assert o.read_range(spark, path, a, n).tolist() == every[a : a + n].tolist()


def test_other_vocabularies(make_docs):
    """Ids and counts of a vocabulary that is no byte-level BPE are those of the library too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    name = "word_bpe_49k.json"
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["Plain words, here.", "UPPER lower  two spaces\nline", "Été 42 don't", "", "many words " * 9000, "x<|endoftext|>y"]
    docs = make_docs(list(enumerate(texts)))
    want = [tok.encode(x, add_special_tokens=False).ids for x in texts]
    assert {r.doc_id: r.n_tokens for r in c.count_tokens(docs, name).collect()} == {i: len(x) for i, x in enumerate(want)}
    path = shared_path(docs.sparkSession, "other-vocabulary")
    o.write_tokens(docs, path, name)
    got = o.read_range(docs.sparkSession, path, 0, sum(map(len, want)) + len(want)).tolist()
    assert got == [t for x in want for t in [*x, 0]]
    assert c.byte_level("byte_bpe_50k.json") and not c.byte_level(name)
