import pytest

#: Names that operators use inside; given tables may have them too.
EXTRA = "size copies n fp cell row bad recipe version lines at label tie rate first last base chunk digest node root keep_id score".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns on request."""

    def make(rows, extra=()):
        full = [(*r, *("en", "src1")[len(r) - 2 :]) for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None, *(["x"] * len(extra))) for r in full]
        more = "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{more}")

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, clashing column names."""
    long = " ".join(f"word{i % 977} line\n" if i % 13 == 0 else f"w{i % 1013}" for i in range(40_000))
    rows = [
        (1, "One two three four five six seven.", "en", "src1"), (2, None, "en", "src1"), (3, "", None, "src2"), (None, "Only a text", "en", None),
        (4, " \n\t ", "de", "src2"), (5, long, "en", "src1"), (6, long, "en", "src1"), (7, "ONE two three four five six seven.", None, None),
        (8, "One two three four five six seven.", "en", "src1"), (8, "One two three four five six seven.", "en", "src1"), (None, None, None, None),
        (9, "<|endoftext|> e\u0301t\u00e9 \u00c9t\u00c9 \u4f60\u597d \U0001f600\u00a0x\x1cy", "zh", "src3"),
    ]
    return make_docs(rows, EXTRA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 0, 1), (5, 1, 0), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (8, 0, 1), (9, 7, -1), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
