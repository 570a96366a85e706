"""Quality classifier by co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.llm.toxicity import platt, sigmoid

#: Buckets for the values of each categorical metadata column.
BUCKETS = 32


def content(text: str | None) -> list[float]:
    """The text view: how words and characters are used, whatever the language."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * 14 + [1.0]
    letters = sum(map(str.isalpha, words))  # words of letters only
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    different = len(set(words))
    runs = sum(1 for _ in groupby(words))
    longest = max(sum(1 for _ in g) for _, g in groupby(words))
    marks = [text.count(c) for c in "!|#*$%&"]
    return [
        letters / n, upper / n, title / n, np.log1p(n / different), 1 - runs / n, np.log1p(longest), size / n,
        (text.count(".") + text.count(",")) / n, marks[0] / n, marks[1] / n, sum(marks[2:]) / n,
        sum(c in text for c in "0123456789") / 10, (text.count("http") + text.count("@")) / n, np.log1p(n), 0.0,
    ]


def metadata(text: str | None, n_chars: float | None, *labels: str | None) -> list[float]:
    """The page view: declared length, layout of lines, and hashed source and language."""
    n = 0.0 if n_chars is None or n_chars != n_chars else max(float(n_chars), 0.0)
    lines = (text or "").split("\n")
    widths = [len(x) for x in lines]
    out = [np.log1p(n), 1.0 if n == 0 else 0.0, np.log1p(len(lines)), np.log1p(np.mean(widths)), np.log1p(np.std(widths)), widths.count(0) / len(widths)]
    for k, x in enumerate(labels):
        one = [0.0] * BUCKETS
        one[zlib.crc32(f"{k}:{x}".encode()) % BUCKETS] = 1.0
        out += one
    return out


class View(NamedTuple):
    """A logistic model over squared and plain standardised features, with the calibration of its logit."""

    mean: np.ndarray
    dev: np.ndarray
    beta: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expanded((x - self.mean) / self.dev) @ self.beta

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.offset, -12, 12)


class Model(NamedTuple):
    content: View
    metadata: View
    prior: float

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both views as independent evidence over the prior."""
        return sigmoid(self.content.logit(a) + self.metadata.logit(b) - self.prior)


def expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> View:
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expanded((x - mean) / dev)
    beta = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        q = sigmoid(z @ beta)
        hess = z.T @ (z * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, z.T @ (weight * (q - y)) + ridge * beta)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return View(mean, dev, beta)


def log_odds(good: float, bad: float) -> float:
    return float(np.log((good + 0.5) / (bad + 0.5)))


def co_train(
    a: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = 3, confident: float = 0.97, share: float = 0.25, prior: float | None = None
) -> Model | None:
    """Two views that teach each other: y is 0, 1 or -1 (no label).

    Every fifth labelled row is kept for calibration.  In each round each view is
    fitted, and each gives the other its most confident guesses of unlabelled rows, at
    most ``share`` of them a class and only above ``confident``.  None without both labels.
    ``prior`` is the log odds of label 1 among all labelled rows (default: as in ``y``).  Where the rows of ``y`` are a sample
    with other odds, each view's calibrated logit is moved by the difference, so guesses and scores are those of all rows.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if min(len(good), len(bad)) < 2:
        return None
    known = np.concatenate([good, bad])
    held = np.concatenate([good[::5], bad[::5]])
    learn = np.concatenate([np.delete(good, np.s_[::5]), np.delete(bad, np.s_[::5])])
    free = np.flatnonzero(y < 0)
    here = log_odds(len(good), len(bad))
    prior = here if prior is None else prior
    views: list[View] = []
    taught = [(np.empty(0, dtype=int), np.empty(0)), (np.empty(0, dtype=int), np.empty(0))]
    for turn in range(rounds):
        views = []
        for x, (rows, guess) in zip((a, b), taught, strict=True):
            use = np.concatenate([learn, rows])
            views.append(fit(x[use], np.concatenate([y[learn], guess]), np.append(np.ones(len(learn)), np.full(len(rows), 0.5))))
        views = [v._replace(**dict(zip(("slope", "offset"), platt(v.raw(x[held]), y[held] == 1), strict=True))) for v, x in zip(views, (a, b), strict=True)]
        views = [v._replace(offset=v.offset + prior - here) for v in views]
        if turn == rounds - 1 or not len(free):
            break
        taught = []
        for v, x in zip(views[::-1], (b, a), strict=True):  # what view 2 knows teaches view 1, and the reverse
            p = sigmoid(v.logit(x[free]))
            most = int(share * len(free)) + 1
            high, low = np.argsort(-p, kind="stable")[:most], np.argsort(p, kind="stable")[:most]
            high, low = high[p[high] >= confident], low[p[low] <= 1 - confident]
            taught.append((free[np.concatenate([high, low])], np.append(np.ones(len(high)), np.zeros(len(low)))))
    return Model(*views, prior)


def features(docs: DataFrame, meta: Sequence[str]) -> Column:
    """Both views of a row as one array of doubles."""

    @F.pandas_udf("array<double>")
    def both(text: pd.Series, n_chars: pd.Series, labels: pd.DataFrame) -> pd.Series:
        rows = zip(text, n_chars, labels.itertuples(index=False), strict=True)
        return pd.Series([content(t) + metadata(t, n, *more) for t, n, more in rows])

    return both("text", F.col("n_chars").cast("double"), F.struct(*[F.col(c).cast("string") for c in meta]))


N_CONTENT = len(content(""))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 4000, meta: Sequence[str] = ("source", "lang")) -> Model | None:
    """Fit on the driver from a bounded sample: at most ``rows`` labelled documents of each label and ``rows`` without one.

    Rows are chosen by a hash of their id before texts are read; features are
    computed in the tasks, only they come to the driver.  The prior is that of all labelled documents, so the model
    does not change its level where a label has more rows than the bound.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in docs.select("doc_id").join(rated, "doc_id").groupBy("y").count().collect()}
    rated = rated.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    others = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(rated, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("y"))
    chosen = others.orderBy(*order).limit(rows)
    for y in (0, 1):
        chosen = chosen.union(rated.where(F.col("y") == y).orderBy(*order).limit(rows))
    # ids and labels of at most 3 * rows documents
    sample = texts(docs, "n_chars", *meta).join(F.broadcast(chosen), "doc_id")
    got = sample.select("doc_id", "y", features(sample, meta).alias("x")).collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.x))
    if not got:
        return None
    x = np.array([r.x for r in got])
    return co_train(x[:, :N_CONTENT], x[:, N_CONTENT:], np.array([r.y for r in got]), prior=log_odds(totals.get(1, 0), totals.get(0, 0)))


def quality_score(docs: DataFrame, model: Model | None, meta: Sequence[str] = ("source", "lang")) -> Column:
    """Probability of label 1 from both views; one half where nothing could be learned."""
    if model is None:
        return F.lit(0.5).cast("double")

    @F.pandas_udf("double")
    def score(text: pd.Series, n_chars: pd.Series, labels: pd.DataFrame) -> pd.Series:
        rows = list(zip(text, n_chars, labels.itertuples(index=False), strict=True))
        if not rows:
            return pd.Series([], dtype="float64")
        a = np.array([content(t) for t, _, _ in rows])
        b = np.array([metadata(t, n, *more) for t, n, more in rows])
        return pd.Series(model.score(a, b))

    return score("text", F.col("n_chars").cast("double"), F.struct(*[F.col(c).cast("string") for c in meta]))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = 4000) -> DataFrame:
    """Quality of every document: doc_id, score (0 to 1), keep (score >= least), one row per input row.

    Two classifiers, one of the text's words and characters and one of the page's
    metadata (source, language, declared length, layout of lines), are co-trained on
    a bounded sample (``train_quality``) and applied in the tasks that read the documents.

    Nulls in any column are values of their own; an empty text has its own
    feature.  Conflicting labels of one id count as 0, labels other than 0 and 1
    are ignored.  Without both labels every score is one half and all documents are kept.
    """
    model = train_quality(docs, labels, rows=rows)
    scored = docs.select("doc_id", quality_score(docs, model).alias("score"))
    return scored.withColumn("keep", F.col("score") >= least)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = 4000) -> DataFrame:
    """Documents that are kept, with all their columns."""
    return docs.where(quality_score(docs, train_quality(docs, labels, rows=rows)) >= least)
