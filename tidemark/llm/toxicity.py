"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_column, text_groups, texts

BUCKETS = 1 << 17
#: Words in half a window; windows overlap by half.
HALF = 8
GRAMS = (3, 4, 5)
#: A window with fewer n-grams is averaged as if it had so many.
LEAST_GRAMS = 80
DIMENSIONS = 8


class Model(NamedTuple):
    """``worth`` of a bucket is its embedding's share of the toxic logit; slope and offset calibrate a text's largest window."""

    worth: np.ndarray
    bias: float
    slope: float
    offset: float


def word_buckets(word: str) -> list[int]:
    """Hash buckets of a word and its character n-grams, word ends marked; punctuation around the word is left out."""
    w = "<" + word.strip("\"'`.,;:!?()[]{}*_-~|&$%#<>/\\") + ">"
    crc, last = zlib.crc32, BUCKETS - 1
    return [crc(g.encode()) & last for g in {w, *[w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]}]


def words_of(text: str) -> list[str]:
    """Lower-case words; a word right after the same word counts once, an empty text is one empty word."""
    return [w for w, _ in groupby(text.lower().split())] or [""]


def halves(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the half windows of consecutive texts in their joined words, and how many each text has."""
    many = -(-n_words // HALF)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(n_words) - n_words, many) + inside * HALF, many


def paired(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sum of each half window and the next one of the same text."""
    after = np.append(x[1:], 0)
    after[np.cumsum(many) - 1] = 0
    return x + after


class Bags(NamedTuple):
    """Texts as windows of words, words as bags of buckets."""

    words: np.ndarray  # distinct word of each place
    starts: np.ndarray
    many: np.ndarray
    gram: np.ndarray
    gram_word: np.ndarray
    n_words: int

    @classmethod
    def of(cls, values: list[list[str]]) -> Bags:
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in values for w in ws], dtype=np.int64)
        buckets = [word_buckets(w) for w in number]
        starts, many = halves(np.array([len(w) for w in values]))
        return cls(flat, starts, many, np.array([b for g in buckets for b in g]), np.repeat(np.arange(len(buckets)), [len(g) for g in buckets]), len(number))

    def windows(self, per_bucket: np.ndarray) -> np.ndarray:
        """Sum over each window of a value per bucket."""
        word = np.bincount(self.gram_word, per_bucket[self.gram], self.n_words)
        return paired(np.add.reduceat(word[self.words], self.starts), self.many)

    def buckets(self, per_window: np.ndarray) -> np.ndarray:
        """Sum over each bucket of a value per window, the transpose of ``windows``."""
        before = np.append(0, per_window[:-1])
        before[np.cumsum(self.many) - self.many] = 0
        half = per_window + before
        sizes = np.diff(np.append(self.starts, len(self.words)))
        word = np.bincount(self.words, np.repeat(half, sizes), self.n_words)
        return np.bincount(self.gram, word[self.gram_word], BUCKETS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: Bags, toxic: np.ndarray, rounds: int, epochs: int, rate: float, scale: float, seed: int, share: float = 0.2, floor: float = 1e-4) -> tuple[np.ndarray, float]:
    """Worth of each bucket and bias.

    A text's label says that some window of it is toxic.  The first round
    takes all windows of toxic texts as positive, each later one the window of
    each toxic text that the model so far finds most toxic.  Positive windows
    have the share ``share`` of all weight, so unknown words count as clean.  Adam's
    epsilon ``floor`` is large, so that buckets seen in few windows stay near zero.
    """
    doc = np.repeat(np.arange(len(toxic)), bags.many)
    size = np.maximum(bags.windows(np.ones(BUCKETS)), LEAST_GRAMS)
    first = np.cumsum(bags.many) - bags.many
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.001, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = rng.normal(0, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, dtype=np.float32)
    positive, used = toxic[doc], np.ones(len(doc), dtype=bool)
    for turn in range(rounds):
        if turn:
            z = bags.windows(e @ (w[1] - w[0])) / size
            positive = toxic[doc] & (z == np.maximum.reduceat(z, first)[doc])
            used = positive | ~toxic[doc]
        weight = np.where(positive, share / positive.sum(), (1 - share) / (used & ~positive).sum()) * used
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, bias)]
        for t in range(1, epochs + 1):
            z = scale * bags.windows(e @ (w[1] - w[0])) / size + (bias[1] - bias[0])
            d = (sigmoid(z) - positive) * weight
            s = (scale * bags.buckets(d / size)).astype(np.float32)
            one = e.T @ s  # gradient of the two classes' weights: one and its opposite
            grads = (s[:, None] * (w[1] - w[0])[None, :], np.stack([-one, one]), np.array([-d.sum(), d.sum()], dtype=np.float32))
            for x, g, (m, v) in zip((e, w, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + floor)
    return (scale * (e @ (w[1] - w[0]))).astype(np.float32), float(bias[1] - bias[0])


def train(values: list[str], toxic: np.ndarray, odds: float | None = None, rounds: int = 3, epochs: int = 30, rate: float = 0.1, scale: float = 16.0, seed: int = 7, stretches: int = 6, stretch_words: int = 64) -> Model:
    """Embeddings and softmax fitted jointly on four fifths of the texts, calibrated on the rest.

    Of texts without the label, all of whose windows are clean, ``stretches`` stretches
    of ``stretch_words`` words each are learned from, dealt by ``seed``; calibration takes whole texts.  ``odds`` are those of the label among all labelled rows.  Without both classes the model knows the rate only.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if toxic.sum() < 2 or (~toxic).sum() < 2:
        base = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, float(np.log(base / (1 - base))))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(np.flatnonzero(toxic)), rng.permutation(np.flatnonzero(~toxic))])
    rest, own, own_toxic = order[::5], [], []
    for i in np.delete(order, np.s_[::5]):
        words = words_of(values[i])
        starts = [0] if toxic[i] else rng.permutation(range(0, max(1, len(words)), stretch_words))[:stretches]
        own += [words if toxic[i] else words[k : k + stretch_words] for k in starts]
        own_toxic += [toxic[i]] * len(starts)
    epochs = round(epochs * min(4.0, max(1.0, 2000 / len(own))))  # few texts: cheap rounds, so more of them
    worth, bias = fit(Bags.of(own), np.array(own_toxic), rounds, epochs, rate, scale, seed)
    model = Model(worth, bias, 1.0, 0.0)
    top = np.concatenate([largest_windows(g, model, WordWorth(worth)) for g in text_groups([values[i] for i in rest])])
    slope, offset = platt(top, toxic[rest])
    shift = np.log(odds * (~toxic).sum() / toxic.sum()) if odds else 0.0
    return model._replace(slope=slope, offset=float(offset + shift))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with smoothed labels."""
    p, n = y.sum(), (~y).sum()
    t = np.where(y, (p + 1) / (p + 2), 1 / (n + 2))
    mean, dev = x.mean(), x.std() + 1e-9
    a = np.stack([(x - mean) / dev, np.ones_like(x)], axis=1)
    beta = np.array([0.0, np.log((p + 1) / (n + 1))])
    for _ in range(rounds):
        q = sigmoid(a @ beta)
        step = np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), a.T @ (q - t) + 1e-3 * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(beta[0]), 1e-6) / dev
    return slope, float(beta[1] - beta[0] * mean / dev)


class WordWorth(dict):
    """Place of a word in the sums of worth and numbers of grams of the words a worker has met; emptied at ``most`` entries."""

    def __init__(self, worth: np.ndarray, most: int = 800_000):
        self.worth, self.most, self.sums, self.counts = worth.tolist(), most, array("d"), array("d")

    def __missing__(self, word: str) -> int:
        b = word_buckets(word)
        self[word] = n = len(self.sums)
        self.sums.append(sum([self.worth[i] for i in b]))
        self.counts.append(len(b))
        return n

    def places(self, text: str) -> np.ndarray:
        """Places of the words of a text, as ``words_of`` has them."""
        words = text.lower().split() or [""]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return at[np.append(True, at[1:] != at[:-1])]


def largest_windows(values: list[str], model: Model, memo: WordWorth) -> np.ndarray:
    """Logit of the most toxic window of each text."""
    if len(memo) > memo.most:
        memo.clear()
        memo.sums, memo.counts = array("d"), array("d")
    places = [memo.places(x) for x in values]
    flat = np.concatenate(places)
    starts, many = halves(np.array([len(x) for x in places]))
    s, n = (paired(np.add.reduceat(np.frombuffer(x)[flat], starts), many) for x in (memo.sums, memo.counts))
    return np.maximum.reduceat(s / np.maximum(n, LEAST_GRAMS), np.cumsum(many) - many) + model.bias


def score_texts(values: list[str], model: Model, memo: WordWorth) -> np.ndarray:
    return sigmoid(model.slope * largest_windows(values, model, memo) + model.offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_chars: int) -> tuple[list[tuple[str, int]], float]:
    """Texts with their label, at most ``rows`` of label 1 and twice as many of label 0, and the odds of the label.

    Rows are chosen by a hash of the id among all labelled rows that may be
    learned from, before any text is read; conflicting labels of one id count as 1.
    Of these, in the same order, each label takes ids up to ``most_chars`` characters, by lengths
    that Spark sums; only the texts of the ids taken reach the driver.  The first id of a label is always taken.
    """
    learned = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    rated = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learned).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = {r.y: r.n for r in rated.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rated.where("y = 1").orderBy(*order).limit(rows).union(rated.where("y = 0").orderBy(*order).limit(2 * rows))
    # ids, labels and lengths of at most 3 * rows documents
    sizes = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.sum(F.length("text")).alias("size"))
    taken, used = [], {}
    for r in sizes.orderBy("y", *order).collect():
        now = used.get(r.y, 0) + r["size"]
        if now <= most_chars or r.y not in used:
            taken.append((r.doc_id, r.y))
        used[r.y] = now
    ids = docs.sparkSession.createDataFrame(taken, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int")
    got = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").collect()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: (r.y, r.doc_id, r.text))], n.get(1, 0) / max(n.get(0, 0), 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 1500, most_chars: int = 30_000_000, stretches: int = 6, stretch_words: int = 64) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), one row per input row.

    The model is fitted on the driver from a bounded sample: at most ``rows``
    labelled texts of label 1 and twice as many of label 0, and ``most_chars``
    characters of each label, in hash order whatever their length; of a text of label 0 the
    embeddings see ``stretches`` stretches of ``stretch_words`` words.  Rows whose crc32(doc_id as text) is divisible by 5 are held out.  A
    text's score is that of its most toxic window of words, calibrated.  It
    depends on the text only; every text is scored whole, in the tasks that read it.

    Null and empty texts get the score of an empty window.  A null doc_id is not held out.  Labels
    other than 0 and 1 are ignored; without both labels every score is the rate of label 1.
    """
    sample, odds = labelled_sample(docs, labels, label, rows, most_chars)
    model = train([t for t, _ in sample], np.array([y for _, y in sample], dtype=bool), odds, stretches=stretches, stretch_words=stretch_words)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordWorth(shared.value.worth)
        for batch in batches:
            scores = [score_texts(g, shared.value, memo) for g in text_groups(text_column(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
