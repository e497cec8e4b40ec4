"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its features, a document's is their noisy-or, and
only documents carry labels; gradients through the noisy-or let the labels settle on the sentences that explain them, which
``sentences`` then locates. Features are the words and the first 3, 4 and 5 characters of longer words (insults are inflected
and compounded), chosen on the training labels by their smoothed log-odds.

Training takes a bounded number of labelled documents (TRAIN_DOCS, by a hash of doc_id) outside the held-out third; its word
counts are summed on the executors, at most FEATURES of them (a parameter, the size of the model) and the sample's few features
a sentence reach the driver.

Rows: null and empty texts are one sentence without features. Without labels of both kinds every score is 0 (below 1e-300). Repeated rows
give one row each; a document with several labels counts as toxic if any of them is 1. Rows without doc_id have no label and are
not held out. Features of equal worth are taken in order of their letters. Texts of any length are scored whole. An empty table
gives no rows. Columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .langid import held_out
from .text import keep_rows, map_rows

TRAIN_DOCS = 20_000
FEATURES = 3000
MIN_DOCS = 4
HOLD_OUT_OF, HOLD_OUT = 3, 1
TOXIC_AT = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, at least one."""
    return [m.span() for m in _SENTENCE.finditer(text or "")] or [(0, len(text or ""))]


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "*" for k in (3, 4, 5) if len(word) > k))


class _Known(dict):
    """word -> numbers of its features; remembers at most LIMIT words."""

    LIMIT = 100_000

    def __init__(self, names: list[str]):
        self.at = {f: k for k, f in enumerate(names)}

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = tuple(k for f in features(word) if (k := self.at.get(f)) is not None)
        return got


def bags(text: str | None, known: _Known) -> list[tuple[int, ...]]:
    """For each sentence its distinct features."""
    text = text or ""
    out = []
    for a, z in split_sentences(text):
        hit = set()
        for w in _WORD.findall(text[a:z].lower()):
            hit.update(known[w])
        out.append(tuple(sorted(hit)))
    return out


class NoisyOr:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.known = _Known(names)

    def sentence_scores(self, text: str | None) -> list[float]:
        return [1 / (1 + np.exp(-float(self.bias + sum(self.weights[k] for k in s)))) for s in bags(text, self.known)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of many texts in one pass over their sentences' features."""
        found = [bags(t, self.known) for t in texts]
        sentences = [s for d in found for s in d]
        owner = np.repeat(np.arange(len(found)), list(map(len, found)))
        place = np.repeat(np.arange(len(sentences)), list(map(len, sentences)))
        features = np.fromiter((k for s in sentences for k in s), dtype=np.int64, count=len(place))
        logit = self.bias + np.bincount(place, np.asarray(self.weights)[features] if len(features) else None, minlength=len(sentences))
        none = np.bincount(owner, np.logaddexp(0, logit), minlength=len(found))
        return (-np.expm1(-none)).tolist()


def fit(data: list[tuple[int, dict[tuple[int, ...], int]]], n: int, rounds: int = 600, rate: float = 0.1, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the documents' log-loss. data: label, and how often each set of features is a sentence."""
    doc, count, rows, cols = [], [], [], []
    for d, (_, sents) in enumerate(data):
        for s, c in sents.items():
            rows += [len(doc)] * len(s)
            cols += s
            doc.append(d)
            count.append(c)
    doc, count, rows, cols = np.array(doc), np.array(count, float), np.array(rows, int), np.array(cols, int)
    y = np.array([label for label, _ in data], float)
    x = np.zeros(n + 1)
    x[n] = -8.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, x[cols], minlength=len(doc)) + x[n]
        none = np.bincount(doc, np.logaddexp(0, z) * count, minlength=len(y))  # -log of the probability that no sentence is toxic
        pull = (1 - y) - y * np.exp(-none) / np.maximum(-np.expm1(-none), 1e-12)
        g = pull[doc] * count / (1 + np.exp(-z)) / len(y)
        grad = np.append(np.bincount(cols, g[rows], minlength=n), g.sum())
        grad[:n] += l2 * x[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:n], float(x[n])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, size: int = FEATURES) -> NoisyOr:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), the held-out part left aside."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(HOLD_OUT_OF, HOLD_OUT)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    chosen = written(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (limit << 20) // max(n, 1)), "toxic-labels")
    # The sample has about `limit` rows of 12 bytes whatever the corpus, so it is broadcast.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return NoisyOr([], np.zeros(0), -700.0)

    def count():
        def work(texts, toxic):
            sums = {0: Counter(), 1: Counter()}
            for text, label in zip(texts, toxic):
                sums[label].update({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)})
            names = list(sums[0].keys() | sums[1].keys())
            return {"feature": names, "clean": [sums[0][f] for f in names], "bad": [sums[1][f] for f in names]}

        return work

    counts = map_rows(sample, "feature string, clean long, bad long", count).groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(total[1] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(total[0] + 1.0))
    worth = odds * F.sqrt(F.col("bad").cast("double"))
    names = sorted(r.feature for r in counts.where((F.col("bad") >= MIN_DOCS) & (odds > 1)).orderBy(worth.desc(), "feature").limit(size).collect())
    if not names:
        return NoisyOr([], np.zeros(0), -700.0)

    def sets():
        known = _Known(names)

        def work(texts, toxic):
            found = [Counter(bags(t, known)) for t in texts]
            return {"toxic": toxic, "sets": [[list(s) for s in c] for c in found], "n": [list(c.values()) for c in found]}

        return work

    data = [(r.toxic, {tuple(s): c for s, c in zip(r.sets, r.n)}) for r in map_rows(sample, "toxic int, sets array<array<int>>, n array<int>", sets).toLocalIterator()]
    return NoisyOr(names, *fit(data, len(names)))


def score_toxicity(docs: DataFrame, labels: DataFrame | None, model: NoisyOr | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    model = model or train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def start():
        own = NoisyOr(*sent.value)

        def work(ids, texts, held):
            scores = own.scores(texts)
            return {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(s >= TOXIC_AT) for s in scores]}

        return work

    return map_rows(docs.select("doc_id", "text", held_out(HOLD_OUT_OF, HOLD_OUT)), SCHEMA, start)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that aren't predicted toxic."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def start():
        own = NoisyOr(*sent.value)
        return lambda texts: [s < TOXIC_AT for s in own.scores(texts)]

    return keep_rows(docs, ["text"], start)


def sentences(docs: DataFrame, model: NoisyOr, at: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, start and end (code points), score."""
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def start():
        own = NoisyOr(*sent.value)

        def work(ids, texts):
            out = {"doc_id": [], "start": [], "end": [], "score": []}
            for doc, text in zip(ids, texts):
                for (a, z), s in zip(split_sentences(text), own.sentence_scores(text)):
                    if s >= at:
                        for k, x in zip(out, (doc, a, z, s)):
                            out[k].append(x)
            return out

        return work

    return map_rows(docs.select("doc_id", "text"), "doc_id long, start int, end int, score double", start)
