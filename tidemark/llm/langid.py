"""Language identification by rank-order profiles.

A text becomes its letters, lower-cased, with one space for each run of anything else and at both ends. Its 1-, 2- and
3-grams of characters (never the lone space) are ranked by count, ties by code. A language's profile is the ranking over its
labelled training documents. A document goes to the language with the least out-of-place distance: for each of its top
n-grams the difference of the two ranks, or PROFILE where the profile lacks it.

Training counts n-grams in a bounded number of labelled documents a language (TRAIN_PER_LANG, chosen by a hash of doc_id),
summed on the executors; what reaches the driver is PROFILE rows a language. Prediction reads whole texts.

Rows: a text that is null, or has no letter, is ``und`` with score 0. Ties go to the first language in order. If nothing is
labelled every row is ``und``. The score is 1 - distance / largest possible distance. Repeated rows give one row each and count
each in training. Rows without doc_id are not held out. Texts of any length are read whole. An empty table gives no rows. Columns
other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import keep_rows, map_rows

PROFILE = 400
TRAIN_PER_LANG = 4000
HOLD_OUT_OF, HOLD_OUT = 4, 2
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: A document below this score is like no profile; texts in a learned language lie far above it.
MIN_SCORE = 0.2
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, each packed into 63 bits (21 a character), and their counts."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return none, none
    codes[~letter] = _SPACE
    codes = np.concatenate([[_SPACE], codes, [_SPACE]])
    codes = codes[np.r_[True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)]]
    pairs = codes[:-1] << 21 | codes[1:]
    grams = np.concatenate([codes[codes != _SPACE], pairs, pairs[:-1] << 21 | codes[2:]])
    grams.sort()
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.diff(np.r_[first, len(grams)])


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent, in order."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]]):
        """rows: language, n-gram, rank from 0."""
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({g for _, g, _ in rows}), dtype=np.int64)
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for lang, gram, rank in rows:
            self.rank[self.langs.index(lang), np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*ngrams(text), PROFILE)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        rank = self.rank[:, at]
        distance = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(top)))).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(top)))


def held_out(of: int, rest: int) -> F.Column:
    """Whether a document belongs to the held-out part: crc32 of doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """Profiles from docs (doc_id, text, lang), the held-out part left aside."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(~held_out(HOLD_OUT_OF, HOLD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.groupBy("lang").count()
    picked = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < F.ceil(F.lit(per_lang << 20) / F.col("count"))

    def start():
        def work(langs, texts):
            sums: dict[str, list] = defaultdict(list)
            for lang, text in zip(langs, texts):
                sums[lang].append(ngrams(text))
            out = {"lang": [], "gram": [], "n": []}
            for lang, parts in sums.items():
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(grams))
                out["lang"] += [lang] * len(grams)
                out["gram"] += grams.tolist()
                out["n"] += counts.astype(np.int64).tolist()
            return out

        return work

    sample = known.join(F.broadcast(n), "lang").where(picked).select("lang", "text")
    counts = map_rows(sample, "lang string, gram long, n long", start).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return [tuple(r) for r in counts.select("lang", "gram", (order - 1).cast("long").alias("rank")).where(F.col("rank") < size).collect()]


def identify(docs: DataFrame, rows: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, and lang if rows isn't given)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs) if rows is None else rows)

    def start():
        profiles = Profiles(sent.value)

        def work(ids, texts, held):
            found = [profiles.predict(t) for t in texts]
            return {"doc_id": ids, "held_out": held, "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return work

    return map_rows(docs.select("doc_id", "text", held_out(HOLD_OUT_OF, HOLD_OUT)), SCHEMA, start)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose text is in a learned language."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def start():
        profiles = Profiles(sent.value)

        def keep(texts):
            found = [profiles.predict(t) for t in texts]
            return [lang != UNKNOWN and score >= MIN_SCORE for lang, score in found]

        return keep

    return keep_rows(docs, ["text"], start)
