"""Quality rules with weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes' patterns are counted over all documents (there
are at most 3 ** len(RULES) of them, whatever the corpus), and expectation-maximisation on these counts estimates for each
rule how it votes on good and on bad documents. A document is kept if the posterior probability of good is at least 0.5 and
the base rules (50 words, at most half of them in repeated 3-word windows) hold.

Rows: null, empty and wordless texts have 0 words, fail the base rules and are not kept. Repeated rows give one row each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import ASCII_SPACE, map_rows, utf8

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
KEEP_AT = 0.5
EM_ROUNDS = 200
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_closed_lines", "n_upper", "n_letters", "n_bytes")
STATS = "doc_id long, " + ", ".join(f"{k} long" for k in BASE + MORE)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    v = len(seen)
    key = (ids[:n] * v + ids[1 : n + 1]) * v + ids[2:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    at = order[np.r_[same, False] | np.r_[False, same]]
    mask = np.zeros(len(words), dtype=bool)
    for k in range(3):
        mask[at + k] = True
    return int(mask.sum())


def measures(text: str | None) -> dict[str, int]:
    text = text or ""
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words), "n_lines": len(lines),
        "n_closed_lines": sum(x.rstrip(ASCII_SPACE).endswith((".", "!", "?", ":", '"', "…")) for x in lines),
        "n_upper": len(raw.translate(None, _NOT_UPPER)), "n_letters": len(raw.translate(None, _NOT_LETTERS)), "n_bytes": len(raw) - sum(map(text.count, ASCII_SPACE)),
    }


def _stats():
    def work(ids, texts):
        out = defaultdict(list, doc_id=ids, **{k: [] for k in BASE + MORE})
        for text in texts:
            for k, v in measures(text).items():
                out[k].append(v)
        return out

    return work


def _vote(bad, good):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, F.Column]:
    """Votes by the columns of STATS. A rule abstains between its two bounds."""
    c, share = F.col, lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    word = share("word_chars", "n_words")
    return {
        "length": _vote(c("n_words") < MIN_WORDS, c("n_words") >= 100),
        "repetition": _vote(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        "symbols": _vote(share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.02),
        "duplicate_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, (c("n_lines") >= 3) & (share("n_dup_lines", "n_lines") < 0.1)),
        "word_length": _vote((word < 3) | (word > 12), word.between(4, 9)),
        "letters": _vote(share("n_letters", "n_bytes") < 0.8, share("n_letters", "n_bytes") > 0.92),
        "capitals": _vote(share("n_upper", "n_letters") > 0.3, (c("n_letters") > 0) & (share("n_upper", "n_letters") < 0.1)),
        "closed_lines": _vote((c("n_lines") > 0) & (share("n_closed_lines", "n_lines") < 0.3), share("n_closed_lines", "n_lines") > 0.8),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and their counts: prior of good, and [rule, bad or good, vote + 1] probabilities."""
    n_rules = votes.shape[1]
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = np.clip(0.5 + votes.sum(axis=1) / (2 * n_rules), 0.05, 0.95)
    for _ in range(rounds):
        total = np.stack([counts * (1 - good), counts * good])
        table = (np.einsum("cp,prv->rcv", total, onehot) + 1) / (total.sum(axis=1)[None, :, None] + 3)
        prior = float((total[1].sum() + 1) / (counts.sum() + 2))
        new = posterior(votes, prior, table)
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(table)
    pick = lambda c: sum(logs[r, c, votes[:, r] + 1] for r in range(votes.shape[1]))
    return 1 / (1 + np.exp(np.clip(np.log1p(-prior) - np.log(prior) + pick(0) - pick(1), -700, 700)))


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, posterior for each row of docs (doc_id, text)."""
    spark, named = docs.sparkSession, rules()
    stats = written(map_rows(docs.select("doc_id", "text"), STATS, _stats).select("doc_id", *BASE, *(v.cast("tinyint").alias(f"v_{k}") for k, v in named.items())), "quality")
    names = [f"v_{k}" for k in named]
    # At most 3 ** 8 rows: the only thing that the driver sees.
    found = stats.groupBy(*names).count().collect()
    if found:
        votes, counts = np.array([r[:-1] for r in found], dtype=int), np.array([r[-1] for r in found], dtype=float)
        fitted = posterior(votes, *fit_votes(votes, counts))
        rows = [(*map(int, v), float(p)) for v, p in zip(votes, fitted)]
    else:
        rows = []
    table = spark.createDataFrame(rows, ", ".join(f"{k} tinyint" for k in names) + ", posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.join(F.broadcast(table), names, "left").select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior")
