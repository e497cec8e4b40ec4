"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (an item of fewer words is one window). The alphabet is
the word, the block is two words. SHIFT tells for the block at the end of the search window how far it can move without
missing a pattern; where it says 0 the block's bucket lists the patterns that end in it, their first block is compared,
then the words themselves.

Words are numbered and a pattern is a place in the benchmark's words, so the tables take about 40 bytes a word; a worker builds
them once. A benchmark of over MAX_BROADCAST_BYTES is searched in parts of this size: the corpus is then written once with row
numbers, each part gives the rows that it hits, and these are joined with the rows.

Rows: null or empty text, or text without a word, has no hit and is not contaminated. Repeated documents give one row each.
Items without a word have no window and never occur; equal windows of several items count for each of them. Ties do not arise:
every occurrence counts. Items without item_id hit like the others and count as one item together, but are not in the list of
ids. Items of one id are one item. Texts of any length are searched whole. An empty benchmark hits nothing, an empty table of
documents gives no rows. Columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import alnum_words, keep_rows, kept, map_rows

WINDOW = 13
#: Pattern text that goes to the executors at once.
MAX_BROADCAST_BYTES = 16 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WuManber:
    """All occurrences of the windows of m words that begin at `places` of the numbered words `line`."""

    def __init__(self, line: np.ndarray, places: np.ndarray, m: int):
        self.line, self.m, self.b = line.tolist(), m, min(2, m)
        self.far = m - self.b + 1
        # Every block of every window, by where it ends in the window.
        ends = np.concatenate([places + end for end in range(self.b, m + 1)])
        steps = np.repeat(m - np.arange(self.b, m + 1), len(places))
        codes = self.codes(line)[ends - self.b]
        order = np.lexsort((steps, codes))
        codes, steps = codes[order], steps[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.blocks, self.shift = codes[first], steps[first]
        last = self.codes(line)[places + m - self.b]
        by_last = np.argsort(last, kind="stable")
        self.patterns = places[by_last].tolist()
        self.begin, self.stop = (np.searchsorted(last[by_last], self.blocks, side) for side in ("left", "right"))

    def codes(self, line: np.ndarray) -> np.ndarray:
        """The block at each place but the last one; words that the benchmark lacks give -1."""
        if self.b == 1:
            return line
        return np.where((line[:-1] < 0) | (line[1:] < 0), -1, line[:-1] << 32 | line[1:])

    def search(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, the pattern's place) of every occurrence, by start."""
        m, b, n = self.m, self.b, len(words)
        if n < m:
            return
        codes = self.codes(words)
        at = np.minimum(np.searchsorted(self.blocks, codes), len(self.blocks) - 1)
        known = self.blocks[at] == codes
        if not (known & (self.shift[at] == 0)).any():
            return
        shift, block, own = np.where(known, self.shift[at], self.far).tolist(), at.tolist(), words.tolist()
        end = m
        while end <= n:
            step = shift[end - b]
            if step:
                end += step
                continue
            start, k = end - m, block[end - b]
            first, whole = own[start : start + b], own[start:end]
            for p in self.patterns[self.begin[k] : self.stop[k]]:
                if self.line[p : p + b] == first and self.line[p : p + m] == whole:
                    yield start, p
            end += 1


class Matcher:
    """Numbers of the benchmark's words, and Wu-Manber tables for each length of window that occurs."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        line: list[int] = []
        self.owner: dict[int, str | None] = {}  # by the place at which a window's item begins
        places = defaultdict(list)
        self.starts = []
        for item, text in items:
            words = alnum_words(text)
            if words:
                at, m = len(line), min(len(words), size)
                line += [self.number.setdefault(w, len(self.number)) for w in words]
                places[m].append(np.arange(at, at + len(words) - m + 1))
                self.starts.append(at)
                self.owner[at] = item
        numbers = np.array(line, dtype=np.int64)
        self.tables = [WuManber(numbers, np.concatenate(places[m]), m) for m in sorted(places)]
        self.starts = np.array(self.starts, dtype=np.int64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        spans, found = [], set()
        get = self.number.get
        numbers = np.array([get(w, -1) for w in words], dtype=np.int64)
        for table in self.tables:
            for start, place in table.search(numbers):
                spans.append((start, start + table.m))
                found.add(place)
        items = self.starts[np.searchsorted(self.starts, sorted(found), "right") - 1].tolist() if found else []
        return spans, {self.owner[i] for i in items}


def _parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    part, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if part and size + len(text or "") > limit:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text or "")
    yield part


def covered(n: int, spans: Iterable[tuple[int, int]]) -> int:
    mask = bytearray(n)
    for a, z in spans:
        mask[a:z] = b"\1" * (z - a)
    return mask.count(1)


def _verdicts(ids: list, sizes: list[int], hits: list[tuple[list[tuple[int, int]], set[str | None]]]) -> dict[str, list]:
    n_hit = [covered(n, spans) if spans else 0 for n, (spans, _) in zip(sizes, hits)]
    named = [",".join(sorted(x for x in items if x is not None)) for _, items in hits]
    return {
        "doc_id": ids, "n_words": sizes, "n_hit": n_hit, "n_items": [len(items) for _, items in hits],
        "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in named], "contaminated": [h > 0 and 20 * h >= n for h, n in zip(n_hit, sizes)],
    }


def _matcher(sent: Broadcast, name: str, size: int) -> Matcher:
    return kept(("benchmark", name, size), lambda: Matcher(sent.value, size))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES, id_type: str = "long") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = _parts(benchmark, max_bytes)
    part, following = next(parts), next(parts, None)
    docs, schema = docs.select("doc_id", "text"), SCHEMA.replace("doc_id long", f"doc_id {id_type}")

    def searched(part):
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex
        return lambda: _matcher(sent, name, size)

    if following is None:
        matcher = searched(part)

        def start():
            own = matcher()

            def work(ids, texts):
                split = [alnum_words(t) for t in texts]
                return _verdicts(ids, [len(w) for w in split], [own.hits(w) for w in split])

            return work

        return map_rows(docs, schema, start, keeps=True)

    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = []
    while part is not None:
        matcher = searched(part)

        def start(matcher=matcher):
            own = matcher()

            def work(names, texts):
                hits = [(n, *own.hits(alnum_words(t))) for n, t in zip(names, texts)]
                hits = [h for h in hits if h[1]]
                return {"row": [n for n, *_ in hits], "spans": [[x for s in spans for x in s] for _, spans, _ in hits], "items": [list(items) for *_, items in hits]}

            return work

        found.append(written(map_rows(rows.select("row", "text"), "row long, spans array<int>, items array<string>", start, keeps=True), "decontaminate-hits"))
        part, following = following, next(parts, None)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    hits = every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def end():
        def work(ids, texts, spans, items):
            pairs = [(list(zip(s[::2], s[1::2])) if s else [], set(i or ())) for s, i in zip(spans, items)]
            return _verdicts(ids, [len(alnum_words(t)) for t in texts], pairs)

        return work

    return map_rows(rows.join(hits, "row", "left").select("doc_id", "text", "spans", "items"), schema, end)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that aren't contaminated, each judged by its own text.

    A benchmark of one part filters the rows where they are. Beyond that the contaminated texts' digests are joined out.
    """
    parts = _parts(benchmark, max_bytes)
    part, following = next(parts), next(parts, None)
    if following is None:
        sent, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def start():
            own = _matcher(sent, name, size)

            def keep(texts):
                split = [alnum_words(t) for t in texts]
                return [not x for x in _verdicts(texts, [len(w) for w in split], [own.hits(w) for w in split])["contaminated"]]

            return keep

        return keep_rows(docs, ["text"], start, keeps=True)
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("doc_id"), "text")
    found = decontaminate(texts, benchmark, size, max_bytes, "string")
    bad = written(found.where("contaminated").select(F.col("doc_id").alias("_text_digest")).distinct(), "contaminated")
    return docs.withColumn("_text_digest", F.sha2("text", 256)).join(bad, "_text_digest", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
