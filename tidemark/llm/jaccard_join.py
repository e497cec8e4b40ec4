"""N-gram Jaccard join: links, and connected components, of documents whose shingle sets have a Jaccard similarity of 0.75 or more.

Every step is exact and nothing is capped. No step emits the pairs of a group: inside a group links are counted where its
documents meet, and only counts leave.

1. Documents with equal sets form a class (128 bits of the sorted set, 64 of them its key); one document of a class goes on.
2. Shingles are ordered by document count where they are common, then by hash. Two linked sets share a shingle in the first
   n // 7 + 1 of the smaller and the first n // 4 + 1 of the larger, so only these are posted to inverted lists. Common
   shingles' lists are dealt over several tasks; a long list that was not foreseen is cut while it streams by.
3. Short lists (at most STAR documents) give their pairs. In long lists each document is paired with the most central document
   of one or two of its lists, and what links by that forms groups.
4. Groups: the links among all members of a group are counted by the search of step 6, in chunks of bounded size, every
   two chunks of a large group together.
5. Candidates: pairs from short lists, and pairs that meet in a long list, that are of different groups, pass the size and
   position filters and whose parity bitmaps differ in no more bits than two linked sets can.
6. T-occurrence search: a block indexes documents in inverted lists; a query merges its short lists, on a heap with skips or, if
   they are many entries, by counting, probes its long lists by binary search (DivideSkip), and retains the documents that reach
   the required overlap.
7. Links are merged by alternating large and small stars; a component's id is its smallest doc_id.

Rows: null, empty and wordless texts have n_shingles 0, no link, and are their own component. Fewer words than SHINGLE are one
shingle. Repeated rows give one row each, in one component, linked with each other. Rows without doc_id link to nothing and have
no component_id. Texts of any length are compared whole. An empty table gives no rows. Columns other than doc_id and text are
not read. Equal doc_ids with different texts are different documents; where two components have documents with one doc_id, both
may show that id. Ties do not matter: the result does not depend on which document of a class or list is taken first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from functools import reduce
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import drop_written, written
from .text import Sieve, give_back, kept, lower_space_words, map_rows, small_batches

SHINGLE = 5
#: The threshold as a fraction of integers.
NEAR, OF = 75, 100
#: Common shingles that the order knows: a bounded list, which only steers how much work there is. TASK_HOT come from a task.
HOT, HOT_MIN, TASK_HOT = 300_000, 8, 100_000
#: Slots of a task's table of shingles met before, and the least and most bits of a document's parity bitmap.
SLOTS, LEAST_BITS, MOST_BITS = 1 << 24, 512, 1 << 17
#: Lists are dealt or cut into parts of about this size; lists longer than STAR form groups first.
LIST_ROWS, STAR = 2000, 8
#: Sets in a block of the search, in bytes; partners of an indexed document in one block.
BLOCK_BYTES, PARTNERS = 8 << 20, 500
#: DivideSkip's cost ratio; lists of at most PROBED entries are always merged; with more entries than HEAP_ROWS by counting.
MU, PROBED, HEAP_ROWS = 0.0085, 256, 256
#: Parts of a hub's edges, and of a class's rows.
HUB_PARTS = 16
#: A column beside those of the documents.
KEY = "_jaccard_key"
#: Odd multipliers of a shingle's words, which are 64-bit hashes already.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_FINAL = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


#: Word hashes and set keys that a worker remembers.
WORD_HASHES, SEEN_KEYS = 100_000, 100_000


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) >= WORD_HASHES:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _words() -> _WordHash:
    return kept("jaccard-words", _WordHash)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = lower_space_words(text)
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words().__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(h))
    n = len(h) - width + 1
    s = h[:n] * _MIX[0]
    for k in range(1, width):
        s += h[k : k + n] * (_MIX[k % 5] + np.uint64(2 * (k // 5)))
    s += np.uint64(width)
    s ^= s >> _SHIFT
    s *= _FINAL
    s ^= s >> _SHIFT
    s = s.view(np.int64)
    s.sort()
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def required(n_x: int, n_y):
    """The least overlap of two linked sets of these sizes."""
    return -(-NEAR * (n_x + n_y) // (OF + NEAR))


def parity(s: np.ndarray) -> bytes:
    """Bitmap of 2 to 4 bits a shingle, in which each shingle turns one: two sets' bitmaps differ in at most as many bits as the sets in shingles.

    Its halves, one turned by the other, are the bitmap of half the size.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s)).bit_length()))
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as ones of `size` words."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class _Repeats:
    """Counts of the shingles that a stream of sets repeats, in bounded memory: what falls on a slot met before is counted."""

    def __init__(self):
        self.met = np.zeros(SLOTS, dtype=bool)
        self.tokens, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, s: np.ndarray) -> None:
        at = s & (SLOTS - 1)
        again = s[self.met[at]]
        self.met[at] = True
        self.waiting.append(again)
        self.n += len(again)
        if self.n > 1_000_000:
            self.merge()

    def merge(self) -> None:
        got, n = np.unique(np.concatenate([self.tokens[:0], *self.waiting]), return_counts=True)
        tokens, at = np.unique(np.concatenate([self.tokens, got]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), minlength=len(tokens)).astype(np.int64)
        if len(tokens) > 10 * TASK_HOT:
            keep = np.sort(np.argpartition(-counts, 5 * TASK_HOT)[: 5 * TASK_HOT])
            tokens, counts = tokens[keep], counts[keep]
        self.tokens, self.counts, self.waiting, self.n = tokens, counts, [], 0

    def top(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        keep = np.argsort(-self.counts, kind="stable")[:size]
        return self.tokens[keep], self.counts[keep]


SIGNATURES = "doc_id long, n long, key long, parity binary, hot array<long>, hot_n array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and a last one with the common shingles of the task."""
    repeats, seen = _Repeats(), set()
    longs = pa.list_(pa.int64())
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        sets = [shingle_set(t) for t in texts]
        keys = [set_key(s) for s in sets]
        for s, k in zip(sets, keys):
            if k not in seen:
                seen.add(k)
                repeats.add(s)
        if len(seen) > SEEN_KEYS:
            seen.clear()
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": pa.array(map(len, sets), pa.int64()), "key": pa.array(map(short_key, keys), pa.int64()), "parity": pa.array(map(parity, sets), pa.binary()), "hot": pa.nulls(len(ids), longs), "hot_n": pa.nulls(len(ids), longs)})
    tokens, counts = repeats.top(TASK_HOT)
    none = pa.nulls(1, pa.int64())
    yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "key": none, "parity": pa.nulls(1, pa.binary()), "hot": pa.array([tokens.tolist()], longs), "hot_n": pa.array([counts.tolist()], longs)})


class Order:
    """The order of shingles: those not known as common by hash, then the common ones from rare to frequent.

    It also deals the lists: a slot is a shingle, or a part of the list of a common one.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, list_rows: int):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[tokens & ((1 << 22) - 1)] = True
        self.parts = -(-self.counts // list_rows)

    @staticmethod
    def _slot(token, part):
        return (token.view(np.uint64) + part.astype(np.uint64) * _MIX[1]).view(np.int64)

    def slots(self, prefix: np.ndarray, key: int) -> np.ndarray:
        """The slots to which a document with this key is posted."""
        if not len(self.tokens):
            return prefix
        found = np.minimum(np.searchsorted(self.tokens, prefix), len(self.tokens) - 1)
        parts = np.where(self.tokens[found] == prefix, self.parts[found], 1)
        if (parts <= 1).all():
            return prefix
        return self._slot(prefix, np.int64(key) % parts)

    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slots of lists in several parts, sorted, with their shingles and parts."""
        many = np.flatnonzero(self.parts > 1)
        token = np.repeat(self.tokens[many], self.parts[many])
        part = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in self.parts[many])])
        slot = self._slot(token, part)
        order = np.argsort(slot)
        return slot[order], token[order], part[order]

    def prefix(self, s: np.ndarray) -> np.ndarray:
        size = len(s) // 4 + 1
        at = np.flatnonzero(self.maybe[s & ((1 << 22) - 1)])
        if not len(at) or at[0] >= size:
            return s[:size]
        found = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
        weight = np.zeros(len(s), np.int64)
        weight[at] = np.where(self.tokens[found] == s[at], self.counts[found], 0)
        if not weight[:size].any():
            return s[:size]
        free = np.flatnonzero(weight == 0)
        if len(free) >= size:
            return s[free[:size]]
        return s[np.lexsort((s, weight))[:size]]


def _lists(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], most: int) -> Iterator[dict[str, np.ndarray]]:
    """Lists of a stream sorted by the columns `by`: for each batch its finished lists together, the last one held back.

    What is held back of one list goes on once it has more than `most` rows; `piece` counts such parts of a list.
    """
    held: list[pa.RecordBatch] = []
    rows, name, piece = 0, None, 0

    def give(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out = pa.Table.from_batches(parts)
        g = {c: out.column(c).to_numpy() for c in out.column_names}
        g["piece"] = np.where(np.logical_and.reduce([g[c] == x for c, x in zip(by, name)]), piece, 0)
        return g

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        first, last = tuple(int(c[0]) for c in cols), tuple(int(c[-1]) for c in cols)
        name = first if name is None else name
        if name == last:
            held.append(batch)
            rows += batch.num_rows
            if rows > most:
                yield give(held)
                held, rows, piece = [], 0, piece + 1
            continue
        others = np.flatnonzero(np.logical_or.reduce([c != x for c, x in zip(cols, last)]))
        cut = int(others[-1]) + 1 if len(others) else 0
        yield give([*held, batch.slice(0, cut)])
        held, rows, name, piece = [batch.slice(cut)], batch.num_rows - cut, last, 0
    if held:
        yield give(held)


def _bounds(g: dict[str, np.ndarray], by: tuple[str, ...]) -> np.ndarray:
    change = np.logical_or.reduce([g[c][1:] != g[c][:-1] for c in (*by, "piece")])
    return np.flatnonzero(np.r_[True, change, True])


SHARED = "token long, part long, key long, n int, pos int, size int, other long"


def _shared(owners: tuple[np.ndarray, np.ndarray, np.ndarray], star: int, list_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key, other) of lists of at most `star` documents, and the rows of longer lists, each document once."""
    slots, tokens, parts = owners
    pairs = _Pairs()
    ints = lambda x: pa.array(x, pa.int32())

    def met() -> pa.RecordBatch:
        a, b = pairs.take()
        none = pa.nulls(len(a), pa.int32())
        return pa.RecordBatch.from_pydict({"token": pa.nulls(len(a), pa.int64()), "part": pa.nulls(len(a), pa.int64()), "key": pa.array(a), "n": none, "pos": none, "size": none, "other": pa.array(b)})

    for g in _lists(batches, ("slot",), list_rows):
        at = _bounds(g, ("slot",))
        new = np.r_[True, (g["key"][1:] != g["key"][:-1]) | (g["n"][1:] != g["n"][:-1])]
        new[at[:-1]] = True
        slot = g["slot"]
        found = np.minimum(np.searchsorted(slots, slot), max(len(slots) - 1, 0))
        dealt = slots[found] == slot if len(slots) else np.zeros(len(slot), dtype=bool)
        size = np.repeat(np.add.reduceat(new, at[:-1]), np.diff(at))
        split = dealt | (g["piece"] > 0)
        keep = new & ((size > 1) | split)
        long = keep & ((size > star) | split)
        if long.any():
            token = np.where(dealt, tokens[found], slot) if len(slots) else slot
            # Parts of a shingle's list: those foreseen have the first numbers, what was cut further ones.
            part = np.where(dealt, parts[found], 0) + (g["piece"].astype(np.int64) << 32) if len(slots) else g["piece"].astype(np.int64) << 32
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[long]), "part": pa.array(part[long]), "key": pa.array(g["key"][long]), "n": ints(g["n"][long]), "pos": ints(g["pos"][long]), "size": ints(size[long]), "other": pa.nulls(int(long.sum()), pa.int64())})
        short = np.flatnonzero(keep & ~long)
        if len(short):
            key, n, pos, s = (g[c][short] for c in ("key", "n", "pos", "slot"))
            for d in range(1, star):  # each with the d-th behind it in its list
                a = np.flatnonzero(s[d:] == s[:-d])
                b = a + d
                ok = _ordered_fits(n[a], key[a], pos[a], n[b], key[b], pos[b])
                pairs.add(key[a[ok]], key[b[ok]])
            if pairs.n > 200_000:
                yield met()
    yield met()
    give_back()


def _fits(n_x, n_y, pos_x, pos_y):
    """Size and position filters for n_x <= n_y."""
    return (OF * n_x >= NEAR * n_y) & (pos_x < n_x // 7 + 1) & (np.minimum(n_x - pos_x, n_y - pos_y) >= required(n_x, n_y))


def _ordered_fits(n_a, k_a, p_a, n_b, k_b, p_b):
    swap = (n_a > n_b) | ((n_a == n_b) & (k_a > k_b))
    pick = lambda a, b: (np.where(swap, b, a), np.where(swap, a, b))
    (n_x, n_y), (p_x, p_y) = pick(n_a, n_b), pick(p_a, p_b)
    return _fits(n_x, n_y, p_x, p_y)


class _Pairs:
    """Distinct pairs; a bounded part of them at a time."""

    def __init__(self):
        self.a, self.b, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(np.minimum(a, b))
        self.b.append(np.maximum(a, b))
        self.n += len(a)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.__init__()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        return a[new], b[new]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each long list the pairs of different groups that pass the filters."""
    out = _Pairs()
    batch_of = lambda p: pa.RecordBatch.from_pydict({"a": pa.array(p[0]), "b": pa.array(p[1])})
    by = ("token", "part")
    held: dict[str, list[np.ndarray]] = {}
    last = None

    def meet(g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, key, n, pos, guest = (g[c] for c in ("comp", "key", "n", "pos", "guest"))
        if own.min() == own.max():
            return
        _, which, counts = np.unique(own, return_inverse=True, return_counts=True)
        main = which == counts.argmax()
        for i in np.flatnonzero(~main):
            ok = _ordered_fits(n, key, pos, n[i], key[i], pos[i]) & (own != own[i]) & ~(guest & guest[i])
            ok &= main | (np.arange(len(n)) > i)  # two outside the main group meet once
            out.add(key[ok], np.full(int(ok.sum()), key[i]))
            if out.n > 200_000:
                yield batch_of(out.take())

    for g in _lists(batches, by, LIST_ROWS):
        at = _bounds(g, by)
        for a, z in zip(at[:-1], at[1:]):
            name = (int(g["token"][a]), int(g["part"][a]))
            if name != last and held:
                yield from meet({c: np.concatenate(x) for c, x in held.items()})
                held = {}
            last = name
            for c in ("comp", "key", "n", "pos", "guest"):
                held.setdefault(c, []).append(g[c][a:z])
    if held:
        yield from meet({c: np.concatenate(x) for c, x in held.items()})
    yield batch_of(out.take())
    give_back()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow a link."""
    for batch in batches:
        c = {k: batch.column(k) for k in batch.schema.names}
        n_a, n_b = c["n_a"].to_numpy(), c["n_b"].to_numpy()
        data = [c[k].to_pylist() for k in ("parity_a", "parity_b")]
        sizes = [np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in data]
        ok = np.zeros(len(n_a), dtype=bool)
        for pair in set(zip(*(x.tolist() for x in sizes))):
            at = np.flatnonzero((sizes[0] == pair[0]) & (sizes[1] == pair[1]))
            a, b = (folded(np.frombuffer(b"".join([x[k] for k in at]), dtype=np.uint64).reshape(len(at), -1), min(pair) // 8) for x in data)
            ok[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= (n_a + n_b - 2 * required(n_a, n_b))[at]
        yield pa.RecordBatch.from_pydict({k: c[k].filter(pa.array(ok)) for k in ("a", "b", "n_a", "n_b")})


def divide_skip(entries: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements that occur in at least `least` of the sorted lists entries[start:end], and how often they do."""
    none = np.zeros(0, np.int64)
    if len(starts) < least or least < 1:
        return none, none
    sizes = ends - starts
    longest = int(sizes.max())
    n_long = min(least - 1, int(least / (MU * log2(max(2, longest)) + 1)), int((sizes > PROBED).sum()))
    order = np.argsort(-sizes, kind="stable") if n_long else np.arange(len(sizes))
    long, short, need = order[:n_long], order[n_long:], least - n_long
    if sizes[short].sum() > HEAP_ROWS:
        width = sizes[short]
        at = np.repeat(starts[short] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        count = np.bincount(entries[at])
        found = np.flatnonzero(count >= need)
        n = count[found]
    else:
        found, n = merge_skip([entries[a:z].tolist() for a, z in zip(starts[short].tolist(), ends[short].tolist())], need)
    for k in long.tolist():
        if not len(found):
            break
        x = entries[starts[k] : ends[k]]
        p = np.minimum(np.searchsorted(x, found), len(x) - 1)
        n = n + (x[p] == found)
    return found[n >= least], n[n >= least]


def merge_skip(lists: list[list[int]], need: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements that occur in at least `need` of the sorted lists, and how often, by a heap of the lists' heads."""
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapify(heap)
    at, found, counts = [0] * len(lists), [], []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            found.append(top)
            counts.append(len(popped))
            target = top + 1
        else:
            while heap and len(popped) < need - 1:  # nothing below the next head can still reach the threshold
                popped.append(heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in popped:
            x = lists[k]
            p = at[k] = bisect_left(x, target, at[k])
            if p < len(x):
                heappush(heap, (x[p], k))
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


class Block:
    """An inverted index of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        self.sizes = np.array([len(sets[k]) for k in self.order], dtype=np.int64)
        tokens = np.concatenate([np.zeros(0, np.int64), *(sets[k] for k in self.order)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)])
        self.tokens, self.ends = tokens[self.starts], np.r_[self.starts[1:], len(tokens)]
        self.order = np.array(self.order, dtype=np.int64)

    def search(self, s: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with s, itself included if it is one of them."""
        if not len(self.tokens):
            return self.order[:0]
        p = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        p = p[self.tokens[p] == s]
        found, n = divide_skip(self.owner, self.starts[p], self.ends[p], -(-NEAR * len(s) // OF))
        return self.order[found[OF * n >= NEAR * (len(s) + self.sizes[found] - n)]]


def search_block(index: dict[int, np.ndarray], queries: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Linked (query, indexed document) pairs."""
    names = list(index)
    block = Block(list(index.values()))
    return [(q, names[k]) for q, s in queries.items() for k in block.search(s).tolist() if names[k] != q]


def _unpack(data: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in data]


def _search(table: pa.Table) -> pa.Table:
    roles, keys, sets = table.column("role").to_pylist(), table.column("key").to_pylist(), _unpack(table.column("set"))
    index, queries = ({k: s for k, s, r in zip(keys, sets, roles) if r == role} for role in (0, 1))
    found = search_block(index, queries)
    give_back()
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def _count(table: pa.Table) -> pa.Table:
    """Links of the members of groups, weighed with the rows of the class at the other end: inside a chunk of a group, or between two."""
    out: dict[str, list] = {"key": [], "more": []}
    keys, rows, sets = table.column("key").to_numpy(), table.column("rows").to_numpy(), _unpack(table.column("set"))
    meetings: dict[tuple[int, int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    met = set()
    for k, (root, low, high, chunk) in enumerate(zip(*(table.column(c).to_pylist() for c in ("root", "low", "high", "chunk")))):
        if (root, low, high, keys[k]) not in met:  # a set may come from several tasks
            met.add((root, low, high, keys[k]))
            meetings[root, low, high][chunk].append(k)
    for (_, low, high), parts in meetings.items():
        one, two = np.array(parts[low], dtype=np.int64), np.array(parts[high], dtype=np.int64)
        block = Block([sets[k] for k in one])
        more = np.zeros(len(keys), np.int64)
        for q in two.tolist():
            linked = one[block.search(sets[q])]
            linked = linked[linked != q]
            more[q] += rows[linked].sum()
            if low != high:
                more[linked] += rows[q]
        members = np.flatnonzero(more)
        out["key"] += keys[members].tolist()
        out["more"] += more[members].tolist()
    give_back()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def alike(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that can link by their sizes and bitmaps and are not of one group yet. ends: key, n, parity, comp."""
    for k in "ab":
        pairs = pairs.join(ends.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"), F.col("comp").alias(f"comp_{k}")), k)
    like = (F.col("comp_a") != F.col("comp_b")) & (F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * NEAR)
    return pairs.where(like).select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(_alike, "a long, b long, n_a long, n_b long")


def stars(lists: DataFrame) -> DataFrame:
    """At most two pairs (a, b) for each document of long lists: with the most central document of its longest list and of another one.

    A document is the more central, the longer the lists are that it is in.
    """
    per_key = written(lists.groupBy("key").agg(F.sum("size").alias("score"), F.max_by(F.struct("token", "part"), F.struct("size", "token")).alias("t1"), F.max_by(F.struct("token", "part"), F.xxhash64("token")).alias("t2")), "jaccard-central")
    # One row a list, repeated for each part of it: the members of a long list are joined part by part.
    heads = lists.join(per_key.select("key", "score"), "key").groupBy("token").agg(F.max_by("key", F.struct("score", "key")).alias("head"), F.collect_set("part").alias("parts"))
    heads = heads.select("token", "head", F.explode("parts").alias("part"))
    member = per_key.select("key", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("t")).select("key", "t.token", "t.part")
    pairs = member.join(heads, ["token", "part"]).where("key <> head")
    return pairs.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()


def sets_of(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """key, set (little-endian 64-bit) of at least the classes with these keys; each task gives a class once."""
    wanted = written(classes.join(keys, "key").select("rep"), "jaccard-wanted")
    near = Sieve(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").split(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id", True)

    def start():
        seen: set[int] = set()

        def work(texts):
            out = {"key": [], "set": []}
            for s in map(shingle_set, texts):
                key = short_key(set_key(s))
                if key not in seen:
                    seen.add(key)
                    out["key"].append(key)
                    out["set"].append(s.tobytes())
            return out

        return work

    # Others pass as well: by chance, or as they share a doc_id with a wanted one. The joins by key leave them out.
    return written(map_rows(near.select("text"), "key long, set binary", start, keeps=True), "jaccard-near")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of the distinct pairs (a, b, n_a, n_b) that link, by T-occurrence search in blocks; and the sets at their ends.

    Links that the search meets besides may be among them.
    """
    size = pairs.agg(F.sum((F.col("n_a") + F.col("n_b")) * 8)).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    near = sets_of(docs, classes, ends.select("key"))
    # The end with fewer partners is indexed, so a document with very many partners is a query in many blocks.
    deg = lambda c: ends.select(F.col("key").alias(c), F.col("degree").alias(f"d_{c}"))
    sides = pairs.select("a", "b").join(deg("a"), "a").join(deg("b"), "b")
    a_indexed = (F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("a") < F.col("b")))
    sides = sides.select(F.when(a_indexed, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(a_indexed, F.col("b")).otherwise(F.col("a")).alias("q"), F.least("d_a", "d_b").alias("d"))
    share = F.pmod(F.xxhash64("q"), F.ceil(F.col("d") / PARTNERS))
    block = F.pmod(F.xxhash64("i", share), F.lit(blocks))
    places = sides.select(block.alias("block"), F.explode(F.array(F.struct(F.col("i").alias("key"), F.lit(0).alias("role")), F.struct(F.col("q").alias("key"), F.lit(1).alias("role")))).alias("x")).select("block", "x.*").distinct()
    found = near.join(places, "key").select("key", "set", "block", "role").groupBy("block").applyInArrow(_search, "a long, b long").distinct()
    return found, near


def inner_links(groups: DataFrame, near: DataFrame, classes: DataFrame) -> DataFrame:
    """key, more: the rows that a member of a group (key, root) is linked with in the other classes of its group.

    A group's sets are cut into chunks of BLOCK_BYTES / 2; every two chunks meet in a block. Small groups share blocks.
    """
    members = written(groups.join(classes.select("key", "n", "rows"), "key"), "jaccard-groups")
    sizes = members.groupBy("root").agg(F.sum(F.col("n") * 8).alias("bytes"))
    chunks = F.ceil(F.col("bytes") / (BLOCK_BYTES // 2))
    total = sizes.where(chunks == 1).agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = members.join(sizes.select("root", chunks.alias("chunks")), "root").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("low", F.least("chunk", "with")).withColumn("high", F.greatest("chunk", "with"))
    block = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(blocks))).otherwise(F.xxhash64("root", "low", "high"))
    blocks_of = near.join(met.select("key", "root", "chunk", "low", "high", "rows", block.alias("block")), "key")
    return blocks_of.groupBy("block").applyInArrow(_count, "key long, more long").groupBy("key").agg(F.sum("more").alias("more"))


def components(edges: DataFrame) -> DataFrame:
    """key, root for every key of edges (a, b): the least key that it is connected to; by alternating large and small stars.

    A hub's edges are joined in HUB_PARTS parts.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    part = F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).alias("part")
    spread = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))))
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").select("u", "v", part).join(spread(least), ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("u", "v", part).join(spread(low), ["u", "part"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        old, e = e, written(small.distinct(), "components")
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark is not None:
            drop_written(old)
        if seen == mark:
            return e.select(F.col("u").alias("key"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = seen


def _hot(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles and about how many classes have them, summed over the tasks' shares."""
    found = rows.where("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy(F.col("x.hot").alias("token")).agg((F.sum("x.hot_n") + 1).alias("n"))
    hot = found.where(F.col("n") >= HOT_MIN).orderBy(F.desc("n"), "token").limit(HOT).toArrow()
    return hot.column("token").to_numpy(), hot.column("n").to_numpy()


def _inverted(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """SHARED: what lists of two or more classes give."""
    sent, star, list_rows = docs.sparkSession.sparkContext.broadcast(hot), STAR, LIST_ROWS

    def start():
        order, seen = Order(*sent.value, list_rows), set()

        def work(ids, texts):
            out = {"key": [], "n": [], "prefix": []}
            for doc, text in zip(ids, texts):
                s = shingle_set(text)
                key = short_key(set_key(s))
                if doc is None or not len(s) or key in seen:  # a class is posted once by each task; lists drop what is left
                    continue
                seen.add(key)
                out["key"].append(key)
                out["n"].append(len(s))
                out["prefix"].append(order.slots(order.prefix(s), key))
            if len(seen) > SEEN_KEYS:
                seen.clear()
            return out

        return work

    posts = map_rows(docs.select("doc_id", "text"), "key long, n int, prefix array<long>", start, keeps=True).select("key", "n", F.posexplode("prefix").alias("pos", "slot"))

    def run(batches):
        yield from _shared(Order(*sent.value, list_rows).owners(), star, list_rows, batches)

    return posts.repartition("slot").sortWithinPartitions("slot", "n", "key").mapInArrow(run, SHARED)


class Found(NamedTuple):
    """rows: doc_id, key, n of each row. classes: key, n, rep, parity, rows. Of links: edges (a, b) that connect the same keys, and key, more (linked rows of other classes)."""

    rows: DataFrame
    classes: DataFrame
    edges: DataFrame | None
    more: DataFrame | None


def _find(docs: DataFrame) -> Found:
    small_batches(docs.sparkSession)
    signed = written(docs.select("doc_id", "text").mapInArrow(_signatures, SIGNATURES), "jaccard-sets")
    rows = signed.where("hot is null")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity"), F.count("*").alias("rows")), "jaccard-classes")
    met = written(_inverted(docs, _hot(signed)), "jaccard-lists")
    lists = met.where("other is null").drop("other")
    pairs = met.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))

    edges, counts = [], []
    single = classes.withColumn("comp", F.col("key"))
    first = written(alike(stars(lists), single), "jaccard-stars")
    grouped = single
    if not first.isEmpty():
        found, near = linked(first, docs, classes)
        groups = written(components(written(found, "jaccard-star-links")), "jaccard-roots")
        grouped = classes.join(groups, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
        edges.append(groups.select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts.append(inner_links(groups, near, classes))
        lists = lists.join(groups, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    else:
        lists = lists.withColumn("comp", F.col("key"))
    lists = written(lists, "jaccard-long").withColumn("guest", F.lit(False))
    # A list in several parts: documents outside its main group also visit the other parts.
    parts = lists.groupBy("token").agg(F.collect_set("part").alias("parts")).where(F.size("parts") > 1)
    split = lists.join(parts.select("token", F.explode("parts").alias("part")), ["token", "part"])
    main = split.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    each = parts.join(main, "token").withColumn("part", F.explode("parts"))
    visits = lists.join(each, ["token", "part"]).where("comp <> main").withColumn("to", F.explode("parts")).where("to <> part").withColumn("part", F.col("to")).withColumn("guest", F.lit(True))
    meeting = lists.unionByName(visits.select(*lists.columns)).repartition("token", "part").sortWithinPartitions("token", "part", "n", "key")
    pairs = pairs.union(meeting.mapInArrow(_candidates, "a long, b long")).distinct()
    candidates = written(alike(pairs, grouped), "jaccard-candidates")
    if not candidates.isEmpty():
        found, _ = linked(candidates, docs, classes)
        links = written(found, "jaccard-links")
        if edges:  # the search also meets links inside groups, which are counted already
            comps = grouped.select("key", "comp")
            for k in "ab":
                links = links.join(comps.select(F.col("key").alias(k), F.col("comp").alias(f"comp_{k}")), k)
            links = links.where("comp_a <> comp_b").select("a", "b")
        edges.append(links)
        both = links.union(links.select("b", "a")).toDF("key", "other")
        counts.append(both.join(classes.select(F.col("key").alias("other"), "rows"), "other").groupBy("key").agg(F.sum("rows").alias("more")))
    more = reduce(DataFrame.union, counts).groupBy("key").agg(F.sum("more").alias("more")) if counts else None
    return Found(rows, classes, reduce(DataFrame.union, edges) if edges else None, more)


def _label(found: Found) -> DataFrame:
    """key, root, rep (the class's smallest doc_id), rows, component_id, more (linked rows in other classes) of each class."""
    classes = found.classes.select("key", "rep", "rows")
    if found.edges is None:
        return classes.select("key", F.col("key").alias("root"), "rep", "rows", F.col("rep").alias("component_id"), F.lit(0).cast("long").alias("more"))
    labelled = classes.join(components(found.edges), "key", "left").withColumn("root", F.coalesce("root", "key")).join(found.more, "key", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    labelled = written(labelled, "jaccard-classes-linked")
    linked_ones = labelled.where("more > 0")
    least = linked_ones.groupBy("root").agg(F.min("rep").alias("component_id"))
    alone = labelled.where("more = 0").withColumn("component_id", F.col("rep"))
    return linked_ones.join(least, "root").select("key", "root", "rep", "rows", "component_id", "more").unionByName(alone.select("key", "root", "rep", "rows", "component_id", "more"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links for each row of docs (doc_id, text).

    class_id is the smallest doc_id with the same set, null for rows that link to nothing for lack of words or of doc_id.
    n_links: how many other rows the row's set is linked with, equal sets among them.
    """
    found = _find(docs)
    joined = found.rows.join(_label(found), "key", "left")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(real, F.col("rep")).alias("class_id"), F.when(real, F.col("rows") - 1 + F.col("more")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without all but one of each component: one with the component's id.

    Rows that link to nothing, for lack of words or of doc_id, all stay. Of repeated rows one stays.
    """
    found = _find(docs)
    labelled = written(_label(found), "jaccard-result")
    first = labelled.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("first"))
    several = labelled.where("more > 0 or rows > 1").join(first, "root").select(F.col("key").alias(KEY), F.when(F.col("key") == F.col("first.key"), F.col("rep")).alias("stays"))
    # Copies of one text are many rows of one key, so the join is by parts of a key.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(HUB_PARTS)).alias("_part")
    rows = found.rows.where("doc_id is not null").select("doc_id", F.col("key").alias(KEY), part)
    several = several.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))))
    verdict = rows.join(several, [KEY, "_part"]).groupBy("doc_id", KEY).agg((F.first("stays").eqNullSafe(F.col("doc_id"))).alias("_stays"), F.count("*").alias("_times"))
    verdict = written(verdict, "jaccard-verdict")
    goes = Sieve(verdict.where("not _stays or _times > 1").select("doc_id"), "doc_id")
    schema = StructType([*docs.schema.fields, StructField(KEY, LongType())])
    at = docs.columns.index("text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [short_key(set_key(shingle_set(t))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, KEY])
        give_back()

    maybe = goes.split(docs, "doc_id", True).mapInArrow(keyed, schema).join(verdict, ["doc_id", KEY], "left").where("_stays is null or _stays")
    once = maybe.where("_times is null or _times = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
    out = goes.split(docs, "doc_id", False).unionByName(once)
    if verdict.where("_stays and _times > 1").isEmpty():
        return out
    return out.unionByName(maybe.where("_times > 1").dropDuplicates(["doc_id", KEY]).select(*(F.col(f"`{c}`") for c in docs.columns)))
