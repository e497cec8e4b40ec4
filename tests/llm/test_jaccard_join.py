import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join as jj


def brute(rows):
    """doc_id -> (n_shingles, component_id), by all pairs of Python sets."""
    sets = []
    for doc, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d, _ in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for (d, x), (e, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(d), root(e)))
            up[b] = a
    return {d: (len(s), root(d)) for d, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 4)))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(r.randrange(1, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [word()]
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i * 3, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a b c"), (1006, "x " * 3000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    if small:  # short lists count as long: contraction, dealing over parts and visits are all used
        for name, value in (("LIST_ROWS", 4), ("STAR", 3), ("HOT_MIN", 2), ("BLOCK_BYTES", 2000), ("PARTNERS", 2)):
            monkeypatch.setattr(jj, name, value)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    got = Counter(tuple(r)[:3] for r in jj.jaccard_join(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")).collect())
    assert got == Counter({(1, 2, 1): 3, (None, 2, None): 1, (2, 2, 1): 1, (3, 0, 3): 1})
    assert jj.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("LIST_ROWS", 4), ("STAR", 3), ("HOT_MIN", 2), ("BLOCK_BYTES", 2000), ("PARTNERS", 2)):
            monkeypatch.setattr(jj, name, value)
    rows = corpus(4) + [(2000, "a b c d e f g"), (2000, "a b c d e f g"), (None, "a b c d e f g")]
    sets = [frozenset(jj.shingle_set(t).tolist()) for _, t in rows]
    can = [bool(s) and d is not None for (d, _), s in zip(rows, sets)]
    n = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if can[i] and can[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            n[i] += 1
            n[j] += 1
    components = brute([x for x in rows if x[0] is not None])
    got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((d, k) for (d, _), k in zip(rows, n))
    assert max(n) > 5 and all((r.n_shingles, r.component_id) == components[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("heap_rows", [0, 10_000])
@pytest.mark.parametrize("probed", [0, 5])
def test_divide_skip_counts(monkeypatch, heap_rows, probed):
    monkeypatch.setattr(jj, "HEAP_ROWS", heap_rows)
    monkeypatch.setattr(jj, "PROBED", probed)
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randrange(1, 20))) for _ in range(r.randrange(1, 12))]
        least = r.randrange(1, 8)
        count = Counter(x for y in lists for x in y)
        ends = np.cumsum([len(x) for x in lists])
        found, n = jj.divide_skip(np.concatenate(lists), np.r_[0, ends[:-1]], ends, least)
        assert dict(zip(found.tolist(), n.tolist())) == {k: v for k, v in count.items() if v >= least}


def test_lists_are_cut_while_they_stream():
    rows = [(1, k) for k in range(25)] + [(2, 0), (2, 1)] + [(3, k) for k in range(20)] + [(4, 0)]
    batches = [pa.RecordBatch.from_pydict({"slot": [s for s, _ in rows[a : a + 5]], "key": [k for _, k in rows[a : a + 5]]}) for a in range(0, len(rows), 5)]
    got = [(int(s), int(k), int(p)) for g in jj._lists(iter(batches), ("slot",), 8) for s, k, p in zip(g["slot"], g["key"], g["piece"])]
    assert [x[:2] for x in got] == rows and {p for s, _, p in got if s == 1} >= {0, 1} and {p for s, _, p in got if s in (2, 4)} == {0}


def test_columns_that_clash(spark):
    rows = [(k, "a b c d e f", 1, 2, 3, 4, "x") for k in (1, 2)] + [(3, "", 1, 2, 3, 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, root long, key long, component_id long, rows string")
    assert sorted(tuple(r)[:3] for r in jj.jaccard_join(docs).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_long_texts(spark):
    words = [f"w{k}" for k in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:160_000])), (3, " ".join(words[:140_000])), (4, "x" * 1_000_000)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jj.jaccard_join(docs).collect()) == [(1, 199_996, 1, 1, 1), (2, 159_996, 1, 2, 2), (3, 139_996, 1, 3, 1), (4, 1, 4, 4, 0)]


def test_one_row_of_a_component_stays(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(5, text), (5, text), (5, text + " q"), (7, text), (5, "other words are here too"), (None, text), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jj.keep_one(docs).collect(), key=str)
    ids = [r.doc_id for r in got]
    assert Counter(ids) == Counter({5: 2, None: 1, 8: 2}) and {r.text for r in got if r.doc_id == 5} & {"other words are here too"}


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (3, 80, 700, 5000, 60_000):
        a = np.unique(r.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.8)], r.integers(-(2**62), 2**62, n // 9 + 1)]))
        x, y = (np.frombuffer(jj.parity(s), np.uint64)[None] for s in (a, b))
        size = min(x.shape[1], y.shape[1])
        assert np.array_equal(jj.folded(x, 8)[0], np.frombuffer(np.packbits(np.bincount(a & 511, minlength=512) & 1).tobytes(), np.uint64))
        assert np.bitwise_count(jj.folded(x, size) ^ jj.folded(y, size)).sum() <= len(np.setxor1d(a, b))
