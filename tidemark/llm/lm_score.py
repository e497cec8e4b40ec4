"""Masked pseudo-likelihood by a bidirectional window network.

Every token of a document is predicted from the two words before it and the two behind it: their embeddings, each scaled by
its place, are summed into a hidden vector, which gives a class of the network's tokens and then the token within its class (each
a softmax). The sum of the conditional log-probabilities over all tokens is the document's pseudo-log-likelihood.

Words are counted over all documents, and the counts stay a distributed table that grows with the corpus. The most frequent
words are tokens of the network; each other word belongs to one of BUCKETS hashed tokens, and its probability is its bucket's
times its own share of the bucket's count in the corpus. So no two words are scored as one. The KNOWN most frequent words' counts
are broadcast; all others are looked up by a join, which gives the same.

Training in numpy takes every row once. Documents are dealt over shards of about SHARD_TOKENS by a hash of doc_id and tokens,
sorted within a shard, each shard trains from the same start, and the parameters are averaged by the shards' tokens, in order of
the shards: how the input is cut into tasks does not matter, but for the rounding of 32-bit sums. Rows without doc_id are dealt
by their place in the input.

Rows: null, empty and wordless texts have no tokens, log_prob 0 and a null score. Repeated rows give one row each, of one score.
An empty corpus gives an untrained network and no rows. A word that the model's corpus lacks counts as once in its bucket. Words
of equal count are ordered by their bytes. Texts of any length are scored whole. Columns other than doc_id and text are not read.
The join compares 64-bit hashes of words.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import flat_words, give_back, kept, map_rows, small_batches

CLASSES, CLASS_SIZE, DIM, SIDE = 32, 32, 16, 2
VOCAB, BUCKETS = CLASSES * CLASS_SIZE, 255
#: The words of the network: 0 is the border, then the buckets follow.
WORDS = VOCAB - 1 - BUCKETS
#: Frequent words whose counts are broadcast: a bounded list, which only spares the join.
KNOWN = 65_536
#: Tokens of a shard and of one step; learning rate.
SHARD_TOKENS, STEP_TOKENS, RATE = 2_000_000, 4096, 0.1
#: Shards are averaged in groups of GROUP first.
GROUP = 64
#: A row of the corpus as tokens: its number, the log of its words' shares of their buckets as far as they are known, and the hashes of the other words.
IDS_SCHEMA = "row long, doc_id long, n_tokens long, own double, ids binary, rare array<long>"
SHAPES = {"embed": (VOCAB, DIM), "place": (2 * SIDE, DIM), "bias": (DIM,), "cls": (CLASSES, DIM), "cls_bias": (CLASSES,), "out": (VOCAB, DIM), "out_bias": (VOCAB,)}
N_PARAMETERS = sum(int(np.prod(s)) for s in SHAPES.values())


def split_parameters(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_parameters() -> np.ndarray:
    flat = np.random.default_rng(7).normal(0, 0.1, N_PARAMETERS).astype(np.float32)
    p = split_parameters(flat)
    p["place"][:] = 1
    for name in ("bias", "cls_bias", "out_bias"):
        p[name][:] = 0
    return flat


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets and their contexts (2 * SIDE, n), the border id outside a document."""
    pad = np.zeros(SIDE, np.uint16)
    line = np.concatenate([pad, *(x for d in docs for x in (d, pad))])
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    at = np.arange(int(sizes.sum())) + np.repeat(SIDE * np.arange(1, len(docs) + 1), sizes)
    return line[at], np.stack([line[at + k] for k in range(-SIDE, SIDE + 1) if k])


def _exp_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place the exponentials of rows, less their largest; their sums, and the logarithms of the normalisers."""
    top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    return total, np.log(total[:, 0]) + top[:, 0]


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the targets by class, and each class's bounds in it."""
    cls = (targets // CLASS_SIZE).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    return order, np.searchsorted(cls[order], np.arange(CLASSES + 1))


def _hidden(p: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    out = p["embed"][context[0]] * p["place"][0]
    for k in range(1, 2 * SIDE):
        out += p["embed"][context[k]] * p["place"][k]
    return out + p["bias"]


def log_probs(p: dict[str, np.ndarray], targets: np.ndarray, context: np.ndarray) -> np.ndarray:
    order, bounds = _by_class(targets)
    targets, hidden = targets[order].astype(np.int64), _hidden(p, context[:, order])
    rows = np.arange(len(targets))
    logits = hidden @ p["cls"].T + p["cls_bias"]
    got = logits[rows, targets // CLASS_SIZE]
    got = got - _exp_rows(logits)[1]
    within = targets % CLASS_SIZE
    for c, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a < z:
            part = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            logits = hidden[a:z] @ p["out"][part].T + p["out_bias"][part]
            own = logits[rows[: z - a], within[a:z]]
            got[a:z] += own - _exp_rows(logits)[1]
    out = np.empty_like(got)
    out[order] = got
    return out


def train_step(p: dict[str, np.ndarray], grad2: dict[str, np.ndarray], targets: np.ndarray, context: np.ndarray, rate: float = RATE) -> None:
    """One AdaGrad step on the mean log-loss."""
    n = len(targets)
    order, bounds = _by_class(targets)
    targets, context = targets[order].astype(np.int64), context[:, order]
    hidden = _hidden(p, context)
    rows = np.arange(n)
    d_cls = hidden @ p["cls"].T + p["cls_bias"]
    d_cls /= _exp_rows(d_cls)[0]
    d_cls[rows, targets // CLASS_SIZE] -= 1
    d_hidden = d_cls @ p["cls"]
    grads = {"cls": d_cls.T @ hidden, "cls_bias": d_cls.sum(axis=0), "out": np.zeros_like(p["out"]), "out_bias": np.zeros_like(p["out_bias"])}
    within = targets % CLASS_SIZE
    for c, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a < z:
            part = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
            d = hidden[a:z] @ p["out"][part].T + p["out_bias"][part]
            d /= _exp_rows(d)[0]
            d[rows[: z - a], within[a:z]] -= 1
            grads["out"][part] = d.T @ hidden[a:z]
            grads["out_bias"][part] = d.sum(axis=0)
            d_hidden[a:z] += d @ p["out"][part]
    grads["bias"] = d_hidden.sum(axis=0)
    grads["place"], grads["embed"] = np.empty_like(p["place"]), np.zeros_like(p["embed"])
    for k, ids in enumerate(context):
        grads["place"][k] = np.einsum("nd,nd->d", p["embed"][ids], d_hidden)
        mix = np.argsort(ids, kind="stable")
        found = ids[mix]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        grads["embed"][found[first]] += np.add.reduceat(d_hidden[mix], first, axis=0) * p["place"][k]
    for name, g in grads.items():
        g /= n
        grad2[name] += g * g
        p[name] -= rate * g / (np.sqrt(grad2[name]) + 1e-6)


def train_shard(docs: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, int]:
    """The parameters after one pass over the documents in steps of STEP_TOKENS, and the tokens."""
    own = start.copy()
    p, grad2 = split_parameters(own), split_parameters(np.zeros(N_PARAMETERS, np.float32))
    targets, context = windows(docs)
    mix = np.random.default_rng(len(targets)).permutation(len(targets))
    for a in range(0, len(mix), STEP_TOKENS):
        at = mix[a : a + STEP_TOKENS]
        train_step(p, grad2, targets[at], context[:, at])
    return own, len(targets)


def word_key(word: bytes) -> int:
    """The same as Spark's xxhash64 of the word."""
    return int.from_bytes(xxhash.xxh64_digest(word, seed=42), "big", signed=True)


def word_keys(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()), dtype=np.uint64, count=len(words)).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word, key, n: how often each word occurs in all documents."""

    def run(batches):
        kept("lm", lambda: None)
        parts: list[pa.Table] = []
        held = 0

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            coded = flat_words(batch.column(0))[0].dictionary_encode()
            parts.append(pa.table({"word": coded.dictionary, "n": pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))}))
            held += len(coded.dictionary)
            if held > 600_000:
                parts = [merged()]
                held = parts[0].num_rows
                if held > 300_000:
                    yield from parts[0].to_batches(max_chunksize=50_000)
                    parts, held = [], 0
        if parts:
            yield from merged().to_batches(max_chunksize=50_000)
        give_back()

    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.select("word", F.xxhash64("word").alias("key"), "n"), "lm-words")


class Words(NamedTuple):
    """The most frequent words and their counts, the count of each bucket's words together, and the table of count_words()."""

    known: pa.Array
    n: np.ndarray
    totals: np.ndarray
    counts: DataFrame


def frequent(counts: DataFrame) -> Words:
    top = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(KNOWN).toArrow().combine_chunks()
    known, n = top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.binary()), top.column("n").to_numpy()
    totals = np.zeros(1 + BUCKETS)
    for r in counts.groupBy(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[1 + r.bucket] += r.n
    np.subtract.at(totals, 1 + word_keys(known[:WORDS]) % BUCKETS, n[:WORDS])
    return Words(known, n, totals, counts)


def tokens(docs: DataFrame, words: Words) -> DataFrame:
    """IDS_SCHEMA for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((words.known.to_pylist(), words.n, np.log(np.maximum(words.totals, 1))))

    def start():
        known, n, log_totals = sent.value
        known, log_n = pa.array(known, pa.binary()), np.log(n)
        rows = count(TaskContext.get().partitionId() << 40)

        def work(ids, texts):
            flat, bounds = flat_words(texts)
            coded = flat.dictionary_encode()
            index, distinct = coded.indices.to_numpy(), coded.dictionary
            found = pc.index_in(distinct, value_set=known)
            missing = found.is_null().to_numpy(zero_copy_only=False)
            rank = found.fill_null(0).to_numpy().astype(np.int64)
            direct = ~missing & (rank < WORDS)
            keys = np.zeros(len(distinct), np.int64)
            keys[~direct] = word_keys(distinct.filter(pa.array(~direct)))
            token = np.where(direct, 1 + BUCKETS + rank, 1 + keys % BUCKETS).astype(np.uint16)
            # The log of a word's share of its bucket; the count of a word that isn't known is added later.
            own = np.zeros(len(distinct))
            own[~direct] = -log_totals[token[~direct]]
            inside = ~missing & ~direct
            own[inside] += log_n[rank[inside]]
            per_word, packed = np.r_[0.0, np.cumsum(own[index])], token[index].astype("<u2").tobytes()
            rare = missing[index]
            at = np.r_[0, np.cumsum(rare)][bounds].astype(np.int32)
            return {
                "row": [next(rows) for _ in range(len(ids))], "doc_id": ids, "n_tokens": np.diff(bounds), "own": np.diff(per_word[bounds]),
                "ids": [packed[2 * a : 2 * z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())], "rare": pa.ListArray.from_arrays(pa.array(at), pa.array(keys[index][rare])),
            }

        return work

    return written(map_rows(docs.select("doc_id", "text"), IDS_SCHEMA, start, arrow=True), "lm-ids")


def train(ids: DataFrame) -> np.ndarray:
    """The network's parameters after one pass over every row of tokens()."""
    n = ids.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-n // SHARD_TOKENS))
    name = F.xxhash64(F.coalesce("doc_id", "row"), "ids")

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("hash", "ascending"), ("ids", "ascending")])
        docs = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in table.column("ids").take(order)]
        own, weight = train_shard(docs, first_parameters())
        give_back()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "weight": pa.array([float(weight)]), "data": pa.array([own.tobytes()], pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "weight", "data"))))
        total, weight = np.zeros(N_PARAMETERS), 0.0
        for _, w, data in rows:
            total += w * np.frombuffer(data, np.float32)
            weight += w
        return pa.table({"shard": pa.array([rows[0][0]], pa.int64()), "weight": pa.array([weight]), "data": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    schema = "shard long, weight double, data binary"
    dealt = ids.where("n_tokens > 0").select(F.pmod(name, F.lit(shards)).alias("shard"), name.alias("hash"), "ids")
    parts = dealt.groupBy("shard").applyInArrow(run, schema)
    while True:  # groups of neighbours, then one row
        parts = parts.withColumn("to", F.floor(F.col("shard") / GROUP)).groupBy("to").applyInArrow(average, schema).withColumn("shard", F.floor(F.col("shard") / GROUP))
        shards = -(-shards // GROUP)
        if shards == 1:
            break
    got = parts.collect()
    return np.frombuffer(got[0].data, np.float32) if got else first_parameters()


class Model(NamedTuple):
    words: Words
    flat: np.ndarray


def fit(docs: DataFrame) -> Model:
    words = frequent(count_words(docs))
    return Model(words, train(tokens(docs, words)))


def score_text(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob, score (log-probability a token) for each row of docs (doc_id, text), by a model of docs or the one given."""
    words = model.words if model else frequent(count_words(docs))
    ids = tokens(docs, words)
    sent = docs.sparkSession.sparkContext.broadcast(model.flat if model else train(ids))

    def start():
        p = split_parameters(sent.value)

        def work(rows, ids, sizes, own, packed):
            docs = [np.frombuffer(x, dtype="<u2") for x in packed]
            targets, context = windows(docs)
            logs = np.concatenate([np.zeros(0), *(log_probs(p, targets[a : a + 20_000], context[:, a : a + 20_000]) for a in range(0, len(targets), 20_000))])
            ends = np.cumsum([0, *map(len, docs)])
            return {"row": rows, "doc_id": ids, "n_tokens": sizes, "base": np.diff(np.r_[0.0, np.cumsum(logs, dtype=np.float64)][ends]) + np.array(own)}

        return work

    small_batches(docs.sparkSession)
    net = map_rows(ids.select("row", "doc_id", "n_tokens", "own", "ids"), "row long, doc_id long, n_tokens long, base double", start)
    # A word that is not found occurs once, or never.
    more = words.counts.where("n > 1").select("key", "n")
    rare = ids.select("row", F.explode("rare").alias("key")).join(more, "key").groupBy("row").agg(F.sum(F.log("n")).alias("rare"))
    log_prob = F.col("base") + F.coalesce("rare", F.lit(0.0))
    return net.join(rare, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("score"))
