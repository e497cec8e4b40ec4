"""Byte-level BPE with two-tier lookup.

A pre-token (a match of the pattern) that is itself in the vocabulary is found by a minimal perfect hash: one bucket of
displacements and one comparison. All other pre-tokens are merged from their bytes, which are linked to their neighbours, with
a heap that yields the pair of lowest rank, leftmost first. Both tiers fill a bounded memo of pieces.

Rows: null and empty texts have no ids, and decode to no bytes; a null doc_id stays null. Repeated rows give one row each. Pairs
of one rank are merged from the left. Texts of any length are encoded whole. An empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder, Ragged, ragged
from .text import kept, map_rows, utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash: keys to 0..n-1 by hash and displace. Strangers are told by comparing with the key in the slot."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 2)
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        buckets = defaultdict(list)
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            buckets[h % self.n_buckets].append((h, k))
        order = sorted(buckets, key=lambda b: -len(buckets[b]))
        singles = [b for b in order if len(buckets[b]) == 1]
        for b in order[: len(order) - len(singles)]:
            d, group = 1, buckets[b]
            while len({s for h, _ in group if self.keys[s := self._slot(h, d)] is None}) < len(group):
                d += 1
            self.shift[b] = d
            for h, k in group:
                self.keys[self._slot(h, d)] = k
        free = [s for s in range(n) if self.keys[s] is None]
        for b, s in zip(singles, free):
            self.shift[b] = -1 - s
            self.keys[s] = buckets[b][0][1]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
        return ((x >> 32) * self.n) >> 32

    def get(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return s if self.keys[s] == key else -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.slot_id = [array("I", [ranks[k]]) for k in self.hash.keys]
        self.vocabulary = {v: k for k, v in ranks.items()}
        self.encoder = ChunkEncoder(self._ask)

    def merge(self, piece: bytes) -> array:
        """The ids of a pre-token that is not in the vocabulary."""
        ranks, n = self.ranks.get, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i, stop = heappop(heap)
            j = after[i]
            if j >= n or end[i] < 0 or end[j] != stop:  # one of the two has changed since
                continue
            end[i], end[j] = stop, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(piece[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return array("I", out)

    def _token(self, token: str) -> array:
        raw = utf8(token)
        slot = self.hash.get(raw)
        return self.slot_id[slot] if slot >= 0 else self.merge(raw)

    def _ask(self, units: pa.Array) -> Ragged:
        """The ids of pieces: letters, with a space before them or not, are one pre-token; other pieces are split by the pattern."""
        body = pc.if_else(pc.starts_with(units, " "), pc.utf8_slice_codeunits(units, 1), units)
        known: dict[str, array] = {}
        rows = []
        for unit, plain in zip(units.to_pylist(), pc.utf8_is_alpha(body).to_pylist()):
            if plain:
                rows.append(self._token(unit))
                continue
            row = array("I")
            for token in self.split(unit):
                ids = known.get(token)
                if ids is None:
                    ids = known[token] = self._token(token)
                row.extend(ids)
            rows.append(row)
        return ragged(rows)

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        ids, offsets = self.encoder.encode(texts)
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def codec(path: str, pattern: str) -> BytePairCodec:
    return kept(("bpe", path, pattern), lambda: BytePairCodec(load_ranks(path), pattern))


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the packed ids, for each row of docs (doc_id, text)."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def start():
        own = codec(path, pattern)

        def work(doc_ids, texts):
            out = defaultdict(list, {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}, doc_id=doc_ids)
            for packed in own.encode_batch(texts):
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(packed)).hexdigest())
                out["ids"].append(packed if keep_ids else None)
            return out

        return work

    return map_rows(docs.select("doc_id", "text"), SCHEMA + ", ids binary" * keep_ids, start, arrow=True, keeps=True)
