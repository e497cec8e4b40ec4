"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt by ranges of doc_id, one shard a range, in ascending order. A shard is a folder of the shared directory:

- ``ids.bin``: the ids of its documents, each document closed by the end id, little-endian, 16 bits wide if the vocabulary
  fits and 32 bits otherwise
- ``offsets.bin``: one more than its documents, little-endian signed 64-bit, positions in ids.bin counted in ids
- ``docs.bin`` and ``known.bin``: doc_id as little-endian signed 64-bit, and a byte that is 0 where doc_id is null

Only shards named by tasks that succeeded are in the manifest, so a task that is run again leaves no trace. The manifest has a
row for each shard; the exclusive prefix sums of its token counts are the shards' bases. Files are read memory-mapped; from a
store that is not a local file system they are read by ranges of a few documents.

Rows: null and empty texts have just the end id. Null doc_ids come first. Repeated rows give one row each; rows of equal
doc_id (ties) stand together in no set order. Texts of any length are encoded whole. An empty table has no shards and no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import shared_path
from .chunks import ChunkEncoder, Ragged, ragged, take_rows
from .text import give_back, kept, small_batches

END_ID = 0
#: The letters that byte-level models write for bytes: a printable byte is itself, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTERS_OF_SPACE = chr(_LETTERS[32])
#: The same as an array of code points; the line end, which parts pieces here, stays.
_LETTER_OF = np.array([b if b == 10 else _LETTERS.get(b, b) for b in range(256)], dtype="<u4")
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class LibraryEncoder:
    """The tokenizers library, asked for each distinct token or chunk that the memos don't hold.

    Texts are cut only for a byte-level model without normaliser or prefix space; a text that holds a string of an added token
    goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.whole = not (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        assert sys.byteorder == "little"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = None
        if not self.whole:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_LETTERS_OF_SPACE) for i in range(self.tokenizer.get_vocab_size())])
        self.encoder = ChunkEncoder(self._ask)

    def _whole(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, units: pa.Array) -> Ragged:
        """Letters behind a space need no splitting: many of them, written as the bytes' letters, are one call of the library's model.

        Each of them begins with the space's letter and has no other, so the ids that begin with it begin a piece.
        """
        if self.words is None:
            return ragged(self._whole(units.to_pylist()))
        plain = pc.and_(pc.starts_with(units, " "), pc.utf8_is_alpha(pc.utf8_slice_codeunits(units, 1)))
        letters = units.filter(plain)
        ids = np.zeros(0, np.int64)
        if len(letters):
            lines = pc.binary_join_element_wise(letters, "", "\n")
            ends = np.cumsum(pc.binary_length(lines).to_numpy())
            raw = np.frombuffer("".join(lines.to_pylist()).encode(), dtype=np.uint8)
            text = _LETTER_OF[raw].tobytes().decode("utf-32-le")
            cuts = [0, *ends[499::500].tolist(), len(text)]
            ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in self.words.encode_batch_fast([text[a:z] for a, z in zip(cuts, cuts[1:]) if a < z], add_special_tokens=False)])
        starts = np.flatnonzero(self.begins[ids])
        sizes = np.empty(len(units), np.int64)
        own = plain.to_numpy(zero_copy_only=False)
        sizes[own] = np.diff(np.r_[starts, len(ids)])
        rest, widths = ragged(self._whole(units.filter(pa.array(~own)).to_pylist()))
        sizes[~own] = widths
        begin = np.empty(len(units), np.int64)
        begin[own], begin[~own] = starts, len(ids) + np.cumsum(widths) - widths
        return take_rows(np.concatenate([ids.astype(np.uint32), rest]), begin, sizes), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and one more offset than texts."""
        texts = texts.cast(pa.string())
        whole = np.full(len(texts), self.whole)
        for a in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, a), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encoder.encode(texts)
        ids, offsets = self.encoder.encode(pc.if_else(pa.array(whole), "", texts))
        parts = [ids[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        for k, got in zip(np.flatnonzero(whole), self._whole(texts.filter(pa.array(whole)).to_pylist())):
            parts[k] = np.array(got, dtype=np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]


def encoder(path: str) -> LibraryEncoder:
    return kept(("library", path), lambda: LibraryEncoder(path))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> list[tuple[int, str, int, int]]:
    """Encode docs (doc_id, text) into shards under folder; the manifest, by shard."""
    small_batches(docs.sparkSession)

    def run(batches):
        own, shard = encoder(path), TaskContext.get().partitionId()
        fs, to = _open(f"{folder}/{shard:06d}-{uuid.uuid4().hex}")
        fs.create_dir(to)
        sizes, ids, known = [], [], []
        with fs.open_output_stream(f"{to}/ids.bin") as out:
            for batch in batches:
                names = batch.column(0)
                got, offsets = own.encode(batch.column(1))
                out.write(np.insert(got.astype(own.dtype), offsets[1:], end_id).tobytes())
                sizes += (np.diff(offsets) + 1).tolist()
                ids.append(names.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                known.append(names.is_valid().to_numpy(zero_copy_only=False).astype("u1"))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        for name, data in (("offsets", [offsets]), ("docs", ids), ("known", known)):
            with fs.open_output_stream(f"{to}/{name}.bin") as out:
                for x in data:
                    out.write(x.tobytes())
        give_back()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{to.rsplit('/', 1)[1]}"], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return sorted(tuple(r) for r in ordered.mapInArrow(run, MANIFEST).collect())


class _Mapped:
    """A file of numbers: memory-mapped where the file system is local, read by ranges elsewhere."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.size = fs.get_file_info(path).size // self.dtype.itemsize
        self.local = isinstance(fs, pafs.LocalFileSystem)
        self.data = None
        if self.size:
            self.data = np.memmap(path, dtype=self.dtype, mode="r") if self.local else fs.open_input_file(path)

    def __getitem__(self, at: slice) -> np.ndarray:
        start, stop, _ = at.indices(self.size)
        if start >= stop:
            return np.zeros(0, self.dtype)
        if self.local:
            return self.data[start:stop]
        return np.frombuffer(self.data.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), dtype=self.dtype)


def read_shards(spark, manifest: list[tuple[int, str, int, int]], dtype: str, batch: int = 2000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    bases = [0, *accumulate(n for *_, n in manifest)]
    rows = [(base, path) for base, (_, path, n_docs, _) in zip(bases, manifest) if n_docs]

    def run(batches):
        for given in batches:
            for base, path in zip(*(c.to_pylist() for c in given.columns)):
                fs, at = _open(path)
                ids, offsets = _Mapped(fs, f"{at}/ids.bin", dtype), _Mapped(fs, f"{at}/offsets.bin", "<i8")
                docs, known = _Mapped(fs, f"{at}/docs.bin", "<i8"), _Mapped(fs, f"{at}/known.bin", "u1")
                for a in range(0, docs.size, batch):
                    z = min(a + batch, docs.size)
                    places = np.array(offsets[a : z + 1])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(places[:-1].tolist(), places[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.array(docs[a:z]), pa.int64(), mask=np.array(known[a:z]) == 0), "start": pa.array(base + places[:-1]),
                        "n_tokens": pa.array(np.diff(places)), "ids_crc32": pa.array(crc, pa.int64()),
                    })
        give_back()

    return spark.createDataFrame(rows, "base long, path string").repartition(max(1, len(rows))).mapInArrow(run, SCHEMA)


def token_file(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs as token files to folder (a new one in the shared directory) and give what the files say of each document."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_shards(docs, folder or shared_path(docs.sparkSession, "tokens"), path, end_id)
    return read_shards(docs.sparkSession, manifest, encoder(path).dtype.str)
