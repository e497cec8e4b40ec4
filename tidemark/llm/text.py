"""Word splitting and Arrow helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\r\x0b\x0c"
#: A-Z to a-z; every other ASCII character but 0-9 and a-z to a space.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, case kept; bytes.split() cuts at exactly these six characters."""
    return utf8(text).split()


def lower_space_words(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z; bytes.lower() changes exactly these."""
    return utf8(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: runs of 0-9, a-z and all that is not ASCII."""
    return utf8(text).translate(_ALNUM).split()


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of alnum_words() of all texts one after another, and one more offset than texts."""
    lines = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n").cast(pa.large_string())
    ends = np.r_[0, np.cumsum(pc.binary_length(lines).to_numpy())]
    data = np.frombuffer("".join(lines.to_pylist()).encode("utf-8", "surrogatepass").translate(_ALNUM), dtype=np.uint8)
    inside = data != 0x20
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.searchsorted(starts, ends)


def small_batches(spark: SparkSession) -> None:
    """Batches to Python of at most 4 MB, unless the session asks for less: long texts must not fill a worker."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
        spark.conf.set(name, str(most))


#: The one model that a worker keeps for its next tasks. Workers outlive stages, so another stage's model goes first.
_KEPT: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """make(), kept for the next tasks of this worker until a task asks for another name."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """At the end of a task: freed memory goes back to the system, for the worker stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., dict[str, list]]], arrow: bool = False, keeps: bool = False) -> DataFrame:
    """df through start()(column lists...) -> column lists, batch by batch; start runs once in each task.

    arrow: arrays instead of lists go in. keeps: start asks for a model by kept(); other tasks forget what is kept.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        work = start()
        for batch in batches:
            got = work(*(c if arrow else c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., list[bool]]], keeps: bool = False) -> DataFrame:
    """The rows of df, with all its columns, for which start()(column lists...) says True. No shuffle: rows stay where they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(*(batch.column(c).to_pylist() for c in columns)), pa.bool_()))
        del keep
        give_back()

    return df.mapInArrow(run, df.schema)


class Sieve:
    """A bitmap of hashed ids as a small table: at most MOST bits, whatever the number of ids, so it is always broadcast.

    Ids that are in it may pass by chance; an exact join follows, which needs only the rows that pass.
    """

    LEAST, MOST = 1 << 12, 1 << 25

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(self.MOST, max(self.LEAST, 1 << (64 * n).bit_length()))
        at = self._at(column)
        words = ids.select((at / 64).cast("int").alias("_sieve_word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(`{column}`), {self.bits}), 64) as int)) as bit"))
        self.words = words.groupBy("_sieve_word").agg(F.bit_or("bit").alias("_sieve_bits"))

    def _at(self, column: str):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits))

    def split(self, df: DataFrame, column: str, inside: bool) -> DataFrame:
        """The rows of df whose column may be one of the ids, or those whose column is none for certain."""
        at = self._at(column)
        marked = df.withColumn("_sieve_word", (at / 64).cast("int")).join(F.broadcast(self.words), "_sieve_word", "inner" if inside else "left")
        bit = F.expr(f"getbit(coalesce(_sieve_bits, 0L), cast(pmod(pmod(xxhash64(`{column}`), {self.bits}), 64) as int)) = 1")
        return marked.where(bit if inside else ~bit).select(*(F.col(f"`{c}`") for c in df.columns))
