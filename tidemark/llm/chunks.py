"""Token ids of whole batches of texts, each distinct piece looked up once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that the split pattern of byte-level BPE takes as a token of their own after letters.
MARKS = ".,;:!?"
Ragged = tuple[np.ndarray, np.ndarray]  # values of all rows, and the rows' sizes


def ragged(rows: list) -> Ragged:
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.frombuffer(b"".join(rows), dtype=np.uint32), sizes


def take_rows(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of rows that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Memo:
    """Ids of pieces as Arrow and numpy arrays. When it has more than `limit` pieces, those that the last batch used stay."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.keys = pa.array([], pa.string())
        self.values, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, units: pa.Array, ask: Callable[[pa.Array], Ragged]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """values, starts and sizes of distinct units; ask gives the ids of those that aren't known."""
        at = pc.index_in(units, value_set=self.keys)
        new = at.is_null().to_numpy(zero_copy_only=False)
        fresh = units.filter(pa.array(new))
        values, sizes = ask(fresh)
        pool = np.concatenate([self.values, values])
        begin = len(self.values) + np.cumsum(sizes) - sizes
        at = at.fill_null(0).to_numpy()
        starts, widths = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        starts[~new], widths[~new] = self.starts[at[~new]], self.sizes[at[~new]]
        starts[new], widths[new] = begin, sizes
        short = pc.less_equal(pc.binary_length(units), self.longest).to_numpy(zero_copy_only=False)
        if len(self.keys) + len(fresh) > self.limit:
            self.keys, self.sizes = units.filter(pa.array(short)), widths[short]
            self.values = take_rows(pool, starts[short], self.sizes)
            self.starts = np.cumsum(self.sizes) - self.sizes
        else:
            own = short[new]
            self.keys = pa.concat_arrays([self.keys, fresh.filter(pa.array(own))])
            kept = take_rows(values, begin[own] - len(self.values), sizes[own])
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes[own]) - sizes[own]])
            self.sizes = np.concatenate([self.sizes, sizes[own]])
            self.values = np.concatenate([self.values, kept])
        return pool, starts, widths


class ChunkEncoder:
    """Token ids of texts, each distinct piece of a batch looked up once.

    No match of the split pattern crosses the border before a single space, so a text can be cut there, if no two spaces stand
    together and none stands at its end; another text is one piece. A piece of letters with a mark behind them is two. Cutting,
    finding the distinct pieces and putting the ids together run in Arrow and numpy. ask gives the ids of distinct pieces, each
    with the space before it if it has one.
    """

    def __init__(self, ask: Callable[[pa.Array], Ragged], pieces: int = 300_000):
        self.ask, self.memo = ask, Memo(pieces)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and one more offset than texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
        pieces = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        bounds = pieces.offsets.to_numpy()
        flat = pieces.flatten()
        heads = pc.if_else(whole, texts, flat.take(pa.array(bounds[:-1])))
        coded = flat.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        stem = pc.utf8_rtrim(distinct, MARKS)
        mark = pc.subtract(pc.binary_length(distinct), pc.binary_length(stem))
        split = pc.and_(pc.utf8_is_alpha(stem), pc.equal(mark, 1))
        ends = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        firsts = pc.binary_join_element_wise(" ", pc.if_else(split, stem, distinct), "")
        marks = pc.utf8_slice_codeunits(distinct.take(pa.array(ends)), -1)
        units = pa.concat_arrays([firsts, marks, heads]).dictionary_encode()
        number, n = units.indices.to_numpy(), len(distinct)
        values, starts, sizes = self.memo.look_up(units.dictionary, self.ask)
        starts, sizes = np.append(starts, 0), np.append(sizes, 0)  # the last one is nothing
        none = len(starts) - 1
        second = np.full(n, none)
        second[ends] = number[n : n + len(ends)]
        # Two units for each piece: itself and its mark, or nothing; a text's first piece has its own.
        sequence = np.stack([number[:n][index], second[index]], axis=1)
        at = bounds[:-1]
        sequence[at, 0], sequence[at, 1] = number[n + len(ends) :], none
        sequence[at, 0] = np.where(pc.equal(pc.binary_length(heads), 0).to_numpy(zero_copy_only=False), none, sequence[at, 0])
        sequence = sequence.ravel()
        width = sizes[sequence]
        done = np.r_[0, np.cumsum(width)]
        return take_rows(values, starts[sequence], width), done[2 * bounds]
