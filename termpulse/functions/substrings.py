"""Which terms of a list occur in texts, by substring: Arrow batches of texts, in numpy.

Strings are compared by their UTF-8 bytes, which hold a term wherever the characters do.
Terms are grouped by their number of bytes. A window of the text as long as the terms of a
group is read as numbers of eight bytes, looked up in a hash table by them, and compared
in full. Windows of four, eight, 16, ... bytes that begin no term as long as that are left
out first, so that few places of a text are looked up for long terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text at which windows begin that are looked up at once.
BYTES = 1 << 18
#: Largest set of texts and terms that is marked in an array; a larger one is sorted.
MARKS = 1 << 23
_ODD = np.uint64(0x9E3779B97F4A7C15)


def contained_terms(terms: Broadcast[pa.Array]) -> Callable[[Column], Column]:
    """A function column from a text to the array of those terms that it holds, each once."""

    def batches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = TermIndex(terms.value)
        for texts in arrays:
            yield from index.found(texts)

    return F.arrow_udf(batches, "array<string>")


def _numbers(data: np.ndarray) -> np.ndarray:
    """The number that the eight bytes from each place on make."""
    return np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,)).astype(np.uint64)


def _offsets(length: int) -> list[int]:
    """Where the numbers of a window begin; the last one ends with it."""
    return [0] if length <= 8 else [*range(0, length - 8, 8), length - 8]


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << 8 * min(length, 8)) - 1)


def _hash(numbers: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    """One number for each of the windows ``at``, exact up to eight bytes."""
    value = numbers[at] & _mask(length)
    for offset in _offsets(length)[1:]:
        value = (value ^ (value >> np.uint64(29))) * _ODD + numbers[at + offset]
    return value


def _slots(value: np.ndarray, bits: int) -> np.ndarray:
    return (value * _ODD) >> np.uint64(64 - bits)


def _bits(n: int) -> int:
    return max(int(n).bit_length() + 3, 10)


class _Heads:
    """The first ``length`` bytes of the terms that are as long, as marks in a hash table."""

    def __init__(self, length: int, values: np.ndarray) -> None:
        self.length, self.bits = length, _bits(len(values))
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[_slots(values, self.bits)] = True

    def among(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at[self.marks[_slots(_hash(numbers, at, self.length), self.bits)]]


class _Terms:
    """Hash table of the terms of one length."""

    def __init__(self, length: int, ids: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> None:
        self.length, self.bits = length, _bits(len(ids))
        slots = _slots(_hash(numbers, at, length), self.bits)
        order = np.argsort(slots, kind="stable")
        slots, at = slots[order], at[order]
        self.ids = ids[order]
        self.numbers = [numbers[at + offset] & _mask(length) for offset in _offsets(length)]
        self.first = np.full(1 << self.bits, -1, np.int32)
        begins = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        self.first[slots[begins]] = begins
        # Whether the next term is in the same slot.
        self.more = np.r_[slots[1:] == slots[:-1], False]

    def hits(self, numbers: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and the numbers of the terms there, by their order in ``ids``."""
        term = self.first[_slots(_hash(numbers, at, self.length), self.bits)]
        some = np.flatnonzero(term >= 0)
        at, term = at[some], term[some]
        while len(at):
            same = np.ones(len(at), bool)
            for offset, own in zip(_offsets(self.length), self.numbers):
                same &= (numbers[at + offset] & _mask(self.length)) == own[term]
            yield at[same], term[same]
            more = self.more[term]
            at, term = at[more], term[more] + 1


class TermIndex:
    """Terms, and for each class of lengths (1 to 3, 4 to 7, 8 to 15, ... bytes) the heads
    that windows must have and a table of the terms of each length."""

    def __init__(self, terms: pa.Array) -> None:
        self.terms = terms
        data, starts = _bytes(terms)
        lengths, numbers, starts = np.diff(starts), _numbers(np.r_[data, np.zeros(8, np.uint8)]), starts[:-1]
        self.longest = int(lengths.max(initial=0))
        self.classes: list[tuple[_Heads | None, list[_Terms]]] = []
        size = 1
        while size <= self.longest:
            up_to = 4 if size == 1 else size * 2
            longer = starts[lengths >= size]
            heads = _Heads(size, _hash(numbers, longer, size)) if size > 1 else None
            tables = []
            for length in np.unique(lengths[(lengths >= size) & (lengths < up_to)]).tolist():
                ids = np.flatnonzero(lengths == length)
                tables.append(_Terms(length, ids, numbers, starts[ids]))
            self.classes.append((heads, tables))
            size = up_to

    def found(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """A list of terms for each text, some texts at a time.

        The texts are read as one run of bytes, in pieces. What a text holds is given out
        with the piece in which it ends.
        """
        data, ends = _bytes(texts)
        starts, ends = ends[:-1], ends[1:]
        if not len(texts):
            return
        stop, done, width = int(ends[-1]), 0, max(len(self.terms), 1)
        found = np.empty(0, np.int64)
        begin, step = int(starts[0]), max(BYTES, self.longest)
        while done < len(texts):
            end = min(begin + step, stop)
            found = np.unique(np.concatenate([found, *self._in_piece(data, starts, ends, begin, end)]))
            over = len(texts) if end == stop else int(np.searchsorted(ends, end, "right"))
            if over > done:
                cut = int(np.searchsorted(found, over * width))
                text, term = np.divmod(found[:cut], width)
                offsets = pa.array(np.searchsorted(text, np.arange(done, over + 1)), pa.int32())
                yield pa.ListArray.from_arrays(offsets, self.terms.take(pa.array(term)))
                found, done = found[cut:], over
            begin = end

    def _in_piece(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int, end: int
    ) -> Iterator[np.ndarray]:
        """For windows that begin in a piece: the number of the text, times the number of
        terms, plus that of the term, each once."""
        if begin == end or not self.longest:
            return
        piece = data[begin : end + self.longest]
        numbers = _numbers(np.r_[piece, np.zeros(self.longest + 8, np.uint8)])
        low, high = np.searchsorted(ends, [begin, end - 1], "right")
        sizes = np.minimum(ends[low : high + 1], end) - np.maximum(starts[low : high + 1], begin)
        text_of = np.repeat(np.arange(high + 1 - low, dtype=np.int32), sizes)
        end_of = (ends[low : high + 1] - begin).astype(np.int64)
        at = np.arange(end - begin)
        for heads, tables in self.classes:
            if heads:
                at = heads.among(numbers, at)
            for table in tables:
                n = len(table.ids)
                for place, term in table.hits(numbers, at):
                    text = text_of[place]
                    inside = place + table.length <= end_of[text]
                    pairs = _distinct(text[inside].astype(np.int64) * n + term[inside], len(end_of) * n)
                    text, term = np.divmod(pairs, n)
                    yield (text + low) * len(self.terms) + table.ids[term]


def _distinct(values: np.ndarray, size: int) -> np.ndarray:
    """The different values, which are below ``size``, in order."""
    if size > MARKS:
        return np.unique(values)
    marks = np.zeros(size, bool)
    marks[values] = True
    return np.flatnonzero(marks)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each one begins and the last one ends."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at
