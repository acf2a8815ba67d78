"""Count the terms of many texts with array operations, in buckets by length.

A term is a run of bytes of one class. Terms of up to 8 bytes are packed into one 64-bit word and those of up to 16 into
two, first byte highest, so words order as bytes do; they are sorted by radix, 16 bits a pass, and equal neighbours are
counted. Longer terms go to buckets by their padded length and are sorted there as bytes. No term holds a zero byte, so
padding is never mistaken for a part of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8_000_000
SHORT = (8, 16)  # bytes that fit into one word and into two
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


@dataclass
class Runs:
    """Distinct (term, group) of a slice: where one occurrence lies, occurrences, and texts that hold the term."""

    begin: np.ndarray
    length: np.ndarray
    group: np.ndarray
    count: np.ndarray
    texts: np.ndarray


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about `size` bytes (one row at least): first row, their bytes, and where each row begins.

    The bytes have 16 zero bytes more at the end; the bounds have one more entry. A null row is empty.
    """
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary()).cast(pa.large_binary())
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        own = np.zeros(int(offsets[stop] - offsets[row]) + 16, np.uint8)
        own[:-16] = data[offsets[row] : offsets[stop]]
        yield row, own, offsets[row : stop + 1] - offsets[row]
        row = stop


def term_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and row of each run of bytes that are `inside`; a run ends with its row."""
    n = int(bounds[-1])
    inside = inside[:n]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    begin = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end - begin, np.searchsorted(bounds, begin, "right") - 1


def words_of(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Terms of up to 16 bytes as one or two 64-bit words, by the longest of them."""
    at = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
    out = []
    for first in range(0, int(length.max(initial=1)), 8):
        spare = (8 * np.clip(first + 8 - length, 0, 7)).astype(np.uint64)
        word = at[begin + first].astype(np.uint64) >> spare << spare
        out.append(np.where(length > first, word, np.uint64(0)) if first else word)
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by several unsigned keys, the first being the most significant."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it, and at the first."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _runs(terms: np.ndarray, order: np.ndarray, new: np.ndarray, begin, length, group, row) -> Runs:
    """`terms` are the positions of a bucket's terms, `order` sorts them, `new` marks new terms in that order."""
    place = terms[order]
    new = new | _changes(group[place])
    first = np.flatnonzero(new)
    texts = np.add.reduceat((new | _changes(row[place])).astype(np.int64), first) if len(first) else first
    count = np.diff(np.append(first, len(place)))
    head = place[first]
    return Runs(begin[head], length[head], group[head], count, texts)


def counted(data: np.ndarray, begin: np.ndarray, length: np.ndarray, row: np.ndarray, group_of_row: np.ndarray) -> Runs:
    """The runs of a slice's terms; `group_of_row` has a small unsigned number for each text."""
    group = group_of_row[row]
    by_group = radix_order([group])  # texts stay in their order within a group, as every later pass is stable
    size = length[by_group]
    out = []
    low = 0
    for high in SHORT:
        terms = by_group[(size > low) & (size <= high)]
        low = high
        if not len(terms):
            continue
        words = words_of(data, begin[terms], length[terms])
        order = radix_order(words)
        new = np.logical_or.reduce([_changes(w[order]) for w in words])
        out.append(_runs(terms, order, new, begin, length, group, row))
    while (size > low).any():
        high = low * 2 if low > 64 else low + 16
        terms = by_group[(size > low) & (size <= high)]
        low = high
        if not len(terms):
            continue
        places = np.arange(high)
        held = places < length[terms][:, None]
        matrix = np.where(held, data[np.minimum(begin[terms][:, None] + places, len(data) - 1)], np.uint8(0))
        padded = matrix.view(f"S{high}").ravel()
        order = np.argsort(padded, kind="stable")
        out.append(_runs(terms, order, _changes(padded[order]), begin, length, group, row))
    if not out:
        none = np.empty(0, np.int64)
        return Runs(none, none, group[:0], none, none)
    return Runs(*[np.concatenate([getattr(r, f) for r in out]) for f in ("begin", "length", "group", "count", "texts")])


def strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """The terms as an Arrow string column."""
    ends = np.cumsum(length)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    at = np.repeat(begin - (ends - length), length) + np.arange(int(offsets[-1]))
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def pieces(begin: np.ndarray, size: int) -> Iterator[slice]:
    """Runs of terms that begin within about `size` bytes of each other, so that very long texts take bounded memory."""
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + size)))
        yield slice(at, stop)
        at = stop
