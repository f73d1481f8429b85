"""Words of Arrow string arrays as numpy arrays.

Texts are taken as UTF-8 bytes in slices of bounded size, so that a batch with
long texts does not multiply the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most, unless one text is longer.
SLICE_BYTES = 4 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

# Odd multipliers of the polynomial hashes, and those of the
# public splitmix64 finalizer.
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


@dataclass
class Words:
    """Word `k` of the slice is `data[starts[k]:ends[k]]`; document `d` has the
    words from `first[d]` up to `first[d + 1]`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a string column, nulls as empty texts, with their offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, column.slice(begin, end - begin)
        begin = end


def split(column: pa.Array) -> Words:
    """The words of a `large_string` array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial in its bytes."""
    n = len(words.data)
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
    value = (prefix[words.ends] - prefix[words.starts]) * powers(n, inverse)[words.starts]
    return mix(value)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` consecutive values."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total = total * BASE + hashes[i : i + len(total)]
    return total


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a run of `width` words lies within one document."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, np.int64)
    doc_end = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    return np.flatnonzero(np.arange(n - width + 1) + width <= doc_end)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over each document's run, zero where it is empty."""
    total = np.zeros(len(values) + 1, np.result_type(values, np.int64) if values.dtype.kind in "iub" else float)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
