"""Vectorised words, shingles and hashes over Arrow string columns.

A *word* is a maximal run of bytes other than space and the control bytes
9..13; ``A-Z`` are lower-cased, nothing else is changed.  Everything works on
the bytes of many texts at once with numpy, in slices of a few megabytes, so a
batch of any number of texts needs bounded memory besides one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)
_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of plain tokens: ASCII other than letters and digits.
NOT_TOKEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
_FOLDED = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 1)
        got = np.full(size, base, dtype=_U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size > 4 * SLICE_BYTES:  # one very long text: don't keep its tables
            return got
        _powers[kind] = got
    return got[:n]


class Words:
    """Words of a run of texts.

    ``hashes``, ``start`` and ``end`` (byte offsets into ``data``) are parallel;
    the words of text ``i`` are ``bounds[i]:bounds[i + 1]``.
    """

    __slots__ = ("_total", "bounds", "data", "end", "hashes", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, separators: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hashes, self._total = np.zeros(0, dtype=_U64), np.zeros(1, dtype=_U64)
            self.bounds = np.zeros(len(offsets), dtype=np.int64)
            return
        word = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        total = np.zeros(n + 1, dtype=_U64)
        values = (_FOLDED if fold else _BYTE)[data]
        values *= _power("up", _MULT, n)
        np.cumsum(values, out=total[1:])
        self._total = total
        self.hashes = self._hash(self.start, self.end)
        self.bounds = np.searchsorted(self.start, offsets)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._total[end] - self._total[start]) * _power("down", _INV, len(self.data))[start]
        return mix(raw + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words longer than ``length`` bytes, and the hashes of their first ``length`` bytes with the number as a mark."""
        at = np.flatnonzero(self.end - self.start > length)
        start = self.start[at]
        return at, mix(self._hash(start, start + length) + _U64(length))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside one text, and their bounds by text."""
        w, n = self.hashes, len(self.hashes) - width + 1
        count = np.maximum(np.diff(self.bounds) - width + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(count)])
        if n <= 0:
            return np.zeros(0, dtype=_U64), bounds
        acc = np.zeros(n, dtype=_U64)
        for j in range(width):
            acc = (acc ^ w[j : n + j]) * _MULT
            acc ^= acc >> _U64(29)
        acc = mix(acc + _U64(width))
        if width > 1:
            keep = np.ones(n, dtype=bool)
            ends = self.bounds[1:]
            for j in range(1, width):  # a run must not reach over the end of its text
                at = ends - j
                at = at[(at >= 0) & (at < n) & (at >= self.bounds[:-1])]
                keep[at] = False
            acc = acc[keep]
        return acc, bounds


def whole_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole word sequence as one shingle."""
    acc = np.zeros(1, dtype=_U64)
    for w in words:
        acc = (acc ^ w) * _MULT
        acc ^= acc >> _U64(29)
    return mix(acc + _U64(len(words)))[0]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), dtype=bool)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64), valid
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0], valid


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``SLICE_BYTES``: first row, end row, bytes, offsets."""
    data, offsets, _ = utf8(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n, row + 20_000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(column: pa.Array, fold: bool = True, separators: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, offsets in slices(column):
        yield row, end, Words(data, offsets, fold, separators)


class HashArray:
    """Sorted 64-bit hashes with an index on their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        tops = np.arange(1 << self.bits, dtype=_U64) << _U64(64 - self.bits)
        self.index = np.searchsorted(keys, tops).astype(np.int64)

    def find(self, query: np.ndarray) -> np.ndarray:
        """Positions of the queries in ``keys``, -1 where there is none."""
        if len(self.keys) == 0:
            return np.full(len(query), -1, dtype=np.int64)
        at = self.index[(query >> _U64(64 - self.bits)).astype(np.int64)]
        top = len(self.keys) - 1
        got = self.keys[np.minimum(at, top)]
        open_ = np.flatnonzero(got < query)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] <= top]
            open_ = open_[self.keys[at[open_]] < query[open_]]
        at = np.minimum(at, top)
        at[self.keys[at] != query] = -1
        return at
