"""Words and word shingles of whole Arrow columns as 64-bit hashes, in arrays and without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit number for each byte.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: An odd factor for each place in a shingle.
_PLACES = mix(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def separators(extra: bytes = b"") -> np.ndarray:
    """Which bytes part words: white space and ``extra``."""
    found = np.zeros(256, bool)
    found[list(WHITE)] = True
    found[list(extra)] = True
    return found


_WHITE = separators()


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 19)
        back = pow(_BASE, -1, 1 << 64)
        made = []
        for factor in (_BASE, back):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers, _inverse = made
    return _powers[:n], _inverse[:n]


@dataclass
class Words:
    """The words of a column: hash, first byte and byte behind the last one, and the first word of each row."""

    data: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin in them; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    rows = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, rows - rows[0]


def words_of(column: pa.Array, parts: np.ndarray = _WHITE) -> Words:
    """Words of each row, A-Z lower-cased for the hash; ``parts`` says which bytes stand between words."""
    raw, rows = column_bytes(column)
    n = len(raw)
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = ~parts[raw]
    begins = inner[1:-1] & ~inner[:-2]
    ends = inner[1:-1] & ~inner[2:]
    edges = rows[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inner[1:-1][edges]
    ends[edges - 1] |= inner[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _grown(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[LOWERED[raw]] * power[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    return Words(raw, rows, hashes, start, end, np.searchsorted(start, rows))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _PLACES[k]
    return mix(out)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted by hash, and where each row's begin.

    A row of fewer words has its whole sequence as the only one; a row without words has none.
    """
    counts = words.counts
    every = grams(words.hashes, size)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words.hashes))
    whole = np.flatnonzero(place[: len(every)] + size <= words.first[row[: len(every)] + 1])
    value, owner = every[whole], row[whole]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        extra = [
            mix(np.sum(words.hashes[a : a + c] * _PLACES[:c], keepdims=True) + _PLACES[128 + c : 129 + c])[0]
            for a, c in zip(words.first[few].tolist(), counts[few].tolist(), strict=True)
        ]
        value = np.concatenate((value, np.array(extra, np.uint64)))
        owner = np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))
