"""Whole Arrow batches of text as numpy arrays: words, word hashes, word n-grams.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; no such byte is part
of a multi-byte UTF-8 character, so bytes may be split where code points may.
Hashes are 64-bit polynomials over random byte values, finished by a mixer; they
are computed for all words of a batch at once from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(0x5EED)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
GRAM = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[base] = have = np.cumprod(p, dtype=np.uint64)
    if n > 1 << 22:  # a giant row's table isn't worth keeping
        _POWERS.pop(base, None)
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]] if len(arr) else buf[:0], offs - offs[0] if len(arr) else np.zeros(1, np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 18, most_rows: int = 256):
    """Slices of the batches with few bytes each (a longer row alone): (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + most_bytes, side="right")) - 1
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at), buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


class Words:
    """The words of one slice: ``start``/``end`` byte positions, ``per_row`` counts, ``row`` of each word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool):
        self.buf = buf = _LOWER[buf] if lower else buf
        self.offs = offs
        space = _SPACE[buf]
        solid = ~space
        starts, ends = solid.copy(), solid.copy()
        if len(buf):
            starts[1:] &= space[:-1]
            ends[:-1] &= space[1:]
            full = offs[:-1] < offs[1:]
            first, last = offs[:-1][full], offs[1:][full] - 1
            starts[first] = solid[first]
            ends[last] = solid[last]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.solid = solid
        at = np.searchsorted(self.start, offs)
        self.first = at[:-1]
        self.per_row = np.diff(at)
        self.row = np.repeat(np.arange(len(offs) - 1), self.per_row)

    def prefix(self) -> np.ndarray:
        """Prefix sums from which any byte range's hash follows."""
        n = len(self.buf)
        h = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.buf] * powers(_BASE, n), out=h[1:], dtype=np.uint64)
        return h

    def ranges(self, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        h = self.prefix() if h is None else h
        return mix((h[end] - h[start]) * powers(_INVERSE, len(self.buf) + 1)[start])

    def hashes(self) -> np.ndarray:
        return self.ranges(self.start, self.end)


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of k words inside one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h = np.full(n, k * int(GRAM[15]) % 2**64, dtype=np.uint64)
    for j in range(k):
        h += hashes[j : j + n] * GRAM[j]
    return at, mix(h[at])


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (row, 56-bit hash), sorted; a shorter row's whole sequence is its one shingle.

    At most 256 rows: the row shares a 64-bit sort key with the hash.
    """
    wh = words.hashes()
    at, h = grams(wh, words.row, k)
    keys = [words.row[at].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)]
    for m in range(1, k):
        rows = np.flatnonzero(words.per_row == m)
        if len(rows):
            h = np.full(len(rows), m * int(GRAM[15]) % 2**64, dtype=np.uint64)
            for j in range(m):
                h += wh[words.first[rows] + j] * GRAM[j]
            keys.append(rows.astype(np.uint64) << np.uint64(56) | mix(h) >> np.uint64(8))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(56)).astype(np.int64), key & np.uint64(2**56 - 1)
