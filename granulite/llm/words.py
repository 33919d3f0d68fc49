"""Words, word hashes and windows of many texts at once, on NumPy arrays.

A word is a maximal run of characters outside the six ASCII white-space
characters (0x20 and 0x09 to 0x0D), as the contracts of this package define it.
UTF-8 keeps those bytes out of other characters, so all of this works on bytes:
no Python object is made for a word. Texts are handled in segments of about
``SEGMENT`` bytes, so temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64
_SPACE = np.ones(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
NOT_SPACE = _SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (every output bit depends on every input bit)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i mod 2^64 for i up to n, kept between calls up to a segment's length."""
    if not _powers or len(_powers["p"]) <= n:
        size = max(n, SEGMENT) + 2
        for name, r in (("p", _R), ("q", _R_INV)):
            x = np.full(size, r, _U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    p, q = _powers["p"], _powers["q"]
    if len(p) > 8 * SEGMENT:  # made for one very long text: not kept
        _powers.clear()
    return p, q


@dataclass
class Words:
    """The words of consecutive texts. ``doc`` numbers the texts from 0 within the batch."""

    doc: np.ndarray  # int64, ascending
    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    hash: np.ndarray  # uint64
    data: np.ndarray  # uint8, of the segment
    first: int  # number of the segment's first text
    offsets: np.ndarray  # byte offsets of the segment's texts into ``data``, one more than texts

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        """Words of each text of the segment."""
        return np.bincount(self.doc - self.first, minlength=self.n_docs)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a column of strings; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def segments(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes each, at least one text."""
    n, i, size = len(offsets) - 1, 0, size or SEGMENT
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and byte after the last of each word."""
    solid = NOT_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever it stands."""
    if not len(start):
        return np.empty(0, _U)
    p, q = _power(len(data))
    h = np.empty(len(data) + 1, _U)
    h[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * p[: len(data)], out=h[1:])
    return mix((h[end] - h[start]) * q[start] + _U(0x632BE59BD9B4E019) * (end - start).astype(_U))


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int | None = None) -> Iterator[Words]:
    """The words of a column of texts, segment by segment."""
    offsets, data = buffers(texts)
    for i, j in segments(offsets, size):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            part = LOWER[part]
        doc, start, end = bounds(part, off)
        yield Words(doc + i, start, end, hashes(part, start, end), part, i, off)


_M = [_U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive values; the caller drops runs that cross texts.

    Runs double in length, so n values cost about 2 log2 n passes, whatever n is.
    """
    if len(h) < n:
        return np.empty(0, _U)
    have, size, out, taken = h if not salt else mix(h + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), 1, None, 0
    step = salt % len(_M)
    while True:
        if n & size:
            out = have if out is None else out[: len(have) - taken] * _M[(step + 1) % 6] + have[taken:][: len(out)]
            taken += size
        if taken == n:
            break
        have = have[:-size] * _M[step % 6] + have[size:]
        size, step = 2 * size, step + 1
    return mix(out[: len(h) - n + 1])
