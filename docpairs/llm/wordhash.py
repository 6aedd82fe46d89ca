"""Words of many texts at once, as 64-bit hashes in numpy.

Words are the maximal runs of bytes other than 0x09-0x0D and 0x20, A-Z lower-cased. A
word's hash is a polynomial over its bytes modulo 2^64, taken from running sums over a
stretch of text, then mixed; it depends on the word alone.
"""

from __future__ import annotations

import numpy as np

from .common import ascii_lower_bytes

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
STRETCH = 1 << 21


def mix(x):
    """A bijective finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"n": 0}


def _powers(n: int):
    if _POWERS["n"] < n:
        _POWERS.update(n=n, p=np.cumprod(np.full(n, _P)) * _Q, q=np.cumprod(np.full(n, _Q)) * _P)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column without nulls."""
    import pyarrow as pa
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, size)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def slices(column, limit: int = 8 << 20):
    """Consecutive parts of a column with about ``limit`` bytes each (one text at least)."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of every word, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = ascii_lower_bytes(data)
    inside = ~_SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(stops, low + STRETCH, side="right")))
        high = stops[upto - 1]
        p, q = _powers(int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * q, out=sums[1:])
        s, e = starts[at:upto] - low, stops[at:upto] - low
        hashes[at:upto] = mix((sums[e] - sums[s]) * p[s] + (e - s).astype(np.uint64) * _P)
        at = upto
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def hash_word(word: bytes) -> int:
    """The hash of one word, by definition (for tests)."""
    total = sum((b + 1) * pow(int(_Q), j, 1 << 64) for j, b in enumerate(word.lower() if word.isascii() else word))
    return int(mix(np.array([(total + len(word) * int(_P)) % (1 << 64)], np.uint64))[0])
