"""Hashes of words and word runs over Arrow string arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once; a longer text is taken alone and whole.
CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


_VALUES = _byte_values()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for k, base in enumerate((_MULT, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def pieces(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about ``most`` bytes each; nulls become empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield at, texts.slice(at, i - at)
            at, size = i, 0
        size += int(n)
    if at < len(sizes):
        yield at, texts.slice(at)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array without nulls, and the bounds of its rows."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, A-Z lower-cased, and the bounds of each row's words.

    ``texts``: large_string without nulls. Words are runs of bytes other than ASCII white space.
    """
    data, bounds = raw_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_IS_SPACE[data]
    begins, ends = bounds[:-1][bounds[:-1] < n], bounds[1:][bounds[1:] > 0] - 1
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[begins] |= word[begins]  # a word never goes on in the next row
    last[ends] |= word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    h = mix((sums[stops] - sums[starts]) * down[starts])
    return h, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each row.

    A row of fewer words has its whole sequence as one; a row without words has none.
    """
    h, bounds = word_hashes(texts)
    n = len(h) - width + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        runs = runs * _MULT + h[k : n + k]
    runs = mix(runs)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for x in h[lo:hi]:
                one = one * _MULT + x
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
