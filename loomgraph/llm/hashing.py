"""Words and word shingles of whole texts as 64-bit hashes, for use inside Arrow tasks.

A word's hash is multilinear: one random number per byte value times one random odd
number per position, summed modulo 2^64 and mixed. Texts are handled in slices of
bounded size, so memory per task follows the slice (or the longest word), and eight
bytes per word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SEED = 0x9E3779B97F4A7C15
_U = np.uint64
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_numbers(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(salt << 32)) * _U(SEED))


_EXACT = random_numbers(256, 1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _LOWER[97:123]
_PLACE = random_numbers(4096, 2) | _U(1)
_STEP = random_numbers(64, 3) | _U(1)
_LENGTH = random_numbers(64, 4)


def _places(n: int) -> np.ndarray:
    return _PLACE if n <= len(_PLACE) else random_numbers(n, 2) | _U(1)


def _hash_slice(data: np.ndarray, breaks: np.ndarray, lower: bool):
    """Word hashes of ``data``; a word also ends at each offset in ``breaks``."""
    inside = ~_IS_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts.astype(_U), starts
    where = np.flatnonzero(inside)
    begin = np.searchsorted(where, starts)
    lengths = np.diff(np.append(begin, len(where)))
    place = np.arange(len(where)) - np.repeat(begin, lengths)
    value = (_LOWER if lower else _EXACT)[data[where]] * _places(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, begin)), starts


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE_BYTES, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces that end after white space."""
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data):
            white = np.flatnonzero(_IS_WHITE[data[at:end]])
            if len(white):
                end = at + int(white[-1]) + 1
                break
            end = min(end + SLICE_BYTES, len(data))
        yield data[at:end]
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for every row of a string column, in order."""
    if not len(column):
        return
    data, offsets = buffers(column)
    with np.errstate(over="ignore"):
        for i, j in _slices(offsets):
            part = data[offsets[i] : offsets[j]]
            if j == i + 1 and len(part) > SLICE_BYTES:
                none = np.zeros(0, np.int64)
                yield i, np.concatenate([_hash_slice(p, none, lower)[0] for p in _pieces(part)])
                continue
            breaks = offsets[i : j + 1] - offsets[i]
            hashes, starts = _hash_slice(part, breaks[:-1], lower)
            ends = np.searchsorted(starts, breaks)
            for row in range(i, j):
                yield row, hashes[ends[row - i] : ends[row - i + 1]]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; empty for shorter texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _STEP[0]
        for k in range(1, width):
            total = total + hashes[k : n + k] * _STEP[k]
        return mix(total + _LENGTH[width])


def windows_at(hashes: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    """``windows(hashes, width)[places]``, of which only these are formed."""
    with np.errstate(over="ignore"):
        total = hashes[places] * _STEP[0]
        for k in range(1, width):
            total = total + hashes[places + k] * _STEP[k]
        return mix(total + _LENGTH[width])


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle of all its words."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes (none empty), in slices of SLICE_BYTES or one longer span."""
    lengths = end - start
    edges, out = np.concatenate([[0], np.cumsum(lengths)]), np.zeros(len(start), _U)
    with np.errstate(over="ignore"):
        for i, j in _slices(edges):
            size = lengths[i:j]
            begin = edges[i:j] - edges[i]
            place = np.arange(edges[j] - edges[i]) - np.repeat(begin, size)
            value = _EXACT[data[np.repeat(start[i:j], size) + place]] * _places(int(size.max()))[place]
            out[i:j] = mix(np.add.reduceat(value, begin))
    return out
