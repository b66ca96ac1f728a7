"""Vectorised work on the UTF-8 bytes of Arrow string columns, inside Spark tasks.

A column is walked in chunks of about ``limit`` bytes so that the arrays built per chunk stay small,
whatever the Arrow batch size; a text is never split, so a chunk holds at least one whole text.
Words are hashed to 64 bits by a polynomial over a random byte table, then mixed; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240501)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

# Words that end only at ASCII space (0x20) and 0x09-0x0D.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
# Words made of digits, letters and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 20), _BASE if kind == "up" else _BASE_INVERSE, _U)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=_U)
    return _powers[kind][:n]


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) with offsets of len(rows) + 1; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the index of its first word (len(rows) + 1)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:] = inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, the same wherever the word stands."""
    if not len(starts):
        return np.empty(0, _U)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODE[data] * powers("down", len(data)), out=total[1:], dtype=_U)
    return mix((total[ends] - total[starts]) * powers("up", len(data))[starts] + (ends - starts).astype(_U))


PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; the run that starts at word i is at index i."""
    if len(hashes) < n:
        return np.empty(0, _U)
    total = np.full(len(hashes) - n + 1, n, _U)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * PLACE[i]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a shorter text is one shingle, one without words has none."""
    starts, ends, first = word_bounds(data, offsets, SPACE_SEPARATED)
    words = word_hashes(data, starts, ends)
    runs = sequence_hashes(words, n)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(runs[lo : hi - n + 1]))
        else:
            out.append(sequence_hashes(words[lo:hi], hi - lo) if hi > lo else np.empty(0, _U))
    return out
