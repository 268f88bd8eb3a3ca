"""Vectorised 64-bit hashes of words, lines and substrings.

`pieces` identifies text: eight bytes at a time go through `mix`, so two pieces share a hash only by chance.
`kgrams` does so for short substrings at every position. All seeds are fixed, so every task of every run
gives the same hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SEED = 20240611
#: White space that separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_LANE = 8
#: Pieces longer than this are hashed one by one.
_LONG = 640
_KEY = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(_LANE)] + [(1 << 64) - 1], np.uint64)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal for equal bytes wherever they stand."""
    lengths = (ends - starts).astype(np.int64)
    out = mix(lengths.astype(np.uint64) + _KEY)
    padded = np.concatenate([data, np.zeros(_LANE, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    long = np.flatnonzero(lengths > _LONG)
    left = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    at = 0
    while len(left):
        # the bytes of a piece that end inside the lane; the others are masked
        lane = lanes[starts[left] + at] & _MASKS[np.minimum(lengths[left] - at, _LANE)]
        out[left] = mix((out[left] + lane) * _KEY ^ (out[left] >> np.uint64(29)))
        at += _LANE
        left = left[lengths[left] > at]
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, seed=_SEED)
    return out


def kgrams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position that has as many from it on; data has k bytes at least."""
    width, n = min(k, _LANE), len(data) - k + 1
    padded = np.concatenate([data, np.zeros(_LANE, np.uint8)])
    lane = np.ndarray((len(data) - width + 1,), np.dtype("<u8"), padded, strides=(1,)) & _MASKS[width]
    lane *= _KEY
    lane ^= lane >> np.uint64(32)
    out = lane[:n].copy()
    for at in (*range(_LANE, k - _LANE, _LANE), k - width):  # the last lane ends with the k bytes
        out *= _M
        out += lane[at : at + n]
    out ^= out >> np.uint64(29)
    out *= _KEY
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents; a word never crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end), A-Z lower-cased."""
    starts, ends = word_bounds(data, offsets)
    hashes = pieces(LOWER[data], starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    length = min(n, size)
    out = np.full(n - length + 1, length, np.uint64)
    for i in range(length):
        out = out * _M + hashes[i : n - length + 1 + i]
    return mix(out)
