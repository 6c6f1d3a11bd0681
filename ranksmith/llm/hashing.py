"""Hashes of words and byte strings over whole column buffers."""

from __future__ import annotations

import numpy as np

from .common import SPACE_BYTES, TABLES, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
TABLES.append(_POWERS.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse mod 2^64."""
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the hash of data[a:b], wherever it stands, is
    (sums[b] - sums[a]) * inverse[a] mod 2^64."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:len(data)], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts in a buffer; words are runs of
    bytes other than ASCII white space, A-Z lower-cased if asked for."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    begin = inside & (np.r_[True, ~inside[:-1]] | cut[:n])
    end = inside & (np.r_[~inside[1:], True] | cut[1:])
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums, down = prefix_sums(data)
    h = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(offsets, a, side="right") - 1


def chain(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours of ``h``."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix64(out * _BASE + h[k:n + k])
    return out
