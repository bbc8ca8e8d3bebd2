"""Content-defined grouping of all fixed-length windows of a text.

A window of SPAN bytes belongs to its anchor: the place of the smallest hash (by its upper 44 bits) among its GRAM-byte
strings, the leftmost if several are smallest.  The anchor depends on the window's bytes alone, so equal windows have equal anchor hashes,
and consecutive windows mostly share one anchor: they form a piece, the bytes from the first window's start to
the last window's end.
"""

import numpy as np

SPAN, GRAM = 400, 48
_PLACES = SPAN - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)


def powers(base, n):
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = powers(_BASE, _BLOCK + SPAN), powers(_UNBASE, _BLOCK + SPAN)


def gram_hashes(data, size):
    """A 64-bit hash of every `size`-byte string of `data` (at most _BLOCK + SPAN bytes)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _INVERSE[: len(data) - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h, width):
    """Smallest of every `width` consecutive values, by prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def pieces(raw):
    """(anchor hash, start, windows, anchor offset) arrays: every window of `raw` is in exactly one piece."""
    found = []
    total = len(raw) - SPAN + 1
    for at in range(0, max(total, 0), _BLOCK):
        data = np.frombuffer(raw, np.uint8, min(_BLOCK + SPAN - 1, len(raw) - at), at)
        h = gram_hashes(data, GRAM)
        # The place in the low bits: the smallest number is the leftmost of the smallest hashes.
        low = _sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), _PLACES)
        fresh = np.ones(len(low), bool)
        fresh[1:] = low[1:] != low[:-1]
        first = np.nonzero(fresh)[0]
        place = (low[first] & _PLACE).astype(np.int64)
        found.append((h[place], first + at, np.diff(first, append=len(low)), place - first))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))
