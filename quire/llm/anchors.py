"""Content-defined anchors: where, inside every fixed-size byte window, is the smallest k-gram?

Two equal windows select the same k-gram at the same relative place, whatever surrounds
them, so a window can only be shared if the k-gram at its anchor is shared.  All code here
works on one concatenated buffer with numpy and in blocks that stay in the CPU caches.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 16
_POS_BITS = 24
_POS_MASK = np.uint64((1 << _POS_BITS) - 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**64, 64, dtype=np.uint64)]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit integers."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S33
    return x


def kgram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hash of every k-gram of a uint8 buffer (length len(buf) - k + 1)."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # parts[j] hashes 2**j bytes; k is put together from its binary digits
    part, width, have, total = _TABLE[buf], 1, None, 0
    while True:
        if k & width:
            m = len(buf) - (total + width) + 1
            have = part[:m] if have is None else have[:m] * _ODD[32 + total % 32] + part[total : total + m]
            total += width
        if width * 2 > k:
            break
        part = part[:-width] * _ODD[width.bit_length()] + part[width:]
        width *= 2
    return mix64(have[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (length len(x) - w + 1)."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


def anchor_runs(buf: np.ndarray, ends: np.ndarray, window: int, k: int):
    """Maximal runs of window starts that share one anchor.

    buf: documents one after another; ends: where each ends.  Returns arrays
    (anchor, first, last, hash): window starts first..last (inclusive, all inside one
    document) have the leftmost smallest k-gram of their window at `anchor`.
    """
    empty = np.empty(0, np.int64)
    n = len(buf) - window + 1
    if n <= 0:
        return empty, empty, empty, np.empty(0, np.uint64)
    w = window - k + 1
    valid = np.ones(n, bool)
    for back in range(1, window):
        cut = ends - back
        cut = cut[(cut >= 0) & (cut < n)]
        valid[cut] = False
    anchors, firsts, lasts, hashes = [], [], [], []
    for b in range(0, n, _BLOCK):
        e = min(n, b + _BLOCK)
        h = kgram_hashes(buf[b : e + window - 1], k)
        packed = (h & ~_POS_MASK) | np.arange(len(h), dtype=np.uint64)
        low = _sliding_min(packed, w)
        at = (low & _POS_MASK).astype(np.int64)
        ok = valid[b:e]
        step = np.empty(e - b, bool)
        step[0] = True
        step[1:] = (at[1:] != at[:-1]) | (ok[1:] & ~ok[:-1])
        first = np.flatnonzero(step & ok)
        if not len(first):
            continue
        stop = np.flatnonzero(np.append(step[1:] | ~ok[1:], True) & ok)
        anchors.append(at[first] + b)
        firsts.append(first + b)
        lasts.append(stop + b)
        hashes.append(h[at[first]])
    if not anchors:
        return empty, empty, empty, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in (anchors, firsts, lasts, hashes))
