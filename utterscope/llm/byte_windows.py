"""Blocks of byte windows that share their minimizer.

All windows of ``LENGTH`` bytes of a text fall into blocks of consecutive
windows with the same smallest ``GRAM``-byte substring.  Where a block begins
and ends depends on nearby bytes only, so repeated stretches fall into the
same blocks wherever they stand, and equal windows are always found in blocks
with the same minimizer.
"""

from __future__ import annotations

import numpy as np
import xxhash

LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams of a window
PIECE = 1 << 19  # bytes of a text that are worked on at a time

_LOW = np.uint64(0xFFFFF)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every place on."""
    parts, x, size = {}, codes.astype(np.uint64) + np.uint64(1), 1
    while size <= GRAM:
        parts[size] = x
        if 2 * size > GRAM:
            break
        turn = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64) | 1)
        x = x[:-size] * turn + x[size:]
        size *= 2
    n = len(codes) - GRAM + 1
    out, at = np.zeros(n, dtype=np.uint64), 0
    for size in sorted(parts, reverse=True):  # the binary digits of GRAM
        if GRAM & size:
            out = out * np.uint64(0xD6E8FEB86659FD93) + parts[size][at:at + n]
            at += size
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(29))


def blocks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer hash) of the blocks of a
    text, in order; none below ``LENGTH`` bytes."""
    found = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        codes = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + LENGTH - 1, len(data) - begin), offset=begin)
        hashes = gram_hashes(codes)
        # the leftmost of the smallest: the place breaks ties
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size < SPAN:
            step = min(size, SPAN - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        place = (least & _LOW).astype(np.int64)
        firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((firsts + begin, np.diff(np.r_[firsts, len(place)]), hashes[place[firsts]].view(np.int64)))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def block_hashes(data: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each block."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    return np.fromiter((digest(view[a:a + n]) for a, n in zip(first.tolist(), (count + LENGTH - 1).tolist())),
                       dtype=np.uint64, count=len(first)).view(np.int64)
