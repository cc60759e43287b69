"""Parity sketches of shingle sets."""

from __future__ import annotations

import numpy as np

from .shingles import mixed

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A dense sketch has 64 << LEAST_BITS bits at least.
LEAST_BITS = 2


def band_of(n: int) -> int:
    """Size band: band b holds sizes from 4 ** b up to 4 ** (b + 1) - 1."""
    return (n.bit_length() - 1) // 2


def most_differing(n: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a set of n with one that it links to.

    With sizes n <= m <= n * 100 / percent the difference is at most (100 - percent) / (100 + percent) * (n + m)."""
    return n * (100 - percent) // percent


def identity(hashes: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    x = np.bitwise_xor.reduce(mixed(hashes + np.uint64(0x51ED270B))) if len(hashes) else np.uint64(0)
    s = np.add.reduce(mixed(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))) if len(hashes) else np.uint64(0)
    return int(mixed(np.array([x], np.uint64) * np.uint64(3) + np.array([s], np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


def dense(hashes: np.ndarray) -> np.ndarray:
    """A sketch of at least a bit a shingle, in 64-bit words, a power of two of them: each shingle flips one bit, so the bits in which two
    sketches differ are at most the shingles in which the sets do. The XOR of a sketch's halves is the sketch of half the width."""
    bits = 64 << max(LEAST_BITS, (len(hashes) // 64).bit_length())
    flips = np.bincount((mixed(hashes ^ np.uint64(0x77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def within(keys: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which keys are in late, a sorted array."""
    return late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys if len(late) else np.zeros(len(keys), bool)


def band_keys(hashes: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """The keys by which a set is found.

    In its size band a sketch has as many segments as the band's largest set has shingles, half as many from size 64 on; a segment is the
    XOR of the shingles that fall into it. Sets that link differ in at most d segments, so of the first d + 1 of
    either set's non-empty segments, in one order for all, one at least is in both. A set within reach
    of the band below is in that one, too. late: keys (sorted) that come last in the order."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    own, out = band_of(n), []
    for band in (own, own - 1) if own and n * PERCENT <= 100 * 4**own else (own,):
        segments = 4 ** (band + 1) >> (band >= 3)  # in larger bands a segment holds one to two shingles; more than d segments have some all the same
        at = mixed(hashes + np.uint64(band)) >> np.uint64(1)
        at = (at % np.uint64(segments)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        value = np.bitwise_xor.reduceat(mixed(hashes[order]), first)
        keys = mixed(value + mixed(at[first].astype(np.uint64) * np.uint64(64) + np.uint64(band + 1))).view(np.int64)
        take = min(len(keys), most_differing(n) + 1)
        rank = mixed(at[first].astype(np.uint64) + np.uint64(0xABCD))
        if late is not None and len(late):
            slow = within(keys, late)
            rank = (rank >> np.uint64(1)) | (slow.astype(np.uint64) << np.uint64(63))
        # with as many non-empty segments as may differ or fewer, empty ones count: one key stands for "all the same but empty"
        if len(keys) <= most_differing(n):
            out.append(mixed(np.array([band + 1], np.uint64)).view(np.int64))
        out.append(keys[np.argsort(rank, kind="stable")[:take]])
    return np.unique(np.concatenate(out))
