"""Word shingles of a text as 64-bit hashes, by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _INVERSE ** i for i up to n, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            out = np.full(max(1 << 16, 2 * n), b, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z lower-cased; words are split at the six ASCII white-space characters."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles, sorted; of fewer words than one takes, the whole sequence; of none, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(words, len(w))
    s = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        s = mixed(s * _BASE + w[k : len(w) - width + 1 + k])
    return np.unique(s)
