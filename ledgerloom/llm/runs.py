"""Runs of repeated words, by divide and conquer.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of max(MIN_WORDS, 2 * q) words or more, that no neighbouring word extends
keeping period q. Words are interned as numbers of their text. A stretch is halved;
Z-functions from its middle give, for every period at once, how far words one period
apart agree to the right and to the left, and so the repetitions that cross the middle;
then both halves are searched. The smallest period comes first, is extended and taken,
and what lies within a taken run is left out, so each run comes once, with its smallest period.

Every run consists of stretches of SEED words that come twice, so only stretches
of words in such seeds are searched; that leaves nothing out. A text is one unit
of work: n words take n * log(n) steps at most, and memory in proportion to n.

Cases. Null, empty and blank texts have no words and no runs; their collapsed text is empty.
Very long texts are read whole. Runs overlap freely; each is listed, by start, then period. Rows that
repeat each get their own result; ids are not looked at. Every column stays, new ones get a free name; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Words that a run has at least.
MIN_WORDS = 12
FIELDS = ("start", "length", "period")
#: Texts whose results a task holds at a time.
ROWS = 256


def z_function(s: list[int]) -> list[int]:
    """Of each place, how many numbers from there on equal those from the start on; the whole length at 0."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(s: list[int], mid: int, least: int) -> np.ndarray:
    """Repetitions of s that cross mid, as rows (period, start, end), by period: of 2 periods and least words or more."""
    left, right, n = s[:mid], s[mid:], len(s)
    ahead = np.array(z_function([*right, -1, *s]))  # against the right half, from mid on
    behind = np.array(z_function([*left[::-1], -1, *s[::-1]]))  # against the left half, from mid back
    q = np.arange(1, n - mid + 1)  # words at mid + i and mid + q + i
    go, back = np.append(ahead[1 : n - mid], 0), behind[mid + 1 + (n - mid) - q]
    found = [np.stack([q, mid - back, mid + q + go], 1)]
    q = np.arange(1, mid + 1)  # words at mid - q + i and mid + i
    go, back = ahead[n - mid + 1 + mid - q], np.append(behind[1:mid], 0)
    found.append(np.stack([q, mid - q - back, mid + go], 1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 2] - rows[:, 1] >= np.maximum(2 * rows[:, 0], least)]
    return rows[np.argsort(rows[:, 0], kind="stable")]


def _outside(rows: np.ndarray, q: int, start: int, end: int) -> np.ndarray:
    """rows without those that lie within a run of period q: a longer period that repeats there is a multiple of q."""
    return rows[(rows[:, 0] < q) | (rows[:, 1] < start) | (rows[:, 2] > end)]


def _search(s: list[int], least: int, at: int, out: set[tuple[int, int, int]]) -> None:
    """Adds the runs of s, shifted by at, to out as (start, period, length)."""
    todo: list[tuple[int, int, list[tuple[int, int, int]]]] = [(0, len(s), [])]
    while todo:
        lo, hi, known = todo.pop()  # known: taken runs (period, start, end) that reach into lo .. hi
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        rows = crossing(s[lo:hi], mid - lo, least)
        rows[:, 1:] += lo
        for run in known:
            rows = _outside(rows, *run)
        while len(rows):
            q, a, b = (int(x) for x in rows[0])
            while a and s[a - 1] == s[a - 1 + q]:
                a -= 1
            while b < len(s) and s[b] == s[b - q]:
                b += 1
            known = [*known, (q, a, b)]
            out.add((a + at, q, b - a))
            rows = _outside(rows, q, a, b)
        for x, y in ((lo, mid), (mid, hi)):
            todo.append((x, y, [(q, a, b) for q, a, b in known if min(b, y) - max(a, x) >= least]))


def islands(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of ids that hold every run: words in seeds that come twice within the stretch."""
    seed = max(1, (least + 1) // 2)  # a run of n >= max(least, 2 q) words has n - q >= seed places that agree q apart
    n = len(ids) - seed + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(seed):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int32)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + seed, -1)
    inside = np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= least:
            part = h[a : b - seed + 1]
            if len(np.unique(part)) < len(part):
                out.append((a, b))
    return out


def find_runs(words: list, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """The runs of a list of words as (start, length, period), by start, then period."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    out: set[tuple[int, int, int]] = set()
    if len(number) < len(ids):
        for a, b in islands(np.array(ids, np.int64), least):
            _search(ids[a:b], least, a, out)
    return [(a, n, q) for a, q, n in sorted(out)]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, k in zip(words, np.cumsum(edge).tolist(), strict=False) if not k]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with n_words, runs (start, length, period: the first word's number, words, words) and collapsed, the words left joined by one space."""
    raw = fresh(docs, "raw")
    new = [T.StructField(fresh(docs, "n_words"), T.LongType()), T.StructField(fresh(docs, "runs"), T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in FIELDS]))), T.StructField(fresh(docs, "collapsed"), T.StringType())]
    names, kind = docs.columns, pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))

    def run(batches):
        for big in batches:
            for k in range(0, max(1, big.num_rows), ROWS):
                batch = big.slice(k, ROWS)
                counts, found, left = [], [], []
                for t in batch.column(len(names)).to_pylist():
                    words = (t or b"").split()  # of bytes: by the six ASCII white-space characters alone
                    runs = find_runs(words, least)
                    counts.append(len(words))
                    found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                    left.append(b" ".join(kept_words(words, runs)))
                arrays = [pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], names=[*names, *(f.name for f in new)])

    return docs.withColumn(raw, F.col(text).cast("binary")).mapInArrow(run, T.StructType([*docs.schema.fields, *new]))
