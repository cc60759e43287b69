"""Periodic runs against all periods and starts tried one by one."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import queries, runs

from .helpers import no_documents, odd_documents


def brute(words, least=12):
    """Every (start, length, period) by the definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def cases():
    rng = random.Random(3)
    for size, letters in ((0, 1), (1, 1), (11, 1), (12, 1), (13, 1), (40, 1), (60, 2), (90, 2), (200, 2), (200, 3), (300, 6)):
        for _ in range(25):
            yield [rng.choice("abcdef"[:letters]) for _ in range(size)]
    for _ in range(300):  # planted runs, one within another, with errors
        w = []
        while len(w) < 150:
            block = [rng.choice("abcd") for _ in range(rng.randint(1, 20))]
            if rng.random() < 0.5:
                block = block * rng.randint(2, 4)
            w += block * rng.randint(1, 5)
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "x"
        yield w
    a, b = ["a"], ["b"]
    while len(b) < 300:
        a, b = b, b + a  # Fibonacci words are full of runs
    yield b


def test_equal_to_all_periods_tried():
    n = 0
    for w in cases():
        got = runs.find_runs(w)
        assert got == brute(w), w
        n += len(got)
        for least in (2, 5):
            if len(w) < 100:
                assert runs.find_runs(w, least) == brute(w, least), (w, least)
    assert n > 500


def test_long_texts_stay_fast():
    w = ["a"] * 60_000
    assert runs.find_runs(w) == [(0, 60_000, 1)]
    w = [str(i % 7001) for i in range(50_000)]
    assert runs.find_runs(w) == [(0, 50_000, 7001)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("ka", "lo", "mi")) for _ in range(rng.randint(0, 80)))) for i in range(100, 400)]
    docs = odd_documents(spark, [*rows, (50, " a\x1cb " * 20), (51, "é\n" * 13)]).withColumnsRenamed({"n": "runs", "score": "raw", "key": "collapsed"})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_word_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sum(1 for r in got if r[1]) > 20
    out = runs.periodic_runs(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[len(docs.columns) :] == ["n_words", "runs_", "collapsed_"]
    assert out.count() == docs.count()


def test_empty_table(spark, tmp_path):
    no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_word_runs(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("words,want", [(["a", "b"] * 6, [(0, 12, 2)]), (["a", "b"] * 5, []), (list("abcdefghijkl") * 2, [(0, 24, 12)]), (list("abcdefghijklm"), [])])
def test_thresholds(words, want):
    assert runs.find_runs(words) == want
