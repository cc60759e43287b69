"""Code lengths against a PPM coder written byte by byte, and held-out accuracy."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import language_id, queries

from .helpers import no_documents, odd_documents

DATA = "/root/testdata/sf0.01"


def plain_model(texts, order, rare):
    """Which bytes follow each context, for contexts that are not too rare."""
    seen = defaultdict(Counter)
    for t in texts:
        p = bytes(order) + t
        for i in range(order, len(p)):
            for k in range(order + 1):
                seen[p[i - k : i]][p[i]] += 1
    total = sum(map(len, texts))
    return {c: f for c, f in seen.items() if sum(f.values()) * rare >= total}


def plain_length(t, seen, order):
    p, units = bytes(order) + t, 0
    for i in range(order, len(p)):
        bits, out = 0.0, set()
        k = next(k for k in range(order, -1, -1) if p[i - k : i] in seen)
        for j in range(k, -1, -1):
            f = {b: n for b, n in seen[p[i - j : i]].items() if b not in out}
            total, kinds = sum(f.values()), len(f)
            if p[i] in f:
                bits -= math.log2(f[p[i]] / (total + kinds))
                break
            if kinds:
                bits -= math.log2(kinds / (total + kinds))
            out |= set(f)
        else:
            bits += math.log2(256 - len(out))
        units += round(bits * language_id.BIT)
    return units


def some_texts(seed, letters, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(n)]


@pytest.mark.parametrize("order,rare", [(4, 16384), (3, 40), (1, 10), (2, 1)])
def test_lengths_equal_a_plain_coder(spark, order, rare):
    texts = {"a": some_texts(1, "abc é", 12), "b": some_texts(2, "abbbß \n", 9)}
    rows = [(t, x) for x, ts in texts.items() for t in ts] + [(None, "a"), ("", "b"), ("zz", None), ("", "empty")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), order=order, rare=rare)
    assert model.langs == ["a", "b"]
    asked = [b"", b"a", "abc é zzz \0\0 ".encode() * 3, *(t.encode() for t in some_texts(3, "abcß z\n", 6)), b"abcab" * 700]
    got = language_id.lengths(np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)]), model)
    plain = {x: plain_model([t.encode() for t in ts], order, rare) for x, ts in texts.items()}
    assert got.tolist() == [[plain_length(t, plain[x], order) for x in ("a", "b")] for t in asked]


def test_cut_texts_count_alike():
    text = "abc é".encode() * 100
    code, n = language_id.grams([(bytes(4), text)], 4)
    cut = Counter()
    for piece in language_id.pieces(text, 4, 7):
        for c, k in zip(*language_id.grams([piece], 4), strict=True):
            cut[c] += k
    assert dict(zip(code.tolist(), n.tolist(), strict=True)) == cut


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op11_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs[:200])
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


def test_odd_rows(spark, tmp_path):
    more = [(60, "12 34 !?"), (61, "ЖЖЖ"), (62, "漢"), (63, "un deux " * 40_000), (64, "́")]
    docs = odd_documents(spark, more).toDF("doc_id", "text", "lang", "source", "n_chars", "score", "raw", "lang_pred")
    model = language_id.fit(docs)
    out = language_id.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred_", "score_", "bits"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score_ <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred_ == "und"}
    assert und == {4, 5, 6, 60, 64, None} and {r.lang_pred_ for r in rows} == {"en", "und"}
    nothing = language_id.identify(docs, language_id.fit(no_documents(spark))).collect()
    assert {(r.lang_pred_, r.score_) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    assert language_id.identify(no_documents(spark), model).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_language_id(spark, str(tmp_path)).count() == len(rows)


def test_ties_go_to_the_first(spark):
    rows = [("same text here", "y"), ("same text here", "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = language_id.identify(df, language_id.fit(df)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("x", 0.5)}
