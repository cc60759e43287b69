"""Token totals by tokenizer version, against a count of every text."""

import base64
from collections import Counter

import pytest

from ledgerloom.llm import queries, token_rollup
from ledgerloom.scratch import Scratch

from .helpers import odd_documents, words


def test_versions_are_told_apart(spark):
    book = token_rollup.Ledger(spark, Scratch(spark, "test-versions").root)
    schema = "op string, source string, lang string, tokenizer string, version string, tokens long, old_version string, old_tokens long"
    rows = [("insert", "a", "en", "w", "1", 5, None, None), ("insert", "a", "en", "w", "1", 7, None, None), ("revise", "a", "en", "w", "2", 3, "1", 5)]
    assert book.commit("1", spark.createDataFrame(rows, schema)) and not book.commit("1", spark.createDataFrame(rows, schema))
    assert {(r.version, r.n_docs, r.n_tokens) for r in book.totals().collect()} == {("1", 1, 7), ("2", 1, 3)}


def test_totals_of_both_vocabularies(spark, tmp_path):
    import random

    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    rng = random.Random(8)
    docs = odd_documents(spark, [(100 + i, words(rng, rng.randrange(15, 40)) + " 12 -- é\t\tdon't 日本語") for i in range(20)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for version, file in (("1", "byte_bpe_50k.tiktoken"), ("2", "byte_bpe_multi_50k.tiktoken")):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(file), "rb"))}
        coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in docs.collect():
            if len((r.text or "").split()) >= 20:
                want[r.source, r.lang, "bpe", version, "docs"] += 1
                want[r.source, r.lang, "bpe", version, "tokens"] += len(coder.encode_ordinary(r.text))
    rows = queries.op7_token_counts(spark, str(tmp_path)).collect()
    got = {(r.source, r.lang, r.tokenizer, r.version, k): n for r in rows if r.tokenizer == "bpe" for k, n in (("docs", r.n_docs), ("tokens", r.n_tokens))}
    assert got == dict(want) and want
    assert {(r.tokenizer, r.version) for r in rows} == {("bpe", "1"), ("bpe", "2"), ("words", "2"), ("chars", "1")}
