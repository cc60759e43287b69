"""Longest-prefix normalisation through a compiled character map, and spans that come from it."""

import pytest
import sentencepiece as spm
from ledgerloom.llm import sentencepiece_codec as codec

TEXTS = ["", "plain text", "  two  blanks ", "ﬁne ① ｶﾞ ㌀ Å", "é é", "tab\tand\nline", "日本語ﾃｽﾄ　全角", "…—“”", "½ ² ﷺ", "a​b", "𝒳y"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normalise_equals_the_library(rule):
    lib = spm.SentencePieceNormalizer(rule_name=rule)
    how = codec.settings(codec._message([(3, lib.serialized_normalizer_spec())]))
    assert how.map.units
    for text in TEXTS:
        out, back = codec.normalise(text.encode(), how)
        assert out.decode() == lib.normalize(text)
        assert len(back) == len(out) + 1 and back[-1] == len(text.encode()) and (back[1:] >= back[:-1]).all()


def test_ids_and_spans_of_the_model_equal_the_library():
    with open(codec.default_model(), "rb") as f:
        mine = codec.Codec(f.read())
    for text in [*TEXTS, None, "▁ set already", "x" * 5000, "\x00 zero"]:
        ids, span = mine.encode(text)
        assert ids == mine.sp.encode(text or "") and codec.covers(span, text)
        data = (text or "").encode()
        for i, (a, b) in zip(ids, span.tolist(), strict=True):
            piece = bytes([int(mine.sp.id_to_piece(i)[1:-1], 16)]) if mine.sp.is_byte(i) else mine.sp.id_to_piece(i).replace("▁", " ").encode()
            assert data[a:b] in (piece, piece[1:]) or "▁" in text  # an inserted prefix stands for no byte


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_tokens int, IDS string")
    out = codec.encode(docs)
    row = out.first().asDict()
    assert (row["n_tokens"], row["IDS"], row["n_tokens_"]) == (7, "x", 2) and len(row["ids_"]) == 2 and len(set(map(str.lower, out.columns))) == len(out.columns)
