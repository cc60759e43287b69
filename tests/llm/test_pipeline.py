"""The pipeline as a whole against plain Python, stage after stage."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm import mixing, sentencepiece_codec

from .helpers import no_documents, odd_documents, words
from .test_text_operators import components_by_brute_force, dedup_by_brute_force

VILE = ("scumbagger", "worthlessness", "idiotically", "disgustingest", "moronically")


def corpus():
    """Ordinary and toxic documents, near copies and a passage that several share."""
    rng, rows = random.Random(11), []
    passage = "\n".join(words(rng, 14) for _ in range(4))
    for i in range(240):
        lines = [words(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines = [x + " " + " ".join(rng.sample(VILE, 2)) for x in lines]
        elif i % 13 == 1:
            lines.insert(rng.randint(0, len(lines)), passage)
        elif i % 11 == 2 and rows:
            lines = [rows[i - 1][1].replace("\n", " ") + " tail"] if (i - 1) % 5 else lines
        rows.append((i, "\n".join(lines), "en", ("b", "a", "c", None, "a")[rng.randrange(5)]))
    return rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed_by_brute_force(rows):
    """Copies of each document: shares by weight, capped sources out, what they leave dealt again."""
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else share
        left -= sum(3.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    copies = Counter()
    for i, text, _, source in rows:
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        coin = int(hashlib.md5(f"{mixing.SEED}|{i}|{text}".encode()).hexdigest()[:13], 16) / 2**52
        copies[i] = int(rate) + (coin < rate - int(rate))
    return copies


def test_pipeline_against_brute_force(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rows = corpus()
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r in rows if r[0] % 5]
    text = dedup_by_brute_force([r[:2] for r in kept])
    assert any(text[r[0]] != r[1] for r in kept)
    kept = [(r[0], text[r[0]], *r[2:]) for r in kept]
    found = components_by_brute_force([r[:2] for r in kept])
    one = [r for r in kept if found[r[0]][1] == r[0]]
    assert len(one) < len(kept)
    copies = mixed_by_brute_force(one)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    digest = lambda t: hashlib.sha256(",".join(map(str, model.encode(t))).encode()).hexdigest()
    assert got == Counter({(r[0], digest(r[1])): copies[r[0]] for r in one if copies[r[0]]})


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_keep_the_columns_of_documents(spark, tmp_path, make):
    """Every stage takes odd rows and an empty table; all but the last return the columns of documents."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = make(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and (out.count() > 0) == (make is odd_documents)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
