import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from ledgerloom.llm import line_dedup, mixing, near_duplicates, parity, quality, sentencepiece_codec, shingles, token_rollup, toxicity
from ledgerloom.scratch import Scratch

from .helpers import no_documents, odd_documents, words


def shingle_set(text, width=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components_by_brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_shingles_and_sketches():
    assert len(shingles.shingle_hashes(None)) == len(shingles.shingle_hashes(" \n")) == 0
    assert shingles.shingle_hashes("A b C")[0] == shingles.shingle_hashes("a  b\tc")[0] != shingles.shingle_hashes("a b")[0]
    rng = random.Random(1)
    for n in (4, 5, 6, 50, 700):
        t = words(rng, n)
        assert len(shingles.shingle_hashes(t)) == len(shingle_set(t))
        other = t.replace("ka", "zz", 3)
        a, b = shingles.shingle_hashes(t), shingles.shingle_hashes(other)
        x, y = parity.dense(a), parity.dense(b)
        if len(x) == len(y):
            assert sum(int(v).bit_count() for v in (x ^ y).view("uint64")) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_band_keys_meet_for_every_linked_pair():
    rng = random.Random(2)
    for n in (1, 2, 5, 9, 16, 40, 63, 64, 65, 85, 300):
        for _ in range(20):
            a = shingles.mixed(shingles.np.array([rng.getrandbits(64) for _ in range(n)], "uint64"))
            keep = math.ceil(n * 6 / 7) if rng.random() < 0.5 else math.ceil(n * 3 / 4)
            more = [rng.getrandbits(64) for _ in range(n - keep if keep * 100 >= 75 * (2 * n - keep) else 0)]
            b = shingles.np.unique(shingles.np.concatenate([a[:keep], shingles.np.array(more, "uint64")]))
            both = len(shingles.np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert set(parity.band_keys(shingles.np.sort(a)).tolist()) & set(parity.band_keys(b).tolist())


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 3)  # so that pivots are used
    monkeypatch.setattr(near_duplicates, "PIVOTS", 2)
    rng = random.Random(3)
    rows, base = [], words(rng, 120).split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, rng.randint(0, 60))) for i in range(30)]
    rows += [(200 + i, rows[60 + i][1] + " tail") for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_brute_force(rows)


def test_near_duplicates_in_blocks_compare_only_what_fits(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("PIVOTS", 2), ("GROWTH", 2), ("MOST_PIVOTS", 8), ("BLOCK", 8)):
        monkeypatch.setattr(near_duplicates, name, value)
    sizes, may_link = [], near_duplicates.may_link

    def watched(pairs, nodes):
        n = nodes.select("node", "n")
        both = pairs.join(n.toDF("a", "x"), "a").join(n.toDF("b", "y"), "b")
        sizes.extend((r.x, r.y) for r in both.select("x", "y").collect())
        return may_link(pairs, nodes)

    monkeypatch.setattr(near_duplicates, "may_link", watched)
    rng = random.Random(5)
    passage, rows = words(rng, 40), []
    for i in range(48):  # one passage in all, other words and sizes around it
        rows.append((i, f"{words(rng, rng.randint(8, 20))} {passage} {words(rng, rng.randint(0, 90))}"))
    rows += [(100 + i, text + " end") for i, text in rows[::4]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_brute_force(rows)
    assert sizes and all(100 * min(x, y) >= 75 * max(x, y) for x, y in sizes)


def test_near_duplicates_odd_cases(spark):
    docs = odd_documents(spark)
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert (got[1], got[2], got[9], got[10]) == (1, 1, 8, 8) and all(got[i] == i for i in (4, 5, 6, 7, 11))
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[7] == 1 and ids[None] == 2 and ids[8] == 1 and ids[9] == ids[10] == 0
    assert near_duplicates.near_duplicates(no_documents(spark)).count() == 0


def dedup_by_brute_force(rows, least=line_dedup.MIN_WORDS):
    """Lines that lie in a run of enough words that stands earlier, too: all pairs of places, extended as far as they agree."""
    lines = {d: [(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d, t in rows}
    gone = {d: set() for d in lines}
    places = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    for d, i in places:
        for e, j in places:
            if (e, j) < (d, i):
                n = 0
                while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                    n += 1
                if sum(x.count(" ") + 1 for _, x in lines[d][i : i + n]) >= least:
                    gone[d] |= {p for p, _ in lines[d][i : i + n]}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = [words(rng, n) for n in (1, 1, 2, 2, 3, 4, 5, 7, 8, 9, 12)] + [""]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else words(rng, 4) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dedup_by_brute_force(rows)


def test_line_dedup_odd_cases(spark):
    docs = odd_documents(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = [(r.doc_id, r.text) for r in out.collect()]
    before = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(got)
    assert texts[1] == dict(before)[1] and texts[2] == "" and texts[4] is None and texts[5] == "" and texts[6] == " \n\t "
    assert [t for i, t in got if i == 7] == [t for i, t in before if i == 7]  # a row repeated is one document
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0


def test_mixing(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and abs(sum(got.values()) - 1600) < 1e-6 and all(got[s] <= 3 * n for s, n in (("a", 1000), ("c", 500), (None, 90)))
    assert got[None] == 1600 - 30 - 4 * got["a"] or got[None] == 270
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(5, 60)), "s%d" % (i % 3 if i % 2 else 0)) for i in range(1500)], "doc_id long, text string, source string")
    rows = mixing.rates(docs).collect()
    assert rows == mixing.rates(docs).collect()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) / mine[0].target - 1) < 0.1
    assert max(r.copies for r in rows) <= 3
    odd = odd_documents(spark)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = {(r.doc_id, r.text) for r in mixed.collect()}
    assert taken <= {(r.doc_id, r.text) for r in odd.collect()}
    assert mixing.mix(no_documents(spark)).count() == 0


def test_quality_measures_and_policies(spark):
    assert quality.measure_text(None) == quality.measure_text("") == (0,) * len(quality.MEASURES)
    m = dict(zip(quality.MEASURES, quality.measure_text("a b\na b\n\n # $x\xa0y"), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (6, 9, 2, 1)
    text = " ".join(map(str, range(8))) + " z " + " ".join(map(str, range(8)))
    assert quality.measure_text(text)[4] == 16 and quality.measure_text(" ".join(map(str, range(17))))[4] == 0
    book = quality.ledger(odd_documents(spark)).cache()
    assert book.count() == odd_documents(spark).count()
    strict, base = (quality.apply_policy(book, v).filter("kept").count() for v in ("strict-1", "base-1"))
    assert strict <= base
    for r in quality.ablations(book, "strict-1").collect():
        bit = quality.rules()[r.rule][0]
        bits = [x.failed_bits for x in book.collect()]
        assert r.failed == sum(b >> bit & 1 for b in bits) and r.failed_alone == sum(b == 1 << bit for b in bits) and r.kept_without == sum(not b & ~(1 << bit) for b in bits)
    assert quality.ledger(no_documents(spark)).count() == 0


def test_toxicity_separates_and_is_total(spark):
    rng = random.Random(7)
    bad = ("vermin", "blockhead", "nincompoop", "scoundrel")
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rng, 60).split()
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 3 == 0]
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    odd = odd_documents(spark)
    kept = toxicity.reject_toxic(odd, marks.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    scored = toxicity.score(odd.select("doc_id", "text"), model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(no_documents(spark).select("text"), model).count() == 0


def test_held_out_is_the_crc(spark):
    from ledgerloom.llm.toxicity import held_out

    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_sentencepiece_round_trip(spark):
    spm = pytest.importorskip("sentencepiece")
    try:
        path = sentencepiece_codec.default_model()
    except ImportError:
        pytest.skip("no vocabulary")
    sp = spm.SentencePieceProcessor(model_file=path)
    docs = odd_documents(spark, [(20, "  two  spaces ▁ and\n①\x00 <s> \U0001f600")]).select("doc_id", "text")
    for r in sentencepiece_codec.encode(docs).collect():
        t = r.text or ""
        assert list(r.ids) == sp.encode(t) and r.n_tokens == len(r.ids) and r.spans_ok
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(list(r.ids)).encode()).hexdigest()
        data = t.encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data
    assert sentencepiece_codec.encode(no_documents(spark).select("text")).count() == 0


def test_character_map_takes_the_longest_prefix():
    # a trie of "a" -> "x" and "ab" -> "yz", laid out by hand: a unit's offset, its label, and whether a value follows
    units = [0] * 300
    label = {}

    def put(at, offset, char, leaf):
        units[at] = offset << 10 | leaf << 8 | char
        label[at] = char

    units[0] = 1 << 10
    node_a = 1 ^ ord("a")
    put(node_a, node_a ^ 200, ord("a"), 1)
    units[200] = 1 << 31 | 0
    node_ab = 200 ^ ord("b")
    put(node_ab, node_ab ^ 250, ord("b"), 1)
    units[250] = 1 << 31 | 2
    import struct

    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    m = sentencepiece_codec.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    how = sentencepiece_codec.Settings(m, dummy_prefix=True, remove_extra=True)
    out, back = sentencepiece_codec.normalise(b"  ab  ac ", how)
    assert out == "▁yz▁xc".encode() and back[3] == 2 and len(back) == len(out) + 1


def test_rollup_is_idempotent_and_additive(spark):
    scratch = Scratch(spark, "test-rollup")
    book = token_rollup.Ledger(spark, scratch.root)
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    assert book.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "w", 5, None), ("insert", "a", "en", "w", 7, None), ("insert", None, None, "w", None, None), ("odd", "a", "en", "w", 9, 9), (None, "a", "en", "w", 9, 9)], schema)
    assert book.commit("1", first) and not book.commit("1", first)
    assert book.commit("2", spark.createDataFrame([("revise", "a", "en", "w", 6, 5), ("delete", "a", "en", "w", 7, None)], schema))
    assert book.commit("3", spark.createDataFrame([], schema))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in book.totals().collect()}
    assert got == {("a", "en"): (1, 6), (None, None): (1, 0)}


def test_bpe_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_documents(spark).select("doc_id", "text")
    for r in token_rollup.bpe_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert r.tokens == len(coder.encode_ordinary(r.text or ""))
