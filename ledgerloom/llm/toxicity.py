"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary words,
one on the same ordinary words and those that set toxic text apart: words with a
beginning in 2 % or more of the toxic documents and at e**3 times its rate
elsewhere. Toxic text without such words can pass (README). A window
(a word with its borders, between two fixed strings that both dictionaries
hold) is compressed with each; the lengths, and how many bytes the toxic
dictionary leaves over, are looked up in a table of calibrated log-odds. A
document's score is a logistic function of what its windows add up to.

The fit reads a bounded sample of labelled rows (MAX_DOCS_PER_CLASS documents and
MAX_BYTES_PER_CLASS bytes of text of each class) and runs in one task on an executor; only the
model reaches the driver.

Cases. Null, empty or blank texts have no windows and get the score of a text
without evidence. Very long texts are read whole; as labelled rows they are left out, and no other, where they don't
fit into what is left of MAX_BYTES_PER_CLASS; it is an error if no text of a class fits. Repeated rows each get their row; a doc_id with several labels is toxic if one of them says so. Without
labels of both classes, or without any word that sets them apart, the score is the share of toxic labels; an empty table
gives an empty result. A column of the name that score writes is refused; reject_toxic takes a free name.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Labelled documents of each class that a fit reads at most.
MAX_DOCS_PER_CLASS = 3000
#: Bytes of text of each class that a fit reads at most.
MAX_BYTES_PER_CLASS = 16 << 20
#: Sizes of the dictionaries: what ordinary words get, what marked words get, and what ordinary words that look toxic get besides.
ORDINARY_BYTES, MARKED_BYTES, FILL_BYTES = 16384, 8192, 8192
#: Ordinary words that the ordinary dictionary is trained on at most, drawn from the sample.
PLAIN_WORDS = 100_000
#: A score from here on means toxic.
THRESHOLD = 0.3
#: Borders of a window: the compressor needs bytes on either side of a word.
HEAD, TAIL = b"<|carrier-0123456789-ABCDEFGHIJKLMNOP|>", b"<|tail-9876543210|>"
EDGES = b".,;:!?\"'()[]|*#%$&-<>"
GAINS, LEFT = 14, 20
CACHE = 200_000


def windows(text: str | None) -> list[bytes]:
    found = (w.strip(EDGES) for w in (text or "").lower().encode("utf-8", "replace").split())
    return [b" " + w + b" " for w in found if w]


def compressor(dictionary: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_BTLAZY2, min_match=4, search_log=7, hash_log=16, chain_log=16, window_log=17, target_length=64,
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class Model:
    """ordinary, toxic: dictionaries. odds: log-odds by gain and bytes left. weights: of the features, bias last."""

    ordinary: bytes = b""
    toxic: bytes = b""
    odds: np.ndarray = field(default_factory=lambda: np.zeros((GAINS, LEFT)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    prior: float = 0.0
    strong: float = 2.0

    def cells(self):
        """A function from a window to its cell of the table; what it has seen is kept."""
        by_ordinary, by_toxic = compressor(self.ordinary), compressor(self.toxic)
        empty, seen = len(by_toxic.compress(HEAD + TAIL)), {}

        def cell(window: bytes) -> tuple[int, int]:
            got = seen.get(window)
            if got is None:
                whole = HEAD + window + TAIL
                a, b = len(by_ordinary.compress(whole)), len(by_toxic.compress(whole))
                if len(seen) >= CACHE:
                    seen.clear()
                got = seen[window] = (min(GAINS - 1, max(0, a - b + 3)), min(LEFT - 1, max(0, b - empty)))
            return got

        return cell

    def features(self, text: str | None, cell) -> list[float]:
        odds = [self.odds[cell(w)] for w in windows(text)]
        hits = [x for x in odds if x >= self.strong]
        return [math.log1p(len(hits)), 30 * len(hits) / (len(odds) + 30), min(6.0, max(hits, default=0.0)), min(8.0, sum(hits) / 4), 1.0]

    def score(self, text: str | None, cell) -> float:
        if not self.toxic:
            return self.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, self.features(text, cell)))))))


def _marks(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words of toxic documents one of whose beginnings is far more frequent there than elsewhere."""
    least = max(3, 0.02 * len(toxic))
    longest = max((len(w) for ws in toxic for w in ws), default=0)
    there: dict[bytes, int] = {}
    for k in range(5, longest + 1):  # a beginning is frequent only if the shorter ones are, so no counter holds the rare ones' longer ones
        n = Counter(x for ws in toxic for x in {w[:k] for w in ws if len(w) >= k and (k == 5 or w[: k - 1] in there)})
        longer = {x: c for x, c in n.items() if c >= least}
        if not longer:
            break
        there |= longer
    other: Counter = Counter()
    for ws in ordinary:
        other.update({w[:k] for w in set(ws) for k in range(5, len(w) + 1) if w[:k] in there})
    far = {x for x, n in there.items() if math.log(n / len(toxic)) - math.log((other[x] + 0.5) / len(ordinary)) > 3}
    return {w for ws in toxic for w in ws if any(w[:k] in far for k in range(5, len(w) + 1))}


def _dictionary(sample: list[bytes], size: int) -> bytes:
    joined = [b"".join(sample[i : i + 20]) for i in range(0, len(sample), 20)]
    try:
        return zs.train_dictionary(size, joined).as_bytes()
    except zs.ZstdError:  # too few samples for its trainer: the sample itself is a dictionary
        return b"".join(joined)[-size:]


def train(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """A model from labelled texts, the same each time."""
    model = Model(prior=sum(toxic) / len(toxic) if toxic else 0.0)
    known: dict[bytes, bytes] = {}  # one object a word
    docs = [([known.setdefault(w, w) for w in windows(t)], y) for t, y in zip(texts, toxic, strict=True)]
    del known
    bad, good = [w for w, y in docs if y], [w for w, y in docs if not y]
    if not any(bad) or not any(good):
        return model
    rng = random.Random(seed)
    marks = _marks(bad, good)
    count = Counter(w for ws in bad for w in ws if w in marks)
    plain = [w for ws in good for w in ws if len(w) > 5]
    plain = rng.sample(plain, min(PLAIN_WORDS, len(plain)))
    ordinary = _dictionary(plain, ORDINARY_BYTES)
    marked = b"".join(sorted(count, key=lambda w: (count[w], w)))[-MARKED_BYTES:]  # the most frequent ones last, where the compressor finds them best
    if not marked:
        return model
    fill = b"".join(plain)[: len(marked)]
    model.ordinary, model.toxic = TAIL + ordinary + fill + HEAD, TAIL + ordinary + marked + HEAD
    for turn in range(2):  # ordinary words that the toxic dictionary shortens go to the ordinary one
        cell = model.cells()
        pulled = Counter(w for ws in good for w in ws if cell(w)[0] >= 6)
        if turn or not pulled:
            break
        fill = (b"".join(plain)[: len(marked)] + b"".join(w for w, _ in pulled.most_common()[::-1]))[-FILL_BYTES:]
        model.ordinary = TAIL + ordinary + fill + HEAD
    cell = model.cells()
    seen = np.full((2, GAINS, LEFT), 0.0)
    for ws, y in docs:
        for c in {cell(w) for w in set(ws)}:
            seen[(int(y), *c)] += 1
    a, b = (seen[1] + 0.2) / (len(bad) + 1), (seen[0] + 0.5) / (len(good) + 1)
    model.odds = np.where(seen.sum(0) >= 2, np.log(a / b), 0.0)
    x = np.array([model.features(t, cell) for t in texts])
    y = np.array(toxic, float)
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-3 * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    z = x @ w  # the cut with the best F1 becomes THRESHOLD
    order = np.argsort(-z, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(z[order][1:] != z[order][:-1], True)
    f1 = np.where(last, 2 * hits / (n + y.sum()), -1)
    k = int(np.argmax(f1))
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    w[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - (z[order][k] + below) / 2
    model.weights = w
    return model


def held_out() -> Column:
    """Whether a row's doc_id is kept back from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt_from(labels: DataFrame) -> DataFrame:
    """The labels that are not held out."""
    return labels.filter(~held_out())


def fit(docs: DataFrame, labels: DataFrame, max_docs_per_class: int = MAX_DOCS_PER_CLASS, max_bytes_per_class: int = MAX_BYTES_PER_CLASS) -> Model:
    """A model from labelled documents: of each class those with the smallest hash of doc_id, up to both bounds."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id"))
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(*order).limit(max_docs_per_class)
    chosen = pick(0).unionByName(pick(1))  # at most 2 * max_docs_per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "toxic", F.when(size <= max_bytes_per_class, F.col("text")).alias("text"), size.alias("size"), order[0].alias("place"))

    def run(batches):
        got, used, there = [], [0, 0], [0, 0]
        for batch in batches:
            for i, y, text, size, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                there[y] += 1
                if used[y] + size <= max_bytes_per_class:  # a text that doesn't fit is left out alone
                    used[y] += size
                    got.append((i, y, text))
        for y in (0, 1):
            if there[y] and not any(z == y for _, z, _ in got):
                raise ValueError(f"no labelled text of class {y} fits into {max_bytes_per_class} bytes")
        got.sort(key=lambda row: row[0])
        model = train([t for _, _, t in got], [y for _, y, _ in got])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(vars(model))]})

    found = rows.repartition(1).sortWithinPartitions("place", "doc_id").mapInArrow(run, "model binary").first()  # none if no row is labelled
    return Model(**pickle.loads(found.model)) if found else Model()


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, a double from 0 to 1; every column stays."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}")
    at, model_ = docs.columns.index(text), model

    def run(batches):
        cell = model_.cells() if model_.toxic else None
        for batch in batches:
            got = [model_.score(t, cell) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, out])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored THRESHOLD or more, with the columns of docs."""
    name = fresh(docs, "tox_score")
    return score(docs, fit(docs, labels), out=name).filter(F.col(name) < THRESHOLD).drop(name)
