"""Language identification by prediction by partial matching.

Of each language, Spark counts which byte follows each context of up to ORDER bytes, over the whole
texts of all rows it learns from. A language's tree keeps the contexts that hold at least one in
RARE of its bytes, so it has RARE contexts of each length at most, however much text there
is. The statistics are then frozen. A byte's code length is that of PPM with escape method C and exclusion:
in the longest context kept, a byte seen n times among total bytes of d kinds costs
-log2(n / (total + d)) bits, an escape to the next shorter context -log2(d / (total + d)), where bytes seen in longer
contexts no longer count; after the empty context what is left of the 256 bytes is equally likely.
Code lengths are whole numbers of 2**-16 bit, so a text's sum is exact and no order changes it.

Such a tree is an automaton: its state is the longest context kept, and the last ORDER bytes decide it. So a text
is scored in pieces of CHUNK bytes, each after a run-up of ORDER bytes, many pieces abreast, with the same sums as in one go.

The language with the least code length is predicted; score is its share of 2**-length, all
languages being equally likely beforehand.

Cases. Text that is null or has no letter gets UNDETERMINED and score 0, as do all rows where nothing was learnt. Rows with null lang or without
a byte of text teach nothing. Very long texts are counted and scored whole. Ties go to the first language by code point. Repeated
rows count as often as they come when learning, and each gets its result. Other columns stay, new ones get a free name; an empty table gives
an empty result. The model is told to all tasks: 256 * 12 bytes a context at most, in practice a third of that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

ORDER, RARE = 4, 16384
UNDETERMINED = "und"
CHUNK, ABREAST = 256, 16384
#: Bytes of text that a task counts at a time, and distinct entries that it holds.
SLICE, HELD = 4 << 20, 4_000_000
BIT = 1 << 16


def pieces(text: bytes, order: int, size: int = SLICE) -> list[tuple[bytes, bytes]]:
    """text in pieces, each with the order bytes before it; zeros stand before the first byte."""
    padded = bytes(order) + text
    return [(padded[i : i + order], padded[i + order : i + order + size]) for i in range(0, len(text), size)]


def grams(found: list[tuple[bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the order bytes before it as one number, and how often it comes."""
    a = np.frombuffer(b"".join(x for p in found for x in p), np.uint8).astype(np.int64)
    sizes = np.array([len(body) for _, body in found])
    body = np.repeat(np.tile([False, True], len(found)), np.stack([np.full(len(found), order), sizes], 1).ravel())
    code = np.zeros(len(a) - order, np.int64)
    for i in range(order + 1):
        code = (code << 8) | a[i : len(a) - order + i]
    return np.unique(code[body[order:]], return_counts=True)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """lang, k, context, total and followers (byte, n) of each context of k bytes, over all rows."""

    def run(batches):
        held: dict[str, list] = {}

        def rows():
            for name, (code, n) in ((name, merged(x)) for name, x in held.items()):
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(code)), pa.array(code), pa.array(n)], names=["lang", "gram", "n"])

        def merged(parts):
            if len(parts) == 1:
                return parts[0]
            code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in parts]))
            return code, n

        waiting: dict[str, list] = {}
        size: dict[str, int] = {}

        def counted(name):
            if waiting.get(name):
                held.setdefault(name, []).append(grams(waiting[name], order))
                if len(held[name]) > 8:
                    held[name] = [merged(held[name])]
                waiting[name], size[name] = [], 0

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces(t.as_py(), order):
                    waiting.setdefault(name, []).append(piece)
                    size[name] = size.get(name, 0) + len(piece[1])
                    if size[name] >= SLICE:
                        counted(name)
            if sum(len(c) for x in held.values() for c, _ in x) > HELD:
                yield from rows()
                held.clear()
        for name in list(waiting):
            counted(name)
        yield from rows()

    learnt = docs.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).cast("string"), F.col(text).cast("binary"))
    whole = learnt.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    mask = F.array(*(F.lit((1 << 8 * (k + 1)) - 1).cast("long") for k in range(order + 1)))
    every = whole.select("lang", "n", "gram", F.posexplode(mask).alias("k", "mask")).groupBy("lang", "k", F.col("gram").bitwiseAND(F.col("mask")).alias("gram")).agg(F.sum("n").alias("n"))
    follower = F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    return every.groupBy("lang", "k", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(follower)).alias("followers"))


@dataclass
class Tree:
    """One language's automaton: classes of bytes, and of state * width + class the code length and the next state * width."""

    classes: np.ndarray
    cost: np.ndarray
    step: np.ndarray
    width: int


def tree(contexts: list[tuple[int, int, list[tuple[int, int]]]]) -> Tree:
    """From (k, context, followers), with every suffix of each context among them."""
    contexts = sorted((k, c, f) for k, c, f in contexts)
    place = {(k, c): i for i, (k, c, _) in enumerate(contexts)}
    used = sorted({0, *(b for _, _, f in contexts for b, _ in f), *(c >> 8 * i & 255 for k, c, _ in contexts for i in range(k))})
    stop, width = len(used) + 1, len(used) + 2  # classes: bytes, one for all other bytes, one for no byte
    classes = np.full(256, len(used), np.uint8)
    classes[used] = range(len(used))
    n = len(contexts)
    seen = np.zeros((n, len(used) + 1), np.int64)
    for i, (_, _, f) in enumerate(contexts):
        seen[i, classes[[b for b, _ in f]]] = [x for _, x in f]
    shorter = np.array([place[k - 1, c & (1 << 8 * (k - 1)) - 1] if k else 0 for k, c, _ in contexts])
    length = np.array([k for k, _, _ in contexts])

    cost, step = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for lo in range(0, n, 2048):
        at = np.arange(lo, min(n, lo + 2048))
        bits, known = np.zeros((len(at), len(used) + 1)), np.zeros((len(at), len(used) + 1), bool)
        escape, now, open_ = np.zeros(len(at)), at.copy(), np.ones(len(at), bool)
        while open_.any():
            here = np.where(known | ~open_[:, None], 0, seen[now])
            total, kinds = here.sum(1), (here > 0).sum(1)
            new = here > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(new, escape[:, None] - np.log2(here / (total + kinds)[:, None]), bits)
                escape = escape - np.where(kinds > 0, np.log2(kinds / np.maximum(total + kinds, 1)), 0)
            known |= new
            open_ &= length[now] > 0
            now = shorter[now]
        left = 256 - known.sum(1)
        bits = np.where(known, bits, (escape + np.log2(np.maximum(left, 1)))[:, None])
        cost[at, : len(used) + 1] = np.rint(bits * BIT)
    for k in range(length.max() + 1 if n else 0):
        mine = np.flatnonzero(length == k)
        step[mine] = step[shorter[mine]] if k else 0
        for i in np.flatnonzero(length == k + 1):  # contexts one byte longer
            c = contexts[i][1]
            step[place[k, c >> 8], classes[c & 255]] = i
    step[:, stop] = 0
    return Tree(classes, cost.astype(np.int32).ravel(), (step * width).ravel(), width)


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int = ORDER


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, rare: int = RARE) -> Model:
    """A model of every language in docs."""
    found = counts(docs, lang, text, order)
    whole = found.filter("k = 0").select("lang", F.col("total").alias("bytes"))  # a row a language
    kept = found.join(whole, "lang").filter(F.col("total") * rare >= F.col("bytes")).select("lang", "k", "context", "followers")
    by: dict[str, list] = {}
    for batch in kept.toArrow().to_batches():
        for r in batch.to_pylist():
            by.setdefault(r["lang"], []).append((r["k"], r["context"], [(f["byte"], f["n"]) for f in r["followers"]]))
    langs = sorted(by)
    return Model(langs, [tree(by[x]) for x in langs], order)


def lengths(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Code lengths of texts, in 2**-16 bit: a row a text, a column a language. Text i is data[offsets[i]:offsets[i + 1]]."""
    n, order = len(offsets) - 1, model.order
    size = np.diff(offsets)
    many = -(-size // CHUNK)
    owner = np.repeat(np.arange(n), many)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)  # which piece of its text
    begin = offsets[:-1][owner] + first * CHUNK
    out = np.zeros((n, len(model.langs)), np.int64)
    for lo in range(0, len(owner), ABREAST):
        own, at, part = owner[lo : lo + ABREAST], begin[lo : lo + ABREAST], first[lo : lo + ABREAST]
        end = offsets[1:][own]
        long = int(np.minimum(end - at, CHUNK).max())
        rows = at[None, :] + np.arange(-order, long)[:, None]
        inside = rows < end
        code = data[np.where(inside & (rows >= 0), rows, 0)]
        code[:order][:, part == 0] = 0  # before a text's first byte
        for j, t in enumerate(model.trees):
            cls = t.classes[code]
            cls[~inside] = t.width - 1
            state, cost = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for i in range(order):
                state = t.step[state + cls[i]]
            for i in range(order, order + long):
                state += cls[i]
                cost += t.cost[state]
                state = t.step[state]
            edge = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[edge], j] += np.add.reduceat(cost, edge)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits, the code length in the predicted language."""
    new = [T.StructField(fresh(docs, "lang_pred"), T.StringType()), T.StructField(fresh(docs, "score"), T.DoubleType()), T.StructField(fresh(docs, "bits"), T.DoubleType())]
    names, told = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = told.value
        for big in batches:
            whole = pa.compute.fill_null(big.column(len(names)), b"")
            size = np.asarray(pa.compute.binary_length(whole)).astype(np.int64)
            slice_ = (np.cumsum(size) - size) // SLICE  # rows that begin within the same SLICE bytes
            edge = [*np.flatnonzero(np.diff(slice_, prepend=-1)).tolist(), len(size)]
            for lo, hi in zip(edge, edge[1:]):
                batch, part = big.slice(lo, hi - lo), whole.slice(lo, hi - lo)
                letters = np.asarray(batch.column(len(names) + 1).to_pylist(), bool)
                best, score, bits = np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo)
                if model.langs and letters.any():
                    data = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
                    cost = lengths(data, np.concatenate([[0], np.cumsum(size[lo:hi])]), model)
                    least = cost.min(1)
                    best = np.where(letters, cost.argmin(1), -1)
                    score = np.where(letters, 1 / np.exp2(-(cost - least[:, None]) / BIT).sum(1), 0)
                    bits = np.where(letters, least / BIT, 0)
                found = [model.langs[i] if i >= 0 else UNDETERMINED for i in best]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(score), pa.array(bits)], names=[*names, *(f.name for f in new)])

    raw, letter = fresh(docs, "raw"), fresh(docs, "letter")
    rows = docs.withColumn(raw, F.col(text).cast("binary")).withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))
