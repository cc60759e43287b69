"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles. Each set's sketch is cut into
segments (the XOR of the shingles that fall in each), sets of one size band that may
link agree in a segment among the first d + 1 of either, and what agrees is
verified: by size, by the Hamming distance of dense sketches (it never exceeds the
symmetric difference), then by the sets themselves.

Documents with the same set are one class; only one row of each class gives keys. The keys
are dealt out once. In each key the first class (the smallest name) is compared with
all others, which connects most of a group of near copies at the cost of its size. Of a key only those
classes go on that lie in different components. With at most SMALL of them, pairs across components are compared
directly. In larger keys a few pivots are compared with all in blocks of entries, by sizes and dense sketches,
and again until all that is left there is connected or compared; only what may link leaves a block,
a root's nearest entries first, and in the first round one key of each class stands for all
its keys, as near copies share most of them. So only what links with nothing meets all of its
key. Keys that a sample of documents shows to be frequent come last in every document's order, and are
counted before they are dealt out; that changes which keys are used, not what is found.

Cases. Null, empty and blank texts have an empty set, n_shingles 0 and themselves as
component. A null doc_id takes no part in links and has a null component. Rows that
repeat a doc_id share a component if their texts link. Texts are read whole, very long ones too. An empty
table gives an empty result. Columns other than doc_id and text aren't read, so their names can't clash. Sets are
compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..scratch import Scratch, bounded
from . import parity
from .common import fresh, small_batches
from .shingles import shingle_hashes

#: Entries of a key up to which pairs across components are compared without pivots.
SMALL = 24
#: Pivots of a key in the first round; each round takes GROWTH times as many, up to MOST_PIVOTS. BLOCK entries are compared with them at a time.
PIVOTS, GROWTH, MOST_PIVOTS, BLOCK = 16, 16, 1024, 512
#: Words of sketches that a comparison holds at a time.
CELLS = 1 << 18
#: Rows that are sketched at a time.
ROWS = 256
#: A pivot is verified with so many entries of a root and block in the first round, with twice as many in each later one.
NEAREST = 1
#: One document in SAMPLE is asked for frequent keys; a key is frequent from FREQUENT such documents on. LATE keys at most are told to all.
SAMPLE, FREQUENT, LATE = 16, 3, 500_000


def sketched(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """doc_id, th (a hash of the text), uid (of the row), n, node (the set's name), keys, hot (keys that are in late) and the dense sketch of each row."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("th", "uid", "n", "node")), *(T.StructField(c, longs) for c in ("keys", "hot", "dense"))])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n, node, keys, hot, dense = [], [], [], [], []
                for t in batch.column(1).to_pylist():
                    h = shingle_hashes(t)
                    k = parity.band_keys(h, late)
                    slow = parity.within(k, late)
                    n.append(len(h)), node.append(parity.identity(h)), dense.append(parity.dense(h))
                    keys.append(k[~slow]), hot.append(k[slow])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, hot, dense)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *lists], names=schema.names)

    return small_batches(docs).select("doc_id", "text", F.xxhash64("text"), F.monotonically_increasing_id()).mapInArrow(run, schema)


def frequent_keys(docs: DataFrame) -> np.ndarray:
    """Keys of many documents in the sample, sorted; LATE at most."""
    sample = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    keys = sketched(sample, np.zeros(0, np.int64)).select(F.explode("keys").alias("key")).groupBy("key").count()
    top = keys.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "key").limit(LATE)
    return np.sort(top.select("key").toArrow().column(0).to_numpy())


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (doc_id, node). The set of each node as an array of hashes."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [shingle_hashes(t) for t in part.column(1).to_pylist()]
                node = pa.array([parity.identity(h) for h in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([node, part.column(0), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["found", "wanted", "hashes"])

    mine = docs.select("doc_id", "text").filter("doc_id is not null").join(bounded(wanted.select("doc_id", F.col("node").alias("wanted")), wanted), "doc_id").select("wanted", "text")
    out = mine.mapInArrow(run, "found long, wanted long, hashes array<long>").filter("found = wanted")
    return out.select(F.col("found").alias("node"), "hashes")


def sizes_fit(x: str, y: str) -> Column:
    """Whether sets of these sizes may link."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * parity.PERCENT


def narrow(sketch: Column, words: Column) -> Column:
    """A dense sketch at the width of one half as wide, where that is narrower; sizes that may link differ by less than a width."""
    halves = F.zip_with(F.slice(sketch, 1, words), F.slice(sketch, words + 1, words), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(sketch) > words, halves).otherwise(sketch)


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that sizes and dense sketches let link, with n_a and n_b. nodes: node, n, dense."""
    side = lambda x: nodes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "dense")))
    near = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    near = near.filter(sizes_fit("n_a", "n_b"))
    x, y = narrow(F.col("dense_a"), F.size("dense_b")), narrow(F.col("dense_b"), F.size("dense_a"))
    distance = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    near = near.filter(distance * (100 + parity.PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - parity.PERCENT))
    return near.select("a", "b", "n_a", "n_b")


def by_width(dense: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each number of words the rows with sketches of that width, and the sketches."""
    lists = dense.combine_chunks()
    words, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    widths = np.diff(ends, prepend=0)
    out = {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        out[w] = rows, words[(ends[rows] - w)[:, None] + np.arange(w)]
    return out


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches at half their width."""
    w = sketches.shape[1] // 2
    return sketches[:, :w] ^ sketches[:, w:]


def compare(rows: pa.Table, most: int) -> pa.Table:
    """may_link for the rows of a block that are here and the pivots of other roots, with their key: of each pivot the most rows of each root that are nearest by sketch.

    before: the keys that a row's class has before this one. A pair with a common one of them is looked at there, so that it leaves one block at most. A pivot with more has a row of its own with a null b: it has not met all yet."""
    pivots_, block = rows.filter(rows.column("pivot")), rows.filter(rows.column("here"))
    (n_p, root_p, id_p), (n_e, root_e, id_e) = (tuple(t.column(c).to_numpy() for c in ("n", "root", "node")) for t in (pivots_, block))
    before_p, before_e = pivots_.column("before"), block.column("before")
    hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    of_pivots, of_entries = by_width(pivots_.column("dense")), by_width(block.column("dense"))
    for w, (entries, x) in of_entries.items():
        for v in (w // 2, w, 2 * w):
            if v not in of_pivots:
                continue
            posed, y = of_pivots[v]
            own, y = (folded(x), y) if v < w else (x, folded(y) if v > w else y)
            step = max(1, CELLS // (len(posed) * y.shape[1]))
            for at in range(0, len(entries), step):
                e, r = entries[at : at + step], own[at : at + step]
                least, largest = np.minimum.outer(n_e[e], n_p[posed]), np.maximum.outer(n_e[e], n_p[posed])
                i, j = np.nonzero((root_e[e][:, None] != root_p[posed]) & (100 * least >= parity.PERCENT * largest))
                distance = np.bitwise_count((r[i] ^ y[j]).view(np.uint64)).sum(1, dtype=np.int64)
                near = distance * (100 + parity.PERCENT) <= (n_e[e[i]] + n_p[posed[j]]) * (100 - parity.PERCENT)
                for k, p, far in zip(e[i[near]].tolist(), posed[j[near]].tolist(), distance[near].tolist(), strict=True):
                    if not np.isin(before_e[k].values.to_numpy(), before_p[p].values.to_numpy()).any():
                        hits.setdefault((p, int(root_e[k])), []).append((far, int(id_e[k]), int(n_e[k])))
    out = []
    for (i, _), found in hits.items():
        pivot = int(id_p[i])
        out += [(pivot, node, int(n_p[i]), n) if pivot < node else (node, pivot, n, int(n_p[i])) for _, node, n in sorted(found)[:most]]
    out += [(pivot, None, None, None) for pivot in {int(id_p[i]) for (i, _), found in hits.items() if len(found) > most}]
    key = rows.column("key")[0].as_py()
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({"key": pa.array([key] * len(out), pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "n_a", "n_b"), columns, strict=True)}})


def met(now: DataFrame, mine: DataFrame, most: int) -> DataFrame:
    """compare for the pivots of each key and its other entries, block by block. now: key, block, node, root, entries (of the key), pivot. mine: node, n, dense, mine.

    A pivot goes to the other blocks of its key, too; in its own it is there as an entry, so what belongs to it is sent there once."""
    last = F.ceil(F.col("entries") / BLOCK) - 1
    away = now.filter(F.col("pivot") & (last > 0)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), last))).filter("to <> block")
    rows = now.select("key", "block", "node", "root", "pivot", F.lit(True).alias("here"))
    rows = rows.unionByName(away.select("key", F.col("to").alias("block"), "node", "root", "pivot", F.lit(False).alias("here"))).join(mine, "node")
    rows = rows.withColumn("before", F.slice("mine", F.lit(1), F.array_position("mine", F.col("key")).cast("int") - 1)).drop("mine")
    return rows.groupBy("key", "block").applyInArrow(lambda t: compare(t, most), "key long, a long, b long, n_a long, n_b long")


def verified(near: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of near, a written table of may_link, whose sets link; near is dropped. nodes: node, doc_id."""
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.save(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
    sets = scratch.save(sets_of(docs, wanted), "sets")
    if sets.count() > wanted.count():  # rows that repeat doc_id and text
        again = sets
        sets = scratch.save(again.dropDuplicates(["node"]), "sets")
        scratch.drop(again)
    both = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = scratch.save(both.filter(100 * shared >= parity.PERCENT * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"), "links")
    scratch.drop(near, wanted, sets)
    return out


def pivots(entries: DataFrame, most: int) -> DataFrame:
    """entries (key, node, root, block, entries, ...) with pivot: of each key about most entries, as many of each block (one at least), those of the roots with fewest entries in it first, so that what is not yet connected meets the rest."""
    order = Window.partitionBy("key", "block").orderBy("size", F.xxhash64("node"), "node")
    quota = F.ceil(most / F.ceil(F.col("entries") / BLOCK))
    sized = entries.repartition("key", "block").withColumn("size", F.count("*").over(Window.partitionBy("key", "block", "root")))  # one exchange for both
    return sized.select(*entries.columns, (F.row_number().over(order) <= quota).alias("pivot"))


def entries_of(live: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """live: uid, node, n, keys, hot. (key, node, n, first, fits) of each class in each key that another class has, too; first is one class of the key, fits tells whether their sizes may link."""
    rep = scratch.save(live.groupBy("node").agg(F.min("uid").alias("uid"), F.min("n").alias("n")), "reps")
    one = live.join(bounded(rep.select("uid"), rep), "uid", "left_semi")
    columns = ("key", "node", "n", "first", sizes_fit("n", "n_first").alias("fits"))
    in_key = Window.partitionBy("key").orderBy("uid")  # the small number of a class's row goes through the exchange, not its random name
    cold = one.select("uid", F.explode("keys").alias("key"))
    cold = cold.select("key", "uid", F.first("uid").over(in_key.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"), F.lead("uid").over(in_key).alias("after"))
    cold = cold.filter("lead <> uid or after is not null").select("key", "uid", "lead").join(bounded(rep), "uid")
    cold = cold.join(bounded(rep.select(F.col("uid").alias("lead"), F.col("node").alias("first"), F.col("n").alias("n_first")), rep), "lead")
    cold = scratch.save(cold.select(*columns), "entries")
    # the few keys known to be frequent are summed up where they are and their entries stay where they are
    hot = one.filter("size(hot) > 0").select("node", "n", F.explode("hot").alias("key"))
    least = hot.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("last"))
    least = scratch.save(least.select("key", F.col("least.node").alias("first"), F.col("least.n").alias("n_first"), "last"), "least")  # LATE rows at most
    hot = scratch.save(hot.join(bounded(least.filter("first <> last").drop("last"), least), "key").select(*columns), "entries")
    scratch.drop(rep, least)
    return cold.unionByName(hot), (cold, hot)


def across(entries: DataFrame, root: DataFrame) -> DataFrame:
    """The entries with their root (nodes without links are their own)."""
    return entries.join(bounded(root), "node", "left").select(*entries.columns, F.coalesce("root", "node").alias("root"))


def unsettled(placed: DataFrame) -> DataFrame:
    """key and entries of those keys of placed (key, root) whose entries lie in different components."""
    state = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("entries"))
    return state.filter("lo <> hi").select("key", "entries")


def linked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The rows (doc_id, th, n, node) and, if any link, (node, root) of connected classes."""
    whole = scratch.save(sketched(docs, frequent_keys(docs)), "sketches")
    rows = scratch.save(whole.select("doc_id", "th", "n", "node"), "rows")
    live = whole.filter("n > 0 and doc_id is not null")
    entries, parts = entries_of(live.select("uid", "node", "n", "keys", "hot"), scratch)
    if entries.isEmpty():
        scratch.drop(whole, *parts)
        return rows, None
    ids = scratch.save(entries.select("node").distinct(), "ids")
    nodes = live.join(bounded(ids), "node", "left_semi")
    nodes = scratch.save(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("dense").alias("dense")), "nodes")
    scratch.drop(whole, ids)

    # each key's first class with all others of the key
    stars = entries.filter("node <> first and fits").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(scratch.save(may_link(stars, nodes), "near"), nodes, docs, scratch)
    root = scratch.save(components(links, scratch), "root")
    placed = across(entries.filter("node <> first").select("key", "node", "n"), root)
    open_ = scratch.save(unsettled(placed), "open")
    rest = scratch.save(placed.join(bounded(open_), "key"), "rest")
    scratch.drop(links, open_, *parts)

    # small keys: pairs across components
    few = rest.filter(F.col("entries") <= SMALL).select("key", "node", "n", "root")
    pairs = few.alias("x").join(few.alias("y"), "key").filter("x.node < y.node and x.root <> y.root").filter(sizes_fit("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    root = merged(root, scratch.save(may_link(pairs, nodes), "near"), nodes, docs, scratch)

    # large keys: pivots, in the first round in one key of each class
    hot = scratch.save(rest.filter(F.col("entries") > SMALL).select("key", "node"), "hot")
    scratch.drop(rest)
    most, nearest, one_key = PIVOTS, NEAREST, True
    while not hot.isEmpty():
        placed = across(hot, root)
        open_ = scratch.save(unsettled(placed), "open")
        placed = scratch.save(placed.join(bounded(open_), "key"), "placed")
        keys = scratch.save(placed.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("mine")), "keys")  # a node has fewer keys than shingles
        mine = scratch.save(nodes.select("node", "n", "dense").join(bounded(keys), "node"), "mine")
        turn = scratch.save((keys.select(F.col("mine")[0].alias("key")) if one_key else placed.select("key")).distinct(), "turn")
        now = placed.join(bounded(turn), "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("entries") / BLOCK)))
        now = scratch.save(pivots(now.select("key", "block", "node", "root", "entries"), most), "now")
        chosen = now.filter("pivot")
        found = scratch.save(met(now, mine, nearest), "met")  # sketches come in only where they are compared
        # the other pivots have met all of their key; one that has more than the nearest stays an entry, and nearest grows
        more = found.filter("b is null").select("key", F.col("a").alias("node")).distinct()
        done = scratch.save(chosen.select("key", "node").join(more, ["key", "node"], "left_anti"), "done")
        left = scratch.save(placed.select("key", "node").join(bounded(done), ["key", "node"], "left_anti"), "hot")
        near = scratch.save(found.filter("b is not null").select("a", "b", "n_a", "n_b").distinct(), "near")
        scratch.drop(hot, placed, keys, mine, now, open_, turn, found, done)
        root = merged(root, near, nodes, docs, scratch)
        hot, most, nearest, one_key = left, min(MOST_PIVOTS, GROWTH * most), 2 * nearest, False
    scratch.drop(nodes, hot)
    return rows, root


def merged(root: DataFrame, near: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """root (node, root) with the links among near, a written table of may_link; both are dropped."""
    if near.isEmpty():
        scratch.drop(near)
        return root
    new = verified(near, nodes, docs, scratch)
    if new.isEmpty():
        scratch.drop(new)
        return root
    out = scratch.save(components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new), scratch), "root")
    scratch.drop(root, new)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    return grouped(docs, Scratch(docs.sparkSession, "near")).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, th, root (the component's name), n_shingles and component_id of each row of docs."""
    rows, root = linked(docs, scratch)
    if root is None:
        placed = rows.withColumn("root", F.col("node"))
    else:
        placed = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    least = scratch.save(least.filter("members > 1").select("root", "least"), "least")  # the others are alone
    out = placed.join(bounded(least), "root", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", "root", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the rows of its smallest doc_id, once; all columns stay. Rows without doc_id or without a word stay.

    Rows are told apart by doc_id and text, so rows of one doc_id whose texts don't link are judged each by its own component."""
    scratch = Scratch(docs.sparkSession, "dedup")
    th, root = fresh(docs, "near_th"), fresh(docs, "near_root")
    groups = scratch.save(grouped(docs, scratch).withColumnsRenamed({"th": th, "root": root}), "groups")
    scratch.keep_only(groups)
    gone = scratch.save(groups.filter("doc_id <> component_id").select("doc_id", th).distinct(), "gone")
    kept = docs.withColumn(th, F.xxhash64("text")).join(bounded(gone), ["doc_id", th], "left_anti")
    first = groups.filter("doc_id = component_id and n_shingles > 0")
    again = first.groupBy("doc_id", root).agg(F.count("*").alias("count")).filter("count > 1").select("doc_id", root)
    again = scratch.save(first.join(again, ["doc_id", root]).select("doc_id", th, root).distinct(), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    ids = bounded(again)
    once = kept.join(ids, ["doc_id", th]).dropDuplicates(["doc_id", root])
    return kept.join(ids, ["doc_id", th], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
