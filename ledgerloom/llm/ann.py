"""Approximate nearest neighbours by a tree of k-means.

The tree is fitted on a bounded sample; every row goes to the leaf that it reaches
by the nearest centre at each level. A query walks the tree best bin first: a
priority queue holds the nodes seen so far, the nearest is taken, a leaf is visited.
Visits widen until the recall on the sample, against brute force, reaches
TARGET, and for each query until its leaves hold k ids besides its own. Small leaves that
follow each other share a bucket; buckets are searched in blocks of rows by blocks of
queries, so a leaf with many rows is many tasks, and a row counts only for queries that visit its leaf.

Cases. Vectors that are null, empty, zero, of another length than the sample's most
common one, or hold a null or a number that isn't finite take no part, nor do rows
without an id. Rows that repeat an id count once for a query, with their best score;
a query's own id is no candidate. With fewer than k candidates all are returned.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The fit reads at most SAMPLE rows and VALUES numbers.
SAMPLE, VALUES = 20_000, 4_000_000
BRANCHES, LEAF = 8, 80
TARGET, TRIALS = 0.97, 300
BLOCK = 4096


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as rows of doubles, and their places in the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    if width is None:
        found, n = np.unique(sizes[sizes > 0], return_counts=True)
        width = int(found[np.argmax(n)]) if len(found) else 0
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), width) if len(at) else np.zeros((0, width))
    ok = np.isfinite(x).all(1) & (x != 0).any(1)  # nulls have become NaN
    return np.ascontiguousarray(x[ok]), at[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """Nodes with centres; a node without children is a leaf, numbered in leaf."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.width, self.centres, self.children, self.leaf, self.visits = sample.shape[1], [], [], [], 1
        self.leaves = 0
        rng = np.random.default_rng(seed)
        x = unit(sample) if len(sample) else sample
        self._grow(x, x.mean(0) if len(x) else np.zeros(self.width), rng)
        self.centres = np.array(self.centres)
        if len(x):
            self._calibrate(x, rng)

    def _grow(self, x: np.ndarray, centre: np.ndarray, rng) -> int:
        me = len(self.centres)
        self.centres.append(centre), self.children.append([]), self.leaf.append(-1)
        if len(x) > LEAF:
            c = x[rng.choice(len(x), BRANCHES, replace=False)]
            for _ in range(12):
                near = np.argmax(x @ c.T, 1)
                for j in range(BRANCHES):
                    if (near == j).any():
                        m = x[near == j].mean(0)
                        c[j] = m / (np.sqrt((m * m).sum()) or 1.0)
            near = np.argmax(x @ c.T, 1)
            used = [j for j in range(BRANCHES) if (near == j).any()]
            if len(used) > 1:
                self.children[me] = [self._grow(x[near == j], c[j], rng) for j in used]
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        u = unit(x) if len(x) else x
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = np.argmax(u[rows] @ self.centres[self.children[node]].T, 1)
                todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node])]
        return out

    def walk(self, q: np.ndarray):
        """Leaves, best bin first; q has length 1."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                near = self.centres[self.children[node]] @ q
                for s, c in zip(near.tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (-s, c))
            else:
                yield self.leaf[node]

    def _calibrate(self, x: np.ndarray, rng, k: int = 5) -> None:
        home = self.assign(x)
        trial = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
        place = np.zeros((len(trial), min(k, len(x) - 1)), np.int64)
        for r, i in enumerate(trial):
            s = x @ x[i]
            s[i] = -9
            best = np.argsort(-s, kind="stable")[: place.shape[1]]
            turn = {leaf: n for n, leaf in enumerate(self.walk(x[i]))}
            place[r] = [turn[home[b]] for b in best]
        self.recall = 0.0
        while place.size and self.visits < self.leaves:
            self.recall = float((place < self.visits).mean())
            if self.recall >= TARGET:
                break
            self.visits = min(self.leaves, self.visits + max(1, self.visits // 10))


def fit(vectors: DataFrame, column: str = "embedding") -> Tree | None:
    """vectors: vec_id and column. A tree of the ids with the smallest hash, a row of each; None without usable vectors."""
    first = vectors.select(column).filter(F.size(column) > 0).limit(1).collect()
    if not first:
        return None
    rows = max(100, min(SAMPLE, VALUES // len(first[0][0])))
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    ids = vectors.select("vec_id").filter("vec_id is not null").distinct().orderBy(*order).limit(rows)
    sample = vectors.select("vec_id", column).join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min(column).alias(column)).orderBy(*order).toArrow()  # ids are SAMPLE at most
    x, _ = matrix(sample.column(1))
    return Tree(x) if len(x) else None


def search(vectors: DataFrame, is_query, k: int = 5, column: str = "embedding", tree: Tree | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds (a condition on vec_id), the k nearest rows found."""
    spark = vectors.sparkSession
    tree = tree or fit(vectors, column)
    empty = "query_id long, rank int, vec_id long, score double"
    if tree is None:
        return spark.createDataFrame([], empty)
    scratch = Scratch(spark, "ann")
    width = tree.width

    def place(batches):
        for batch in batches:
            x, at = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(tree.assign(x), pa.int64())], names=["vec_id", "v", "leaf"])

    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    placed = scratch.save(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long"), "placed")
    held = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf; leaves are bounded by the sample
    ids_of = {r.leaf: r.n for r in placed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # an id counts in one leaf
    bucket_of, bucket, filled = {}, 0, 0
    for leaf in sorted(held):
        if filled and filled + held[leaf] > BLOCK:
            bucket, filled = bucket + 1, 0
        bucket_of[leaf] = bucket
        filled += held[leaf]

    def visit(batches):
        for batch in batches:
            x, at = matrix(batch.column(1), width)
            ids, buckets, visits = [], [], []
            for i, q in zip(at.tolist(), unit(x) if len(x) else x, strict=True):
                seen, ids_seen, mine = 0, 0, {}
                for leaf in tree.walk(q):
                    if held.get(leaf):
                        mine.setdefault(bucket_of[leaf], []).append(leaf)
                        ids_seen += ids_of.get(leaf, 0)
                    seen += 1
                    if seen >= tree.visits and ids_seen > k:
                        break
                for bucket, leaves in mine.items():
                    ids.append(i), buckets.append(bucket), visits.append(leaves)
            pick = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(buckets, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], names=["query_id", "q", "bucket", "visits"])

    asked = placed.filter(is_query).dropDuplicates(["vec_id"]).select("vec_id", "v").mapInArrow(visit, "query_id long, q array<double>, bucket long, visits array<long>")
    asked = scratch.save(asked, "asked")
    near = F.broadcast(spark.createDataFrame(sorted(bucket_of.items()), "leaf long, bucket long"))  # a row a leaf
    placed = placed.join(near, "leaf")
    blocks = placed.groupBy("bucket").agg(F.count("*").alias("n")).join(asked.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    blocks = blocks.select("bucket", F.ceil(F.col("n") / BLOCK).alias("row_blocks"), F.ceil(F.col("m") / BLOCK).alias("query_blocks"))
    blocks = F.broadcast(scratch.save(blocks, "blocks"))  # a row a bucket
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    data = placed.join(blocks, "bucket").withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks"))).withColumn("qb", F.explode(upto("query_blocks")))
    posed = asked.join(blocks, "bucket").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks"))).withColumn("rb", F.explode(upto("row_blocks")))

    def compare(queries: pa.Table, data: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and data.num_rows:
            q, _ = matrix(queries.column("q"), width)
            x, _ = matrix(data.column("v"), width)
            qid, vid = queries.column("query_id").to_numpy(), data.column("vec_id").to_numpy()
            leaf, visits = data.column("leaf").to_numpy(), queries.column("visits").to_pylist()
            order = np.argsort(vid, kind="stable")  # rows of an id side by side
            x, vid, leaf = x[order], vid[order], leaf[order]
            starts = np.flatnonzero(np.append(True, vid[1:] != vid[:-1]))
            lq, lx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
            for a in range(0, len(q), 256):
                s = (q[a : a + 256] / lq[a : a + 256, None]) @ (x / lx[:, None]).T
                s[qid[a : a + 256, None] == vid[None, :]] = -9
                for r in range(len(s)):
                    s[r, ~np.isin(leaf, visits[a + r])] = -9
                    top = np.maximum.reduceat(s[r], starts) if len(starts) < len(vid) else s[r]  # the best score of each id
                    kth = np.partition(top, len(top) - k)[len(top) - k] if len(top) > k else -2.0
                    c = np.flatnonzero(s[r] >= max(kth - 1e-9, -2))
                    score = (x[c] * q[a + r]).sum(1) / (lx[c] * lq[a + r])
                    best, used = [], set()
                    for j in np.lexsort((vid[c], -score)):
                        if vid[c[j]] not in used:
                            used.add(vid[c[j]])
                            best.append(j)
                            if len(best) == k:
                                break
                    out_q += [qid[a + r]] * len(best)
                    out_v += vid[c[best]].tolist()
                    out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    keys = ["bucket", "rb", "qb"]
    found = posed.select(*keys, "query_id", "q", "visits").groupBy(*keys).cogroup(data.select(*keys, "leaf", "vec_id", "v").groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
