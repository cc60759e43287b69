"""Centroid clustering by sort-means: exact rounds of k-means on whole numbers.

Each component x becomes floor(SCALE * x), so all sums and squared distances are exact
and no order of the rows changes a result. In each round a vector starts at the
centroid c of the round before, at distance d; the others are tried by their distance from c, and the
scan stops at the first one strictly beyond 2 d from c: by the triangle inequality it and
all after it are farther than d. Equally near ones are never passed over, and the smaller number wins.
Within a batch, the rows that start at one centroid are scanned together, farthest
first, so each step is one subtraction over the rows that are still in the scan.

A round is one pass over the written whole numbers; each task adds up its own
sums, and k rows of sums reach the driver.

Cases. Vectors that are null, of another length than width, or hold a null or a number that isn't
finite take no part. Zero vectors do. Rows that repeat count as often as they come; rows of one id
that differ are ordered by their numbers where they tie as starts; without an id a row comes last there. With fewer than k
vectors there are as many centroids. A centroid without vectors stays. A component of 2**27 or more after scaling is an error, as
distances would leave 64 bits. Other columns of vectors stay, the vector goes; new columns get a free name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from .common import fresh

K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Rows that are scanned at a time.
ROWS = 8192


def whole(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as rows of whole numbers, and their places in the column."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at, pa.int64())).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), width)  # nulls become NaN
    ok = np.isfinite(x).all(1)
    x = np.floor(scale * x[ok])
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT // scale} or more")
    return x.astype(np.int64), at[ok]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row its nearest centroid and the squared distance; and how many distances were taken."""
    best, least, asked = start.copy(), np.zeros(len(x), np.int64), 0
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        d = squared(x[rows], centroids[a])
        far = np.argsort(-d, kind="stable")
        rows, d = rows[far], d[far]
        number, near, asked = np.full(len(rows), a), d.copy(), asked + len(rows)
        apart = squared(centroids, centroids[a])
        for c in np.lexsort((np.arange(len(centroids)), apart)):
            if c == a:
                continue
            n = int(np.searchsorted(-4 * d, -apart[c], side="right"))  # rows with apart <= (2 d) ** 2
            if not n:
                break
            asked += n
            got = squared(x[rows[:n]], centroids[c])
            take = (got < near[:n]) | ((got == near[:n]) & (c < number[:n]))
            number[:n][take], near[:n][take] = c, got[take]
        best[rows], least[rows] = number, near
    return best, least, asked


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def sort_means(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The kept rows without their vector, with cluster and distance (squared) after all rounds and a last assignment, a written table; and the centroids.

    Starts are the k rows with the smallest sha256 of `seed:id`, in that order."""
    scratch = Scratch(vectors.sparkSession, "sort-means")
    others = [c for c in vectors.columns if c != vector]
    place = {c: vectors.columns.index(c) for c in vectors.columns}
    q = fresh(vectors, "whole")
    cluster, distance = fresh(vectors, "cluster"), fresh(vectors, "distance")
    kept = [vectors.schema[c] for c in others]
    numbers = [T.StructField(q, T.ArrayType(T.IntegerType(), False)), T.StructField(cluster, T.IntegerType())]

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.astype(np.int32).ravel()))

    def decode(batches):
        for batch in batches:
            x, at = whole(batch.column(place[vector]), width, scale)
            rows = [batch.column(place[c]).take(pa.array(at, pa.int64())) for c in others]
            yield pa.RecordBatch.from_arrays([*rows, lists(x), pa.array(np.zeros(len(x), np.int32))], names=[*others, q, cluster])

    now = scratch.save(vectors.mapInArrow(decode, T.StructType([*kept, *numbers])), "whole")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"), 256)
    starts = now.select(key.alias("h"), q).orderBy(F.asc_nulls_last("h"), q).limit(k).collect()
    centroids = np.array([r[q] for r in starts], np.int64).reshape(len(starts), width)

    def assigned(table: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
        def run(batches):
            for big in batches:
                for i in range(0, big.num_rows, ROWS):
                    batch = big.slice(i, ROWS)
                    n = len(others)
                    x = _rows(batch.column(n), width)
                    best, least, _ = assign(x, batch.column(n + 1).to_numpy(zero_copy_only=False).astype(np.int64), centroids)
                    more = pa.array(least) if last else batch.column(n)
                    names = [*others, cluster, distance] if last else [*others, q, cluster]
                    found = pa.array(best.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], *((found, more) if last else (more, found))], names=names)

        new = [numbers[1], T.StructField(distance, T.LongType())] if last else numbers
        return table.select(*others, q, cluster).mapInArrow(run, T.StructType([*kept, *new]))

    def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """The centroids as the floors of their vectors' means."""

        def run(batches):
            total, count = np.zeros((len(centroids), width), np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                x, c = _rows(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)
                for j in np.unique(c):
                    mine = x[c == j]
                    total[j] += mine.sum(0)
                    count[j] += len(mine)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["c", "n", "s"])

        parts = table.select(q, cluster).mapInArrow(run, "c bigint, n bigint, s array<bigint>")
        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        sums = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(wide(F.col("s")[i]) for i in range(width))).alias("s")).collect()
        out = centroids.copy()
        for r in sums:
            out[r.c] = [int(s) // r.n for s in r.s]
        return out

    for i in range(rounds):
        after = scratch.save(assigned(now, centroids, last=False), f"round{i}")
        scratch.drop(now)
        now, centroids = after, moved(after, centroids)
    out = scratch.save(assigned(now, centroids, last=True), "assigned")
    scratch.drop(now)
    return out, centroids


def with_inertia(found: DataFrame, centroids: np.ndarray, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; a row for each cluster is told to all tasks."""
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = found.groupBy(cluster).agg(F.sum(F.col(distance).cast("decimal(38,0)")).alias("s")).collect()  # k rows
    total = sum(int(r.s) for r in sums)
    rows = [(r[cluster], int(r.s), total, digest[r[cluster]]) for r in sums]
    names = [fresh(found, c) for c in ("cluster_inertia", "inertia", "centroid_sha256")]
    side = found.sparkSession.createDataFrame(rows, f"`{cluster}` int, `{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` string")
    return found.join(F.broadcast(side), cluster)
