"""Sort-means against plain k-means in Python's own numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerloom.llm import clustering, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"
COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=16, rounds=3, width=64):
    """rows (id, vector) by the contract, every distance taken."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    got = [(i, *near(v)) for i, v in kept]
    sums = {}
    for _, d, j in got:
        sums[j] = sums.get(j, 0) + d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in got]


def written(spark, path, rows):
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()


def tables():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 64)) * 3
    some = [(i, [float(x) for x in (centres[i % 9] + rng.normal(size=64)).astype(np.float32)]) for i in range(400)]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [float("nan")] * 64), (505, [1.0] * 63 + [float("inf")]), (506, [None] + [1.0] * 63), (507, [0.0] * 64), (None, [0.25] * 64)]
    yield "clusters", [*some, *odd, *some[:50], (3, [0.5] * 64)]
    yield "one very common vector", [*((1000 + i, [-0.01] * 64) for i in range(300)), *some[:60]]
    ties = random.Random(2)
    yield "ties", [(i, [float(ties.choice((-1, 1)) * (j < 3)) for j in range(64)]) for i in range(120)]
    yield "fewer than k", some[:5]
    yield "none", odd[:7]
    yield "empty", []


@pytest.mark.parametrize("name,rows", list(tables()), ids=lambda x: x if isinstance(x, str) else "")
def test_query_equals_plain_means(spark, tmp_path, name, rows):
    seen = written(spark, tmp_path, rows)
    got = queries.op12_centroid_clusters(spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    want = plain([(r.vec_id, r.embedding) for r in seen])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_scan_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    cs = rng.integers(-300, 300, (16, 8))
    x = np.repeat(cs, 50, 0) + rng.integers(-9, 10, (800, 8))
    every = np.array([[((r - c) ** 2).sum() for c in cs] for r in x])
    best, least, asked = clustering.assign(x, every.argmin(1), cs)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all() and asked < 0.3 * every.size
    best, least, asked = clustering.assign(x, np.zeros(800, np.int64), cs)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()


def test_other_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], 7, "x") for i in range(20)], SCHEMA)
    out, centroids = clustering.sort_means(df, k=3, width=2)
    assert out.columns == ["vec_id", "label", "cluster", "cluster_", "distance"] and out.count() == 20 and len(centroids) == 3
    assert {r.cluster for r in out.collect()} == {"x"}


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [3e9, 1.0], 7, "x")], SCHEMA)
    with pytest.raises(Exception, match="or more"):
        clustering.sort_means(df, k=3, width=2)
