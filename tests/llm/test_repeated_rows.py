"""Tables whose rows repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann

from .test_pages_and_vectors import vectors


@pytest.mark.parametrize("n, copies", [(12, 5), (12, 2), (300, 5)])
def test_neighbours_where_every_row_repeats(spark, n, copies):
    x = np.random.default_rng(3).normal(size=(n, 8)).astype("float32")
    table = vectors(spark, [(i, [float(v) for v in x[i]], 0, 1) for i in range(n) for _ in range(copies)])
    got = {}
    for r in sorted(ann.search(table, F.col("vec_id") % 4 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    hits = 0
    for q in range(0, n, 4):
        s = y @ y[q]
        s[q] = -9
        best = np.argsort(-s)[:5].tolist()
        assert len(got[q]) == len(set(got[q])) == 5
        assert n > 100 or got[q] == best
        hits += len(set(best) & set(got[q]))
    assert hits / (5 * len(got)) >= 0.9


def test_an_id_that_fills_leaves_by_itself(spark):
    rows = [(1, [1.0, 0.001 * i], 0, 1) for i in range(400)] + [(10 + i, [0.5, 1.0 + 0.01 * i], 0, 1) for i in range(9)] + [(0, [1.0, 0.0], 0, 1)]
    got = sorted(ann.search(vectors(spark, rows), F.col("vec_id") == 0).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in got] == [1, 10, 11, 12, 13]
