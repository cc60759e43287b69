"""doc_ids that rows of different texts share."""

import random

from ledgerloom.llm import near_duplicates

from .helpers import words


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a + " tail"), (2, b), (2, b), (3, c), (3, d), (3, d + " tail"), (4, ""), (4, d + " end")]
    kept = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    linked = [x for x in got if x[0] == 3 and x[1] != c]
    assert len(linked) == 1 and linked[0][1] in (d, d + " tail")
    assert [x for x in got if x not in linked] == sorted([(1, a), (2, b), (3, c), (4, "")])
