"""A labelled text that doesn't fit the bounds of the fit is left out alone."""

import pytest

from ledgerloom.llm import toxicity


def rows(spark, long_id):
    texts = [(i, ("vermin blockhead " if i % 3 == 0 else "garden letter ") * 5) for i in range(60)]
    texts = [(i, "vermin " * 400_000 if i == long_id else t) for i, t in texts]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")


def test_a_long_text_first_in_order_leaves_the_others(spark):
    from pyspark.sql import functions as F

    docs, labels = rows(spark, None)
    order = labels.filter("toxic = 1").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id")).first().doc_id
    docs, labels = rows(spark, order)
    model = toxicity.fit(docs, labels, max_bytes_per_class=1 << 20)
    assert 0 < model.prior < 1 and model.toxic
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(60))


def test_no_text_of_a_class_fits(spark):
    docs, labels = rows(spark, None)
    with pytest.raises(Exception, match="no labelled text of class"):
        toxicity.fit(docs, labels, max_bytes_per_class=50)
