"""Small tables with every odd case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, `key` string"


def words(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ren", "tas", "ul")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_documents(spark, extra=()):
    rng = random.Random(5)
    long = words(rng, 3000)
    base = "\n".join(words(rng, 12) for _ in range(6))
    texts = [(1, base), (2, base), (3, base.replace("ka", "lo", 2)), (4, None), (5, ""), (6, " \n\t "), (7, long), (7, long), (None, base), (8, "one two three"), (9, "one two three"), (10, "ONE two Three"), (None, None), (11, "é" * 30 + " x" * 40), *extra]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (4, 8) else "s%d" % ((i or 0) % 3), None if t is None else len(t), 1, 0.5, "k") for i, t in texts], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
