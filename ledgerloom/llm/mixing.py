"""Mixing sources to target weights.

Sizes are summed per source, targets follow from weights with a ceiling of
MAX_RATE times a source's size (what is above is shared again by weight), and a
document is taken floor(rate) times plus once more if a hash of it falls below the
rate's fraction. Nothing is kept per document, so reruns agree.

Cases. A null text has size 0; a null source is a source, the last. A source
without words has target 0 and gives nothing. Rows that repeat both doc_id and
text share a coin. An empty table gives no rows. The table of sources is broadcast
while it has at most MAX_BROADCAST_SOURCES rows; beyond, the join is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import fresh, n_words

MAX_RATE = 3
WEIGHTS = (1, 2, 3)
MAX_BROADCAST_SOURCES = 50_000
SALTS = 64
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds weight and target; its windows hold sources, not documents."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", (max_rate * F.col("source_size")).cast("double"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    t = t.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    t = t.withColumn("level", (F.sum("source_size").over(whole).cast("double") - F.col("caps")) / (F.sum("weight").over(whole) - F.col("weights")))
    t = t.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return t.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("water")).alias("target"))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A double in [0, 1) that follows from the seed and the document."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs (doc_id, source, text and whatever else, no column named as these) with size, source_size, target and copies."""
    sized = docs.withColumn("size", n_words(F.col("text")))
    scratch = Scratch(docs.sparkSession, "mix")
    goal = scratch.save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    goal = goal.select(F.col("source").alias("__source"), "source_size", "target")
    if goal.count() <= MAX_BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    else:
        salted = sized.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)))
        wide = goal.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(wide, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt2")), "left").drop("__source", "__salt", "__salt2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    more = F.when(coin(F.col("doc_id"), F.col("text")) < rate - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + more).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every document as many times as the mix takes it, with the columns of docs."""
    names = {c: fresh(docs, f"in_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    out = rates(docs.withColumnsRenamed(names), weights).filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    back = {c: names.get(c, c) for c in docs.columns}
    return out.select(*(F.col(x).alias(c) for c, x in back.items()))
