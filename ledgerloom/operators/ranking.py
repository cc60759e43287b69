"""Ranks over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_INDEX_BITS = 33


def global_rank(keys: DataFrame, columns: list[str], scratch: Scratch, out: str = "rank") -> DataFrame:
    """keys (distinct on columns) with out, the place of each row (from 1) in the order of columns.

    Ranges of the order are sorted apart; a row's place is its place in its range and the sizes of the ranges before,
    of which there are as many as partitions."""
    mid = f"__{out}_id"
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keys.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn(mid, F.monotonically_increasing_id())
    placed = scratch.save(dealt.withColumn("__part", F.shiftright(mid, _INDEX_BITS)), "ranked")
    sizes = placed.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    ranked = placed.join(F.broadcast(offsets), "__part")  # a row a partition
    return ranked.withColumn(out, F.col("__before") + F.col(mid).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)) + 1).drop("__part", "__before", mid)
