"""Superficial losses: what is bought again near a sale at a loss denies a part of the loss, which then adds to the cost of what was bought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import asof_join, window_sum

#: Seconds before and after a sale in which buying counts.
WINDOW_SECONDS = 30 * 86400


def denied_losses(losses: DataFrame, buys: DataFrame, keys: list[str], parent: str | None = None) -> DataFrame:
    """losses (keys, ts_s, units, gain below 0) with rebought, ratio (8 places, 1 at most) and denied (2 places).

    buys: keys, buy_s, bought. With parent, a column of both, what was bought as part of the same swap doesn't count; a null parent is nobody's."""
    near = window_sum(losses, buys, keys, "ts_s", "buy_s", -WINDOW_SECONDS, WINDOW_SECONDS, {"rebought": F.col("bought")})
    if parent:
        own = buys.filter(F.col(parent).isNotNull()).groupBy(*keys, parent, "buy_s").agg(F.sum("bought").alias("__b"))
        same = losses.select(*keys, parent, "ts_s").distinct().join(own, [*keys, parent]).filter(F.abs(F.col("buy_s") - F.col("ts_s")) <= WINDOW_SECONDS)
        same = same.groupBy(*keys, parent, "ts_s").agg(F.sum("__b").alias("__own"))
        near = near.join(same, [*keys, parent, "ts_s"], "left").withColumn("rebought", F.col("rebought") - F.coalesce("__own", F.lit(0))).drop("__own")
    sold = F.col("units").cast("decimal(24,8)")
    ratio = F.when(sold > 0, F.round(F.least(F.col("rebought").cast("decimal(24,8)"), sold) / sold, 8)).otherwise(0).cast("decimal(10,8)")
    return near.withColumn("ratio", ratio).withColumn("denied", F.round(F.abs("gain").cast("decimal(24,8)") * F.col("ratio"), 2).cast("decimal(24,2)"))


def into_later_cost(snapshots: DataFrame, denied: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The acquisitions that denied losses go to, with added, and cost_after and acb_per_unit as they then are.

    snapshots: keys, order (ts_s first), kind, units_after, cost_after; denied: keys, ts_s, denied. A loss goes to the first acquisition at a later time; several add up.
    Later snapshots stay as they are."""
    bought = snapshots.filter("kind = 'acquire'").withColumn("at_s", F.col("ts_s"))
    first = bought.groupBy(*keys, "at_s").agg(F.min(F.struct(*order)).alias("__first"))
    later = asof_join(denied.select(*keys, "ts_s", "denied"), first.select(*keys, "at_s", F.lit(1).alias("__one")), keys, "ts_s", "at_s", ["__one"], "forward", exact=False)
    sums = later.filter("at_s is not null").groupBy(*keys, "at_s").agg(F.sum("denied").alias("added"), F.count("*").alias("losses"))
    hit = bought.join(sums, [*keys, "at_s"]).join(first, [*keys, "at_s"]).filter(F.struct(*order) == F.col("__first")).drop("__first", "at_s")
    cost = (F.col("cost_after").cast("decimal(28,8)") + F.col("added").cast("decimal(20,2)")).cast("decimal(28,8)")
    each = F.when(F.col("units_after") > 0, F.round(cost.cast("decimal(20,8)") / F.col("units_after").cast("decimal(17,8)"), 8)).cast("decimal(28,8)")
    return hit.withColumns({"cost_after": cost, "acb_per_unit": each})
