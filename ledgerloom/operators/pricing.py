"""Prices: several sources, currencies, and the order in which they are asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import nearest_join

#: Fixed values.
STABLE = ("USDT", "USDC", "DAI", "BUSD")
FALLBACK_RATE, LARGE, LOOKBACK_DAYS, NEAR_SECONDS, EXACT_SECONDS = 1.36, 500, 5, 3600, 900


def two_sources(primary: Column, secondary: Column, most: float = 0.5) -> Column:
    """Their mean where they differ by no more than most of the smaller, else the primary; either where there is one."""
    off = F.abs(primary - secondary) / F.least(primary, secondary)
    return F.when(primary.isNull(), secondary).when(secondary.isNull(), primary).when(off <= most, (primary + secondary) / 2).otherwise(primary)


def with_rate(rows: DataFrame, rates: DataFrame, day: str = "day", days: int = LOOKBACK_DAYS) -> DataFrame:
    """rows with the rate (rate_day, rate) of the day or of one of the days before, else the constant; estimated tells which."""
    served = rates.select(F.explode(F.sequence("rate_day", F.col("rate_day") + days)).alias("__day"), "rate_day", "rate")
    served = served.groupBy("__day").agg(F.max_by("rate", F.struct("rate_day", "rate")).alias("rate"))  # a row a day
    found = rows.join(F.broadcast(served), F.col(day) == F.col("__day"), "left").drop("__day")
    return found.withColumn("estimated", F.col("rate").isNull()).withColumn("rate", F.coalesce("rate", F.lit(FALLBACK_RATE)))


def minute_prices(rows: DataFrame, prices: DataFrame, on: list[str], ts: str = "ts_s") -> DataFrame:
    """rows that have a price (price_s, price) within an hour, with the nearest; estimated if more than 15 minutes off."""
    return nearest_join(rows, prices, on, ts, "price_s", "price", NEAR_SECONDS).withColumn("estimated", F.col("gap") > EXACT_SECONDS)


def tiered(*tiers: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that there is, and the name of its tier."""
    return F.coalesce(*(v for _, v in tiers)), F.coalesce(*(F.when(v.isNotNull(), n) for n, v in tiers))
