"""Keyed upserts without a table format: a new version of the table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import latest


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str, mode: str = "last", guard: str | None = None) -> DataFrame:
    """mode last: the newest row of a key stays; first: what was there stays. guard: a boolean column of existing rows that no batch may replace."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    newest = [F.col("__new").desc(), F.col(version).desc_nulls_last()]
    oldest = [F.col("__new"), F.col(version).asc_nulls_last()]
    order = newest if mode == "last" else oldest
    if guard:
        order = [F.when((F.col("__new") == 0) & F.coalesce(F.col(guard), F.lit(False)), 0).otherwise(1), *order]
    return latest(both, keys, order).drop("__new")
