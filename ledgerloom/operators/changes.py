"""Tables of pools kept up to date: only what an edit touches is computed and written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, bounded
from .folds import replay


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(parts))


def write_pools(moves: DataFrame, path: str, keys: list[str], order: list[str], parts: int = 64) -> None:
    """All pools of moves, in a folder for each part of the keys."""
    replay(moves, keys, order).withColumn("part", part_of(keys, parts)).write.mode("overwrite").partitionBy("part").parquet(path)


def affected(edits: DataFrame, keys: list[str], since: Column | None = None, at: str = "edited_at") -> DataFrame:
    """The keys of edits after a time (since: that of the last finished job; null counts all)."""
    return (edits if since is None else edits.filter(F.coalesce(F.col(at) > since, F.lit(True)))).select(*keys).distinct()


def apply_changes(spark: SparkSession, path: str, moves: DataFrame, touched: DataFrame, keys: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """Replays the touched keys over moves and overwrites the folders that they lie in; other keys there keep their rows, other folders their files.

    The new rows are written to the shared folder first, so nothing is overwritten while it is read, and an interrupted job can run again. Returns the touched keys."""
    scratch = Scratch(spark, "changes")
    touched = scratch.save(touched.withColumn("part", part_of(keys, parts)), "touched")
    hit = bounded(touched)
    replayed = replay(moves.join(hit.drop("part"), keys, "left_semi"), keys, order).withColumn("part", part_of(keys, parts))
    old = spark.read.parquet(path)
    same = old.join(bounded(touched.select("part").distinct(), of=touched), "part", "left_semi").join(hit.drop("part"), keys, "left_anti")
    fresh = scratch.save(replayed.unionByName(same.select(*replayed.columns)), "fresh")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    scratch.drop(fresh)
    return touched.drop("part")
