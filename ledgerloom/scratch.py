"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set (tests)."""
    there = spark.conf.get(KEY, None)
    if there:
        return there.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Scratch:
    """Written tables of one run of an operator, dropped one by one as they go out of use."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count, self.kept = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, []

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the DataFrame that reads it back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        self.kept.append(path)
        return back

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables saved so far but these."""
        stay = {getattr(df, "_scratch_path", None) for df in tables}
        for path in self.kept:
            if path not in stay:
                self._delete(path)
        self.kept = [p for p in self.kept if p in stay]

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)


#: Bytes that a written table may have on disk to be broadcast.
BROADCAST_BYTES = 8 << 20


def written_bytes(df: DataFrame) -> int:
    """What a table of Scratch.save takes on disk."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bounded(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df for a join: broadcast if it, or the written table that it is a part of, has few bytes, else as it is."""
    return F.broadcast(df) if written_bytes(df if of is None else of) <= BROADCAST_BYTES else df
