"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
NOT_A_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_A_WORD), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name


#: Bytes of rows that reach Python at a time, where the session has Spark's own default.
BATCH_BYTES, _KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """docs; texts reach Python in batches of BATCH_BYTES or one row, so a batch takes little memory on either side however long they are."""
    conf = docs.sparkSession.conf
    if conf.get(_KEY) in ("67108864b", "64MB", "67108864"):
        conf.set(_KEY, str(BATCH_BYTES))
    return docs
