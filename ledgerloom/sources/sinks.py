"""Rows of the files that accounting programs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fmt_units


def koinly_rows(rows: DataFrame, amount: str, currency: str) -> DataFrame:
    """rows (ts, direction) with the columns of a transaction import: what went out on one side, what came in on the other."""
    out = F.col("direction") == "out"
    side = lambda test, x: F.when(test, x).otherwise("")
    return rows.withColumns({
        "date": F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), "sent": side(out, fmt_units(F.col(amount))), "sent_currency": side(out, F.col(currency)),
        "received": side(~out, fmt_units(F.col(amount))), "received_currency": side(~out, F.col(currency)),
    })


def double_entry(rows: DataFrame, proceeds: str, cost: str) -> DataFrame:
    """Three lines a disposal: cash in, the asset out at cost, and gain or loss; debits and credits agree."""
    gain, zero = F.col(proceeds) - F.col(cost), F.lit(0).cast("decimal(18,2)")
    line = lambda account, d, c: F.struct(F.lit(account).alias("account"), d.cast("decimal(18,2)").alias("debit"), c.cast("decimal(18,2)").alias("credit"))
    lines = F.array(line("cash", F.col(proceeds), zero), line("assets", zero, F.col(cost)), line("gains", F.greatest(-gain, zero), F.greatest(gain, zero)))
    return rows.select("*", F.explode(lines).alias("l")).select(*rows.columns, "l.*")


def iif_lines(rows: DataFrame, key: str, date: str, proceeds: str) -> DataFrame:
    """Tab-separated TRNS, SPL and ENDTRNS lines of each row, in order; what a disposal brings stands on both sides, so that they balance."""
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    neg = lambda c: (-F.col(c)).cast("decimal(18,2)").cast("string")
    lines = F.array(F.concat_ws("\t", F.lit("TRNS"), date, F.lit("assets"), text(proceeds)), F.concat_ws("\t", F.lit("SPL"), date, F.lit("gains"), neg(proceeds)), F.lit("ENDTRNS"))
    return rows.select(key, F.posexplode(lines).alias("n", "line"))


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of files with a header; as many as df has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(spark, pattern: str) -> DataFrame:
    """Name, size and hash of each file."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
