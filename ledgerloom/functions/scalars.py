"""Scalar functions of amounts, times, symbols and their formats."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def to_human_units(raw: Column, decimals: int) -> Column:
    """A whole number of the smallest unit, as text, with the point set decimals from its end; exact for any length."""
    digits = F.regexp_replace(raw, "^-", "")
    wide = F.lpad(digits, 38, "0")
    wide = F.when(F.length(digits) > 38, digits).otherwise(wide)
    whole = F.substr(wide, F.lit(1), F.length(wide) - decimals)
    part = F.substr(wide, F.length(wide) - decimals + 1, F.lit(decimals))
    whole = F.coalesce(F.nullif(F.ltrim(whole, F.lit("0")), F.lit("")), F.lit("0"))
    return F.concat(F.when(raw.startswith("-"), "-").otherwise(""), whole, F.lit("."), part)


def to_epoch_seconds(raw: Column) -> Column:
    """Seconds, from a time in seconds, milli-, micro- or nanoseconds, told by its size."""
    return F.when(raw > 10**17, F.floor(raw.cast("decimal(38,0)") / 10**9)).when(raw > 10**14, F.floor(raw / 10**6)).when(raw > 10**11, F.floor(raw / 10**3)).otherwise(raw).cast("long")


def round_down(x: Column, places: int) -> Column:
    """Towards zero."""
    return F.signum(x) * F.floor(F.abs(x) * 10**places) / 10**places


def fmt_cad(x: Column) -> Column:
    return F.coalesce(x.cast("decimal(38,2)").cast("string"), F.lit(""))


def fmt_units(x: Column) -> Column:
    """Eight places; nothing for null and zero."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, "").otherwise(x.cast("decimal(18,8)").cast("string"))


def symbol_of(token_id: Column, chain: Column, asset: Column, known: dict[str, str], native: dict[str, str]) -> Column:
    """An exchange's asset, a known token, the chain's own, or the token's id, in upper case."""
    look = lambda m, k: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), k)
    return F.coalesce(F.upper(asset), F.when(token_id.isNotNull(), F.coalesce(look(known, F.lower(token_id)), F.upper(token_id))), look(native, F.lower(chain)), F.upper(chain))


def relative_difference(a: Column, b: Column) -> Column:
    return F.when(F.greatest(F.abs(a), F.abs(b)) == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def register_functions(spark: SparkSession) -> None:
    """The functions that SQL text can use."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fmt_cad(x DOUBLE) RETURNS STRING RETURN coalesce(cast(cast(x AS DECIMAL(38,2)) AS STRING), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION epoch_seconds(x BIGINT) RETURNS BIGINT RETURN CASE WHEN x > 100000000000000000 THEN x DIV 1000000000 WHEN x > 100000000000000 THEN x DIV 1000000 WHEN x > 100000000000 THEN x DIV 1000 ELSE x END")
