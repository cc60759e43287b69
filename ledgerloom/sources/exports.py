"""Exchange exports as unified transactions: a format is told by its header, its rows are mapped column by column.

Every format gives tx_id, tx_date, tx_type, asset, quantity, price_per_unit, total_value, fee, currency, notes and
raw_data (JSON). Rows are never dropped: what is missing is listed in violations and asks for review.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats of times in the order in which they are tried, and names of types by exchange.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
COINBASE_TYPES = {"Buy": "buy", "Sell": "sell", "Send": "send", "Receive": "receive", "Convert": "convert", "Staking Income": "staking_reward", "Rewards Income": "reward", "Learning Reward": "reward"}
CRYPTO_COM_TYPES = {"crypto_purchase": "buy", "crypto_exchange": "convert", "staking_reward": "staking_reward", "BUY": "buy", "SELL": "sell"}
UNIFIED = ("tx_date", "tx_type", "asset", "quantity", "price_per_unit", "total_value", "fee", "currency", "notes")


def parse_time(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMATS))


def number(c: Column) -> Column:
    """A number as text, without thousands separators, currency signs and blanks; null for none."""
    return F.nullif(F.regexp_replace(c, r"[,$\s]", ""), F.lit(""))


def mapped(c: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(known, c), F.lower(c))


class Row:
    """Columns of a header by name, whatever their case; null for one that is missing."""

    def __init__(self, names: list[str]):
        self.names = {n.strip().lower(): n for n in names}

    def __call__(self, *wanted: str) -> Column:
        found = [F.nullif(F.col(f"`{self.names[w.lower()]}`"), F.lit("")) for w in wanted if w.lower() in self.names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def like(self, *parts: str) -> Column:
        """The first column whose name holds one of the parts, or is held by one."""
        for p in parts:
            for low, name in self.names.items():
                if p in low or low in p:
                    return F.nullif(F.col(f"`{name}`"), F.lit(""))
        return F.lit(None).cast("string")


def coinbase(r: Row) -> dict[str, Column]:
    return {
        "tx_date": parse_time(r("Timestamp", "Date")), "tx_type": mapped(r("Transaction Type", "Type"), COINBASE_TYPES), "asset": r("Asset", "Currency"), "quantity": number(r("Quantity Transacted", "Amount")),
        "price_per_unit": number(r("Spot Price at Transaction")), "total_value": number(r("Total")), "fee": number(r("Fees", "Fee")), "currency": F.coalesce(r("Spot Price Currency", "Native Currency"), F.lit("CAD")), "notes": r("Notes"),
    }


def crypto_com_app(r: Row) -> dict[str, Column]:
    return {
        "tx_date": parse_time(r("Timestamp (UTC)")), "tx_type": mapped(r("Transaction Kind"), CRYPTO_COM_TYPES), "asset": r("Currency"), "quantity": number(r("Amount")), "price_per_unit": F.lit(None).cast("string"),
        "total_value": number(r("Native Amount")), "fee": F.lit(None).cast("string"), "currency": F.coalesce(r("Native Currency"), F.lit("USD")), "notes": r("Transaction Description"),
    }


def crypto_com_exchange(r: Row) -> dict[str, Column]:
    pair = r("Pair")
    return {
        "tx_date": parse_time(r("Trade Date", "Date")), "tx_type": mapped(F.upper(r("Side")), CRYPTO_COM_TYPES), "asset": F.split_part(pair, F.lit("_"), F.lit(1)), "quantity": number(F.split_part(F.trim(r("Executed")), F.lit(" "), F.lit(1))),
        "price_per_unit": number(r("Price")), "total_value": number(r("Total")), "fee": number(r("Fee")), "currency": F.coalesce(F.nullif(F.split_part(pair, F.lit("_"), F.lit(2)), F.lit("")), F.lit("USD")), "notes": F.concat(F.lit("Pair: "), pair),
    }


def wealthsimple(r: Row) -> dict[str, Column]:
    return {
        "tx_date": parse_time(r("Date")), "tx_type": F.lower(r("Type")), "asset": r("Asset", "Symbol"), "quantity": number(r("Units", "Quantity")), "price_per_unit": number(r("Price")),
        "total_value": number(r("Amount")), "fee": number(r("Fee")), "currency": F.lit("CAD"), "notes": F.lit(None).cast("string"),
    }


def generic(r: Row) -> dict[str, Column]:
    quantity = F.regexp_replace(number(r.like("quantity", "destination amount", "volume", "amount", "size")), "^[-+]", "")
    return {
        "tx_date": parse_time(r.like("timestamp", "date", "time", "created")), "tx_type": F.lower(r.like("action", "type", "side", "kind")), "asset": F.upper(r.like("asset", "destination currency", "coin", "symbol", "currency")), "quantity": quantity,
        "price_per_unit": number(r.like("market rate", "price", "rate")), "total_value": number(r.like("total", "origin amount", "value")), "fee": number(r.like("fee amount", "fee")), "currency": F.coalesce(r("Origin Currency", "Currency"), F.lit("CAD")), "notes": F.lit(None).cast("string"),
    }


#: Formats in the order in which they are asked; each knows its header by columns that it must have. Others can be added.
FORMATS: list[tuple[str, Callable[[set[str]], bool], Callable[[Row], dict[str, Column]]]] = [
    ("coinbase", lambda h: {"timestamp", "transaction type"} <= h, coinbase),
    ("crypto_com_app", lambda h: {"timestamp (utc)", "transaction kind"} <= h, crypto_com_app),
    ("crypto_com_exchange", lambda h: {"trade date", "pair"} <= h, crypto_com_exchange),
    ("wealthsimple", lambda h: {"date", "type", "asset", "quantity", "price", "amount", "fee"} == h, wealthsimple),
    ("generic", lambda h: True, generic),
]


def register_format(name: str, detect, rows) -> None:
    """A new format, asked before those there are."""
    FORMATS.insert(0, (name, detect, rows))


def delimiter_of(header: str) -> str:
    return max(",;\t", key=header.count)


def unify(raw: DataFrame, exchange: str | None = None) -> DataFrame:
    """Unified transactions of a table of text columns."""
    header = {c.strip().lower() for c in raw.columns}
    name, rows = next((n, f) for n, detect, f in FORMATS if detect(header))
    out = raw.select(*(c.cast("string").alias(n) if n != "tx_date" else c.alias(n) for n, c in rows(Row(raw.columns)).items()), F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("raw_data"))
    zero = F.coalesce(F.col("quantity").try_cast("decimal(38,10)") == 0, F.lit(True))
    broken = F.array(F.when(zero, "zero_amount"), F.when(F.col("tx_date").isNull(), "no_date"), F.when(F.col("asset").isNull(), "no_asset"))
    out = out.withColumn("violations", F.filter(broken, lambda v: v.isNotNull())).withColumn("needs_review", F.size("violations") > 0)
    key = F.concat_ws("_", F.date_format("tx_date", "yyyyMMddHHmmss"), "asset", "quantity", "tx_type")
    return out.withColumns({"exchange": F.lit(exchange or name), "tx_id": F.coalesce(F.nullif(F.trim("tx_id"), F.lit("")), key) if "tx_id" in out.columns else key})


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export: its delimiter and format are told from the first line, a byte-order mark is dropped, broken lines stay with nulls."""
    first = spark.read.text(path).first()
    line = (first[0] if first else "").lstrip("﻿")
    raw = spark.read.csv(path, header=True, sep=delimiter_of(line), mode="PERMISSIVE", encoding="UTF-8")
    return unify(raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns)))


def import_errors(unified: DataFrame, row_ref: Column) -> DataFrame:
    """A line for each problem of each row: row_ref, problem, exchange, raw_data."""
    return unified.select(row_ref.alias("row_ref"), F.explode("violations").alias("problem"), "exchange", "raw_data")
