"""The bundled star schema as ledger tables, and the same in DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(c: str | Column, scale: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


ORDER = ["ts", "a", "b", "c", "units", "value"]
CATEGORIES = ("income", "reward", "airdrop", "interest", "buy", "sell", "trade", "fee", "deposit", "withdrawal", "stake", "unstake", "transfer", "spam")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a movement: user, token, kind, time, order (a, b, c), units, value, fee, category, direction, wallet, counterparty."""
    li = table(spark, sf_dir, "lineitem")
    pick = F.array(*map(F.lit, CATEGORIES))
    return li.select(
        F.col("l_suppkey").alias("user_id"), F.col("l_returnflag").alias("token"), F.when(F.col("l_linenumber") % 3 == 0, "dispose").otherwise("acquire").alias("kind"),
        F.col("l_shipdate").alias("ts"), F.unix_timestamp("l_shipdate").alias("ts_s"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_partkey").alias("c"),
        dec("l_quantity").alias("units"), dec("l_extendedprice").alias("value"), (dec("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(22,4)").alias("fee"),
        F.element_at(pick, (F.col("l_partkey") % len(CATEGORIES) + 1).cast("int")).alias("category"), F.when(F.col("l_linestatus") == "O", "in").otherwise("out").alias("direction"),
        (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).alias("wallet_id"), F.col("l_partkey").alias("counterparty"),
    )


LEDGER = f"""ledger AS (SELECT l_suppkey AS user_id, l_returnflag AS token, CASE WHEN l_linenumber % 3 = 0 THEN 'dispose' ELSE 'acquire' END AS kind, l_shipdate AS ts, (epoch_us(l_shipdate) // 1000000)::BIGINT AS ts_s,
 l_orderkey AS a, l_linenumber::BIGINT AS b, l_partkey AS c, l_quantity::DECIMAL(18,2) AS units, l_extendedprice::DECIMAL(18,2) AS value, (l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(4,2))::DECIMAL(22,4) AS fee,
 list_value({', '.join(f"'{c}'" for c in CATEGORIES)})[(l_partkey % {len(CATEGORIES)} + 1)::INT] AS category, CASE WHEN l_linestatus = 'O' THEN 'in' ELSE 'out' END AS direction,
 l_suppkey * 10 + l_orderkey % 3 AS wallet_id, l_partkey AS counterparty FROM lineitem)"""


def exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange transactions, from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.element_at(F.array(*map(F.lit, ("coinbase", "kraken", "cryptocom", "bitfinex"))), (F.col("o_custkey") % 4 + 1).cast("int")).alias("exchange"),
        F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "NEAR"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("asset"), F.when(F.col("o_orderstatus") == "O", "buy").when(F.col("o_orderstatus") == "F", "sell").otherwise("deposit").alias("tx_type"),
        F.col("o_orderdate").alias("ts"), F.unix_timestamp("o_orderdate").alias("ts_s"), dec("o_totalprice").alias("quantity"), F.col("o_orderpriority").alias("priority"),
    )


EXCHANGE = """exchange AS (SELECT o_orderkey AS id, o_custkey AS user_id, list_value('coinbase', 'kraken', 'cryptocom', 'bitfinex')[(o_custkey % 4 + 1)::INT] AS exchange, list_value('BTC', 'ETH', 'NEAR')[(o_orderkey % 3 + 1)::INT] AS asset,
 CASE o_orderstatus WHEN 'O' THEN 'buy' WHEN 'F' THEN 'sell' ELSE 'deposit' END AS tx_type, o_orderdate AS ts, (epoch_us(o_orderdate) // 1000000)::BIGINT AS ts_s, o_totalprice::DECIMAL(18,2) AS quantity, o_orderpriority AS priority FROM orders)"""


def onchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers seen on chains, from events: user, chain, direction, symbol, time, amount."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id"), F.element_at(F.array(*map(F.lit, ("near", "ethereum", "polygon"))), (F.col("event_id") % 3 + 1).cast("int")).alias("chain"),
        F.when(F.col("event_type").isin("view", "purchase"), "out").otherwise("in").alias("direction"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "NEAR").otherwise("ETH").alias("symbol"),
        F.col("ts"), F.unix_timestamp("ts").alias("ts_s"), F.col("value"), F.round(F.col("value")).alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


ONCHAIN = """onchain AS (SELECT event_id AS id, user_id, list_value('near', 'ethereum', 'polygon')[(event_id % 3 + 1)::INT] AS chain, CASE WHEN event_type IN ('view', 'purchase') THEN 'out' ELSE 'in' END AS direction, event_type,
 CASE WHEN event_id % 2 = 0 THEN 'NEAR' ELSE 'ETH' END AS symbol, ts, (epoch_us(ts) // 1000000)::BIGINT AS ts_s, value, round(value) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
