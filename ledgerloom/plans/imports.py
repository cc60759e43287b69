"""Sources read back: blocks that landed in pages, and exports of exchanges with odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import EXCHANGE, exchange
from ..scratch import Scratch
from ..sources.exports import import_errors, read_export
from ..sources.landed import register
from ..streaming.commits import Commits, run_now
from .chain import STAGES, movements
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]
SPAN = 3600
START, END = 1704067200 + 10 * 86400 + 1800, 1704067200 + 20 * 86400 + 17  # within pages, not at their ends
_BLOCKS = f"{_MOVES}, b AS (SELECT ts_s AS block, tx_hash, 'w' || wallet_id AS account_id, direction, units::VARCHAR AS amount FROM t WHERE chain = 'near')"


def _land(spark, sf_dir, root: str, test: str) -> None:
    t = movements(spark, sf_dir).filter("chain = 'near'").withColumn("page", F.floor(F.col("ts_s") / SPAN) * SPAN).filter(test)
    rows = t.select("page", F.col("ts_s").alias("block"), "tx_hash", F.concat(F.lit("w"), F.col("wallet_id").cast("string")).alias("account_id"), "direction", F.col("units").cast("string").alias("amount"))
    rows.repartition("page").write.mode("append").partitionBy("page").json(root)


@query("src23_block_range", f"WITH {_BLOCKS} SELECT block, tx_hash, account_id, direction, amount FROM b WHERE block >= {START} AND block < {END}")
def src23(spark, sf_dir):
    """The blocks of a range, read in partitions of a day's pages."""
    register(spark)
    root = f"{Scratch(spark, 'landed').root}/pages"
    _land(spark, sf_dir, root, "true")
    return spark.read.format("landed_blocks").option("path", root).option("start", START).option("end", END).load()


@query("src23_block_stream", f"WITH {_BLOCKS} SELECT block, tx_hash, account_id, direction, amount FROM b")
def src23_stream(spark, sf_dir):
    """Half of the pages are streamed, the rest after a restart from the cursor; every row comes once."""
    register(spark)
    root = Scratch(spark, "landed").root
    commits = Commits(f"{root}/table")
    for test in (f"page < {START // SPAN * SPAN}", f"page >= {START // SPAN * SPAN}"):
        _land(spark, sf_dir, f"{root}/pages", test)
        run_now(spark.readStream.format("landed_blocks").option("path", f"{root}/pages").load(), f"{root}/checkpoint", commits.write)
    return commits.read(spark).drop("batch")


# -- exports -----------------------------------------------------------------------------
_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_ODD_SQL = f"{EXCHANGE}, e AS (SELECT *, CASE id % 13 WHEN 0 THEN '' WHEN 1 THEN 'not a day' ELSE {_TEXT} END AS at, CASE id % 17 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE quantity::VARCHAR END AS amount FROM exchange)"


def _odd(spark, sf_dir):
    """Entries of exchanges; some have no day or one that is none, some no amount, one that is none, or 0."""
    i = F.col("id")
    at = F.when(i % 13 == 0, "").when(i % 13 == 1, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    amount = F.when(i % 17 == 0, "0").when(i % 17 == 1, "").when(i % 17 == 2, "n/a").otherwise(F.col("quantity").cast("string"))
    return exchange(spark, sf_dir).withColumns({"at": at, "amount": amount})


def _export(spark, rows, sep: str = ",") -> str:
    path = f"{Scratch(spark, 'export').root}/csv"
    rows.write.option("header", True).option("sep", sep).csv(path)
    return path


_UNIFIED = ("exchange", "tx_date", "tx_type", "asset", "quantity", "currency", "notes", "needs_review")


@query("src03_coinbase_export", f"""WITH {_ODD_SQL} SELECT id::VARCHAR AS notes, 'coinbase' AS exchange, CASE WHEN id % 13 > 1 THEN ts END AS tx_date, CASE tx_type WHEN 'buy' THEN 'buy' WHEN 'sell' THEN 'sell' ELSE 'staking_reward' END AS tx_type, asset, nullif(amount, '') AS quantity, 'CAD' AS currency,
 id % 13 < 2 OR id % 17 < 3 AS needs_review FROM e""")
def src03(spark, sf_dir):
    kind = F.when(F.col("tx_type") == "buy", "Buy").when(F.col("tx_type") == "sell", "Sell").otherwise("Staking Income")
    rows = _odd(spark, sf_dir).select(F.col("at").alias("Timestamp"), kind.alias("Transaction Type"), F.col("asset").alias("Asset"), F.col("amount").alias("Quantity Transacted"), F.lit("CAD").alias("Spot Price Currency"), F.col("id").cast("string").alias("Notes"))
    return read_export(spark, _export(spark, rows)).select(*_UNIFIED).withColumn("tx_date", F.col("tx_date").cast("timestamp_ntz"))


@query("src05_pair_export", f"""WITH {_ODD_SQL} SELECT 'Pair: ' || asset || '_USDT' AS notes, 'crypto_com_exchange' AS exchange, CASE WHEN id % 13 > 1 THEN ts END AS tx_date, CASE tx_type WHEN 'buy' THEN 'buy' ELSE 'sell' END AS tx_type, asset, nullif(amount, '') AS quantity, 'USDT' AS currency, id % 13 < 2 OR id % 17 < 3 AS needs_review FROM e""")
def src05(spark, sf_dir):
    """Asset and currency from the pair, the amount from before its unit; parted by semicolons."""
    done = F.when(F.col("amount") == "", "").otherwise(F.concat_ws(" ", "amount", "asset"))
    rows = _odd(spark, sf_dir).select(F.col("at").alias("Trade Date"), F.concat("asset", F.lit("_USDT")).alias("Pair"), F.when(F.col("tx_type") == "buy", "buy").otherwise("SELL").alias("Side"), F.lit("1,234.50").alias("Price"), done.alias("Executed"), F.lit("0").alias("Fee"))
    return read_export(spark, _export(spark, rows, ";")).select(*_UNIFIED).withColumn("tx_date", F.col("tx_date").cast("timestamp_ntz"))


@query("src01_import_errors", f"""WITH {_ODD_SQL}, v AS (SELECT id, unnest(list_filter([CASE WHEN id % 17 < 3 THEN 'zero_amount' END, CASE WHEN id % 13 < 2 THEN 'no_date' END], lambda x: x IS NOT NULL)) AS problem FROM e)
SELECT id::VARCHAR AS row_ref, problem FROM v""")
def src01(spark, sf_dir):
    """What is wrong with which row of an export, a line for each problem."""
    rows = _odd(spark, sf_dir).select(F.col("at").alias("Created"), F.lower("tx_type").alias("Kind"), F.col("asset").alias("Coin"), F.col("amount").alias("Size"), F.col("id").cast("string").alias("Ref"))
    return import_errors(read_export(spark, _export(spark, rows)), F.get_json_object("raw_data", "$.Ref")).select("row_ref", "problem")
