import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import chains, exports, sinks
from ledgerloom.streaming import jobs

COINBASE = "﻿Timestamp,Transaction Type,Asset,Quantity Transacted,Spot Price Currency,Spot Price at Transaction,Subtotal,Total,Fees,Notes\n2024-01-15 10:30:00 UTC,Buy,BTC,\"1,000.5\",CAD,2,3,$4.00,5,n\n,Staking Income,,0,CAD,,,,,\n"
APP = "Timestamp (UTC),Transaction Description,Currency,Amount,To Currency,To Amount,Native Currency,Native Amount,Native Amount (in USD),Transaction Kind\n2024-01-10 08:00:00,d,BTC,0.05,CAD,1,CAD,2,3,crypto_purchase\n"
TRADES = "Trade Date,Pair,Side,Price,Executed,Fee,Total\n2024-01-05 09:15:00,BTC_USDT,SELL,22000.00,0.1 BTC,22.00,2222.00\n"
WEALTH = "Date;Type;Asset;Quantity;Price;Amount;Fee\n2024-01-20;buy;BTC;0.05;28000.00;1400.00;14.00\n"
OTHER = "Date,Action,Asset,Volume,Total,Market Rate\n01/08/2024,Buy,btc,-0.1,2400.00,24000.00\n"


@pytest.mark.parametrize("text,name,expected", [(COINBASE, "coinbase", ("buy", "BTC", "1000.5", "4.00")), (APP, "crypto_com_app", ("buy", "BTC", "0.05", "2")), (TRADES, "crypto_com_exchange", ("sell", "BTC", "0.1", "2222.00")), (WEALTH, "wealthsimple", ("buy", "BTC", "0.05", "1400.00")), (OTHER, "generic", ("buy", "BTC", "0.1", "2400.00"))])
def test_exports(spark, tmp_path, text, name, expected):
    path = tmp_path / "e.csv"
    path.write_text(text, encoding="utf-8")
    rows = exports.read_export(spark, str(path)).collect()
    first = next(r for r in rows if r.tx_date)
    assert (first.tx_type, first.asset, first.quantity, first.total_value) == expected and first.exchange == name and not first.needs_review
    assert first.tx_id.startswith("202401") and json.loads(first.raw_data)
    if name == "coinbase":
        bad = next(r for r in rows if not r.tx_date)
        assert bad.needs_review and set(bad.violations) == {"zero_amount", "no_date", "no_asset"} and bad.tx_type == "staking_reward"


def test_registered_format_comes_first(spark):
    exports.register_format("mine", lambda h: "strange" in h, lambda r: {**exports.generic(r), "asset": F.lit("X")})
    try:
        assert exports.unify(spark.createDataFrame([("a", "1")], "strange string, amount string")).first().exchange == "mine"
    finally:
        exports.FORMATS.pop(0)


def test_chain_rows(spark):
    page = spark.createDataFrame([("h1", "0xA", "0xb", "5", "21000", "10", "1700000000", "3", "0xT"), ("h2", "0xb", "0xa", "7", "1", "1", "1700000001", "4", "0xT")], "hash string, `from` string, `to` string, value string, gasUsed string, gasPrice string, timeStamp string, logIndex string, contractAddress string")
    out = {r.tx_hash: r for r in chains.evm_rows(page, "0xA").collect()}
    assert (out["h1"].direction, out["h2"].direction) == ("out", "in") and out["h1"].fee == 210000 and out["h1"].counterparty == "0xb"
    own = page.limit(1).withColumn("to", F.lit("0xA"))
    assert chains.evm_rows(own, "0xa").first().direction == "in"  # to oneself
    assert {r.tx_hash for r in chains.evm_rows(page, "0xa", "erc20").collect()} == {"h1-3", "h2-4"}
    action = "array<struct<action:string,method:string,args:string,deposit:string>>"
    ft = [("ADD_KEY", None, None, None), ("FUNCTION_CALL", "ft_transfer", json.dumps({"receiver_id": "bob", "amount": "42"}), "1")]
    near = spark.createDataFrame([("t1", "me", "tok", ft), ("t2", "x", "me", [("TRANSFER", None, None, "99")])], f"hash string, predecessor string, receiver string, actions {action}")
    got = {r.tx_hash: (r.direction, r.counterparty, r.action_type, int(r.amount), r.token_id) for r in chains.near_actions(near, "me").collect()}
    assert got == {"t1": ("out", "bob", "FUNCTION_CALL", 42, "tok"), "t2": ("in", "x", "TRANSFER", 99, None)}
    more = [("t3", "me", "tok", [("FUNCTION_CALL", "ft_balance_of", None, "3", None)]), ("t4", "me", "tok", [("FUNCTION_CALL", "ft_transfer", "{}", "1", None)]), ("t5", "me", "pool", [("STAKE", None, None, None, "77")])]
    more = spark.createDataFrame(more, "hash string, predecessor string, receiver string, actions array<struct<action:string,method:string,args:string,deposit:string,stake:string>>")
    assert {r.tx_hash: (int(r.amount), r.token_id) for r in chains.near_actions(more, "me").collect()} == {"t3": (3, None), "t4": (1, "tok"), "t5": (77, None)}
    block = {"block": {"header": {"height": 5, "timestamp": 1}}, "shards": [{"chunk": {"transactions": [{"transaction": {"hash": "a", "signer_id": "me", "receiver_id": "you"}}]}, "receipt_execution_outcomes": [{"receipt": {"predecessor_id": "me", "receiver_id": "z"}, "tx_hash": "a"}, {"receipt": {"predecessor_id": "q", "receiver_id": "me"}, "tx_hash": "b"}]}]}
    rows = chains.near_block_rows(spark.createDataFrame([(json.dumps(block),)], "value string"), spark.createDataFrame([("me",)], "account_id string")).collect()
    assert {(r.height, r.tx_hash, r.branch) for r in rows} == {(5, "a", 0), (5, "b", 1)}
    xrp = [{"tx": {"hash": "h", "Account": "me", "Destination": "o", "Amount": "2500000", "date": 1}, "meta": {"TransactionResult": "tesSUCCESS"}}, {"tx": {"hash": "f", "Account": "o", "Destination": "me", "Amount": {"value": "1.5", "currency": "USD"}, "date": 1}, "meta": {"TransactionResult": "tesSUCCESS"}}, {"tx": {"hash": "n"}, "meta": {"TransactionResult": "tecX"}}]
    got = {r.tx_hash: (r.direction, float(r.amount), r.token, r.ts_s) for r in chains.xrp_rows(spark.createDataFrame([(json.dumps(x),) for x in xrp], "value string"), "me").collect()}
    assert got == {"h": ("out", 2.5, "XRP", 946684801), "f": ("in", 1.5, "USD", 946684801)}
    d = spark.createDataFrame([("-1.2345679",), ("0.1",)], "x string").select(F.col("x").cast("decimal(20,8)").alias("delta"))
    assert [(r.direction, str(r.amount)) for r in chains.token_deltas(d).collect()] == [("out", "1.234567"), ("in", "0.100000")]
    lock = spark.createDataFrame([("a", ["new", "ping", "unstake"]), ("b", ["ping"])], "hash string, methods array<string>")
    assert [(r.hash, r.event) for r in chains.lockup_events(lock).collect()] == [("a", "withdraw")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), "out", 10.0, 4.0), (2, dt.datetime(2024, 1, 3), "in", 5.0, 9.0)], "id int, ts timestamp, direction string, p double, c double").withColumns({x: F.col(x).cast("decimal(18,2)") for x in "pc"})
    k = {r.id: (r.sent, r.received) for r in sinks.koinly_rows(rows.withColumn("asset", F.lit("X")), "p", "asset").collect()}
    assert k == {1: ("10.00000000", ""), 2: ("", "5.00000000")}
    lines = sinks.double_entry(rows, "p", "c")
    assert lines.count() == 6 and lines.groupBy("id").agg((F.sum("debit") - F.sum("credit")).alias("x")).filter("x <> 0").count() == 0
    assert [r.line.split("\t")[0] for r in sinks.iif_lines(rows.withColumn("d", F.lit("1/2/24")), "id", "d", "p").filter("id = 1").orderBy("n").collect()] == ["TRNS", "SPL", "ENDTRNS"]
    amounts = [float(r.line.split("\t")[3]) for r in sinks.iif_lines(rows.withColumn("d", F.lit("1/2/24")), "id", "d", "p").filter("id = 1 and n < 2").collect()]
    assert sum(amounts) == 0 and max(amounts) > 0
    sinks.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert sinks.manifest(spark, str(tmp_path / "out" / "*.csv")).filter("length(sha256) = 64 and size > 0").count() >= 1


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [("a", "h1", "in", t(1), 1.0), ("a", "h1", "in", t(1), 1.0), ("b", "h2", "in", t(20), 2.0), ("zz", "h3", "in", t(21), 3.0)]
    schema = "account_id string, tx_hash string, direction string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    wallets = spark.createDataFrame([("a",), ("b",)], "account_id string")
    run_stream(jobs.wallet_rows(stream(), wallets), "wallet_rows", "append")
    assert {r.tx_hash for r in spark.table("wallet_rows").collect()} == {"h1", "h2"} and spark.table("wallet_rows").count() == 2
    run_stream(jobs.windowed_totals(stream(), ["account_id"], "value"), "windowed", "complete")
    assert sorted((r.account_id, r.n, r.total) for r in spark.table("windowed").collect()) == [("a", 2, 2.0), ("b", 1, 2.0), ("zz", 1, 3.0)]
    run_stream(jobs.sessions(stream(), ["account_id"], gap="5 minutes"), "sessions", "complete")
    assert spark.table("sessions").count() == 3


def test_pools_as_state(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "user_id long, token string, ts timestamp, seq long, kind string, units double, value double, fee double"
    batches = [[(1, "X", t(2), 2, "dispose", 300.0, 2400.0, 8.0), (1, "X", t(1), 1, "acquire", 1000.0, 5000.0, 0.0)], [(1, "X", t(0), 0, "acquire", 9.0, 9.0, 0.0), (1, "X", t(5), 3, "dispose", 700.0, 100.0, 0.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.pools(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(f"pools{i}").outputMode("update").option("checkpointLocation", str(tmp_path / f"ck{i}")).trigger(availableNow=True).start()
        q.awaitTermination()
    first, last = spark.table("pools0").first(), spark.table("pools1").orderBy(F.desc("late"), "units_after").first()
    assert (first.units_after, first.cost_after, first.gain, first.late) == (700, 3500, 892, 0)
    assert last.units_after >= 0 and last.user_id == 1
