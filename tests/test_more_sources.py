"""Sums over windows of time, superficial losses, landed blocks and chains' JSON on small inputs with known results."""

import json
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.operators import superficial
from ledgerloom.operators.joins import window_sum
from ledgerloom.sources import chains, landed
from ledgerloom.streaming.commits import Commits, run_now

DAY = 86400


def test_window_sums_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.randrange(0, 5000)) for _ in range(120)] + [("a", 100)] * 3 + [("z", 1)]
    right = [(rng.choice("abc"), rng.randrange(-300, 5300), rng.randrange(9)) for _ in range(300)]
    for slice_seconds in (90 * DAY, 97):
        got = window_sum(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, s long, v long"), ["k"], "t", "s", -50, 200, {"n": F.lit(1).cast("long"), "total": F.col("v")}, slice_seconds)
        want = sorted((k, t, sum(1 for x, s, _ in right if x == k and -50 <= s - t <= 200), sum(v for x, s, v in right if x == k and -50 <= s - t <= 200)) for k, t in left)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_denied_losses_and_where_they_go(spark):
    losses = spark.createDataFrame([(1, 100 * DAY, D(10), D("-100"), None), (1, 200 * DAY, D(10), D("-100"), 7), (1, 300 * DAY, D(3), D("-1"), None), (2, 100 * DAY, D(10), D("-5"), None)], "u long, ts_s long, units decimal(18,2), gain decimal(18,2), parent long")
    buys = spark.createDataFrame([(1, 70 * DAY, D(2), None), (1, 130 * DAY, D(1), None), (1, 131 * DAY, D(50), None), (1, 200 * DAY, D(6), 7), (1, 201 * DAY, D(5), 8), (1, 301 * DAY, D(7), None)], "u long, buy_s long, bought decimal(18,2), parent long")
    got = {(r.u, r.ts_s // DAY): (float(r.rebought), float(r.ratio), float(r.denied)) for r in superficial.denied_losses(losses, buys, ["u"], "parent").collect()}
    assert got == {(1, 100): (3, 0.3, 30), (1, 200): (5, 0.5, 50), (1, 300): (7, 1, 1), (2, 100): (0, 0, 0)}
    snaps = spark.createDataFrame([(1, 150 * DAY, 1, "acquire", D(10), D(100)), (1, 150 * DAY, 2, "acquire", D(20), D(300)), (1, 400 * DAY, 3, "acquire", D(1), D(9)), (1, 120 * DAY, 4, "dispose", D(1), D(9))], "u long, ts_s long, id long, kind string, units_after decimal(38,8), cost_after decimal(38,8)")
    denied = spark.createDataFrame([(1, 100 * DAY, D(30)), (1, 149 * DAY, D(5)), (1, 150 * DAY, D(2)), (1, 500 * DAY, D(1))], "u long, ts_s long, denied decimal(24,2)")
    got = {r.id: (float(r.added), r.losses, float(r.cost_after), float(r.acb_per_unit)) for r in superficial.into_later_cost(snaps, denied, ["u"], ["ts_s", "id"]).collect()}
    assert got == {1: (35, 2, 135, 13.5), 3: (2, 1, 11, 11)}


def test_landed_blocks(spark, tmp_path):
    landed.register(spark)
    rows = [(i // 10 * 10, i, f"h{i}", "a", "in", str(i)) for i in range(0, 100, 3)]
    land = lambda test: spark.createDataFrame(rows, "page long, block long, tx_hash string, account_id string, direction string, amount string").filter(test).write.mode("append").partitionBy("page").json(str(tmp_path / "pages"))
    land("page < 50")
    read = lambda **o: spark.read.format("landed_blocks").options(path=str(tmp_path / "pages"), span=10, pages=2, **o)
    assert sorted(r.block for r in read().load().collect()) == list(range(0, 50, 3))
    df = read(start=12, end=31).load()
    assert sorted(r.block for r in df.collect()) == [12, 15, 18, 21, 24, 27, 30] and df.rdd.getNumPartitions() == 2
    assert read(start=400).load().count() == 0
    commits = Commits(str(tmp_path / "t"))
    stream = lambda: spark.readStream.format("landed_blocks").options(path=str(tmp_path / "pages"), span=10).load()
    run_now(stream(), str(tmp_path / "ck"), commits.write)
    land("page >= 50")
    run_now(stream(), str(tmp_path / "ck"), commits.write)
    assert sorted(r.block for r in commits.read(spark).collect()) == list(range(0, 100, 3)) and commits.read(spark).select("batch").distinct().count() == 2


def values(spark, rows):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "value string")


def test_cosmos_messages(spark):
    message = lambda *m, **more: {"txhash": "h", "code": 0, "tx": {"body": {"messages": list(m)}, "auth_info": {"fee": {"amount": [{"amount": "9"}]}}}} | more
    send = {"@type": "/x.MsgSend", "from_address": "o", "to_address": "ME", "amount": [{"amount": "5", "denom": "ibc/1"}]}
    rows = [message(send), message({"@type": "/x.MsgVote"}, {"@type": "/x.MsgUndelegate", "delegator_address": "me", "amount": {"amount": "7"}}, send), message({"@type": "/x.MsgVote"}, {"@type": "/y.MsgLast"}), message(), message(send, code=5), message(send, txhash=""), "no json"]
    got = [(r.action_type, r.token_id, r.amount, r.fee, r.tx_type) for r in chains.cosmos_rows(values(spark, rows).coalesce(1), "me").collect()]
    assert got == [("in", "ibc/1", "5", "9", "MsgSend"), ("in", "AKT", "7", "9", "MsgUndelegate"), ("self", "AKT", "0", "9", "MsgLast"), ("self", "AKT", "0", "9", "unknown")]


def test_transfers_and_fees(spark):
    transfers = [{"hash": "a", "from": "0xMe", "to": "0xB", "value": 1.5, "blockNum": "0x10"}, {"hash": "a", "from": "0xB", "to": "0xME", "category": "erc20", "rawContract": {"value": "0xde0b6b3a7640000"}, "asset": "T"}, {"hash": "b", "from": "0xme", "to": "0xb", "value": 0.0}, {"hash": "c", "from": "x", "to": "y", "value": 3.0}, {"hash": "d", "from": "x", "to": "0xme", "rawContract": {"value": "junk"}}]
    receipts = [{"transactionHash": "a", "gasUsed": "0x5208", "effectiveGasPrice": "0x3b9aca00", "gasPrice": "0x1"}, {"transactionHash": "b", "gasUsed": "0x5208"}, {"transactionHash": "c", "gasUsed": "0x5208", "gasPrice": "0x1"}]
    got = sorted((r.tx_hash, r.direction, r.amount, r.action_type) for r in chains.transfer_rows(values(spark, transfers), values(spark, receipts), "0xME").collect())
    assert got == [("a", "in", 1.0, "FT_TRANSFER"), ("a", "out", 2.1e-05, "GAS_FEE"), ("a", "out", 1.5, "TRANSFER")]


def test_locks(spark):
    tx = lambda method, args="{}", ok=True, to="mpdao-vote.near": {"transaction_hash": method, "receiver_account_id": to, "predecessor_account_id": "me", "outcomes": {"status": ok}, "actions": [{"method": method, "args": args}]}
    rows = [tx("claim_and_lock", '{"amount":"2500000"}'), tx("bond_mpdao", '{"amount":"0"}'), tx("bond_mpdao", "no json"), tx("claim_unlocked_mpdao"), tx("vote"), tx("claim_unlocked_mpdao", ok=False), tx("claim_unlocked_mpdao", to="other")]
    assert sorted((r.action, None if r.amount is None else float(r.amount)) for r in chains.lock_rows(values(spark, rows)).collect()) == [("lock", 2.5), ("unlock", None)]
