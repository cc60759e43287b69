"""What nodes and explorers give, built from the stand-in movements and read back."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..sources import chains
from .chain import STAGES, movements
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]
ME = "0xMeMe"


@query("src11_evm_rows", f"""WITH {_MOVES} SELECT 'h' || id AS tx_hash, CASE WHEN k % 2 = 0 THEN 'in' ELSE 'out' END AS direction, CASE WHEN k % 2 = 0 THEN '0xsender' ELSE '0xtarget' END AS counterparty, CASE WHEN id % 9 = 0 THEN NULL ELSE (id * 1000)::DOUBLE END AS amount,
 (21000 * (k + 1))::DOUBLE AS fee, ts_s FROM t WHERE id % 3 = 0 UNION ALL SELECT 'h' || id || '-' || k, CASE WHEN k % 2 = 0 THEN 'in' ELSE 'out' END, CASE WHEN k % 2 = 0 THEN '0xsender' ELSE '0xtarget' END, CASE WHEN id % 9 = 0 THEN NULL ELSE (id * 1000)::DOUBLE END, NULL, ts_s FROM t WHERE id % 3 = 1""")
def src11(spark, sf_dir):
    """Explorer rows of a wallet: plain ones carry the fee, those of tokens have the log's number in their hash; an amount that is none is null."""
    i, k = F.col("id"), F.col("k")
    sender, target = F.when(k % 2 == 0, "0xSender").otherwise(ME), F.when(k % 2 == 0, ME).otherwise("0xTarget")
    rows = movements(spark, sf_dir).select(
        "id", F.col("tx_hash").alias("hash"), sender.alias("from"), target.alias("to"), F.when(i % 9 == 0, "n/a").otherwise((i * 1000).cast("string")).alias("value"), F.lit("21000").alias("gasUsed"), (k + 1).cast("string").alias("gasPrice"),
        F.col("ts_s").cast("string").alias("timeStamp"), k.cast("string").alias("logIndex"), F.lit("0xToken").alias("contractAddress"),
    )
    both = chains.evm_rows(rows.filter("id % 3 = 0"), ME).unionByName(chains.evm_rows(rows.filter("id % 3 = 1"), ME, "erc20"))
    return both.select("tx_hash", "direction", "counterparty", F.col("amount").cast("double").alias("amount"), F.col("fee").cast("double").alias("fee"), "ts_s")


@query("src14_near_actions", f"""WITH {_MOVES} SELECT tx_hash, CASE WHEN k % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE id % 3 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'friend.near' ELSE 'payer.near' END ELSE CASE WHEN k % 2 = 0 THEN 'token.near' ELSE 'payer.near' END END AS counterparty,
 CASE id % 3 WHEN 0 THEN 'TRANSFER' WHEN 1 THEN 'FUNCTION_CALL' ELSE 'ADD_KEY' END AS action_type, CASE WHEN id % 3 = 1 THEN 'ft_transfer' END AS method_name, CASE id % 3 WHEN 0 THEN id::DOUBLE WHEN 1 THEN (k * 10)::DOUBLE END AS amount, CASE WHEN id % 3 = 1 THEN 'token.near' END AS token_id FROM t""")
def src14(spark, sf_dir):
    """Transactions with several actions: the one that ranks first speaks, and a token's transfer says to whom and how much, in plain JSON or in base 64."""
    i, k = F.col("id"), F.col("k")
    none = F.lit(None).cast("string")
    action = lambda name, method, args, deposit: F.struct(F.lit(name).alias("action"), method.alias("method"), args.alias("args"), deposit.alias("deposit"))
    args = F.to_json(F.struct(F.lit("friend.near").alias("receiver_id"), (k * 10).cast("string").alias("amount")))
    args = F.when(k % 3 == 0, F.base64(args.cast("binary"))).otherwise(args)
    key, move, call = action("ADD_KEY", none, none, none), action("TRANSFER", none, none, i.cast("string")), action("FUNCTION_CALL", F.lit("ft_transfer"), args, F.lit("1"))
    actions = F.when(i % 3 == 0, F.array(key, move)).when(i % 3 == 1, F.array(key, call)).otherwise(F.array(key))
    t = movements(spark, sf_dir).select(F.col("tx_hash").alias("hash"), F.when(k % 2 == 0, "me.near").otherwise("payer.near").alias("predecessor"), F.lit("token.near").alias("receiver"), actions.alias("actions"))
    return chains.near_actions(t, "me.near").withColumn("amount", F.col("amount").cast("double"))


@query("src15_block_rows", f"""WITH {_MOVES}, b AS (SELECT ts_s AS height, tx_hash, 'w' || wallet_id AS signer, 'w' || (wallet_id + 10) AS receiver, k % 3 = 0 AS receipt FROM t),
e AS (SELECT height, tx_hash, signer AS account_id, 0 AS branch FROM b UNION ALL SELECT height, tx_hash, receiver, 0 FROM b UNION ALL SELECT height, tx_hash, receiver, 1 FROM b WHERE receipt UNION ALL SELECT height, tx_hash, 'w0', 1 FROM b WHERE receipt)
SELECT height, tx_hash, account_id, min(branch)::INT AS branch FROM e WHERE account_id IN (SELECT 'w' || wallet_id FROM t WHERE wallet_id % 3 = 0) GROUP BY 1, 2, 3""")
def src15(spark, sf_dir):
    """Blocks as JSON: each wallet that a transaction or a receipt touches, once a block."""
    t = movements(spark, sf_dir)
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    signer, receiver = name(F.col("wallet_id")), name(F.col("wallet_id") + 10)
    tx = F.struct(F.struct(F.col("tx_hash").alias("hash"), signer.alias("signer_id"), receiver.alias("receiver_id")).alias("transaction"))
    outcome = F.struct(F.struct(receiver.alias("predecessor_id"), F.lit("w0").alias("receiver_id")).alias("receipt"), F.col("tx_hash").alias("tx_hash"))
    shard = F.struct(F.struct(F.array(tx).alias("transactions")).alias("chunk"), F.when(F.col("k") % 3 == 0, F.array(outcome)).otherwise(F.array_remove(F.array(outcome), outcome)).alias("receipt_execution_outcomes"))
    block = F.struct(F.struct(F.struct(F.col("ts_s").alias("height"), F.col("ts_s").alias("timestamp")).alias("header")).alias("block"), F.array(shard).alias("shards"))
    wallets = t.filter("wallet_id % 3 = 0").select(name(F.col("wallet_id")).alias("account_id")).distinct()
    return chains.near_block_rows(t.select(F.to_json(block).alias("value")), wallets)


@query("src17_xrp_rows", f"""WITH {_MOVES} SELECT tx_hash, CASE k % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'in' ELSE 'self' END AS direction, CASE WHEN id % 2 = 0 THEN id::DOUBLE / 1000000 ELSE k::DOUBLE + 0.5 END AS amount, CASE WHEN id % 2 = 0 THEN 'XRP' ELSE 'USD' END AS token, ts_s FROM t WHERE k % 10 <> 0""")
def src17(spark, sf_dir):
    """Payments that went through: native amounts in millionths, or issued ones; times from another epoch."""
    i, k = F.col("id"), F.col("k")
    issued = F.struct((k + 0.5).cast("string").alias("value"), F.lit("USD").alias("currency"))
    amount = F.when(i % 2 == 0, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))).otherwise(F.to_json(issued))
    who = lambda mine: F.when(mine, "rMe").otherwise("rOther")
    j = F.concat(
        F.lit('{"meta":{"TransactionResult":"'), F.when(k % 10 == 0, "tecPATH_DRY").otherwise("tesSUCCESS"), F.lit('"},"tx":{"hash":"'), F.col("tx_hash"), F.lit('","Account":"'), who(k % 3 != 1), F.lit('","Destination":"'), who(k % 3 != 0),
        F.lit('","date":'), (F.col("ts_s") - chains.RIPPLE_EPOCH).cast("string"), F.lit(',"Amount":'), amount, F.lit("}}"),
    )
    return chains.xrp_rows(movements(spark, sf_dir).select(j.alias("value")), "rMe").withColumn("amount", F.col("amount").cast("double"))


@query("src19_token_deltas", f"WITH {_MOVES} SELECT id, CASE WHEN k < 50 THEN 'in' ELSE 'out' END AS direction, (k * 1.234567)::DOUBLE AS amount FROM t")
def src19(spark, sf_dir):
    """The side from the sign of a change, its size cut to six places."""
    size = (F.col("k") * F.lit(Decimal("1.234567")) + F.lit(Decimal("0.0000009"))).cast("decimal(30,12)")
    t = movements(spark, sf_dir).select("id", F.when(F.col("k") < 50, size).otherwise(-size).alias("delta"))
    return chains.token_deltas(t).select("id", "direction", F.col("amount").cast("double").alias("amount"))


@query("src20_lockup_events", f"WITH {_MOVES} SELECT tx_hash, CASE k % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'deposit' WHEN 2 THEN 'withdraw' END AS event FROM t WHERE k % 4 < 3")
def src20(spark, sf_dir):
    """Calls of lockup contracts: the last method that means an event decides."""
    methods = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in (("new", "ping"), ("new", "ping", "stake"), ("deposit_and_stake", "unstake_all"), ("ping", "vote")))), (F.col("k") % 4 + 1).cast("int"))
    return chains.lockup_events(movements(spark, sf_dir).select("tx_hash", methods.alias("methods"))).select("tx_hash", "event")
