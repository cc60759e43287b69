"""Transactions of chains from the JSON that their nodes and explorers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which of a transaction's actions speaks for it; the epoch of one chain's clock; messages by kind.
ACTION_PRIORITY = ("TRANSFER", "FUNCTION_CALL", "STAKE", "CREATE_ACCOUNT", "DELETE_ACCOUNT", "DEPLOY_CONTRACT", "ADD_KEY", "DELETE_KEY")
RIPPLE_EPOCH = 946684800
LOCKUP_EVENTS = {"new": "create", "transfer": "transfer", "deposit_to_staking_pool": "deposit", "stake": "deposit", "deposit_and_stake": "deposit", "withdraw_from_staking_pool": "withdraw", "unstake": "withdraw", "unstake_all": "withdraw", "terminate_vesting": "unlock"}
NEAR_BLOCK = "block struct<header struct<height long, timestamp long>>, shards array<struct<chunk struct<transactions array<struct<transaction struct<hash string, signer_id string, receiver_id string>>>>, receipt_execution_outcomes array<struct<receipt struct<predecessor_id string, receiver_id string>, tx_hash string>>>>"


def hex_number(c: Column) -> Column:
    return F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("decimal(38,0)")


def evm_rows(pages: DataFrame, wallet: str, kind: str = "transfer") -> DataFrame:
    """Explorer rows of a wallet (hash, from, to, value, gasUsed, gasPrice, timeStamp, logIndex, contractAddress: text) as transactions. Only plain transfers carry the fee."""
    me = wallet.lower()
    to, sender = F.lower("to"), F.lower("from")
    direction = F.when(to == me, "in").otherwise("out")
    fee = F.col("gasUsed").try_cast("decimal(19,0)") * F.col("gasPrice").try_cast("decimal(19,0)")
    token = kind in ("erc20", "nft")
    return pages.select(
        (F.concat_ws("-", "hash", "logIndex") if token else F.col("hash")).alias("tx_hash"), direction.alias("direction"), F.when(direction == "in", sender).otherwise(to).alias("counterparty"),
        F.col("value").try_cast("decimal(38,0)").alias("amount"), (fee if kind == "transfer" else F.lit(None).cast("decimal(38,0)")).alias("fee"), (F.lower("contractAddress") if token else F.lit(None).cast("string")).alias("token_id"), F.col("timeStamp").try_cast("long").alias("ts_s"),
    )


def near_actions(txs: DataFrame, account: str) -> DataFrame:
    """txs: hash, predecessor, receiver, actions (array of struct action, method, args, deposit and, if any, stake). The action that ranks first speaks; fungible-token arguments (JSON, plain or in base 64) override amount and counterparty."""
    rank = F.array(*map(F.lit, ACTION_PRIORITY))
    has_stake = "stake" in txs.schema["actions"].dataType.elementType.names
    ranked = F.array_sort(F.transform("actions", lambda a: F.struct(F.when(F.array_position(rank, a["action"]) == 0, 99).otherwise(F.array_position(rank, a["action"])).alias("o"), a.alias("a"))))
    one = txs.withColumn("a", F.get(ranked, F.lit(0))["a"])
    schema = "receiver_id string, amount string, token_id string"
    plain, packed = F.from_json(F.col("a.args"), schema), F.from_json(F.try_to_binary("a.args", F.lit("base64")).cast("string"), schema)
    args = F.coalesce(F.when(F.col("a.args").startswith("{"), plain), packed)
    is_ft = F.coalesce(F.col("a.method").isin("ft_transfer", "ft_transfer_call"), F.lit(False))
    direction = F.when(F.col("predecessor") == account, "out").otherwise("in")
    stake = F.col("a.stake") if has_stake else F.lit(None).cast("string")
    one = one.withColumns({"args": args, "direction": direction})
    other = F.when(F.col("direction") == "out", F.when(is_ft, F.coalesce("args.receiver_id", "receiver")).otherwise(F.col("receiver"))).otherwise(F.col("predecessor"))
    return one.select(
        F.col("hash").alias("tx_hash"), "direction", other.alias("counterparty"), F.col("a.action").alias("action_type"), F.col("a.method").alias("method_name"),
        F.coalesce(F.when(is_ft, F.col("args.amount")), F.when(F.col("a.action") == "STAKE", stake).otherwise(F.col("a.deposit"))).try_cast("decimal(38,0)").alias("amount"), F.when(is_ft, F.col("receiver")).alias("token_id"),
    )


def near_block_rows(blocks: DataFrame, wallets: DataFrame) -> DataFrame:
    """blocks: a column value of JSON. height, tx_hash and wallet of each wallet (account_id, few rows) that a transaction or receipt touches, once a block; transactions come before receipts."""
    b = blocks.select(F.from_json("value", NEAR_BLOCK).alias("b")).select("b.block.header.height", F.explode("b.shards").alias("s"))
    txs = b.select("height", F.explode("s.chunk.transactions").alias("t")).select("height", F.col("t.transaction.hash").alias("tx_hash"), F.explode(F.array_distinct(F.array("t.transaction.signer_id", "t.transaction.receiver_id"))).alias("account_id"), F.lit(0).alias("branch"))
    outs = b.select("height", F.explode("s.receipt_execution_outcomes").alias("r")).select("height", F.col("r.tx_hash"), F.explode(F.array_distinct(F.array("r.receipt.predecessor_id", "r.receipt.receiver_id"))).alias("account_id"), F.lit(1).alias("branch"))
    return txs.unionByName(outs).join(wallets.select("account_id"), "account_id").groupBy("height", "tx_hash", "account_id").agg(F.min("branch").alias("branch"))


def xrp_rows(txs: DataFrame, account: str) -> DataFrame:
    """txs: a column value of JSON. Successful payments; amounts native (millionths) or issued."""
    j = lambda path: F.get_json_object("value", path)
    t = txs.filter(j("$.meta.TransactionResult") == "tesSUCCESS")
    issued = j("$.tx.Amount.value")
    amount = F.coalesce(issued.try_cast("decimal(24,6)"), (j("$.tx.Amount").try_cast("decimal(24,0)") / 1000000).cast("decimal(24,6)"))
    source, target = j("$.tx.Account"), j("$.tx.Destination")
    direction = F.when((source == account) & (target == account), "self").when(source == account, "out").otherwise("in")
    return t.select(j("$.tx.hash").alias("tx_hash"), direction.alias("direction"), amount.alias("amount"), F.coalesce(j("$.tx.Amount.currency"), F.lit("XRP")).alias("token"), (j("$.tx.date").cast("long") + RIPPLE_EPOCH).alias("ts_s"))


def token_deltas(txs: DataFrame) -> DataFrame:
    """Direction from the sign of delta (decimal), its size cut to six places."""
    size = F.abs("delta")
    return txs.withColumns({"direction": F.when(F.col("delta") >= 0, "in").otherwise("out"), "amount": (F.floor(size * 1000000) / 1000000).cast("decimal(38,6)")})


def lockup_events(txs: DataFrame) -> DataFrame:
    """txs: hash, methods (array). The last method that means an event decides."""
    known = F.create_map(*(F.lit(x) for kv in LOCKUP_EVENTS.items() for x in kv))
    events = F.filter(F.transform("methods", lambda m: F.element_at(known, m)), lambda e: e.isNotNull())
    return txs.withColumn("event", F.try_element_at(events, F.lit(-1))).filter("event is not null")

# Kinds of messages of a Cosmos transaction, by what their type holds, and its native coin.
COSMOS_COIN, COSMOS_DENOM = "AKT", "uakt"
#: Methods of a vote contract that lock.
LOCK_METHODS = ("claim_and_lock", "bond_mpdao")
UNLOCK_METHODS = ("claim_unlocked_mpdao", "delegated_claim_unlocked_mpdao")

_MESSAGE = "struct<`@type` string, from_address string, to_address string, delegator_address string, owner string, id struct<owner string>, amount string>"
_COSMOS = f"txhash string, code long, timestamp string, height string, tx struct<body struct<messages array<{_MESSAGE}>>, auth_info struct<fee struct<amount array<struct<amount string, denom string>>>>>"


def cosmos_rows(responses: DataFrame, address: str) -> DataFrame:
    """responses: a column value of JSON. tx_hash, timestamp, action_type (in, out, self), token_id, amount, fee and tx_type of the transactions that went through.

    The first message of a known kind speaks; without one the last message gives the type alone."""
    t = responses.select(F.from_json("value", _COSMOS).alias("t")).select("t.*").filter((F.coalesce("txhash", F.lit("")) != "") & (F.coalesce("code", F.lit(0)) == 0))
    kinds = ("MsgSend", "MsgDelegate", "MsgUndelegate", "MsgWithdrawDelegatorReward", "MsgCreateDeployment", "MsgCloseDeployment")
    messages = F.coalesce("tx.body.messages", F.array().cast(f"array<{_MESSAGE}>"))
    known = F.get(F.filter(messages, lambda m: F.coalesce(m["@type"], F.lit("")).rlike("|".join(kinds))), F.lit(0))
    t = t.select("txhash", "timestamp", F.get("tx.auth_info.fee.amount", F.lit(0))["amount"].alias("fee"), F.coalesce(known, F.try_element_at(messages, F.lit(-1))).alias("m"), known.isNotNull().alias("k"))
    kind, me = F.coalesce("m.@type", F.lit("")), address.lower()
    coins = F.get(F.from_json("m.amount", "array<struct<amount string, denom string>>"), F.lit(0))
    one = F.from_json("m.amount", "struct<amount string>")
    is_ = lambda c: F.coalesce(F.lower(c) == me, F.lit(False))
    send, stake, unstake = kind.contains("MsgSend"), kind.contains("MsgDelegate"), kind.contains("MsgUndelegate")
    side = F.when(send, F.when(is_("m.from_address"), "out").when(is_("m.to_address"), "in"))
    side = side.when(stake & is_("m.delegator_address"), "out").when(unstake & is_("m.delegator_address"), "in").when(kind.contains("MsgWithdrawDelegatorReward") & is_("m.delegator_address"), "in")
    side = side.when(kind.rlike("MsgCreateDeployment|MsgCloseDeployment") & is_(F.coalesce(F.nullif("m.owner", F.lit("")), "m.id.owner")), "out")
    amount = F.when(send, coins["amount"]).when(stake | unstake, one["amount"])
    token = F.when(send & (coins["denom"] != COSMOS_DENOM), coins["denom"]).otherwise(COSMOS_COIN)
    return t.select(
        F.col("txhash").alias("tx_hash"), "timestamp", F.coalesce(F.when(F.col("k"), side), F.lit("self")).alias("action_type"), token.alias("token_id"), F.coalesce(amount, F.lit("0")).alias("amount"), F.coalesce("fee", F.lit("0")).alias("fee"),
        F.when(kind == "", "unknown").otherwise(F.element_at(F.split(kind, r"\."), -1)).alias("tx_type"),
    )


_TRANSFER = "hash string, `from` string, `to` string, value double, asset string, category string, blockNum string, rawContract struct<value string>, metadata struct<blockTimestamp string>"


def transfer_rows(transfers: DataFrame, receipts: DataFrame, wallet: str) -> DataFrame:
    """transfers, receipts: a column value of JSON each. The transfers of a wallet, and a row of action GAS_FEE for each hash that it sent and that has a receipt.

    A transfer of nothing is left out unless it is of a token; the fee is gas used times the effective price, else the plain one."""
    me = wallet.lower()
    number = lambda c: hex_number(F.when(F.lower(c).rlike("^0x[0-9a-f]{1,16}$"), c))
    t = transfers.select(F.from_json("value", _TRANSFER).alias("t")).select("t.*").withColumns({"sender": F.lower("from"), "to_": F.lower("to")})
    t = t.withColumn("direction", F.when(F.col("sender") == me, "out").when(F.col("to_") == me, "in")).filter("direction is not null")
    kind = F.coalesce("category", F.lit("external"))
    amount = F.coalesce("value", number(F.col("rawContract.value")).cast("double") / 1e18, F.lit(0.0))
    action = F.when(kind == "internal", "INTERNAL_TRANSFER").when(kind == "erc20", "FT_TRANSFER").otherwise("TRANSFER")
    found = t.select(
        F.col("hash").alias("tx_hash"), number(F.col("blockNum")).cast("long").alias("block"), "direction", F.when(F.col("direction") == "out", F.col("to_")).otherwise(F.col("sender")).alias("counterparty"), amount.alias("amount"),
        F.coalesce("asset", F.lit("ETH")).alias("asset"), action.alias("action_type"), kind.alias("category"),
    ).filter("amount <> 0 or category = 'erc20'")
    sent = t.filter("direction = 'out'").groupBy(F.col("hash").alias("tx_hash")).agg(F.max(number(F.col("blockNum")).cast("long")).alias("block"))
    r = receipts.select(F.from_json("value", "transactionHash string, gasUsed string, effectiveGasPrice string, gasPrice string").alias("r")).select("r.*")
    fee = number(F.col("gasUsed")).cast("double") * number(F.coalesce(F.nullif("effectiveGasPrice", F.lit("")), "gasPrice")).cast("double") / 1e18
    paid = sent.join(r.select(F.col("transactionHash").alias("tx_hash"), fee.alias("amount")), "tx_hash").filter("amount > 0")
    text = lambda x: F.lit(x).cast("string")
    fees = paid.select("tx_hash", "block", F.lit("out").alias("direction"), text(None).alias("counterparty"), "amount", F.lit("ETH").alias("asset"), F.lit("GAS_FEE").alias("action_type"), F.lit("fee").alias("category"))
    return found.unionByName(fees)


def lock_rows(txs: DataFrame, contract: str = "mpdao-vote.near") -> DataFrame:
    """txs: a column value of JSON. tx_hash, account_id, action (lock, unlock) and amount in whole tokens of each such call that an account made and that went through."""
    schema = "transaction_hash string, receiver_account_id string, predecessor_account_id string, outcomes struct<status boolean>, actions array<struct<method string, args string>>"
    t = txs.select(F.from_json("value", schema).alias("t")).select("t.*").filter((F.col("receiver_account_id") == contract) & F.coalesce("outcomes.status", F.lit(False)))
    a = t.select("transaction_hash", "predecessor_account_id", F.explode("actions").alias("a"))
    amount = F.coalesce(F.get_json_object("a.args", "$.amount").try_cast("decimal(38,0)"), F.lit(0))
    lock, unlock = F.col("a.method").isin(*LOCK_METHODS) & (amount > 0), F.col("a.method").isin(*UNLOCK_METHODS)
    return a.select(F.col("transaction_hash").alias("tx_hash"), F.col("predecessor_account_id").alias("account_id"), F.when(lock, "lock").when(unlock, "unlock").alias("action"), F.when(lock, (amount / 1000000).cast("decimal(38,6)")).alias("amount")).filter("action is not null")
