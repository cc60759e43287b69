"""Joins of ledgers, look-ups of duplicates, back-fills, an audit log, and chains' JSON, each on the stand-in movements."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..adapters import EXCHANGE, exchange
from ..operators.joins import latest, range_join
from ..operators.pipeline import linked
from ..operators.pricing import with_rate
from ..operators.upsert import upsert
from ..scratch import Scratch
from ..sources import chains
from .chain import EVENTS, STAGES, all_classified, events, movements, staking
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]


def dollars(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


# -- prices and links --------------------------------------------------------------------
@query("prc06_tiered_value", f"WITH {EVENTS} SELECT id, leg_no, tier, price_cad::DOUBLE AS price_cad, estimated FROM ev WHERE kind IN ('acquire', 'dispose')")
def prc06(spark, sf_dir):
    """A movement's own value, a staking or lockup event's, money at 1, the nearest minute within an hour for disposals of over 500, the day's price, else the minute's."""
    return events(spark, sf_dir).filter("kind in ('acquire', 'dispose')").select("id", "leg_no", "tier", *dollars("price_cad"), "estimated")


@query("j06_hash_then_tolerance", f"""WITH {_MOVES}, s AS (SELECT id + 1000000000 AS event_id, wallet_id, CASE WHEN k % 2 = 0 THEN tx_hash END AS tx_hash, ts_s + k AS event_s FROM t WHERE event_type = 'signup')
SELECT t.id, coalesce((SELECT max(event_id) FROM s WHERE s.wallet_id = t.wallet_id AND s.tx_hash = t.tx_hash), (SELECT min_by(event_id, (event_s, event_id)) FROM s WHERE s.wallet_id = t.wallet_id AND event_s BETWEEN t.ts_s - 60 AND t.ts_s + 60)) AS linked FROM t WHERE direction = 'in'""")
def j06(spark, sf_dir):
    """By hash first, else the earliest event of the wallet within a minute."""
    return linked(movements(spark, sf_dir).filter("direction = 'in'"), staking(spark, sf_dir), "linked")


@query("prc10_backfill_cad", f"""WITH {_MOVES}, r AS (SELECT ts_s // 86400 AS d, ((count(*) % 100 * 10 + 13000) * 0.0001)::DECIMAL(8,4) AS rate FROM t GROUP BY 1 HAVING ((ts_s // 86400) + 4) % 7 NOT IN (0, 6)),
fx AS (SELECT d.d, coalesce(max_by(r.rate, r.d), 1.36)::DECIMAL(8,4) AS rate FROM (SELECT DISTINCT ts_s // 86400 AS d FROM t) d LEFT JOIN r ON r.d BETWEEN d.d - 5 AND d.d GROUP BY 1)
SELECT id, (CASE WHEN k % 4 = 0 THEN units ELSE round(units * rate, 2) END)::DOUBLE AS cad, k % 4 <> 0 AS filled FROM t JOIN fx ON fx.d = ts_s // 86400 WHERE k % 9 <> 0""")
def prc10(spark, sf_dir):
    """Values in dollars get theirs at the day's rate where it is not there yet; rows without a value stay out."""
    t, day = movements(spark, sf_dir), F.floor(F.col("ts_s") / 86400)
    rates = t.groupBy(day.alias("rate_day")).agg(((F.count("*") % 100 * 10 + 13000) * F.lit(Decimal("0.0001"))).cast("decimal(8,4)").alias("rate")).filter((F.col("rate_day") + 4) % 7 % 6 != 0)
    t = with_rate(t.filter("k % 9 <> 0").withColumn("day", day), rates).withColumn("there", F.when(F.col("k") % 4 == 0, F.col("units")))
    cad = F.coalesce("there", F.round(F.col("units") * F.col("rate").cast("decimal(8,4)"), 2).cast("decimal(18,2)"))
    return t.select("id", cad.cast("double").alias("cad"), F.col("there").isNull().alias("filled"))


@query("prc11_bulk_update", f"""WITH {_MOVES}, p AS (SELECT ts_s // 86400 AS d, min(units) AS usd FROM t WHERE event_type = 'error' AND token = 'NEAR' GROUP BY 1) SELECT id, CASE WHEN k % 3 = 0 AND k > 0 THEN k::DOUBLE ELSE round((units * usd * 1.38)::DOUBLE, 6) END AS cost_cad FROM t LEFT JOIN p ON p.d = ts_s // 86400 WHERE token = 'NEAR' AND units > 1""")
def prc11(spark, sf_dir):
    """Costs of one coin's movements from its prices of days at a fixed rate, where there is none or 0."""
    t, day = movements(spark, sf_dir).filter("token = 'NEAR'"), F.floor(F.col("ts_s") / 86400)
    prices = t.filter("event_type = 'error'").groupBy(day.alias("day")).agg(F.min("units").alias("usd"))
    t = t.filter("units > 1").withColumn("day", day).join(prices, "day", "left")
    cost = F.round((F.col("units") * F.col("usd") * F.lit(Decimal("1.38"))).cast("double"), 6)
    return t.select("id", F.when((F.col("k") % 3 == 0) & (F.col("k") > 0), F.col("k").cast("double")).otherwise(cost).alias("cost_cad"))


# -- joins -------------------------------------------------------------------------------
@query("j02_ledger_with_category", f"WITH {STAGES}, w AS (SELECT DISTINCT wallet_id, 'w' || wallet_id AS account FROM t WHERE wallet_id % 5 <> 0) SELECT t.id, c.category, account FROM t LEFT JOIN classified c ON c.id = t.id AND c.stage = 'rule' LEFT JOIN w ON w.wallet_id = t.wallet_id")
def j02(spark, sf_dir):
    """Every movement, with its category where rules gave it one and the account where the wallet is known."""
    t = movements(spark, sf_dir).select("id", "wallet_id")
    wallets = t.filter("wallet_id % 5 <> 0").select("wallet_id").distinct().withColumn("account", F.concat(F.lit("w"), F.col("wallet_id").cast("string")))
    return t.join(all_classified(spark, sf_dir).filter("stage = 'rule'").select("id", "category"), "id", "left").join(wallets, "wallet_id", "left").select("id", "category", "account")


@query("j11_not_confirmed", f"WITH {STAGES}, sure AS (SELECT id FROM t WHERE k % 10 = 0) SELECT c.id, c.category FROM classified c WHERE c.needs_review AND NOT EXISTS (SELECT 1 FROM sure WHERE sure.id = c.id)")
def j11(spark, sf_dir):
    """What asks for a review and no specialist has confirmed."""
    sure = movements(spark, sf_dir).filter("k % 10 = 0").select("id")
    return all_classified(spark, sf_dir).filter("needs_review").select("id", "category").join(sure, "id", "left_anti")


_ASSETS = """CASE tx_type WHEN 'send' THEN 'out' WHEN 'sale' THEN 'out' WHEN 'receive' THEN 'in' WHEN 'buy' THEN 'in' WHEN 'staking_reward' THEN 'in' END"""


@query("j10_entry_on_chain", f"""WITH {_MOVES}, e AS (SELECT id, user_id, token, ts_s, units, {_ASSETS} AS side FROM t WHERE chain = 'exchange'), again AS (SELECT tx_hash, user_id, token, direction, ts_s, units FROM t WHERE chain = 'near'
 UNION ALL SELECT 'x' || id, user_id, token, side, ts_s + CASE WHEN id % 2 = 0 THEN 300 ELSE -900 END, units FROM e WHERE side IS NOT NULL AND id % 4 < 2)
SELECT e.id, min_by(a.tx_hash, (a.ts_s, a.tx_hash)) AS match FROM e JOIN again a ON a.user_id = e.user_id AND a.token = e.token AND a.direction = e.side AND a.ts_s BETWEEN e.ts_s - 600 AND e.ts_s + 600 AND 100 * abs(a.units - e.units) <= e.units GROUP BY 1""")
def j10(spark, sf_dir):
    """Entries of exchanges that are on chain, too: same user, asset and direction, ten minutes and one per cent apart at most; the first of them. Some land again five minutes later, or fifteen before."""
    t = movements(spark, sf_dir)
    side = F.when(F.col("tx_type").isin("send", "sale"), "out").when(F.col("tx_type").isin("receive", "buy", "staking_reward"), "in")
    e = t.filter("chain = 'exchange'").select("id", "user_id", "token", "ts_s", "units", side.alias("direction")).filter("direction is not null")
    later = F.col("ts_s") + F.when(F.col("id") % 2 == 0, 300).otherwise(-900)
    there = t.filter("chain = 'near'").select("tx_hash", "user_id", "token", "direction", F.col("ts_s").alias("at_s"), F.col("units").alias("got"))
    there = there.unionByName(e.filter("id % 4 < 2").select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("tx_hash"), "user_id", "token", "direction", later.alias("at_s"), F.col("units").alias("got")))
    near = range_join(e, there, ["user_id", "token", "direction"], "ts_s", "at_s", -600, 600).filter(100 * F.abs(F.col("got") - F.col("units")) <= F.col("units"))
    return near.groupBy("id").agg(F.min_by("tx_hash", F.struct("at_s", "tx_hash")).alias("match"))


@query("j14_deleted_accounts", f"""WITH {_MOVES}, g AS (SELECT *, id // 5 AS grp, CASE WHEN id % 5 = 4 AND k % 3 = 0 THEN 'DELETE_ACCOUNT' ELSE 'TRANSFER' END AS act, CASE WHEN id % 5 < 2 THEN 'system' ELSE 'shop.near' END AS party FROM t), d AS (SELECT grp, bool_or(user_id % 2 = 0) AS own FROM g WHERE act = 'DELETE_ACCOUNT' GROUP BY 1)
SELECT g.id, CASE WHEN d.own THEN 'internal' ELSE 'delete_account_received' END AS category FROM g JOIN d USING (grp) WHERE g.act = 'TRANSFER' AND g.party = 'system' AND g.direction = 'in'""")
def j14(spark, sf_dir):
    """What came from the system in a transaction that deleted an account: internal if an own one was deleted. Five movements share a transaction here."""
    i = F.col("id")
    t = movements(spark, sf_dir).withColumns({"grp": F.floor(i / 5), "act": F.when((i % 5 == 4) & (F.col("k") % 3 == 0), "DELETE_ACCOUNT").otherwise("TRANSFER"), "party": F.when(i % 5 < 2, "system").otherwise("shop.near")})
    gone = t.filter("act = 'DELETE_ACCOUNT'").groupBy("grp").agg(F.bool_or(F.col("user_id") % 2 == 0).alias("own"))
    got = t.filter("act = 'TRANSFER' and party = 'system' and direction = 'in'").join(gone, "grp")
    return got.select("id", F.when(F.col("own"), "internal").otherwise("delete_account_received").alias("category"))


@query("j24_wallets_of_users", f"WITH {_MOVES} SELECT id, wallet_id FROM t WHERE wallet_id IN (SELECT wallet_id FROM t WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))")
def j24(spark, sf_dir):
    t = movements(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    wallets = t.join(users, "user_id", "left_semi").select("wallet_id")
    return t.join(wallets, "wallet_id", "left_semi").select("id", "wallet_id")


@query("v11_coverage", f"WITH {_MOVES} SELECT DISTINCT wallet_id, token FROM t WHERE (wallet_id, token) NOT IN (SELECT (wallet_id, token) FROM t WHERE event_type = 'purchase' AND k IS NOT NULL)")
def v11(spark, sf_dir):
    """Tokens of wallets that have no verification."""
    t = movements(spark, sf_dir)
    return t.select("wallet_id", "token").distinct().join(t.filter("event_type = 'purchase' and k is not null").select("wallet_id", "token"), ["wallet_id", "token"], "left_anti")


# -- sinks -------------------------------------------------------------------------------
@query("snk11_upserts", f"""WITH {EXCHANGE}, old AS (SELECT id, tx_type AS v, id % 3 AS version FROM exchange WHERE id % 2 = 0), new AS (SELECT id, exchange AS v, id % 5 AS version FROM exchange WHERE id % 3 = 0)
SELECT id, coalesce(new.v, old.v) AS last_wins, coalesce(old.v, new.v) AS first_wins FROM old FULL JOIN new USING (id)""")
def snk11(spark, sf_dir):
    """A batch over what is there: the new row wins, or what was first stays."""
    e = exchange(spark, sf_dir)
    old, new = e.filter("id % 2 = 0").select("id", F.col("tx_type").alias("v"), (F.col("id") % 3).alias("version")), e.filter("id % 3 = 0").select("id", F.col("exchange").alias("v"), (F.col("id") % 5).alias("version"))
    one = lambda mode, name: upsert(old, new, ["id"], "version", mode=mode).select("id", F.col("v").alias(name))
    return one("last", "last_wins").join(one("first", "first_wins"), "id")


@query("snk13_audit_history", f"WITH {STAGES}, a AS (SELECT user_id, id, ts_s, 'classified' AS action, category AS new_value FROM classified UNION ALL SELECT user_id, id, ts_s + 60, 'confirmed', 'income' FROM t WHERE k % 10 = 0) SELECT user_id, id AS entity_id, action, ts_s AS at_s, json_extract_string('{{\"category\":\"' || new_value || '\"}}', '$.category') AS category FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, id DESC, action) <= 50")
def snk13(spark, sf_dir):
    """An append-only log, written in two batches, and of each user the latest 50 entries (R23)."""
    root = f"{Scratch(spark, 'audit').root}/log"

    def entry(df, action, category):
        value = F.to_json(F.struct(category.alias("category")))
        df.select("user_id", F.col("id").alias("entity_id"), F.lit(action).alias("action"), F.col("at_s"), value.alias("new_value")).write.mode("append").parquet(root)

    entry(all_classified(spark, sf_dir).withColumn("at_s", F.col("ts_s")), "classified", F.col("category"))
    entry(movements(spark, sf_dir).filter("k % 10 = 0").withColumn("at_s", F.col("ts_s") + 60), "confirmed", F.lit("income"))
    last = latest(spark.read.parquet(root), ["user_id"], [F.desc("at_s"), F.desc("entity_id"), F.col("action")], 50)
    return last.select("user_id", "entity_id", "action", "at_s", F.get_json_object("new_value", "$.category").alias("category"))


# -- chains' JSON -------------------------------------------------------------------------
ME = "akash1me"


@query("src18_cosmos_messages", f"""WITH {_MOVES}, m AS (SELECT id, k, units, CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS code, id % 6 AS kind, k % 2 = 0 AS mine FROM t)
SELECT 'h' || id AS tx_hash, CASE WHEN NOT mine THEN CASE WHEN kind = 0 THEN 'in' ELSE 'self' END WHEN kind IN (0, 1, 4) THEN 'out' WHEN kind IN (2, 3) THEN 'in' ELSE 'self' END AS action_type, CASE WHEN kind = 0 AND k % 3 = 0 THEN 'ibc/X' ELSE 'AKT' END AS token_id,
 CASE WHEN kind < 3 THEN k::VARCHAR ELSE '0' END AS amount, CASE WHEN k % 5 = 0 THEN '0' ELSE '250' END AS fee, list_value('MsgSend', 'MsgDelegate', 'MsgUndelegate', 'MsgWithdrawDelegatorReward', 'MsgCreateDeployment', 'MsgVote')[kind + 1] AS tx_type FROM m WHERE code = 0""")
def src18(spark, sf_dir):
    """Transactions of a Cosmos chain: failed ones go, the first message of a known kind speaks."""
    t = movements(spark, sf_dir).withColumns({"kind": F.col("id") % 6, "mine": F.col("k") % 2 == 0})
    k = F.col("kind")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    pair = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    who = F.when(F.col("mine"), F.lit('"Akash1ME"')).otherwise(F.lit('"akash1other"'))
    other = F.when(F.col("mine"), F.lit('"akash1other"')).otherwise(F.lit(f'"{ME}"'))
    coin = F.concat(F.lit('{"denom":"'), F.when(F.col("k") % 3 == 0, "ibc/X").otherwise("uakt"), F.lit('","amount":'), text(F.col("k")), F.lit("}"))
    names = ("/cosmos.bank.v1beta1.MsgSend", "/cosmos.staking.v1beta1.MsgDelegate", "/cosmos.staking.v1beta1.MsgUndelegate", "/cosmos.distribution.v1beta1.MsgWithdrawDelegatorReward", "/akash.deployment.v1beta1.MsgCreateDeployment", "/cosmos.gov.v1beta1.MsgVote")
    kind = pair("@type", text(F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))))
    body = (
        F.when(k == 0, F.concat_ws(",", kind, pair("from_address", who), pair("to_address", other), pair("amount", F.concat(F.lit("["), coin, F.lit("]")))))
        .when(k < 3, F.concat_ws(",", kind, pair("delegator_address", who), pair("amount", coin)))
        .when(k == 3, F.concat_ws(",", kind, pair("delegator_address", who)))
        .when(k == 4, F.concat_ws(",", kind, pair("id", F.concat(F.lit("{"), pair("owner", who), F.lit("}")))))
        .otherwise(kind)
    )
    fee = F.when(F.col("k") % 5 == 0, "").otherwise('{"denom":"uakt","amount":"250"}')
    value = F.concat(
        F.lit('{"txhash":'), text(F.col("tx_hash")), F.lit(',"code":'), F.when(F.col("k") % 7 == 0, "5").otherwise("0"), F.lit(',"tx":{"body":{"messages":[{"@type":"/x.MsgNote"},{'), body, F.lit('}]},"auth_info":{"fee":{"amount":['), fee, F.lit("]}}}}")
    )
    return chains.cosmos_rows(t.select(value.alias("value")), ME).drop("timestamp")


@query("src13_transfers_and_fees", f"""WITH {_MOVES}, f AS (SELECT *, k % 3 = 0 AS sent, k % 3 = 1 AS got FROM t),
x AS (SELECT 'h' || id AS tx_hash, ts_s AS block, CASE WHEN sent THEN 'out' ELSE 'in' END AS direction, '0xother' AS counterparty, CASE WHEN id % 4 = 0 THEN 0.0 WHEN id % 4 = 1 THEN (id * 1000000000000)::DOUBLE / 1e18 ELSE units::DOUBLE END AS amount, CASE WHEN id % 3 = 0 THEN 'ETH' ELSE 'USDC' END AS asset,
 CASE id % 3 WHEN 1 THEN 'FT_TRANSFER' WHEN 2 THEN 'INTERNAL_TRANSFER' ELSE 'TRANSFER' END AS action_type FROM f WHERE sent OR got)
SELECT * FROM x WHERE amount <> 0 OR action_type = 'FT_TRANSFER' UNION ALL SELECT 'h' || id, ts_s, 'out', NULL, 21000.0 * (k * 1000000000 + 7) / 1e18, 'ETH', 'GAS_FEE' FROM f WHERE sent AND id % 5 > 0""")
def src13(spark, sf_dir):
    """Transfers of a wallet on an EVM chain, and the fees of the hashes that it sent."""
    t, i, k = movements(spark, sf_dir), F.col("id"), F.col("k")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))
    me, other, third = F.lit("0xME"), F.lit("0xOther"), F.lit("0xthird")
    raw = F.struct(F.when(i % 4 == 1, hexed(i * 1_000_000_000_000)).alias("value"))
    value = F.when(i % 4 == 0, 0.0).when(i % 4 > 1, F.col("units").cast("double"))
    j = F.to_json(F.struct(
        F.col("tx_hash").alias("hash"), F.when(k % 3 == 0, me).when(k % 3 == 1, other).otherwise(third).alias("from"), F.when(k % 3 == 1, me).otherwise(other).alias("to"), value.alias("value"), F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise("USDC").alias("asset"),
        F.when(i % 3 == 1, "erc20").when(i % 3 == 2, "internal").alias("category"), hexed(F.col("ts_s")).alias("blockNum"), raw.alias("rawContract"),
    ))
    price = hexed(k * 1_000_000_000 + 7)
    r = F.to_json(F.struct(F.col("tx_hash").alias("transactionHash"), hexed(F.lit(21000)).alias("gasUsed"), F.when(i % 2 == 0, price).alias("effectiveGasPrice"), price.alias("gasPrice")))
    return chains.transfer_rows(t.select(j.alias("value")), t.filter("id % 5 > 0").select(r.alias("value")), "0xme").drop("category")


@query("src24_lock_positions", f"""WITH {_MOVES} SELECT tx_hash, 'w' || wallet_id AS account_id, CASE WHEN k % 4 < 2 THEN 'lock' ELSE 'unlock' END AS action, CASE WHEN k % 4 < 2 THEN (k * 1.5)::DOUBLE END AS amount FROM t WHERE id % 3 = 0 AND k % 5 <> 0 AND (k % 4 = 2 OR (k % 4 < 2 AND k > 0))""")
def src24(spark, sf_dir):
    """Calls of a vote contract that lock and unlock."""
    i, k = F.col("id"), F.col("k")
    method = F.element_at(F.array(*map(F.lit, ("claim_and_lock", "bond_mpdao", "claim_unlocked_mpdao", "vote"))), (k % 4 + 1).cast("int"))
    args = F.to_json(F.struct((k * 1_500_000).cast("string").alias("amount")))
    j = F.to_json(F.struct(
        F.col("tx_hash").alias("transaction_hash"), F.when(i % 3 == 0, "mpdao-vote.near").otherwise("shop.near").alias("receiver_account_id"), F.concat(F.lit("w"), F.col("wallet_id").cast("string")).alias("predecessor_account_id"),
        F.struct((k % 5 != 0).alias("status")).alias("outcomes"), F.array(F.struct(method.alias("method"), args.alias("args"))).alias("actions"),
    ))
    return chains.lock_rows(movements(spark, sf_dir).select(j.alias("value"))).withColumn("amount", F.col("amount").cast("double"))
