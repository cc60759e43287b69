"""Categories, prices, journals and checks of balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import EXCHANGE, LEDGER, ONCHAIN, exchange, ledger, onchain
from .costbasis import FOLD, disposals, money
from .domain import CALLS, calls
from .registry import query

# -- categories ---------------------------------------------------------------
OWN = ("bob.near",)  # accounts that the stand-in data calls owned


@query("c15_ordered_categorizer", f"""WITH {CALLS}, t AS (SELECT *, coalesce(counterparty IN ('bob.near'), false) AS own FROM calls)
SELECT id, CASE WHEN own THEN 'internal' WHEN length(counterparty) = 64 AND regexp_matches(counterparty, '^[0-9a-f]') THEN 'internal'
 WHEN action_type = 'TRANSFER' AND direction = 'in' AND counterparty LIKE '%.cdao.near' THEN 'dao_withdrawal'
 WHEN counterparty = 'wrap.near' AND direction = 'out' AND coalesce(method_name, 'near_deposit') = 'near_deposit' AND amount > 0 THEN 'defi_deposit'
 WHEN counterparty = 'meta-pool.near' AND direction = 'out' AND amount > 0 THEN 'staking_deposit' WHEN counterparty LIKE '%.pool%' AND direction = 'out' AND amount > 0 THEN 'staking_deposit'
 WHEN counterparty LIKE '%.pool%' AND direction = 'in' AND action_type = 'TRANSFER' AND amount > 0 THEN 'unstake_return' WHEN counterparty LIKE '%ref%finance%' AND amount > 0 THEN 'swap'
 WHEN counterparty LIKE '%burrow%' AND amount > 0 THEN CASE WHEN direction = 'out' THEN 'defi_deposit' ELSE 'defi_withdrawal' END
 WHEN direction = 'out' AND amount = 0 AND (counterparty LIKE '%burrow%' OR counterparty LIKE '%ref%' OR counterparty IN ('wrap.near', 'meta-pool.near')) THEN 'non_taxable'
 WHEN counterparty = 'system' AND direction = 'in' AND action_type = 'TRANSFER' THEN 'fee_refund' WHEN action_type IN ('ADD_KEY', 'DELETE_KEY', 'DEPLOY_CONTRACT') THEN 'non_taxable' END AS category FROM t""")
def c15(spark, sf_dir):
    """The ladder of updates: own accounts and implicit ones overwrite, every later step fills what is still open.

    Accounts deleted in the same transaction don't occur in the stand-in data."""
    party, out, into, some = F.col("counterparty"), F.col("direction") == "out", F.col("direction") == "in", F.col("amount") > 0
    transfer = F.col("action_type") == "TRANSFER"
    defi = party.like("%burrow%") | party.like("%ref%") | party.isin("wrap.near", "meta-pool.near")
    steps = [
        (party.isin(*OWN), "internal"),
        ((F.length(party) == 64) & party.rlike("^[0-9a-f]"), "internal"),
        (transfer & into & party.like("%.cdao.near"), "dao_withdrawal"),
        ((party == "wrap.near") & out & (F.coalesce("method_name", F.lit("near_deposit")) == "near_deposit") & some, "defi_deposit"),
        ((party == "meta-pool.near") & out & some, "staking_deposit"),
        (party.like("%.pool%") & out & some, "staking_deposit"),
        (party.like("%.pool%") & into & transfer & some, "unstake_return"),
        (party.like("%ref%finance%") & some, "swap"),
        (party.like("%burrow%") & out & some, "defi_deposit"),
        (party.like("%burrow%") & into & some, "defi_withdrawal"),
        (out & defi & (F.col("amount") == 0), "non_taxable"),
        ((party == "system") & into & transfer, "fee_refund"),
        (F.col("action_type").isin("ADD_KEY", "DELETE_KEY", "DEPLOY_CONTRACT"), "non_taxable"),
    ]
    return calls(spark, sf_dir).select("id", F.coalesce(*(F.when(test, name) for test, name in steps)).alias("category"))


@query("c16_suggest_category", f"""WITH {CALLS}, t AS (SELECT id, direction = 'out' AS out, lower(coalesce(method_name, '')) AS m, lower(coalesce(counterparty, '')) AS p FROM calls)
SELECT id, CASE WHEN contains(p, 'pool') OR m IN ('stake', 'unstake', 'deposit_and_stake', 'withdraw_all') THEN if(out, 'staking_deposit', 'unstake_return') WHEN contains(p, 'ref') OR contains(m, 'swap') THEN 'swap'
 WHEN contains(p, 'burrow') OR contains(p, 'wrap.near') THEN if(out, 'defi_deposit', 'defi_withdrawal') WHEN contains(p, '.cdao.') OR contains(p, 'sputnikdao') THEN 'dao_operation'
 WHEN contains(m, 'nft') OR contains(m, 'mint') THEN 'nft_operation' WHEN starts_with(m, 'ft_') THEN 'token_operation' WHEN p = 'system' THEN 'fee_refund' WHEN starts_with(m, 'get_') OR starts_with(m, 'is_') THEN 'non_taxable' ELSE 'NEEDS_REVIEW' END AS suggestion FROM t""")
def c16(spark, sf_dir):
    method, party = F.lower(F.coalesce("method_name", F.lit(""))), F.lower(F.coalesce("counterparty", F.lit("")))
    side = lambda a, b: F.when(F.col("direction") == "out", a).otherwise(b)
    guess = (
        F.when(party.contains("pool") | method.isin("stake", "unstake", "deposit_and_stake", "withdraw_all"), side("staking_deposit", "unstake_return"))
        .when(party.contains("ref") | method.contains("swap"), "swap")
        .when(party.contains("burrow") | party.contains("wrap.near"), side("defi_deposit", "defi_withdrawal"))
        .when(party.contains(".cdao.") | party.contains("sputnikdao"), "dao_operation")
        .when(method.contains("nft") | method.contains("mint"), "nft_operation")
        .when(method.startswith("ft_"), "token_operation")
        .when(F.col("counterparty") == "system", "fee_refund")
        .when(method.startswith("get_") | method.startswith("is_"), "non_taxable")
        .otherwise("NEEDS_REVIEW")
    )
    return calls(spark, sf_dir).select("id", guess.alias("suggestion"))


REVIEW_BELOW, FALLBACK_BELOW, FALLBACK = 0.90, 0.70, ("unknown", 0.30)


@query("c07_confidence_policy", f"WITH {EXCHANGE}, t AS (SELECT id, tx_type, (id % 100) / 100 AS c FROM exchange) SELECT id, CASE WHEN c < 0.3 THEN 'unknown' ELSE tx_type END AS category, greatest(c, 0.3)::DOUBLE AS confidence, c < 0.7 AS asked, c < 0.9 AS needs_review FROM t")
def c07(spark, sf_dir):
    """Below 0.70 a fallback is asked, here the constant one; the surer of the two stays, and below 0.90 it needs a review."""
    c = (F.col("id") % 100) / 100
    asked = c < FALLBACK_BELOW
    wins = asked & (F.lit(FALLBACK[1]) > c)
    sure = F.when(wins, FALLBACK[1]).otherwise(c)
    return exchange(spark, sf_dir).select("id", F.when(wins, FALLBACK[0]).otherwise(F.col("tx_type")).alias("category"), sure.alias("confidence"), asked.alias("asked"), (sure < REVIEW_BELOW).alias("needs_review"))


@query("c10_internal_transfer", f"""WITH {LEDGER}, w AS (SELECT DISTINCT user_id, wallet_id FROM ledger), t AS (SELECT a, b, c, user_id, wallet_id AS src, user_id * 10 + c % 5 AS dst FROM ledger WHERE direction = 'out')
SELECT a, b, c, src, dst, src <> dst AND EXISTS (SELECT 1 FROM w WHERE w.user_id = t.user_id AND w.wallet_id = t.dst) AS internal FROM t""")
def c10(spark, sf_dir):
    """A transfer is internal if both ends are two wallets of its user; wallets are joined by key, however many a user has."""
    t = ledger(spark, sf_dir)
    owned = t.select("user_id", F.col("wallet_id").alias("dst"), F.lit(True).alias("known")).distinct()
    sent = t.filter("direction = 'out'").select("a", "b", "c", "user_id", F.col("wallet_id").alias("src"), (F.col("user_id") * 10 + F.col("c") % 5).alias("dst"))
    return sent.join(owned, ["user_id", "dst"], "left").select("a", "b", "c", "src", "dst", ((F.col("src") != F.col("dst")) & F.coalesce("known", F.lit(False))).alias("internal"))


@query("f06_skipped_methods", f"WITH {CALLS} SELECT id, method_name FROM calls WHERE coalesce(method_name, '') NOT IN ('ping', 'vote', 'storage_deposit')")
def f06(spark, sf_dir):
    return calls(spark, sf_dir).filter(~F.coalesce("method_name", F.lit("")).isin("ping", "vote", "storage_deposit")).select("id", "method_name")


# -- warnings -----------------------------------------------------------------
WARNINGS = f"""{CALLS}, s AS (SELECT id, category, method, amount, CASE WHEN id % 4 > 0 THEN amount * 2 END AS cost FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'airdrop' END AS category, CASE WHEN id % 6 = 0 THEN 'nft_mint' ELSE method_name END AS method, action_type, CASE WHEN id % 7 = 0 THEN 0.00005 WHEN id % 5 = 0 THEN 0 ELSE amount END AS amount FROM calls)),
p AS (SELECT s.id, CASE WHEN s.amount > 0 AND cost IS NULL THEN 'no_price_data' WHEN s.amount > 0 AND s.amount < 0.0001 THEN 'spam_token' WHEN category = 'airdrop' AND cost IS NULL THEN 'airdrop_unvalued'
 WHEN c.action_type = 'FUNCTION_CALL' AND contains(lower(method), 'nft') AND cost IS NULL THEN 'manual_required' END AS warning FROM s JOIN calls c USING (id))"""


def warned(spark, sf_dir):
    """Every movement with its warning, if any; amounts, costs and methods of some rows are changed so that each kind occurs."""
    i = F.col("id")
    t = calls(spark, sf_dir).withColumns({"amount": F.when(i % 7 == 0, 0.00005).when(i % 5 == 0, 0.0).otherwise(F.col("amount")), "method_name": F.when(i % 6 == 0, "nft_mint").otherwise(F.col("method_name")), "category": F.when(i % 9 == 0, "airdrop")})
    t = t.withColumn("cost", F.when(i % 4 > 0, F.col("amount") * 2))
    some, unpriced = F.col("amount") > 0, F.col("cost").isNull()
    nft = (F.col("action_type") == "FUNCTION_CALL") & F.lower("method_name").contains("nft")
    warning = F.when(some & unpriced, "no_price_data").when(some & (F.col("amount") < 0.0001), "spam_token").when((F.col("category") == "airdrop") & unpriced, "airdrop_unvalued").when(nft & unpriced, "manual_required")
    return t.select("id", warning.alias("warning"))


@query("c18_price_warnings", f"WITH {WARNINGS} SELECT id, warning FROM p")
def c18(spark, sf_dir):
    return warned(spark, sf_dir)


@query("a29_warning_summary", f"WITH {WARNINGS} SELECT warning, count(*) AS n, count(*) FILTER (id % 3 = 0) AS resolved, count(*) FILTER (id % 3 > 0) AS pending FROM p WHERE warning IS NOT NULL GROUP BY 1")
def a29(spark, sf_dir):
    return warned(spark, sf_dir).filter("warning is not null").groupBy("warning").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("resolved"), F.count_if(F.col("id") % 3 > 0).alias("pending"))


# -- prices -------------------------------------------------------------------
# Coins worth one dollar, symbols without a price, and the coin names of the symbols that occur here.
STABLE = ("tether", "usd-coin", "dai")
UNPRICED = ("CAD", "USD", "EUR", "GBP", "AUD", "JPY", "UNKNOWN")
COINS = {"NEAR": "near", "ETH": "ethereum", "BTC": "bitcoin", "USDT": "tether", "USDC": "usd-coin", "DAI": "dai", "WNEAR": "near", "WETH": "ethereum"}
SYMBOLS = ("NEAR", "ETH", "USDT", "CAD", "WNEAR", "UNKNOWN", "FOO")


def coin_id(symbol):
    """The price source's name of a symbol; null where there is none to ask for."""
    known = F.create_map(*(F.lit(x) for kv in COINS.items() for x in kv))
    return F.when(~symbol.isin(*UNPRICED), F.coalesce(F.try_element_at(known, symbol), F.lower(symbol)))


def _symbol(id_):
    return F.element_at(F.array(*map(F.lit, SYMBOLS)), (id_ % len(SYMBOLS) + 1).cast("int"))


_COIN = "CASE WHEN s IN ('CAD', 'UNKNOWN') THEN NULL WHEN s IN ('NEAR', 'WNEAR') THEN 'near' WHEN s = 'ETH' THEN 'ethereum' WHEN s = 'USDT' THEN 'tether' ELSE lower(s) END"
_SYM = "list_value('NEAR', 'ETH', 'USDT', 'CAD', 'WNEAR', 'UNKNOWN', 'FOO')[(id % 7 + 1)::INT]"


@query("prc03_coin_ids", f"WITH {ONCHAIN}, t AS (SELECT id, {_SYM} AS s FROM onchain), c AS (SELECT id, s AS symbol, {_COIN} AS coin FROM t) SELECT id, symbol, coin, CASE WHEN coin = 'tether' THEN 1.0 END::DOUBLE AS fixed_usd FROM c")
def prc03(spark, sf_dir):
    """PRC02 and PRC03: coin names, and the fixed price of coins worth a dollar."""
    t = onchain(spark, sf_dir).select("id", _symbol(F.col("id")).alias("symbol")).withColumn("coin", coin_id(F.col("symbol")))
    return t.withColumn("fixed_usd", F.when(F.col("coin").isin(*STABLE), 1.0))


def daily_cad(prices, rates):
    """Price in CAD of each coin and day (coin, day, usd) by the day's rate (day, rate); always an estimate, null without a rate."""
    return prices.join(rates, "day", "left").select("coin", "day", (F.col("usd") * F.col("rate")).alias("cad"), F.lit(True).alias("estimated"))


DAILY = f"""{ONCHAIN}, {EXCHANGE}, px AS (SELECT CASE WHEN symbol = 'NEAR' THEN 'near' ELSE 'ethereum' END AS coin, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, (sum(round(value * 100)::BIGINT) / count(*)) / 100 AS usd FROM onchain WHERE event_type = 'click' GROUP BY 1, 2),
fx AS (SELECT day, 1.2 + (day % 20) / 100 AS rate FROM (SELECT DISTINCT day FROM px) WHERE day % 5 > 0), dc AS (SELECT coin, day, usd * rate AS cad FROM px LEFT JOIN fx USING (day))"""


def _daily(spark, sf_dir):
    day = F.unix_date(F.to_date("ts"))
    clicks = onchain(spark, sf_dir).filter("event_type = 'click'").select(coin_id(F.col("symbol")).alias("coin"), day.alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    prices = clicks.groupBy("coin", "day").agg((F.sum("cents") / F.count("*") / 100).alias("usd"))
    rates = prices.select("day").distinct().filter("day % 5 > 0").withColumn("rate", F.lit(1.2).cast("double") + (F.col("day") % 20) / F.lit(100.0))
    return daily_cad(prices, rates)


@query("prc04_daily_cad", f"WITH {DAILY} SELECT coin, day, round(cad::DOUBLE, 4) AS cad, true AS estimated FROM dc")
def prc04(spark, sf_dir):
    """J19 and PRC04."""
    return _daily(spark, sf_dir).withColumn("cad", F.round("cad", 4))


# -- journals -----------------------------------------------------------------
# Account numbers and names.
CASH, ASSETS, GAINS, INCOME = "1000", "1500", "4100", "4200"
NAMES = {CASH: "Cash / Proceeds", GAINS: "Capital Gains", INCOME: "Crypto Income"}


def journal(spark, sf_dir):
    """Three lines a disposal (net proceeds, cost of what left, gain or loss) and two an income; amounts in cents."""
    cents = lambda c: F.round(F.col(c).cast("decimal(38,8)") * 100).cast("long")
    line = lambda n, account, side, x: F.struct(F.lit(n).alias("line"), F.lit(account).alias("account"), side.alias("side"), x.alias("cents"))
    d = disposals(spark, sf_dir).select("user_id", "token", "ts", "a", "b", "c", "cost_used", "gain").withColumns({"acb": cents("cost_used"), "won": cents("gain")}).withColumn("proceeds", F.col("acb") + F.col("won"))
    of_gain = F.when(F.col("won") >= 0, "credit").otherwise("debit")
    three = F.array(line(1, CASH, F.lit("debit"), F.col("proceeds")), line(2, ASSETS, F.lit("credit"), F.col("acb")), line(3, GAINS, of_gain, F.abs("won")))
    i = ledger(spark, sf_dir).filter("category in ('income', 'reward')").withColumn("fmv", cents("value"))
    two = F.array(line(1, ASSETS, F.lit("debit"), F.col("fmv")), line(2, INCOME, F.lit("credit"), F.col("fmv")))
    key = ["user_id", "token", "ts", "a", "b", "c"]
    return d.select(F.lit("disposal").alias("event"), *key, F.inline(three)).unionByName(i.select(F.lit("income").alias("event"), *key, F.inline(two)))


JOURNAL = f"""{FOLD}, dj AS (SELECT user_id, token, ts, a, b, c, ((2 * used + 1000000) // 2000000)::BIGINT AS acb, (sign(gain) * ((2 * abs(gain) + 1000000) // 2000000))::BIGINT AS won FROM g WHERE kind = 'dispose'),
ij AS (SELECT user_id, token, ts, a, b, c, (value * 100)::BIGINT AS fmv FROM ledger WHERE category IN ('income', 'reward')),
jl AS (SELECT 'disposal' AS event, user_id, token, ts, a, b, c, 1 AS line, '1000' AS account, 'debit' AS side, acb + won AS cents FROM dj UNION ALL SELECT 'disposal', user_id, token, ts, a, b, c, 2, '1500', 'credit', acb FROM dj
 UNION ALL SELECT 'disposal', user_id, token, ts, a, b, c, 3, '4100', if(won >= 0, 'credit', 'debit'), abs(won) FROM dj UNION ALL SELECT 'income', user_id, token, ts, a, b, c, 1, '1500', 'debit', fmv FROM ij UNION ALL SELECT 'income', user_id, token, ts, a, b, c, 2, '4200', 'credit', fmv FROM ij)"""
_AMOUNTS = "CASE WHEN side = 'debit' THEN (cents / 100)::DOUBLE END AS debit, CASE WHEN side = 'credit' THEN (cents / 100)::DOUBLE END AS credit"


def _amounts():
    return [F.when(F.col("side") == s, F.col("cents") / 100).alias(s) for s in ("debit", "credit")]


@query("snk05_xero_journal", f"""WITH RECURSIVE {JOURNAL} SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, token || CASE WHEN event = 'income' THEN ' Income' WHEN line < 3 THEN ' Disposal' WHEN side = 'credit' THEN ' Capital Gain' ELSE ' Capital Loss' END AS description,
 a || '-' || b || '-' || c AS reference, {_AMOUNTS}, account AS account_code, 'GST Free' AS tax_rate FROM jl""")
def snk05(spark, sf_dir):
    what = F.when(F.col("event") == "income", " Income").when(F.col("line") < 3, " Disposal").when(F.col("side") == "credit", " Capital Gain").otherwise(" Capital Loss")
    return journal(spark, sf_dir).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat("token", what).alias("description"), F.concat_ws("-", "a", "b", "c").alias("reference"), *_amounts(), F.col("account").alias("account_code"), F.lit("GST Free").alias("tax_rate"))


@query("snk06_sage_journal", f"""WITH RECURSIVE {JOURNAL} SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, a || '-' || b || '-' || c AS source, CASE WHEN event = 'income' THEN 'income: ' ELSE 'Disposal of ' END || token AS comment, account AS account_number, {_AMOUNTS} FROM jl""")
def snk06(spark, sf_dir):
    comment = F.concat(F.when(F.col("event") == "income", "income: ").otherwise("Disposal of "), "token")
    return journal(spark, sf_dir).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat_ws("-", "a", "b", "c").alias("source"), comment.alias("comment"), F.col("account").alias("account_number"), *_amounts())


@query("snk07_double_entry", f"""WITH RECURSIVE {JOURNAL} SELECT user_id, event, count(*) AS lines, count(*) FILTER (account = '4100' AND side = 'debit') AS losses, (sum(CASE WHEN side = 'debit' THEN cents ELSE 0 END) / 100)::DOUBLE AS debit,
 (sum(CASE WHEN side = 'credit' THEN cents ELSE 0 END) / 100)::DOUBLE AS credit FROM jl GROUP BY 1, 2""")
def snk07(spark, sf_dir):
    """Debits and credits of each user's disposals and income, from the pools' own costs."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("cents")).otherwise(0)) / 100
    loss = (F.col("account") == GAINS) & (F.col("side") == "debit")
    return journal(spark, sf_dir).groupBy("user_id", "event").agg(F.count("*").alias("lines"), F.count_if(loss).alias("losses"), side("debit").alias("debit"), side("credit").alias("credit"))


# -- balances -----------------------------------------------------------------
@query("v02_expected_units", f"WITH RECURSIVE {FOLD} SELECT user_id, token, (max_by(su, rn) / 1e8)::DOUBLE AS expected FROM g GROUP BY 1, 2")
def v02(spark, sf_dir):
    from .costbasis import KEYS, ORDER, snapshots

    return snapshots(spark, sf_dir).groupBy(*KEYS).agg(money(F.max_by("units_after", F.struct(*ORDER))).alias("expected"))


@query("v03_manual_balance", f"WITH {ONCHAIN} SELECT user_id, chain, max_by(k, (ts_s, id)) AS balance, max(ts_s) AS at_s FROM onchain WHERE k IS NOT NULL AND id % 3 <> 1 GROUP BY 1, 2")
def v03(spark, sf_dir):
    """The latest entry that is not null, by wallet."""
    known = onchain(spark, sf_dir).filter("k is not null and id % 3 <> 1")
    return known.groupBy("user_id", "chain").agg(F.max_by("k", F.struct("ts_s", "id")).alias("balance"), F.max("ts_s").alias("at_s"))


@query("v12_reindex_cap", f"WITH {EXCHANGE}, d AS (SELECT max(ts::DATE) AS today FROM exchange) SELECT user_id, count(*) FILTER (ts::DATE >= today) AS today_n, count(*) FILTER (ts::DATE >= today) < 3 AS may_queue FROM exchange, d WHERE tx_type = 'deposit' GROUP BY 1")
def v12(spark, sf_dir):
    """Jobs of the last day in the data, at most three a wallet; the day is a table of one row."""
    e = exchange(spark, sf_dir)
    today = e.agg(F.max(F.to_date("ts")).alias("today"))
    n = F.count_if(F.to_date("ts") >= F.col("today"))
    return e.filter("tx_type = 'deposit'").join(F.broadcast(today)).groupBy("user_id").agg(n.alias("today_n"), (n < 3).alias("may_queue"))


@query("j23_journal_reference", f"WITH {LEDGER}, {EXCHANGE} SELECT l.a, l.b, l.c, coalesce(CASE WHEN l.b % 2 = 0 THEN 'tx' || l.a END, e.exchange || e.id, l.a || '-' || l.b) AS ref FROM ledger l LEFT JOIN exchange e ON e.id = l.a AND e.tx_type = 'sell' WHERE l.kind = 'dispose'")
def j23(spark, sf_dir):
    """A disposal's reference: its transaction, else the exchange's entry, else its own key."""
    sold = exchange(spark, sf_dir).filter("tx_type = 'sell'").select(F.col("id").alias("a"), F.concat("exchange", F.col("id").cast("string")).alias("entry"))
    hashed = F.when(F.col("b") % 2 == 0, F.concat(F.lit("tx"), F.col("a").cast("string")))
    return ledger(spark, sf_dir).filter("kind = 'dispose'").join(sold, "a", "left").select("a", "b", "c", F.coalesce(hashed, "entry", F.concat_ws("-", "a", "b")).alias("ref"))


@query("a17_staking_stats", f"WITH {LEDGER} SELECT user_id, " + ", ".join(f"sum(CASE WHEN category = '{c}' THEN units ELSE 0 END)::DOUBLE AS {c}_units, count(*) FILTER (category = '{c}') AS {c}_count" for c in ("reward", "stake", "unstake")) + " FROM ledger WHERE category IN ('stake', 'unstake', 'reward') GROUP BY 1")
def a17(spark, sf_dir):
    found = [x for c in ("reward", "stake", "unstake") for x in (F.sum(F.when(F.col("category") == c, F.col("units")).otherwise(0)).cast("double").alias(f"{c}_units"), F.count_if(F.col("category") == c).alias(f"{c}_count"))]
    return ledger(spark, sf_dir).filter("category in ('stake', 'unstake', 'reward')").groupBy("user_id").agg(*found)


@query("snk09_staleness", f"""WITH {EXCHANGE}, f AS (SELECT user_id, (epoch_us(max(ts)) // 1000000)::BIGINT AS last_s, count(*) AS n FROM exchange GROUP BY 1), o AS (SELECT user_id, (epoch_us(max(ts)) // 1000000)::BIGINT AS last_s, count(*) AS n FROM exchange WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT f.user_id, f.last_s IS DISTINCT FROM o.last_s AS last_changed, f.n IS DISTINCT FROM o.n AS count_changed, CASE WHEN o.user_id IS NOT NULL THEN f.last_s IS DISTINCT FROM o.last_s OR f.n IS DISTINCT FROM o.n END AS stale FROM f LEFT JOIN o USING (user_id)""")
def snk09(spark, sf_dir):
    """The figures a report was made from against those of now; null without a report."""
    figures = lambda t: t.groupBy("user_id").agg(F.max("ts_s").alias("last_s"), F.count("*").alias("n"))
    e = exchange(spark, sf_dir)
    old = figures(e.filter("ts < timestamp '1998-01-01'")).select("user_id", F.col("last_s").alias("old_s"), F.col("n").alias("old_n"), F.lit(True).alias("made"))
    both = figures(e).join(old, "user_id", "left").withColumns({"last_changed": ~F.col("last_s").eqNullSafe(F.col("old_s")), "count_changed": ~F.col("n").eqNullSafe(F.col("old_n"))})
    return both.select("user_id", "last_changed", "count_changed", F.when(F.col("made"), F.col("last_changed") | F.col("count_changed")).alias("stale"))
