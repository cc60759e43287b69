"""Duplicates of exchanges and chains, gaps, diagnoses, and where holdings lie."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import table
from ..operators.filters import looks_like_spam
from ..operators.joins import latest
from ..operators.verify import best_matches, diagnose, fee_confidence, month_gaps, staking_confidence, threshold_actions
from .chain import OWN_PARTY, STAGES, movements
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]  # the stand-in movements alone


# -- exchange entries that chains have too -------------------------------------------
def _sides(spark, sf_dir):
    """Entries of exchanges, and transfers on chain; of some entries a second record landed there, k times ten seconds later."""
    t, k = movements(spark, sf_dir), F.col("k")
    entry = t.filter("chain = 'exchange'")
    again = entry.filter(k % 4 == 0).select(
        (F.col("id") + 500_000_000).alias("transfer_id"), "user_id", (F.col("ts_s") + k * 10).alias("transfer_s"), F.when(k % 8 == 0, F.col("token")).otherwise(F.lit("OTHER")).alias("transfer_symbol"),
        F.when(k % 3 == 0, F.col("units") * F.lit(Decimal("1.005"))).otherwise(F.col("units")).cast("decimal(18,5)").alias("transfer_amount"),
    )
    there = t.filter("chain = 'near'").select(F.col("id").alias("transfer_id"), "user_id", F.col("ts_s").alias("transfer_s"), F.col("token").alias("transfer_symbol"), F.col("units").cast("decimal(18,5)").alias("transfer_amount"))
    entries = entry.select(F.col("id").alias("entry_id"), "user_id", "wallet_id", "tx_type", F.col("ts_s").alias("entry_s"), F.col("token").alias("entry_symbol"), F.col("units").cast("decimal(18,5)").alias("entry_amount"))
    return entries, there.unionByName(again)


MATCHES = f"""{_MOVES},
entries AS (SELECT id AS entry_id, user_id, wallet_id, tx_type, ts_s AS entry_s, token AS entry_symbol, units AS entry_amount FROM t WHERE chain = 'exchange'),
transfers AS (SELECT id AS transfer_id, user_id, ts_s AS transfer_s, token AS transfer_symbol, units::DECIMAL(18,5) AS transfer_amount FROM t WHERE chain = 'near'
 UNION ALL SELECT id + 500000000, user_id, ts_s + k * 10, CASE WHEN k % 8 = 0 THEN token ELSE 'OTHER' END, (CASE WHEN k % 3 = 0 THEN units * 1.005 ELSE units END)::DECIMAL(18,5) FROM t WHERE chain = 'exchange' AND k % 4 = 0),
scored AS (SELECT *, CASE WHEN abs(transfer_s - entry_s) <= 600 AND entry_symbol = transfer_symbol THEN 0.85 WHEN abs(transfer_s - entry_s) <= 600 THEN 0.80 WHEN entry_symbol = transfer_symbol AND entry_s // 86400 = transfer_s // 86400 THEN 0.60 END::DOUBLE AS score
 FROM entries JOIN transfers USING (user_id) WHERE CASE WHEN transfer_amount = 0 THEN entry_amount = 0 ELSE 100 * abs(entry_amount - transfer_amount) <= transfer_amount END),
best AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, transfer_s, transfer_id) = 1),
held AS (SELECT wallet_id, token, sum(CASE direction WHEN 'in' THEN units ELSE -units END - fee) AS calculated FROM t GROUP BY 1, 2),
real AS (SELECT wallet_id, token, max_by(k, (ts_s, k)) AS actual FROM t WHERE event_type = 'purchase' AND k IS NOT NULL GROUP BY 1, 2),
judged AS (SELECT b.*, coalesce(calculated, 0) AS calculated, actual, CASE WHEN tx_type IN ('receive', 'deposit', 'buy', 'reward', 'interest', 'staking_reward', 'airdrop', 'mining') THEN coalesce(calculated, 0) - entry_amount WHEN tx_type IN ('send', 'withdrawal', 'sell', 'trade') THEN coalesce(calculated, 0) + entry_amount END AS after
 FROM best b LEFT JOIN held h ON h.wallet_id = b.wallet_id AND h.token = entry_symbol LEFT JOIN real r ON r.wallet_id = b.wallet_id AND r.token = entry_symbol),
acted AS (SELECT *, CASE WHEN score >= 0.75 AND coalesce(abs(after - actual) < abs(calculated - actual), false) THEN 'auto_merged' ELSE 'flagged_for_review' END AS action FROM judged)"""


def _acted(spark, sf_dir):
    entries, transfers = _sides(spark, sf_dir)
    t = movements(spark, sf_dir)
    verified = t.filter("event_type = 'purchase'").select("wallet_id", "token", F.col("ts_s").alias("verified_s"), F.col("k").alias("actual"))
    return threshold_actions(best_matches(entries, transfers), t, verified)


@query("v07_exchange_duplicates", f"WITH {MATCHES} SELECT entry_id, transfer_id, score, CASE score WHEN 0.85 THEN 'amount_time_asset' WHEN 0.80 THEN 'amount_time' ELSE 'amount_day_asset' END AS signal, action, action = 'auto_merged' AS resolved FROM acted")
def v07(spark, sf_dir):
    """The best match of each exchange entry and what is done with it."""
    return _acted(spark, sf_dir).select("entry_id", "transfer_id", "score", "signal", "action", (F.col("action") == "auto_merged").alias("resolved"))


@query("v08_balance_aware_merge", f"WITH {MATCHES} SELECT entry_id, wallet_id, entry_symbol AS token, calculated::DOUBLE AS calculated, after::DOUBLE AS after, actual::DOUBLE AS actual, action = 'auto_merged' AS merge FROM acted WHERE score >= 0.75")
def v08(spark, sf_dir):
    """Sure matches: merged only where the balance of the wallet in that token, less fees, comes nearer to the one on chain."""
    m = _acted(spark, sf_dir).filter("score >= 0.75")
    return m.select("entry_id", "wallet_id", F.col("entry_symbol").alias("token"), *(F.col(c).cast("double").alias(c) for c in ("calculated", "after", "actual")), (F.col("action") == "auto_merged").alias("merge"))


# -- gaps ------------------------------------------------------------------------------
def _wallet_moves(spark, sf_dir):
    """All movements of wallets; the index lacks those of line 7."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).alias("wallet_id"), F.unix_timestamp("l_shipdate").alias("ts_s"), F.when(F.col("l_linestatus") == "O", "in").otherwise("out").alias("direction"),
        F.col("l_quantity").cast("decimal(18,2)").alias("units"), F.col("l_tax").cast("decimal(18,2)").alias("fee"), (F.col("l_linenumber") < 7).alias("indexed"),
    )


@query("v10_gap_detection", """WITH m AS (SELECT l_suppkey * 10 + l_orderkey % 3 AS wallet_id, (epoch_us(l_shipdate) // 1000000)::BIGINT AS ts_s, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END::DECIMAL(18,2) - l_tax::DECIMAL(18,2) AS moved, l_linenumber < 7 AS indexed FROM lineitem),
s AS (SELECT wallet_id, ts_s, sum(moved) FILTER (indexed) AS i, sum(moved) AS a, count(*) FILTER (indexed) AS n FROM m GROUP BY 1, 2),
r AS (SELECT wallet_id, ts_s, n, strftime(make_timestamp(ts_s * 1000000), '%Y-%m') AS month, coalesce(sum(i) OVER w, 0) AS running, sum(a) OVER w AS balance FROM s WINDOW w AS (PARTITION BY wallet_id ORDER BY ts_s)),
c AS (SELECT wallet_id, month, max(ts_s) AS end_s, max_by(running, ts_s) AS running, max_by(balance, ts_s) AS balance FROM r WHERE n > 0 GROUP BY 1, 2),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY month DESC) <= 24),
d AS (SELECT wallet_id, month, lag(end_s) OVER w AS start_s, end_s, running - lag(running) OVER w AS delta_indexed, balance - lag(balance) OVER w AS delta_onchain FROM l WINDOW w AS (PARTITION BY wallet_id ORDER BY month))
SELECT wallet_id, month, start_s, end_s, delta_indexed::DOUBLE AS delta_indexed, delta_onchain::DOUBLE AS delta_onchain, abs(delta_indexed - delta_onchain)::DOUBLE AS gap FROM d WHERE abs(delta_indexed - delta_onchain) > 0.02""")
def v10(spark, sf_dir):
    """Months in which the index lacks movements that the archive knows."""
    moves = _wallet_moves(spark, sf_dir)
    sign = F.when(F.col("direction") == "in", F.col("units")).otherwise(-F.col("units")) - F.col("fee")
    w = Window.partitionBy("wallet_id").orderBy("at_s")
    archived = moves.groupBy("wallet_id", F.col("ts_s").alias("at_s")).agg(F.sum(sign).alias("m")).withColumn("balance", F.sum("m").over(w)).drop("m")
    gaps = month_gaps(moves.filter("indexed"), archived)
    return gaps.select("wallet_id", "month", "start_s", "end_s", *(F.col(c).cast("double").alias(c) for c in ("delta_indexed", "delta_onchain", "gap")))


# -- diagnoses -------------------------------------------------------------------------
SIGNS = f"""{_MOVES},
w AS (SELECT wallet_id, any_value(user_id) AS user_id, sum(CASE direction WHEN 'in' THEN units ELSE -units END) AS expected, max_by(k, (ts_s, id)) AS actual, count(*) FILTER (event_type = 'signup' AND k % 2 = 0) AS rewards, count(DISTINCT CASE WHEN event_type = 'purchase' THEN ts_s // 86400 END) AS epochs,
 coalesce(sum(units * (k % 5)) FILTER (direction = 'out'), 0) AS fees_paid, coalesce(sum(units) FILTER (event_type = 'error'), 0) AS fees_tracked, count(*) FILTER (direction = 'out' AND lower(counterparty) = '{OWN_PARTY}' AND user_id % 2 = 0) AS misclassified FROM t GROUP BY 1),
q AS (SELECT wallet_id, max(gap) AS longest FROM (SELECT wallet_id, ts_s - lag(ts_s) OVER (PARTITION BY wallet_id ORDER BY ts_s) AS gap FROM t WHERE event_type = 'view') GROUP BY 1),
s AS (SELECT w.*, actual - expected AS difference, coalesce(longest, 0) AS longest, CASE WHEN wallet_id % 3 = 0 THEN 'ethereum' ELSE 'near' END AS chain FROM w LEFT JOIN q USING (wallet_id)),
c AS (SELECT *, CASE WHEN epochs > 0 THEN CASE WHEN (epochs - rewards) / epochs * 100 > 20 THEN 0.7 WHEN (epochs - rewards) / epochs * 100 > 10 THEN 0.5 END END AS c1, CASE WHEN fees_paid <> fees_tracked AND difference <> 0 THEN abs(fees_paid - fees_tracked)::DOUBLE / abs(difference)::DOUBLE END AS ratio FROM s),
f AS (SELECT *, CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 0.75 WHEN ratio BETWEEN 0.5 AND 1.5 THEN 0.55 END AS c2 FROM c)"""


def _signs(spark, sf_dir):
    t, k = movements(spark, sf_dir), F.col("k")
    out = F.col("direction") == "out"
    signed = F.when(F.col("direction") == "in", F.col("units")).otherwise(-F.col("units"))
    own = out & (F.lower("counterparty") == OWN_PARTY) & (F.col("user_id") % 2 == 0)
    w = t.groupBy("wallet_id").agg(
        (F.max_by("k", F.struct("ts_s", "id")) - F.sum(signed)).alias("difference"), F.count_if((F.col("event_type") == "signup") & (k % 2 == 0)).alias("rewards"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.floor(F.col("ts_s") / 86400))).alias("epochs"),
        F.sum(F.when(out, F.col("units") * (k % 5))).alias("fees_paid"), F.sum(F.when(F.col("event_type") == "error", F.col("units"))).alias("fees_tracked"), F.count_if(own).alias("misclassified"),
    )
    gap = F.col("ts_s") - F.lag("ts_s").over(Window.partitionBy("wallet_id").orderBy("ts_s"))
    silence = t.filter("event_type = 'view'").withColumn("gap", gap).groupBy("wallet_id").agg(F.max("gap").alias("longest_silence"))
    numbers = {c: F.col(c).cast("double") for c in ("difference", "fees_paid", "fees_tracked")}
    return w.join(silence, "wallet_id", "left").withColumns(numbers | {"chain": F.when(F.col("wallet_id") % 3 == 0, "ethereum").otherwise("near")})


@query("v04_first_diagnosis", f"WITH {SIGNS} SELECT wallet_id, CASE WHEN chain = 'near' AND c1 > 0.5 THEN 'missing_staking_rewards' WHEN c2 > 0.5 THEN 'uncounted_fees' WHEN longest > 604800 THEN 'unindexed_period' WHEN misclassified > 0 THEN 'classification_error' ELSE 'unknown' END AS diagnosis, CASE WHEN chain = 'near' AND c1 > 0.5 THEN c1 WHEN c2 > 0.5 THEN c2 WHEN longest > 604800 THEN 0.6 WHEN misclassified > 0 THEN 0.65 ELSE 0 END::DOUBLE AS confidence FROM f")
def v04(spark, sf_dir):
    """What the difference of each wallet's balances comes from: the first of four explanations that is likelier than not."""
    return diagnose(_signs(spark, sf_dir)).select("wallet_id", "diagnosis", "confidence")


@query("a22_staking_confidence", f"WITH {SIGNS} SELECT wallet_id, rewards, epochs, c1::DOUBLE AS confidence FROM f")
def a22(spark, sf_dir):
    return _signs(spark, sf_dir).select("wallet_id", "rewards", "epochs", staking_confidence(F.col("rewards"), F.col("epochs")).alias("confidence"))


@query("a23_fee_confidence", f"WITH {SIGNS} SELECT wallet_id, fees_paid::DOUBLE AS fees_paid, fees_tracked::DOUBLE AS fees_tracked, c2::DOUBLE AS confidence FROM f")
def a23(spark, sf_dir):
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _signs(spark, sf_dir).select("wallet_id", none("fees_paid").alias("fees_paid"), none("fees_tracked").alias("fees_tracked"), fee_confidence(none("fees_paid"), none("fees_tracked"), none("difference")).alias("confidence"))


@query("a24_misclassified_transfers", f"WITH {SIGNS} SELECT wallet_id, misclassified, CASE WHEN misclassified > 0 THEN 0.65 END::DOUBLE AS confidence FROM f")
def a24(spark, sf_dir):
    """Outgoing transfers to an account of the same user that are not booked as internal."""
    return _signs(spark, sf_dir).select("wallet_id", "misclassified", F.when(F.col("misclassified") > 0, 0.65).alias("confidence"))


@query("v09_open_issues", f"WITH {SIGNS}, o AS (SELECT user_id, chain, wallet_id, difference, CASE WHEN difference IS NULL THEN 'unverified' WHEN abs(difference) <= 50 THEN 'resolved' ELSE 'open' END AS status FROM s) SELECT user_id, wallet_id, chain, difference::DOUBLE AS difference, row_number() OVER (PARTITION BY user_id ORDER BY abs(difference) DESC, wallet_id)::INT AS place FROM o WHERE status = 'open'")
def v09(spark, sf_dir):
    """Open issues of each user, the largest difference first; up to 50 units a wallet counts as resolved here."""
    s = _signs(spark, sf_dir).withColumn("user_id", F.floor(F.col("wallet_id") / 10)).filter(F.abs("difference") > 50)
    w = Window.partitionBy("user_id").orderBy(F.abs("difference").desc(), "wallet_id")
    return s.select("user_id", "wallet_id", "chain", "difference", F.row_number().over(w).alias("place"))


# -- holdings, symbols --------------------------------------------------------------------
EXCHANGES = ("coinbase", "kraken", "cryptocom")


@query("j16_holding_source", f"WITH {_MOVES}, s AS (SELECT user_id, token, max_by(list_value('coinbase', 'kraken', 'cryptocom')[(id % 3 + k % 2) % 3 + 1], (ts_s, id)) AS source FROM t WHERE chain = 'exchange' GROUP BY 1, 2) SELECT DISTINCT t.user_id, t.token, coalesce(source, 'self_custody') AS source FROM t LEFT JOIN s USING (user_id, token)")
def j16(spark, sf_dir):
    """The exchange of the latest entry of each token that a user holds, whatever its type; without one the user keeps it."""
    t = movements(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, EXCHANGES)), ((F.col("id") % 3 + F.col("k") % 2) % 3 + 1).cast("int"))
    last = latest(t.filter("chain = 'exchange'"), ["user_id", "token"], [F.desc("ts_s"), F.desc("id")]).select("user_id", "token", name.alias("source"))
    return t.select("user_id", "token").distinct().join(last, ["user_id", "token"], "left").withColumn("source", F.coalesce("source", F.lit("self_custody")))


_SYMBOL = "regexp_replace(url, '^[a-z]+://', '')"


@query("f07_spam_symbols", f"SELECT page_id, {_SYMBOL} AS symbol FROM pages WHERE " + " OR ".join(f"lower({_SYMBOL}) LIKE '{p}'" for p in ("%http%", "%visit%", "%claim%", "%.com%", "%.org%")))
def f07(spark, sf_dir):
    """Names that look like spam; addresses without their scheme stand in for tokens' names."""
    symbol = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", symbol.alias("symbol")).filter(looks_like_spam(F.col("symbol")))
