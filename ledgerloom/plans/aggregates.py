"""Aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import EXCHANGE, LEDGER, ONCHAIN, exchange, ledger, onchain, table
from ..operators.joins import latest, window_sum
from .registry import query

d = lambda c, n=2: F.round((F.col(c) if isinstance(c, str) else c).cast("double"), n)
when = lambda test, c: F.sum(F.when(test, c).otherwise(0))


@query("a01_signed_balance", f"WITH {LEDGER} SELECT wallet_id, token, round((sum(CASE WHEN direction = 'in' THEN units ELSE 0 END) - sum(CASE WHEN direction = 'out' THEN units ELSE 0 END) - sum(CASE WHEN direction = 'out' THEN fee ELSE 0 END))::DOUBLE, 4) AS balance FROM ledger GROUP BY 1, 2")
def a01(spark, sf_dir):
    into, out = F.col("direction") == "in", F.col("direction") == "out"
    return ledger(spark, sf_dir).groupBy("wallet_id", "token").agg(d(when(into, F.col("units")) - when(out, F.col("units")) - when(out, F.col("fee")), 4).alias("balance"))


@query("a04_income_grouping_sets", f"WITH {LEDGER} SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, category AS source, token, count(*) AS n, sum(value)::DOUBLE AS income FROM ledger WHERE category IN ('income', 'reward', 'interest') GROUP BY GROUPING SETS ((1, 2, 3), (2), (1), ())")
def a04(spark, sf_dir):
    spark_view = ledger(spark, sf_dir).filter(F.col("category").isin("income", "reward", "interest")).select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("category").alias("source"), "token", "value")
    return spark.sql("SELECT month, source, token, count(*) AS n, CAST(sum(value) AS DOUBLE) AS income FROM {t} GROUP BY GROUPING SETS ((month, source, token), (source), (month), ())", t=spark_view)


@query("a05_peak_cost", f"WITH {LEDGER} SELECT user_id, token, max(value)::DOUBLE AS peak FROM ledger WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def a05(spark, sf_dir):
    year = (F.col("ts") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("ts") < F.lit("1998-01-01").cast("timestamp"))
    return ledger(spark, sf_dir).filter(year).groupBy("user_id", "token").agg(F.max("value").cast("double").alias("peak"))


@query("a06_foreign_property_threshold", f"WITH {LEDGER}, p AS (SELECT user_id, token, max(value) AS peak FROM ledger GROUP BY 1, 2) SELECT user_id, sum(peak)::DOUBLE AS total, sum(peak) > 100000 AS required FROM p GROUP BY 1")
def a06(spark, sf_dir):
    peak = ledger(spark, sf_dir).groupBy("user_id", "token").agg(F.max("value").alias("peak"))
    return peak.groupBy("user_id").agg(F.sum("peak").cast("double").alias("total"), (F.sum("peak") > 100000).alias("required"))


@query("a07_business_income", f"""WITH {LEDGER} SELECT user_id, sum(CASE WHEN category IN ('income', 'reward', 'airdrop') THEN value ELSE 0 END)::DOUBLE AS income, sum(CASE WHEN kind = 'dispose' THEN value ELSE 0 END)::DOUBLE AS proceeds, sum(CASE WHEN category = 'fee' THEN fee ELSE 0 END)::DOUBLE AS fees,
 sum(CASE WHEN category = 'deposit' THEN value END)::DOUBLE AS fiat_deposit, sum(CASE WHEN category = 'withdrawal' THEN value END)::DOUBLE AS fiat_withdrawal FROM ledger GROUP BY 1""")
def a07(spark, sf_dir):
    t = ledger(spark, sf_dir)
    sums = t.groupBy("user_id").agg(when(F.col("category").isin("income", "reward", "airdrop"), F.col("value")).cast("double").alias("income"), when(F.col("kind") == "dispose", F.col("value")).cast("double").alias("proceeds"), when(F.col("category") == "fee", F.col("fee")).cast("double").alias("fees"))
    flow = t.groupBy("user_id").pivot("category", ["deposit", "withdrawal"]).agg(F.sum("value").cast("double"))
    return sums.join(flow.withColumnsRenamed({"deposit": "fiat_deposit", "withdrawal": "fiat_withdrawal"}), "user_id", "left")


@query("a08_acquisitions", f"WITH {LEDGER} SELECT token, sum(units)::DOUBLE AS units, sum(value + fee)::DOUBLE AS cost FROM ledger WHERE kind = 'acquire' AND year(ts) = 1997 GROUP BY 1")
def a08(spark, sf_dir):
    return ledger(spark, sf_dir).filter((F.col("kind") == "acquire") & (F.year("ts") == 1997)).groupBy("token").agg(F.sum("units").cast("double").alias("units"), F.sum(F.col("value") + F.col("fee")).cast("double").alias("cost"))


@query("a10_flagged_gate", f"WITH {EXCHANGE} SELECT user_id, count(*) FILTER (priority = '1-URGENT') AS flagged, count(*) FILTER (tx_type = 'deposit') AS open, count(*) FILTER (priority = '1-URGENT') + count(*) FILTER (tx_type = 'deposit') > 0 AS blocked FROM exchange GROUP BY 1")
def a10(spark, sf_dir):
    flagged, open_ = F.count_if(F.col("priority") == "1-URGENT"), F.count_if(F.col("tx_type") == "deposit")
    return exchange(spark, sf_dir).groupBy("user_id").agg(flagged.alias("flagged"), open_.alias("open"), (flagged + open_ > 0).alias("blocked"))


@query("a11_duplicate_groups", f"WITH {LEDGER} SELECT a, b, count(*) AS n, min(c) AS keep, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM ledger GROUP BY a, b HAVING count(*) > 1")
def a11(spark, sf_dir):
    g = ledger(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("c").alias("keep"), F.sort_array(F.collect_list("c")).alias("ids")).filter("n > 1")
    return g.select("a", "b", "n", "keep", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("a12_parent_count_invariant", "SELECT o.o_orderkey, count(l.l_orderkey) AS parents FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 GROUP BY 1 HAVING count(l.l_orderkey) <> 1")
def a12(spark, sf_dir):
    parents = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.count("*").alias("p"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(parents, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("o_orderkey").agg(F.sum(F.coalesce("p", F.lit(0))).alias("parents")).filter("parents <> 1")


@query("a13_swap_leg_balance", f"WITH {LEDGER} SELECT a, count(*) FILTER (kind = 'dispose') AS sells, count(*) FILTER (kind = 'acquire') AS buys FROM ledger GROUP BY a HAVING count(*) FILTER (kind = 'dispose') = 0 OR count(*) FILTER (kind = 'acquire') = 0")
def a13(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("a").agg(F.count_if(F.col("kind") == "dispose").alias("sells"), F.count_if(F.col("kind") == "acquire").alias("buys")).filter("sells = 0 or buys = 0")


@query("a14_wallet_discovery", f"WITH {LEDGER} SELECT user_id, counterparty, count(*) AS n, least(1.0, count(*) / 10.0)::DOUBLE AS confidence FROM ledger WHERE counterparty NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2 HAVING count(*) >= 3")
def a14(spark, sf_dir):
    owned = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("counterparty"))
    return ledger(spark, sf_dir).join(owned, "counterparty", "left_anti").groupBy("user_id", "counterparty").agg(F.count("*").alias("n")).filter("n >= 3").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10.0))


@query("a15_staking_rollup", f"WITH {LEDGER} SELECT year(ts)::INT AS year, wallet_id, count(*) AS n, sum(value)::DOUBLE AS total, min(ts_s) AS first, max(ts_s) AS last FROM ledger WHERE category IN ('stake', 'unstake', 'reward') GROUP BY ROLLUP (year(ts)::INT, wallet_id)")
def a15(spark, sf_dir):
    t = ledger(spark, sf_dir).filter(F.col("category").isin("stake", "unstake", "reward")).withColumn("year", F.year("ts"))
    return t.rollup("year", "wallet_id").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))


@query("a16_validator_stats", f"WITH {LEDGER} SELECT counterparty, sum(CASE WHEN category = 'stake' THEN units ELSE 0 END)::DOUBLE AS staked, sum(CASE WHEN category = 'unstake' THEN units ELSE 0 END)::DOUBLE AS unstaked, sum(CASE WHEN category = 'reward' THEN units ELSE 0 END)::DOUBLE AS rewards FROM ledger GROUP BY 1")
def a16(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("counterparty").agg(*(when(F.col("category") == c, F.col("units")).cast("double").alias(n) for c, n in (("stake", "staked"), ("unstake", "unstaked"), ("reward", "rewards"))))


@query("a18_monthly_budget", f"WITH {EXCHANGE} SELECT exchange, strftime(ts, '%Y-%m') AS month, count(*) AS calls, sum(quantity)::DOUBLE AS cost FROM exchange GROUP BY 1, 2 HAVING sum(quantity) > 5000000")
def a18(spark, sf_dir):
    return exchange(spark, sf_dir).groupBy("exchange", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.sum("quantity").alias("q")).filter("q > 5000000").select("exchange", "month", "calls", F.col("q").cast("double").alias("cost"))


@query("a19_category_counts", f"WITH {LEDGER} SELECT category, count(*) AS n FROM ledger GROUP BY 1")
def a19(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("a20_review_totals", f"WITH {EXCHANGE}, {ONCHAIN} SELECT (SELECT count(*) FROM exchange WHERE priority = '1-URGENT') AS exchange_n, (SELECT count(*) FROM onchain WHERE event_type = 'error') AS chain_n, (SELECT count(*) FROM labels WHERE quality = 0) AS label_n")
def a20(spark, sf_dir):
    one = lambda df, c: df.agg(F.count("*").alias(c))
    counts = one(exchange(spark, sf_dir).filter("priority = '1-URGENT'"), "exchange_n"), one(onchain(spark, sf_dir).filter("event_type = 'error'"), "chain_n"), one(table(spark, sf_dir, "labels").filter("quality = 0"), "label_n")
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query("a21_wallet_status", "SELECT s_suppkey AS wallet, CASE WHEN count(o) = 0 THEN 'unverified' WHEN count(o) FILTER (o = 'R') > 0 THEN 'flagged' ELSE 'verified' END AS status FROM supplier LEFT JOIN (SELECT l_suppkey, l_returnflag AS o FROM lineitem WHERE l_quantity > 49) ON l_suppkey = s_suppkey GROUP BY 1")
def a21(spark, sf_dir):
    checks = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    status = F.when(F.col("n").isNull(), "unverified").when(F.col("bad") > 0, "flagged").otherwise("verified")
    return table(spark, sf_dir, "supplier").join(checks, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("wallet"), status.alias("status"))


@query("a22_missing_staking", f"WITH {ONCHAIN} SELECT user_id, count(*) FILTER (event_type = 'click') AS rewards, count(DISTINCT date_trunc('day', ts)) AS epochs, round(1 - count(*) FILTER (event_type = 'click') / count(DISTINCT date_trunc('day', ts)), 6) AS gap FROM onchain GROUP BY 1")
def a22(spark, sf_dir):
    rewards, epochs = F.count_if(F.col("event_type") == "click"), F.count_distinct(F.to_date("ts"))
    return onchain(spark, sf_dir).groupBy("user_id").agg(rewards.alias("rewards"), epochs.alias("epochs"), F.round(1 - rewards / epochs, 6).alias("gap"))


@query("a23_fee_bands", f"WITH {LEDGER}, r AS (SELECT wallet_id, (sum(fee) / sum(value))::DOUBLE * 25 AS ratio FROM ledger GROUP BY 1) SELECT wallet_id, CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 'high' WHEN ratio BETWEEN 0.5 AND 1.5 THEN 'medium' ELSE 'none' END AS band FROM r")
def a23(spark, sf_dir):
    ratio = F.sum("fee").cast("double") / F.sum("value").cast("double") * 25
    r = ledger(spark, sf_dir).groupBy("wallet_id").agg(ratio.alias("ratio"))
    return r.select("wallet_id", F.when(F.col("ratio").between(0.8, 1.2), "high").when(F.col("ratio").between(0.5, 1.5), "medium").otherwise("none").alias("band"))


@query("a25_fee_once_per_hash", f"WITH {LEDGER} SELECT user_id, sum(m)::DOUBLE AS fees FROM (SELECT user_id, a, max(fee) AS m FROM ledger GROUP BY 1, 2) GROUP BY 1")
def a25(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("user_id", "a").agg(F.max("fee").alias("m")).groupBy("user_id").agg(F.sum("m").cast("double").alias("fees"))


@query("a26_wallet_balance_formula", f"""WITH {LEDGER}, m AS (SELECT user_id, sum(CASE WHEN direction = 'in' AND counterparty % 97 <> 0 THEN units ELSE 0 END) AS i, sum(CASE WHEN direction = 'out' THEN units ELSE 0 END) AS o FROM ledger GROUP BY 1),
 f AS (SELECT user_id, sum(x) AS fees FROM (SELECT user_id, a, max(fee) AS x FROM ledger WHERE direction = 'out' GROUP BY 1, 2) GROUP BY 1) SELECT m.user_id, round((i - o - coalesce(fees, 0))::DOUBLE, 4) AS balance FROM m LEFT JOIN f USING (user_id)""")
def a26(spark, sf_dir):
    t = ledger(spark, sf_dir)
    moved = t.groupBy("user_id").agg(when((F.col("direction") == "in") & (F.col("counterparty") % 97 != 0), F.col("units")).alias("i"), when(F.col("direction") == "out", F.col("units")).alias("o"))
    fees = t.filter("direction = 'out'").groupBy("user_id", "a").agg(F.max("fee").alias("x")).groupBy("user_id").agg(F.sum("x").alias("fees"))
    return moved.join(fees, "user_id", "left").select("user_id", d(F.col("i") - F.col("o") - F.coalesce("fees", F.lit(0)), 4).alias("balance"))


@query("a27_transfer_summary", f"WITH {ONCHAIN} SELECT symbol, count(*) AS n, count(*) FILTER (direction = 'in') AS n_in, count(*) FILTER (direction = 'out') AS n_out, count(DISTINCT user_id) AS wallets FROM onchain GROUP BY 1")
def a27(spark, sf_dir):
    return onchain(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "in").alias("n_in"), F.count_if(F.col("direction") == "out").alias("n_out"), F.count_distinct("user_id").alias("wallets"))


@query("a28_defi_rollup", f"WITH {ONCHAIN} SELECT chain, event_type, count(*) AS n, round(sum(value), 4) AS total FROM onchain GROUP BY ROLLUP (chain, event_type)")
def a28(spark, sf_dir):
    return onchain(spark, sf_dir).rollup("chain", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a30_pricing_coverage", f"WITH {ONCHAIN} SELECT symbol, count(*) FILTER (k >= 50) AS priced, count(*) FILTER (k < 50 OR k IS NULL) AS missing FROM onchain GROUP BY 1")
def a30(spark, sf_dir):
    return onchain(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("k") >= 50).alias("priced"), F.count_if((F.col("k") < 50) | F.col("k").isNull()).alias("missing"))


@query("a31_uncategorized", f"WITH {LEDGER} SELECT category, token, count(*) AS n, sum(value)::DOUBLE AS total FROM ledger GROUP BY 1, 2 HAVING count(*) >= 1450 OR sum(value) >= 80000000")
def a31(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("category", "token").agg(F.count("*").alias("n"), F.sum("value").alias("v")).filter("n >= 1450 or v >= 80000000").select("category", "token", "n", F.col("v").cast("double").alias("total"))


@query("a32_daily_price", f"WITH {ONCHAIN} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS price FROM onchain GROUP BY 1, 2")
def a32(spark, sf_dir):
    return onchain(spark, sf_dir).groupBy("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("price"))


@query("a33_yearly_rate", f"WITH {EXCHANGE} SELECT year(ts)::INT AS year, round(avg(quantity)::DOUBLE, 4) AS rate FROM exchange WHERE day(ts) = 15 GROUP BY 1")
def a33(spark, sf_dir):
    return exchange(spark, sf_dir).filter(F.dayofmonth("ts") == 15).groupBy(F.year("ts").alias("year")).agg(F.round((F.sum("quantity").cast("double") / F.count("*")), 4).alias("rate"))


@query("a34_year_end_inventory", f"WITH {LEDGER} SELECT token, sum(CASE WHEN direction = 'in' THEN units ELSE -units END)::DOUBLE AS units, sum(CASE WHEN direction = 'in' THEN value ELSE -value END)::DOUBLE AS cost FROM ledger WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1 HAVING abs(sum(CASE WHEN direction = 'in' THEN units ELSE -units END)) > 0.01")
def a34(spark, sf_dir):
    sign = lambda c: F.sum(F.when(F.col("direction") == "in", F.col(c)).otherwise(-F.col(c)))
    t = ledger(spark, sf_dir).filter(F.col("ts") < F.lit("2000-01-01").cast("timestamp")).groupBy("token").agg(sign("units").alias("u"), sign("value").alias("v"))
    return t.filter(F.abs("u") > 0.01).select("token", F.col("u").cast("double").alias("units"), F.col("v").cast("double").alias("cost"))


@query("a36_traces_by_type", f"WITH {ONCHAIN} SELECT event_type, count(*) AS n, count(*) FILTER (direction = 'in') AS received, round(sum(CASE WHEN direction = 'in' THEN value ELSE -value END), 4) AS net FROM onchain GROUP BY 1")
def a36(spark, sf_dir):
    return onchain(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "in").alias("received"), F.round(F.sum(F.when(F.col("direction") == "in", F.col("value")).otherwise(-F.col("value"))), 4).alias("net"))


@query("a37_job_progress", f"WITH {EXCHANGE} SELECT exchange, count(*) AS jobs, count(*) FILTER (tx_type = 'sell') AS done, round(100.0 * count(*) FILTER (tx_type = 'sell') / count(*), 4)::DOUBLE AS percent FROM exchange GROUP BY 1")
def a37(spark, sf_dir):
    done = F.count_if(F.col("tx_type") == "sell")
    return exchange(spark, sf_dir).groupBy("exchange").agg(F.count("*").alias("jobs"), done.alias("done"), F.round(100.0 * done / F.count("*"), 4).alias("percent"))


@query("a38_data_fingerprint", f"WITH {EXCHANGE}, {ONCHAIN} SELECT (SELECT count(*) FROM lineitem) AS tx_n, (SELECT max(l_orderkey) FROM lineitem) AS tx_max, (SELECT count(*) FROM exchange) AS ex_n, (SELECT max(ts_s) FROM exchange) AS ex_last, (SELECT max(id) FROM onchain) AS chain_max")
def a38(spark, sf_dir):
    tx = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("tx_n"), F.max("l_orderkey").alias("tx_max"))
    ex = exchange(spark, sf_dir).agg(F.count("*").alias("ex_n"), F.max("ts_s").alias("ex_last"))
    return tx.crossJoin(ex).crossJoin(onchain(spark, sf_dir).agg(F.max("id").alias("chain_max")))  # one row each


@query("a39_sync_eligible", f"WITH {EXCHANGE} SELECT user_id, max(ts_s) AS last FROM exchange e WHERE NOT EXISTS (SELECT 1 FROM exchange x WHERE x.user_id = e.user_id AND x.priority = '5-LOW') GROUP BY 1 HAVING max(ts) < TIMESTAMP '2001-01-01'")
def a39(spark, sf_dir):
    e = exchange(spark, sf_dir)
    idle = e.join(e.filter("priority = '5-LOW'").select("user_id").distinct(), "user_id", "left_anti")
    return idle.groupBy("user_id").agg(F.max("ts_s").alias("last"), F.max("ts").alias("t")).filter(F.col("t") < F.lit("2001-01-01").cast("timestamp")).select("user_id", "last")


@query("a40_signed_balances", f"WITH {ONCHAIN} SELECT user_id, symbol, round(sum(CASE WHEN direction = 'in' THEN value ELSE -value END), 4) AS balance FROM onchain GROUP BY 1, 2 HAVING sum(CASE WHEN direction = 'in' THEN value ELSE -value END) > 0.0001")
def a40(spark, sf_dir):
    b = F.sum(F.when(F.col("direction") == "in", F.col("value")).otherwise(-F.col("value")))
    return onchain(spark, sf_dir).groupBy("user_id", "symbol").agg(b.alias("b")).filter("b > 0.0001").select("user_id", "symbol", F.round("b", 4).alias("balance"))


LAST = ["ts", "a", "b", "c", "units", "value"]


@query("w01_latest_per_key", f"WITH {LEDGER} SELECT user_id, token, ts_s, a, b, c, units::DOUBLE AS units FROM ledger QUALIFY row_number() OVER (PARTITION BY user_id, token ORDER BY ts DESC, a DESC, b DESC, c DESC, units DESC, value DESC) = 1")
def w01(spark, sf_dir):
    return latest(ledger(spark, sf_dir), ["user_id", "token"], [F.desc(c) for c in LAST]).select("user_id", "token", "ts_s", "a", "b", "c", F.col("units").cast("double").alias("units"))


@query("w02_opening_values", f"WITH {LEDGER}, l AS (SELECT user_id, token, value FROM ledger WHERE ts < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY user_id, token ORDER BY ts DESC, a DESC, b DESC, c DESC, units DESC, value DESC) = 1) SELECT user_id, sum(value)::DOUBLE AS opening FROM l GROUP BY 1")
def w02(spark, sf_dir):
    before = ledger(spark, sf_dir).filter(F.col("ts") < F.lit("1998-01-01").cast("timestamp"))
    return before.groupBy("user_id", "token").agg(F.max_by("value", F.struct(*LAST)).alias("v")).groupBy("user_id").agg(F.sum("v").cast("double").alias("opening"))


MONTHS = f"""{LEDGER}, m AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, sum(CASE WHEN direction = 'in' THEN units ELSE -units - fee END) AS net FROM ledger GROUP BY 1, 2),
 r AS (SELECT user_id, month, sum(net) OVER (PARTITION BY user_id ORDER BY month) AS balance FROM m)"""


def month_ends(spark, sf_dir):
    """The running balance at each month's end: months are summed first, so the window is over months."""
    net = F.when(F.col("direction") == "in", F.col("units")).otherwise(-F.col("units") - F.col("fee"))
    m = ledger(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(net).alias("net"))
    return m.select("user_id", "month", F.sum("net").over(Window.partitionBy("user_id").orderBy("month")).alias("balance"))


@query("w03_month_end_balances", f"WITH {MONTHS} SELECT user_id, month, round(balance::DOUBLE, 4) AS balance FROM r")
def w03(spark, sf_dir):
    return month_ends(spark, sf_dir).select("user_id", "month", d("balance", 4).alias("balance"))


@query("w04_checkpoint_deltas", f"WITH {MONTHS}, x AS (SELECT *, balance - lag(balance) OVER (PARTITION BY user_id ORDER BY month) AS delta, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS k FROM r) SELECT user_id, month, round(delta::DOUBLE, 4) AS delta FROM x WHERE k <= 24 AND delta IS NOT NULL")
def w04(spark, sf_dir):
    w = Window.partitionBy("user_id")
    x = month_ends(spark, sf_dir).withColumns({"delta": F.col("balance") - F.lag("balance").over(w.orderBy("month")), "k": F.row_number().over(w.orderBy(F.desc("month")))})
    return x.filter("k <= 24 and delta is not null").select("user_id", "month", d("delta", 4).alias("delta"))


@query("w05_longest_silence", f"WITH {ONCHAIN}, g AS (SELECT user_id, ts_s, ts_s - lag(ts_s) OVER (PARTITION BY user_id ORDER BY ts_s) AS gap FROM onchain) SELECT user_id, max(gap) AS gap, max_by(ts_s, (gap, ts_s)) AS until FROM g WHERE gap > 36000 GROUP BY 1")
def w05(spark, sf_dir):
    g = onchain(spark, sf_dir).withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(Window.partitionBy("user_id").orderBy("ts_s"))).filter("gap > 36000")
    return g.groupBy("user_id").agg(F.max("gap").alias("g"), F.max_by("ts_s", F.struct("gap", "ts_s")).alias("until")).select("user_id", F.col("g").alias("gap"), "until")


@query("w06_epoch_rewards", f"""WITH {ONCHAIN}, s AS (SELECT user_id, ts_s, round(value * 100)::BIGINT AS staked FROM onchain WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts_s ORDER BY id) = 1),
 e AS (SELECT *, lag(staked) OVER w AS prev, lag(ts_s) OVER w AS prev_s FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_s)),
 f AS (SELECT e.user_id, e.ts_s, e.staked, e.prev, coalesce(sum(CASE WHEN o.event_type = 'purchase' THEN round(o.value * 100)::BIGINT WHEN o.event_type = 'signup' THEN -round(o.value * 100)::BIGINT END), 0)::BIGINT AS flow
  FROM e LEFT JOIN onchain o ON o.user_id = e.user_id AND o.event_type IN ('purchase', 'signup') AND o.ts_s >= e.prev_s AND o.ts_s < e.ts_s WHERE e.prev IS NOT NULL GROUP BY 1, 2, 3, 4)
 SELECT user_id, ts_s, greatest(0, staked - prev - flow)::BIGINT AS reward FROM f""")
def w06(spark, sf_dir):
    """What a position grew by beyond deposits and withdrawals since the snapshot before, at least 0."""
    t, cents = onchain(spark, sf_dir), F.round(F.col("value") * 100).cast("long")
    snaps = latest(t.filter("event_type = 'view'"), ["user_id", "ts_s"], [F.col("id")]).select("user_id", "ts_s", cents.alias("staked"))
    moves = t.filter("event_type in ('purchase', 'signup')").select("user_id", "ts_s", F.when(F.col("event_type") == "purchase", cents).otherwise(-cents).alias("flow"))
    both = snaps.withColumn("flow", F.lit(None).cast("long")).unionByName(moves.withColumn("staked", F.lit(None).cast("long")))
    order = Window.partitionBy("user_id").orderBy("ts_s", F.col("staked").isNull())  # a snapshot comes before moves of its second
    run = both.withColumn("sum", F.sum(F.coalesce("flow", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("staked is not null")
    w = Window.partitionBy("user_id").orderBy("ts_s")
    run = run.withColumns({"prev": F.lag("staked").over(w), "before": F.lag("sum").over(w)}).filter("prev is not null")
    return run.select("user_id", "ts_s", F.greatest(F.lit(0).cast("long"), F.col("staked") - F.col("prev") - (F.col("sum") - F.col("before"))).alias("reward"))


@query("w07_forward_fill", f"""WITH {EXCHANGE}, r AS (SELECT ts::DATE AS day, (sum(quantity) / count(*))::DOUBLE AS rate FROM exchange GROUP BY 1), c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM r)
 SELECT strftime(c.day, '%Y-%m-%d') AS day, round((SELECT rate FROM r WHERE r.day <= c.day ORDER BY r.day DESC LIMIT 1), 4) AS rate FROM c""")
def w07(spark, sf_dir):
    e = exchange(spark, sf_dir)
    rates = e.groupBy(F.to_date("ts").alias("day")).agg((F.sum("quantity").cast("double") / F.count("*")).alias("rate"))
    days = e.select(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).select(F.explode(F.sequence("first", "last")).alias("day"))
    filled = days.join(rates, "day", "left").withColumn("rate", F.last("rate", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # a row a day
    return filled.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("rate", 4).alias("rate"))


@query("w08_sessions", f"""WITH {ONCHAIN}, n AS (SELECT user_id, ts_s, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY user_id ORDER BY ts_s, id) <= 7200 THEN 0 ELSE 1 END AS fresh, id FROM onchain),
 s AS (SELECT user_id, ts_s, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_s, id ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts_s) AS start, max(ts_s) AS stop FROM s GROUP BY 1, 2""")
def w08(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts_s", "id")
    n = onchain(spark, sf_dir).withColumn("fresh", F.when(F.col("ts_s") - F.lag("ts_s").over(w) <= 7200, 0).otherwise(1))
    s = n.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts_s").alias("start"), F.max("ts_s").alias("stop"))


@query("w09_lifetime_rewards", f"WITH {LEDGER} SELECT wallet_id, greatest(0, sum(CASE WHEN category = 'unstake' THEN units WHEN category = 'stake' THEN -units ELSE 0 END) + max(units))::DOUBLE AS reward FROM ledger GROUP BY 1")
def w09(spark, sf_dir):
    flow = F.sum(F.when(F.col("category") == "unstake", F.col("units")).when(F.col("category") == "stake", -F.col("units")).otherwise(0))
    return ledger(spark, sf_dir).groupBy("wallet_id").agg(F.greatest(F.lit(0.0), (flow + F.max("units")).cast("double")).alias("reward"))


@query("w11_yearly_yield", "SELECT o_custkey, y AS year, round(sum(o_totalprice * 0.1 * greatest(0, date_diff('day', greatest(o_orderdate::DATE, make_date(y, 1, 1)), make_date(y + 1, 1, 1))) / 365), 2) AS yield FROM orders, range(1995, 2002) AS r(y) WHERE y >= year(o_orderdate) AND y <= 1999 GROUP BY 1, 2")
def w11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") <= 1999).withColumn("y", F.explode(F.sequence(F.year("o_orderdate"), F.lit(1999))))
    start = F.greatest(F.to_date("o_orderdate"), F.make_date("y", F.lit(1), F.lit(1)))
    days = F.greatest(F.lit(0), F.date_diff(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)), start))
    return o.groupBy("o_custkey", F.col("y").cast("long").alias("year")).agg(F.round(F.sum(F.col("o_totalprice") * 0.1 * days / 365), 2).alias("yield"))


@query("j04_rebuys_within_30_days", f"WITH {LEDGER} SELECT s.user_id, s.token, s.a, s.b, s.c, s.ts_s, count(*) AS rebuys, sum(r.units)::DOUBLE AS units FROM (SELECT DISTINCT user_id, token, a, b, c, ts_s FROM ledger WHERE kind = 'dispose') s JOIN ledger r ON r.user_id = s.user_id AND r.token = s.token AND r.kind = 'acquire' AND r.ts_s BETWEEN s.ts_s - 2592000 AND s.ts_s + 2592000 GROUP BY ALL")
def j04(spark, sf_dir):
    t = ledger(spark, sf_dir)
    sells = t.filter("kind = 'dispose'").select("user_id", "token", "a", "b", "c", "ts_s").distinct()
    buys = t.filter("kind = 'acquire'").select("user_id", "token", F.col("ts_s").alias("buy_s"), "units")
    found = window_sum(sells, buys, ["user_id", "token"], "ts_s", "buy_s", -2592000, 2592000, {"rebuys": F.lit(1).cast("long"), "bought": F.col("units")})
    return found.filter("rebuys > 0").select("user_id", "token", "a", "b", "c", "ts_s", "rebuys", F.col("bought").cast("double").alias("units"))
