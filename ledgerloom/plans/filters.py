"""Filters, scalar functions, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CATEGORIES, EXCHANGE, LEDGER, ONCHAIN, exchange, ledger, onchain, table
from ..functions.scalars import fmt_cad, fmt_units, round_down, to_epoch_seconds, to_human_units
from ..operators.filters import all_of, fiscal_year_range, is_implicit_account
from .registry import query


@query("f01_success_filter", f"WITH {ONCHAIN}, s AS (SELECT *, CASE WHEN k < 30 THEN NULL WHEN k < 60 THEN true ELSE false END AS success FROM onchain) SELECT chain, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE success OR success IS NULL GROUP BY chain")
def f01(spark, sf_dir):
    success = F.when(F.col("k") < 30, None).when(F.col("k") < 60, True).otherwise(False)
    return onchain(spark, sf_dir).withColumn("success", success).filter(F.col("success") | F.col("success").isNull()).groupBy("chain").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("f02_skip_categories", f"WITH {LEDGER} SELECT category, count(*) AS n FROM ledger WHERE category NOT IN ('spam', 'transfer', 'internal_transfer') GROUP BY category")
def f02(spark, sf_dir):
    return ledger(spark, sf_dir).filter(~F.col("category").isin("spam", "transfer", "internal_transfer")).groupBy("category").agg(F.count("*").alias("n"))


@query("f03_dynamic_filters", f"WITH {EXCHANGE} SELECT id, exchange, asset, quantity::DOUBLE AS quantity FROM exchange WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' AND exchange = 'kraken' AND upper(asset) = 'BTC' AND (lower(priority) LIKE '%urgent%' OR lower(tx_type) LIKE '%urgent%' OR lower(asset) LIKE '%urgent%')")
def f03(spark, sf_dir):
    e = exchange(spark, sf_dir).filter(all_of(start="1996-01-01", end="1997-01-01", equal={"exchange": "kraken", "asset": "BTC"}, search=("urgent", ("priority", "tx_type", "asset"))))
    return e.select("id", "exchange", "asset", F.col("quantity").cast("double").alias("quantity"))


@query("f04_wallet_exclusion", f"WITH {LEDGER} SELECT user_id, count(*) AS n FROM ledger WHERE wallet_id NOT IN (10, 21, 32, 43) GROUP BY user_id")
def f04(spark, sf_dir):
    return ledger(spark, sf_dir).filter(~F.col("wallet_id").isin(10, 21, 32, 43)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("f05_fiscal_year", f"WITH {LEDGER} SELECT token, count(*) AS n, sum(value)::DOUBLE AS total FROM ledger WHERE ts >= TIMESTAMP '1996-07-01' AND ts < TIMESTAMP '1997-07-01' GROUP BY token")
def f05(spark, sf_dir):
    start, end = fiscal_year_range(1997, 6)
    return ledger(spark, sf_dir).filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))).groupBy("token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("f08_small_holdings", "SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS usd FROM customer WHERE NOT (c_mktsegment <> 'BUILDING' AND c_acctbal < 1) AND c_nationkey IN (1, 2, 3)")
def f08(spark, sf_dir):
    usd = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").filter(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_acctbal", usd.alias("usd")).filter(F.coalesce(F.col("usd") >= 1, F.lit(True)))


@query("f09_implicit_account", "SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS account FROM orders WHERE o_orderkey % 2 = 0 AND regexp_matches(sha256(o_orderkey::VARCHAR), '^[0-9a-f]') AND length(sha256(o_orderkey::VARCHAR)) = 64")
def f09(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    account = F.when(F.col("o_orderkey") % 2 == 0, F.sha2(key, 256)).otherwise(F.concat(F.lit("user."), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", account.alias("account")).filter(is_implicit_account(F.col("account")))


@query("f10_counterparty_buckets", "SELECT CASE WHEN host LIKE '%.net' THEN 'net' WHEN host LIKE '%.org' THEN 'org' WHEN host LIKE 'www.%' THEN 'www' ELSE 'other' END AS bucket, count(*) AS n FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) GROUP BY 1")
def f10(spark, sf_dir):
    host = F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    bucket = F.when(F.col("h").like("%.net"), "net").when(F.col("h").like("%.org"), "org").when(F.col("h").like("www.%"), "www").otherwise("other")
    return table(spark, sf_dir, "pages").select(host.alias("h")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("f11_job_claims", f"WITH {EXCHANGE} SELECT e.id, e.user_id FROM exchange e WHERE e.tx_type = 'deposit' AND e.ts <= TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM exchange r WHERE r.user_id = e.user_id AND r.tx_type = 'buy' AND r.priority = '1-URGENT')")
def f11(spark, sf_dir):
    e = exchange(spark, sf_dir)
    busy = e.filter("tx_type = 'buy' and priority = '1-URGENT'").select("user_id").distinct()
    return e.filter((F.col("tx_type") == "deposit") & (F.col("ts") <= F.lit("1998-01-01").cast("timestamp"))).join(busy, "user_id", "left_anti").select("id", "user_id")


@query("s_units_exact", "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 7 AS DECIMAL(38,0))::VARCHAR AS raw, rtrim(rtrim((CASE WHEN o_orderkey * 7 < 0 THEN '-' ELSE '' END) || '0.' || lpad((o_orderkey * 7)::VARCHAR, 24, '0'), '0'), '.') AS units FROM orders")
def s_units(spark, sf_dir):
    raw = (F.col("o_orderkey").cast("decimal(38,0)") * 7).cast("decimal(38,0)")
    units = F.regexp_replace(F.regexp_replace(to_human_units(raw.cast("string"), 24), "0+$", ""), r"\.$", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.cast("string").alias("raw"), units.alias("units"))


@query("s_dates", f"WITH {ONCHAIN} SELECT id, CASE WHEN id % 2 = 0 THEN (ts_s::HUGEINT * 1000000000)::BIGINT ELSE ts_s END AS raw, ts_s AS seconds, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('month', ts), '%Y-%m') AS month, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, ts_s - 946684800 AS ripple FROM onchain")
def s_dates(spark, sf_dir):
    raw = F.when(F.col("id") % 2 == 0, F.col("ts_s") * 1_000_000_000).otherwise(F.col("ts_s"))
    t = onchain(spark, sf_dir).withColumn("raw", raw).withColumn("seconds", to_epoch_seconds(F.col("raw")))
    at = F.timestamp_seconds("seconds")
    return t.select("id", "raw", "seconds", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM").alias("month"), F.date_format(F.date_trunc("week", at), "yyyy-MM-dd").alias("week"), (F.col("seconds") - 946684800).alias("ripple"))


@query("s_formats", "SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice::DECIMAL(18,2))::VARCHAR AS cad, CASE WHEN l_quantity = 0 THEN '' ELSE (l_quantity::DECIMAL(18,8))::VARCHAR END AS units, floor(l_extendedprice::DECIMAL(18,2) * 10) / 10 AS down FROM lineitem")
def s_formats(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", fmt_cad(F.col("l_extendedprice")).alias("cad"), fmt_units(F.col("l_quantity")).alias("units"), round_down(F.col("l_extendedprice").cast("decimal(18,2)"), 1).cast("double").alias("down"))


@query("s_json_fields", f"WITH {ONCHAIN} SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM onchain GROUP BY event_type")
def s_json(spark, sf_dir):
    return onchain(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query("s_dedup_key", f"WITH {EXCHANGE} SELECT id, sha256(user_id::VARCHAR || '|' || exchange || '|' || id::VARCHAR) AS key FROM exchange")
def s_key(spark, sf_dir):
    return exchange(spark, sf_dir).select("id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "exchange", F.col("id").cast("string")), 256).alias("key"))


@query("t01_sorted_page", f"WITH {EXCHANGE} SELECT id, ts_s, quantity::DOUBLE AS quantity FROM exchange WHERE tx_type = 'sell' ORDER BY ts DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def t01(spark, sf_dir):
    return exchange(spark, sf_dir).filter("tx_type = 'sell'").orderBy(F.col("ts").desc_nulls_last(), "id").offset(100).limit(50).select("id", "ts_s", F.col("quantity").cast("double").alias("quantity"))


@query("t02_review_queue", f"WITH {EXCHANGE} SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE round((id % 100) / 100, 2) END AS confidence FROM exchange ORDER BY confidence ASC NULLS LAST, ts, id")
def t02(spark, sf_dir):
    confidence = F.when(F.col("id") % 11 == 0, None).otherwise(F.round((F.col("id") % 100) / 100, 2))
    return exchange(spark, sf_dir).withColumn("confidence", confidence).orderBy(F.col("confidence").asc_nulls_last(), "ts", "id").select("id", "confidence")


@query("t07_distinct_dates", f"WITH {LEDGER} SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM ledger ORDER BY day DESC LIMIT 30")
def t07(spark, sf_dir):
    return ledger(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day")).limit(30)


@query("u01_union_all_ledger", f"WITH {EXCHANGE}, {ONCHAIN} SELECT source, count(*) AS n, min(ts_s) AS first, max(ts_s) AS last FROM (SELECT 'chain' AS source, ts_s FROM onchain UNION ALL SELECT exchange, ts_s FROM exchange) GROUP BY source")
def u01(spark, sf_dir):
    both = onchain(spark, sf_dir).select(F.lit("chain").alias("source"), "ts_s").unionByName(exchange(spark, sf_dir).select(F.col("exchange").alias("source"), "ts_s"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))


@query("u02_union_distinct_dates", f"WITH {EXCHANGE}, {LEDGER} SELECT strftime(ts, '%Y-%m') AS month FROM exchange UNION SELECT strftime(ts, '%Y-%m') FROM ledger")
def u02(spark, sf_dir):
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return exchange(spark, sf_dir).select(month).union(ledger(spark, sf_dir).select(month)).distinct()


@query("u04_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def u04(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select("o_custkey"))


@query("c14_tax_treatment", f"WITH {LEDGER} SELECT category, CASE WHEN category IN ('income', 'reward', 'airdrop', 'interest') THEN 'income' WHEN category IN ('sell', 'trade') THEN 'capital' ELSE 'none' END AS treatment, category IN ('income', 'reward', 'airdrop', 'interest', 'sell', 'trade') AS taxable, count(*) AS n FROM ledger GROUP BY ALL")
def c14(spark, sf_dir):
    income, capital = ("income", "reward", "airdrop", "interest"), ("sell", "trade")
    kinds = [(c, "income" if c in income else "capital" if c in capital else "none", c in income + capital) for c in CATEGORIES]
    map_ = spark.createDataFrame(kinds, "category string, treatment string, taxable boolean")
    return ledger(spark, sf_dir).join(F.broadcast(map_), "category").groupBy("category", "treatment", "taxable").agg(F.count("*").alias("n"))
