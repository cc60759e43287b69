"""What the interface shows: assets by value, open issues, a report in Markdown, the first rows of the ledger, and whether an index has caught up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import EXCHANGE, ORDER, exchange, ledger
from ..operators.verify import diagnose
from .chain import OWN_PARTY, STAGES, all_classified, movements
from .costbasis import FOLD, KEYS, money, snapshots
from .registry import query
from .verification import SIGNS, _signs

_MOVES = STAGES.split(",\nruled AS (")[0]
SMALL, BEHIND, PREVIEW = 1, 86_400, 50

_PRICE = "price AS (SELECT token, (sum(value * 100)::BIGINT // sum(units)::BIGINT) AS cents FROM ledger WHERE ts >= TIMESTAMP '2001-01-01' GROUP BY 1)"


@query("r14_assets", f"""WITH RECURSIVE {FOLD}, {_PRICE}, h AS (SELECT user_id, token, max_by(su, rn) AS su FROM g GROUP BY 1, 2),
w AS (SELECT user_id, token, wallet_id, sum(CASE WHEN direction = 'in' THEN units ELSE -units END) AS held FROM ledger GROUP BY 1, 2, 3), ws AS (SELECT user_id, token, count(*) AS wallets, min_by(wallet_id, (-held, wallet_id)) AS first_wallet FROM w GROUP BY 1, 2),
a AS (SELECT user_id, token, (su / 1e8)::DOUBLE AS balance, (coalesce(cents, 0) / 100)::DOUBLE AS price, (su / 1e8)::DOUBLE * coalesce(cents, 0) / 100 AS value, wallets, first_wallet FROM h LEFT JOIN price USING (token) LEFT JOIN ws USING (user_id, token)
 WHERE su > 0 AND NOT (user_id % 7 = 0 AND token = 'N')) SELECT user_id, token, balance, price, round(value, 4) AS value, wallets, first_wallet, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, token)::INT AS place FROM a WHERE NOT (value < {SMALL} AND price > 0)""")
def r14(spark, sf_dir):
    """What each user holds, without what they marked as spam (here one token of every seventh user) and what is worth less than 1; the most valuable first, with the fullest wallet."""
    moves = ledger(spark, sf_dir)
    cents = F.call_function("div", F.sum(F.col("value") * 100).cast("long"), F.sum("units").cast("long"))
    price = moves.filter("ts >= timestamp_ntz '2001-01-01'").groupBy("token").agg(cents.alias("cents"))
    held = F.sum(F.when(F.col("direction") == "in", F.col("units")).otherwise(-F.col("units")))
    wallets = moves.groupBy(*KEYS, "wallet_id").agg(held.alias("held")).groupBy(*KEYS).agg(F.count("*").alias("wallets"), F.min_by("wallet_id", F.struct(-F.col("held"), F.col("wallet_id"))).alias("first_wallet"))
    now = snapshots(spark, sf_dir).groupBy(*KEYS).agg(F.max_by("units_after", F.struct(*ORDER)).alias("units")).filter("units > 0")
    spam = (F.col("user_id") % 7 == 0) & (F.col("token") == "N")
    a = now.filter(~spam).join(price, "token", "left").join(wallets, KEYS, "left").withColumn("balance", money("units"))
    a = a.withColumns({"price": (F.coalesce("cents", F.lit(0)) / 100), "v": F.col("balance") * F.coalesce("cents", F.lit(0)) / 100}).filter(~((F.col("v") < SMALL) & (F.col("price") > 0)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("v"), "token"))
    return a.select(*KEYS, "balance", "price", F.round("v", 4).alias("value"), "wallets", "first_wallet", place.alias("place"))


@query("r18_issue_summary", f"""WITH {SIGNS}, d AS (SELECT wallet_id // 10 AS user_id, CASE WHEN chain = 'near' AND c1 > 0.5 THEN 'missing_staking_rewards' WHEN c2 > 0.5 THEN 'uncounted_fees' WHEN longest > 604800 THEN 'unindexed_period' WHEN misclassified > 0 THEN 'classification_error' ELSE 'unknown' END AS category FROM f WHERE abs(difference) > 50)
SELECT user_id, category, count(*) AS issues, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total_issues FROM d GROUP BY 1, 2""")
def r18(spark, sf_dir):
    """Open issues of each user by their diagnosis, and in all."""
    d = diagnose(_signs(spark, sf_dir).filter(F.abs("difference") > 50)).groupBy(F.floor(F.col("wallet_id") / 10).alias("user_id"), F.col("diagnosis").alias("category")).agg(F.count("*").alias("issues"))
    return d.withColumn("total_issues", F.sum("issues").over(Window.partitionBy("user_id")))


@query("r18_needs_review", f"WITH {STAGES} SELECT user_id, count(*) FILTER (needs_review) AS classifications, count(*) FILTER (stage = 'fallback') AS unknown FROM classified GROUP BY 1")
def r18_review(spark, sf_dir):
    t = all_classified(spark, sf_dir)
    return t.groupBy("user_id").agg(F.count_if("needs_review").alias("classifications"), F.count_if(F.col("stage") == "fallback").alias("unknown"))


@query("snk10_discrepancy_text", f"""WITH {SIGNS}, o AS (SELECT wallet_id // 10 AS user_id, wallet_id, chain, CASE WHEN difference IS NULL THEN 'unverified' WHEN abs(difference) <= 50 THEN 'verified' ELSE 'flagged' END AS status FROM s),
tally AS (SELECT user_id, count(*) FILTER (status = 'verified') AS v, count(*) FILTER (status = 'flagged') AS f, count(*) FILTER (status = 'unverified') AS u, string_agg('| ' || chain || ' | ' || wallet_id || ' | ' || status || ' |', chr(10) ORDER BY wallet_id) AS body FROM o GROUP BY 1)
SELECT user_id, sha256('# Discrepancy Report' || chr(10) || 'User ID: ' || user_id || chr(10) || '| Verified | ' || v || ' |' || chr(10) || '| Flagged | ' || f || ' |' || chr(10) || '| Unverified | ' || u || ' |' || chr(10) || body) AS text_sha256, f AS flagged FROM tally""")
def snk10(spark, sf_dir):
    """Each user's report as Markdown: counts by status, then a line a wallet; here its digest."""
    status = F.when(F.col("difference").isNull(), "unverified").when(F.abs("difference") <= 50, "verified").otherwise("flagged")
    o = _signs(spark, sf_dir).select(F.floor(F.col("wallet_id") / 10).alias("user_id"), "wallet_id", "chain", status.alias("status"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "chain", F.col("wallet_id").cast("string"), "status"), F.lit(" |"))
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("verified", "flagged", "unverified")}
    c = o.groupBy("user_id").agg(*n.values(), F.sort_array(F.collect_list(F.struct("wallet_id", line.alias("line")))).alias("rows"))  # a user's wallets
    count = lambda s: F.concat(F.lit(f"| {s.title()} | "), F.col(s).cast("string"), F.lit(" |"))
    text = F.concat_ws("\n", F.lit("# Discrepancy Report"), F.concat(F.lit("User ID: "), F.col("user_id").cast("string")), *map(count, n), F.array_join("rows.line", "\n"))
    return c.select("user_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"), "flagged")


@query("r12_ledger_preview", f"WITH {_MOVES}, {EXCHANGE} SELECT * FROM (SELECT make_timestamp(ts_s * 1000000) AS day, 'near' AS source, id, token, units::DOUBLE AS amount FROM t UNION ALL SELECT ts, 'exchange', id, asset, quantity::DOUBLE FROM exchange) ORDER BY day, source, id LIMIT {PREVIEW}")
def r12(spark, sf_dir):
    """The first rows of both ledgers together, as the preview shows them (T04, U03)."""
    near = movements(spark, sf_dir).select(F.timestamp_seconds("ts_s").cast("timestamp_ntz").alias("day"), F.lit("near").alias("source"), "id", "token", money("units").alias("amount"))
    there = exchange(spark, sf_dir).select(F.col("ts").cast("timestamp_ntz").alias("day"), F.lit("exchange").alias("source"), "id", F.col("asset").alias("token"), money("quantity").alias("amount"))
    return near.unionByName(there).orderBy("day", "source", "id").limit(PREVIEW)


@query("st08_backfill_gate", f"WITH {_MOVES}, c AS (SELECT user_id, max(ts_s) AS cursor FROM t GROUP BY 1) SELECT user_id, (SELECT max(ts_s) FROM t) - cursor AS behind, (SELECT max(ts_s) FROM t) - cursor > {BEHIND} AS paused FROM c")
def st08(spark, sf_dir):
    """Whose index is more than a day of blocks behind the tip, so that what follows has to wait; the tip is a table of one row."""
    t = movements(spark, sf_dir)
    behind = F.col("tip") - F.col("cursor")
    c = t.groupBy("user_id").agg(F.max("ts_s").alias("cursor")).join(F.broadcast(t.agg(F.max("ts_s").alias("tip"))))
    return c.select("user_id", behind.alias("behind"), (behind > BEHIND).alias("paused"))


@query("j13_unknown_counterparties", f"WITH {_MOVES} SELECT user_id, lower(counterparty) AS party, count(*) AS n FROM t WHERE counterparty IS NOT NULL AND NOT (user_id % 2 = 0 AND lower(counterparty) = '{OWN_PARTY}') GROUP BY 1, 2")
def j13(spark, sf_dir):
    """Counterparties of each user that are no wallet of theirs, whatever the case."""
    t = movements(spark, sf_dir)
    owned = t.filter("user_id % 2 = 0").select("user_id", F.lit(OWN_PARTY).alias("party")).distinct()
    seen = t.filter("counterparty is not null").groupBy("user_id", F.lower("counterparty").alias("party")).agg(F.count("*").alias("n"))
    return seen.join(owned, ["user_id", "party"], "left_anti")
