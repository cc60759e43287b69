"""Classification, pricing, matching, verification, reports, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import EXCHANGE, LEDGER, ONCHAIN, exchange, ledger, onchain, table
from ..operators import rule_catalogue as catalogue
from ..operators.decode import SPAM_FROM, kind_of, legs, path_tokens, selector_of, spam_score
from ..operators.joins import asof_join, latest, range_join
from ..operators.matching import candidates, greedy, runs
from ..operators.pricing import minute_prices, two_sources, with_rate
from ..operators.rules import match
from ..operators.upsert import upsert
from .registry import query

# -- classification ---------------------------------------------------------
METHODS = ("deposit_and_stake", "unstake", "swap", "supply", "borrow", "add_liquidity", "claim", "ft_transfer", "near_deposit", "vote", "storage_deposit", "ping", "set", None)
PARTIES = ("alpha.poolv1.near", "v2.ref-finance.near", "burrow.near", "wrap.near", "system", "social.near", "team.sputnikdao.near", "bob.near", "meta-pool.near")
ACTIONS = ("FUNCTION_CALL", "TRANSFER", "function_call", "ADD_KEY", "CREATE_ACCOUNT")
SELECTORS = ("0x38ed1739", "0xe8eda9df", "0xe8e33700", "0xC04B8D59", "", "0x")
TYPES = ("buy", "sale", "convert", "staking_reward", "send", "receive", "viban_purchase", "mystery")
_LISTS = {"method_name": (METHODS, 7), "counterparty": (PARTIES, 3), "action_type": (ACTIONS, 11), "selector": (SELECTORS, 5), "tx_type": (TYPES, 13)}


def calls(spark, sf_dir):
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.floor(F.col("id") / k) % len(xs) + 1).cast("int"))
    t = onchain(spark, sf_dir)
    chain = F.element_at(F.array(*map(F.lit, ("near", "evm", "exchange"))), (F.col("id") % 3 + 1).cast("int"))
    return t.select("id", "user_id", "direction", "amount", (F.col("user_id") % 2 == 0).alias("is_own"), *(pick(xs, k).alias(c) for c, (xs, k) in _LISTS.items()), chain.alias("chain"))


def _sql_list(xs):
    return "list_value(" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + ")"


CALLS = f"{ONCHAIN}, calls AS (SELECT id, user_id, direction, amount, user_id % 2 = 0 AS is_own, " + ", ".join(f"{_sql_list(xs)}[((id // {k}) % {len(xs)} + 1)::INT] AS {c}" for c, (xs, k) in _LISTS.items()) + ", list_value('near', 'evm', 'exchange')[(id % 3 + 1)::INT] AS chain FROM onchain)"


def _rule_sql(r) -> str:
    q = lambda xs, f=str.lower: "(" + ", ".join(f"'{f(x)}'" for x in xs) + ")"
    low = lambda c: f"lower(coalesce({c}, ''))"
    tests = [f"chain = '{r.chain}'"]
    tests += [f"upper(coalesce(action_type, '')) IN {q(r.action, str.upper)}"] * bool(r.action) + [f"{low('method_name')} IN {q(r.method)}"] * bool(r.method) + [f"{low('tx_type')} IN {q(r.tx_type)}"] * bool(r.tx_type)
    tests += [f"direction = '{r.direction}'"] * bool(r.direction) + ["(" + " OR ".join(f"ends_with({low('counterparty')}, '{s}')" for s in r.suffix) + ")"] * bool(r.suffix)
    tests += [f"{low('counterparty')} IN {q(r.among)}"] * bool(r.among) + [f"{low('counterparty')} = '{r.exact}'"] * (r.exact is not None) + [f"amount > {r.amount_above}"] * (r.amount_above is not None)
    tests += [f"{low('selector')} IN ('', '0x')"] * (r.selector == "") + [f"{low('selector')} = '{r.selector}'"] * bool(r.selector) + ["is_own"] * bool(r.own)
    return " AND ".join(tests)


_CASE = "CASE " + " ".join(f"WHEN {_rule_sql(r)} THEN '{r.name}'" for r in sorted(catalogue.ALL, key=lambda r: -r.priority)) + " END"
_CATEGORY = f"map {{{', '.join(repr(r.name) + ': ' + repr(r.category) for r in catalogue.ALL)}}}"
_CONFIDENCE = f"map {{{', '.join(repr(r.name) + ': ' + str(r.confidence) + '::DOUBLE' for r in catalogue.ALL)}}}"


@query("c02_rule_match", f"WITH {CALLS}, m AS (SELECT id, {_CASE} AS rule FROM calls) SELECT id, rule, coalesce({_CATEGORY}[rule], 'unknown') AS category, coalesce({_CONFIDENCE}[rule], 0.3)::DOUBLE AS confidence, coalesce({_CONFIDENCE}[rule], 0.3) < 0.9 AS needs_review FROM m")
def c02(spark, sf_dir):
    t = match(calls(spark, sf_dir), catalogue.ALL)
    sure = F.coalesce("confidence", F.lit(0.3))
    return t.select("id", "rule", F.coalesce("category", F.lit("unknown")).alias("category"), sure.alias("confidence"), (sure < 0.9).alias("needs_review"))


_KIND = "CASE " + " ".join(f"WHEN category IN ({', '.join(map(repr, cs))}) THEN '{k}'" for k, cs in catalogue.KINDS.items()) + " WHEN category IN ('spam', 'transfer', 'internal_transfer') THEN 'skip' WHEN category = 'trade' THEN CASE WHEN direction = 'out' THEN 'dispose' ELSE 'acquire' END WHEN category = 'fee' THEN 'dispose' ELSE 'none' END"


@query("k02_category_dispatch", f"WITH {LEDGER} SELECT category, direction, {_KIND} AS kind, count(*) AS n FROM ledger GROUP BY 1, 2, 3")
def k02(spark, sf_dir):
    c = F.col("category")
    kind = F.when(c.isin(*catalogue.SKIPPED), "skip")
    for name, cs in catalogue.KINDS.items():
        kind = kind.when(c.isin(*cs), name)
    kind = kind.when(c == "trade", F.when(F.col("direction") == "out", "dispose").otherwise("acquire")).when(c == "fee", "dispose").otherwise("none")
    return ledger(spark, sf_dir).groupBy("category", "direction", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("c03_swap_legs", f"""WITH {ONCHAIN}, s AS (SELECT id, k % 3 + 2 AS n, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS fee FROM onchain WHERE k IS NOT NULL)
 SELECT id, 'parent' AS leg_type, NULL AS token, 0 AS leg_index, n > 2 AS needs_review FROM s UNION ALL SELECT id, 'sell_leg', 't0', 0, false FROM s UNION ALL SELECT id, 'intermediate_leg_' || i, 't' || i, i::INT, true FROM s, range(1, 4) AS r(i) WHERE i < n - 1
 UNION ALL SELECT id, 'buy_leg', 't' || (n - 1), (n - 1)::INT, false FROM s UNION ALL SELECT id, 'fee_leg', NULL, n::INT, false FROM s WHERE fee > 0""")
def c03(spark, sf_dir):
    t = onchain(spark, sf_dir).filter("k is not null")
    tokens = F.transform(F.sequence(F.lit(0), (F.col("k") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return t.select("id", F.inline(legs(tokens, F.when(F.col("k") % 4 == 0, 1).otherwise(0))))


@query("c08_spam_score", f"WITH {CALLS}, s AS (SELECT id, CASE WHEN counterparty = 'meta-pool.near' THEN 0.99 ELSE least(1.0, CASE WHEN usd > 0 AND usd < 0.001 THEN 0.46 ELSE 0 END + CASE WHEN direction = 'in' AND usd > 0 AND usd < 0.001 THEN 0.46 ELSE 0 END + CASE WHEN starts_with(lower(tx_type), 'myst') THEN 0.46 ELSE 0 END) END::DOUBLE AS score FROM (SELECT *, CASE WHEN id % 5 > 0 THEN amount / 100000 END::DOUBLE AS usd FROM calls)) SELECT id, round(score, 2) AS score, score >= 0.9 AS is_spam FROM s")
def c08(spark, sf_dir):
    """One row in five has no price; a tag's token is told by how the type begins."""
    usd = F.when(F.col("id") % 5 > 0, F.col("amount").cast("double") / 100000)
    score = spam_score(F.col("counterparty") == "meta-pool.near", usd, F.col("direction"), F.lower("tx_type").startswith("myst"))
    return calls(spark, sf_dir).withColumn("s", score).select("id", F.round("s", 2).alias("score"), (F.col("s") >= SPAM_FROM).alias("is_spam"))


@query("c11_evm_selectors", f"WITH {CALLS} SELECT id, CASE WHEN length(x) = 10 THEN x END AS selector, CASE WHEN x IN ('0x38ed1739', '0xc04b8d59') THEN 'swap' WHEN x = '0xe8eda9df' THEN 'lending' WHEN x = '0xe8e33700' THEN 'lp' END AS kind FROM (SELECT id, lower(substr(selector || CASE WHEN selector LIKE '0x_%' THEN sha256(id::VARCHAR) ELSE '' END, 1, 10)) AS x FROM calls)")
def c11(spark, sf_dir):
    data = F.concat(F.col("selector"), F.when(F.col("selector").like("0x_%"), F.sha2(F.col("id").cast("string"), 256)).otherwise(""))
    s = selector_of(data)
    return calls(spark, sf_dir).select("id", s.alias("selector"), kind_of(s).alias("kind"))


@query("c12_packed_path", f"WITH {ONCHAIN}, p AS (SELECT id, substr(sha256(id::VARCHAR) || sha256((id + 1)::VARCHAR) || sha256((id + 2)::VARCHAR), 1, (40 + 46 * (id % 4))::INT) AS h, id % 4 AS hops FROM onchain) SELECT id, i AS hop, '0x' || substr(h, (46 * i + 1)::INT, 40) AS token FROM p, range(0, 4) AS r(i) WHERE i <= hops")
def c12(spark, sf_dir):
    sha = lambda n: F.sha2((F.col("id") + n).cast("string"), 256)
    h = F.substr(F.concat(sha(0), sha(1), sha(2)), F.lit(1), (40 + 46 * (F.col("id") % 4)).cast("int"))
    t = onchain(spark, sf_dir).select("id", F.posexplode(path_tokens(F.concat(F.lit("0x"), h))).alias("hop", "token"))
    return t.select("id", F.col("hop").cast("long").alias("hop"), "token")


@query("c05_group_by_base_hash", f"WITH {LEDGER}, h AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY b, c, units, value) AS k, kind FROM ledger) SELECT a, count(*) AS members, max(CASE WHEN k = 1 THEN kind END) = 'dispose' AS whole_group FROM h GROUP BY a")
def c05(spark, sf_dir):
    h = ledger(spark, sf_dir).withColumn("hash", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    base = F.split_part("hash", F.lit("-"), F.lit(1)).cast("long")
    return h.groupBy(base.alias("a")).agg(F.count("*").alias("members"), (F.min_by("kind", F.struct("b", "c", "units", "value")) == "dispose").alias("whole_group"))


@query("c17_swap_has_both_sides", f"WITH {LEDGER} SELECT a, b, c, category, max(CASE WHEN direction = 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY a) = 1 AND max(CASE WHEN direction = 'out' THEN 1 ELSE 0 END) OVER (PARTITION BY a) = 1 AS is_swap FROM ledger")
def c17(spark, sf_dir):
    w = Window.partitionBy("a")
    has = lambda x: F.max(F.when(F.col("direction") == x, 1).otherwise(0)).over(w) == 1
    return ledger(spark, sf_dir).select("a", "b", "c", "category", (has("in") & has("out")).alias("is_swap"))


@query("c19_guarded_reclassify", f"WITH {EXCHANGE} SELECT id, CASE WHEN priority = '1-URGENT' THEN tx_type WHEN id % 5 = 0 THEN 'revised' ELSE tx_type END AS category FROM exchange")
def c19(spark, sf_dir):
    e = exchange(spark, sf_dir)
    old = e.select("id", F.col("tx_type").alias("category"), (F.col("priority") == "1-URGENT").alias("confirmed"), F.lit(1).alias("version"))
    new = e.filter("id % 5 = 0").select("id", F.lit("revised").alias("category"), F.lit(False).alias("confirmed"), F.lit(2).alias("version"))
    return upsert(old, new, ["id"], "version", guard="confirmed").select("id", "category")


# -- joins in time, prices ---------------------------------------------------
@query("j05_first_after", f"WITH {ONCHAIN} SELECT l.id, coalesce(min(r.ts_s), -1) AS next_s FROM onchain l LEFT JOIN onchain r ON r.user_id = l.user_id AND r.event_type = 'purchase' AND r.ts_s > l.ts_s WHERE l.event_type = 'view' GROUP BY 1")
def j05(spark, sf_dir):
    t = onchain(spark, sf_dir)
    right = t.filter("event_type = 'purchase'").select("user_id", F.col("ts_s").alias("next_s"), F.lit(1).alias("one"))
    return asof_join(t.filter("event_type = 'view'").select("id", "user_id", "ts_s"), right, ["user_id"], "ts_s", "next_s", ["one"], "forward", exact=False).select("id", F.coalesce("next_s", F.lit(-1).cast("long")).alias("next_s"))


def _sides(spark, sf_dir, *keys):
    t = onchain(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100))
    side = lambda d, n: t.filter(F.col("direction") == d).select(*keys, "symbol", F.col("id").alias(f"{n}_id"), F.col("chain").alias(f"{n}_chain"), F.col("ts_s").alias(f"{n}_ts"), F.col("cents").alias(f"{n}_amount"))
    return side("out", "out"), side("in", "in")


PAIRS = f"{ONCHAIN}, x AS (SELECT *, round(value * 100) AS cents FROM onchain), pairs AS (SELECT o.user_id, o.id AS out_id, i.id AS in_id, round(1 - abs(i.cents - o.cents) / o.cents / 0.05 * 0.5 - abs(i.ts_s - o.ts_s) / 1800 * 0.5, 4) AS score FROM x o JOIN x i ON i.user_id = o.user_id AND o.direction = 'out' AND i.direction = 'in' AND i.chain <> o.chain AND i.ts_s - o.ts_s BETWEEN -1800 AND 1800 AND o.cents > 0 AND abs(i.cents - o.cents) / o.cents <= 0.05)"


@query("j07_cross_chain_pairs", f"WITH {PAIRS} SELECT user_id, out_id, in_id, score::DOUBLE AS score FROM pairs")
def j07(spark, sf_dir):
    """Transfers of one user on two chains, whatever their symbols."""
    out_, in_ = _sides(spark, sf_dir, "user_id")
    return candidates(out_.drop("symbol"), in_.drop("symbol"), ["user_id"], 1800, 5, both_ways=True).select("user_id", "out_id", "in_id", "score")


@query("j08_bridge_greedy")
def j08(spark, sf_dir):
    out_, in_ = _sides(spark, sf_dir, "user_id")
    on = ["user_id", "symbol"]
    return greedy(candidates(*runs(out_, in_, on, 1800), [*on, "run"], 1800, 1, both_ways=True, of="in"), [*on, "run"]).select(*on, "out_id", "in_id", "score")


# What two signals of an exchange entry and a transfer count, and how near in time the first two ask for.
SAME_TIME_AND_ASSET, SAME_TIME, SAME_DAY_AND_ASSET, MATCH_SECONDS = 0.85, 0.80, 0.60, 600


@query("j09_best_score", f"""WITH {ONCHAIN}, x AS (SELECT *, round(value * 100)::BIGINT AS cents FROM onchain), e AS (SELECT * FROM x WHERE event_type = 'purchase'), t AS (SELECT * FROM x WHERE event_type <> 'purchase'),
 p AS (SELECT e.id AS entry_id, t.id AS transfer_id, t.ts_s, abs(t.ts_s - e.ts_s) <= 600 AS soon, t.symbol = e.symbol AS same, t.ts::DATE = e.ts::DATE AS day
  FROM e JOIN t ON t.user_id = e.user_id AND CASE WHEN t.cents = 0 THEN e.cents = 0 ELSE 100 * abs(e.cents - t.cents) <= t.cents END),
 s AS (SELECT *, CASE WHEN soon AND same THEN 0.85 WHEN soon THEN 0.8 WHEN same AND day THEN 0.6 END::DOUBLE AS score FROM p)
 SELECT entry_id, transfer_id, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, ts_s, transfer_id) = 1""")
def j09(spark, sf_dir):
    """Of each exchange entry (here purchases) the transfer of the same user and, within 1 %, amount that agrees best in time, asset and day; the earliest of equals."""
    t = onchain(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    side = lambda test, n: t.filter(test).select("user_id", F.col("id").alias(f"{n}_id"), F.col("ts_s").alias(f"{n}_s"), F.col("symbol").alias(f"{n}_symbol"), F.col("cents").alias(f"{n}_cents"))
    entry, transfer = side("event_type = 'purchase'", "entry"), side("event_type <> 'purchase'", "transfer")
    day = lambda n: F.floor(F.col(f"{n}_s") / 86400)
    soon = range_join(entry, transfer, ["user_id"], "entry_s", "transfer_s", -MATCH_SECONDS, MATCH_SECONDS)
    same_day = entry.withColumn("day", day("entry")).join(transfer.withColumn("day", day("transfer")), ["user_id", "day"]).filter("entry_symbol = transfer_symbol").drop("day")
    close = F.when(F.col("transfer_cents") == 0, F.col("entry_cents") == 0).otherwise(100 * F.abs(F.col("entry_cents") - F.col("transfer_cents")) <= F.col("transfer_cents"))
    pairs = soon.withColumn("score", F.when(F.col("entry_symbol") == F.col("transfer_symbol"), SAME_TIME_AND_ASSET).otherwise(SAME_TIME)).unionByName(same_day.withColumn("score", F.lit(SAME_DAY_AND_ASSET)))
    return latest(pairs.filter(close), ["entry_id"], [F.desc("score"), F.col("transfer_s"), F.col("transfer_id")]).select("entry_id", "transfer_id", "score")


@query("j15_latest_of_two", f"WITH {EXCHANGE} SELECT c_custkey, j.id AS job, k.id AS cost FROM customer LEFT JOIN (SELECT user_id, max_by(id, (ts, id)) AS id FROM exchange WHERE tx_type = 'buy' GROUP BY 1) j ON j.user_id = c_custkey LEFT JOIN (SELECT user_id, max_by(id, (ts, id)) AS id FROM exchange WHERE tx_type = 'sell' GROUP BY 1) k ON k.user_id = c_custkey")
def j15(spark, sf_dir):
    top = lambda kind, n: exchange(spark, sf_dir).filter(F.col("tx_type") == kind).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("id", F.struct("ts", "id")).alias(n))
    return table(spark, sf_dir, "customer").select("c_custkey").join(top("buy", "job"), "c_custkey", "left").join(top("sell", "cost"), "c_custkey", "left")


@query("j20_nearest_price", f"WITH {ONCHAIN}, l AS (SELECT id, symbol, ts_s FROM onchain WHERE event_type = 'purchase'), p AS (SELECT symbol, ts_s AS price_s, round(value, 4) AS price FROM onchain WHERE event_type = 'click') SELECT l.id, (min((abs(price_s - ts_s), price_s, price)))[2] AS price_s, (min((abs(price_s - ts_s), price_s, price)))[3] AS price, (min((abs(price_s - ts_s), price_s, price)))[1] > 900 AS estimated FROM l JOIN p ON p.symbol = l.symbol AND abs(price_s - ts_s) <= 3600 GROUP BY 1")
def j20(spark, sf_dir):
    t = onchain(spark, sf_dir)
    prices = t.filter("event_type = 'click'").select("symbol", F.col("ts_s").alias("price_s"), F.round("value", 4).alias("price"))
    return minute_prices(t.filter("event_type = 'purchase'").select("id", "symbol", "ts_s"), prices, ["symbol"]).select("id", "price_s", "price", "estimated")


@query("j21_rate_lookback", f"""WITH {EXCHANGE}, r AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS d, round((sum(quantity) / count(*))::DOUBLE, 2) AS rate FROM exchange GROUP BY 1), q AS (SELECT id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM exchange WHERE tx_type = 'deposit')
 SELECT q.id, coalesce(max_by(r.rate, r.d), 1.36)::DOUBLE AS rate, count(r.d) = 0 AS estimated FROM q LEFT JOIN r ON r.d BETWEEN q.day - 5 AND q.day GROUP BY 1""")
def j21(spark, sf_dir):
    day = F.unix_date(F.to_date("ts"))
    e = exchange(spark, sf_dir)
    rates = e.groupBy(day.alias("rate_day")).agg(F.round(F.sum("quantity").cast("double") / F.count("*"), 2).alias("rate"))
    return with_rate(e.filter("tx_type = 'deposit'").select("id", day.alias("day")), rates).select("id", "rate", "estimated")


@query("j22_inventory_full_outer", f"WITH {LEDGER}, o AS (SELECT token, user_id, sum(value) AS v FROM ledger WHERE ts < TIMESTAMP '1996-01-01' GROUP BY 1, 2), q AS (SELECT token, user_id, sum(value) AS v FROM ledger WHERE year(ts) = 1996 AND kind = 'acquire' GROUP BY 1, 2), c AS (SELECT token, user_id, sum(value) AS v FROM ledger WHERE ts < TIMESTAMP '1997-01-01' AND units > 25 GROUP BY 1, 2) SELECT token, user_id, (coalesce(o.v, 0) + coalesce(q.v, 0) - coalesce(c.v, 0))::DOUBLE AS cogs FROM o FULL JOIN q USING (token, user_id) FULL JOIN c USING (token, user_id)")
def j22(spark, sf_dir):
    t = ledger(spark, sf_dir)
    part = lambda test, n: t.filter(test).groupBy("token", "user_id").agg(F.sum("value").alias(n))
    o, q, c = part("ts < timestamp '1996-01-01'", "o"), part("year(ts) = 1996 and kind = 'acquire'", "q"), part("ts < timestamp '1997-01-01' and units > 25", "c")
    z = lambda n: F.coalesce(n, F.lit(0))
    return o.join(q, ["token", "user_id"], "full").join(c, ["token", "user_id"], "full").select("token", "user_id", (z("o") + z("q") - z("c")).cast("double").alias("cogs"))


@query("j01_fourfold_left", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, c_mktsegment, p_brand, s_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000 LEFT JOIN part ON p_partkey = l_partkey AND p_size > 40 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def j01(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(t("customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(t("part").filter("p_size > 40").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "c_mktsegment", "p_brand", "s_name")


@query("j12_semi_and_anti", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def j12(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("orders").join(t("lineitem").filter("l_quantity > 45").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(t("customer").filter("c_acctbal < 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("prc01_two_sources", f"WITH {ONCHAIN}, p AS (SELECT id, CASE WHEN k % 7 = 0 THEN NULL ELSE value + 1 END AS a, CASE WHEN k % 5 = 0 THEN NULL ELSE k::DOUBLE + 1 END AS b FROM onchain) SELECT id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a - b) / least(a, b) <= 0.5 THEN (a + b) / 2 ELSE a END, 6) AS price FROM p")
def prc01(spark, sf_dir):
    a, b = F.when(F.col("k") % 7 == 0, None).otherwise(F.col("value") + 1), F.when(F.col("k") % 5 == 0, None).otherwise(F.col("k").cast("double") + 1)
    return onchain(spark, sf_dir).select("id", F.round(two_sources(a, b), 6).alias("price"))


@query("prc07_missing_days", f"""WITH {EXCHANGE}, h AS (SELECT DISTINCT asset, ts::DATE AS day FROM exchange), c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM h)
 SELECT asset, strftime(day, '%Y-%m-%d') AS day FROM (SELECT a.asset, c.day FROM (SELECT DISTINCT asset FROM h) a, c EXCEPT SELECT * FROM h)""")
def prc07(spark, sf_dir):
    e = exchange(spark, sf_dir)
    span = e.select(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    days = e.select("asset").distinct().join(F.broadcast(span)).select("asset", F.explode(F.sequence("first", "last")).alias("day"))  # span is one row
    return days.join(e.select("asset", F.to_date("ts").alias("day")).distinct(), ["asset", "day"], "left_anti").select("asset", F.date_format("day", "yyyy-MM-dd").alias("day"))


# -- verification ------------------------------------------------------------
TOLERANCE = {"near": 0.01, "ethereum": 0.0001, "polygon": 0.0001}


@query("v01_reconcile", f"WITH {ONCHAIN}, r AS (SELECT user_id, chain, round(sum(CASE WHEN direction = 'in' THEN round(value * 100)::BIGINT ELSE -round(value * 100)::BIGINT END) / 100, 2) AS replay, max_by(k, (ts_s, id)) AS actual FROM onchain GROUP BY 1, 2) SELECT user_id, chain, replay, actual, CASE WHEN actual IS NULL THEN 'unverified' WHEN abs(actual - replay) <= CASE chain WHEN 'near' THEN 0.01 ELSE 0.0001 END THEN 'resolved' ELSE 'open' END AS status FROM r")
def v01(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    r = onchain(spark, sf_dir).groupBy("user_id", "chain").agg(F.round(F.sum(F.when(F.col("direction") == "in", cents).otherwise(-cents)) / 100, 2).alias("replay"), F.max_by("k", F.struct("ts_s", "id")).alias("actual"))
    tolerance = F.element_at(F.create_map(*(F.lit(x) for kv in TOLERANCE.items() for x in kv)), F.col("chain"))
    status = F.when(F.col("actual").isNull(), "unverified").when(F.abs(F.col("actual") - F.col("replay")) <= tolerance, "resolved").otherwise("open")
    return r.select("user_id", "chain", "replay", "actual", status.alias("status"))


@query("v05_hash_duplicates", f"WITH {LEDGER} SELECT a, b, c, count(*) - 1 AS extra FROM ledger GROUP BY 1, 2, 3 HAVING count(*) > 1")
def v05(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("a", "b", "c").agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


# -- reports and sinks -------------------------------------------------------
@query("r03_ledger_report", f"WITH {EXCHANGE}, {ONCHAIN} SELECT strftime(ts, '%Y-%m-%d') AS day, 'chain' AS source, user_id, id AS ref, round(value, 4) AS amount FROM onchain UNION ALL SELECT strftime(ts, '%Y-%m-%d'), exchange, user_id, id, quantity::DOUBLE FROM exchange")
def r03(spark, sf_dir):
    both = onchain(spark, sf_dir).select("ts", F.lit("chain").alias("source"), "user_id", F.col("id").alias("ref"), F.round("value", 4).alias("amount")).unionByName(exchange(spark, sf_dir).select("ts", F.col("exchange").alias("source"), "user_id", F.col("id").alias("ref"), F.col("quantity").cast("double").alias("amount")))
    return both.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "source", "user_id", "ref", "amount")


@query("snk03_koinly_rows", f"WITH {EXCHANGE} SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS date, CASE WHEN tx_type = 'sell' THEN quantity::DECIMAL(18,8)::VARCHAR ELSE '' END AS sent, CASE WHEN tx_type = 'sell' THEN asset ELSE '' END AS sent_currency, CASE WHEN tx_type <> 'sell' THEN quantity::DECIMAL(18,8)::VARCHAR ELSE '' END AS received, CASE WHEN tx_type <> 'sell' THEN asset ELSE '' END AS received_currency FROM exchange")
def snk03(spark, sf_dir):
    from ..sources.sinks import koinly_rows

    return koinly_rows(exchange(spark, sf_dir).withColumn("direction", F.when(F.col("tx_type") == "sell", "out").otherwise("in")), "quantity", "asset").select("id", "date", "sent", "sent_currency", "received", "received_currency")


@query("snk14_weekly_consolidation", f"WITH {LEDGER} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, token, sum(units)::DOUBLE AS units FROM ledger WHERE category = 'reward' GROUP BY 1, 2")
def snk14(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return ledger(spark, sf_dir).filter("category = 'reward'").groupBy(week.alias("week"), "token").agg(F.sum("units").cast("double").alias("units"))


@query("src16_account_index", f"WITH {ONCHAIN} SELECT user_id AS account, ts_s // 3600 AS block FROM onchain GROUP BY ALL")
def src16(spark, sf_dir):
    return onchain(spark, sf_dir).select(F.col("user_id").alias("account"), F.floor(F.col("ts_s") / 3600).alias("block")).distinct()


@query("st03_session_window", f"WITH {ONCHAIN}, n AS (SELECT user_id, ts_s, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh, id FROM onchain), s AS (SELECT user_id, ts_s, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT user_id, min(ts_s) AS start_s, count(*) AS n FROM s GROUP BY user_id, k")
def st03(spark, sf_dir):
    w = onchain(spark, sf_dir).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


@query("st_tumbling_window", f"WITH {ONCHAIN} SELECT event_type, (ts_s // 900) * 900 AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM onchain GROUP BY 1, 2")
def st_tumbling(spark, sf_dir):
    w = onchain(spark, sf_dir).groupBy("event_type", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_timestamp("w.start").alias("start_s"), "n", "total")
