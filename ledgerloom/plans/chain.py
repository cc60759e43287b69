"""From rules over prices to pools: classified movements become events of several pools, which are replayed.

The stand-in data reads events as movements on chains and exchanges: their user and type are the account and the side, the running number picks
token, method and counterparty from short lists. Signups are also staking events, clicks lockup events and the prices of minutes; errors give the prices of days, and
the number of movements of a working day its rate of exchange.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import table
from ..operators import rule_catalogue as catalogue
from ..operators.decode import spam_score
from ..operators.events import pool_events
from ..operators.folds import replay
from ..operators.pipeline import classify_stages
from ..operators.superficial import denied_losses, into_later_cost
from ..scratch import Scratch
from .domain import _CATEGORY, _CONFIDENCE, _rule_sql, _sql_list
from .registry import query

TOKENS = ("NEAR", "ETH", "BTC", "USDC", "CAD", "ODDCOIN")
METHODS = ("deposit_and_stake", "unstake", "swap", "supply", "borrow", "add_liquidity", "claim", "ft_transfer", "near_deposit", "vote", "storage_deposit", None)
PARTIES = ("alpha.poolv1.near", "v2.ref-finance.near", "burrow.near", "system", "team.sputnikdao.near", "Bob.near", "x1.lockup.near", "gift-drop.near", "shop.near", None)
ACTIONS = ("TRANSFER", "FUNCTION_CALL", "TRANSFER", "CREATE_ACCOUNT")
TYPES = ("buy", "sale", "convert", "staking_reward", "send", "receive", "viban_purchase", "mystery")
SPAM_PARTY, SPAM_TOKEN, OWN_PARTY = "gift-drop.near", "odd", "bob.near"
_LISTS = {"token": (TOKENS, 2), "method_name": (METHODS, 7), "counterparty": (PARTIES, 3), "action_type": (ACTIONS, 11), "tx_type": (TYPES, 13)}
KEYS, ORDER = ["user_id", "token"], ["ts_s", "id", "leg_no"]


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, k = table(spark, sf_dir, "events"), F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.floor(i / n) % len(xs) + 1).cast("int"))
    t = e.select(
        i.alias("id"), "user_id", (F.col("user_id") * 10 + i % 2).alias("wallet_id"), F.concat(F.lit("h"), i.cast("string")).alias("tx_hash"), F.unix_timestamp("ts").alias("ts_s"), "event_type", k.alias("k"),
        F.when(F.col("event_type").isin("view", "purchase"), "out").otherwise("in").alias("direction"), F.when(i % 3 == 2, "exchange").otherwise("near").alias("chain"),
        F.col("value").cast("decimal(18,2)").alias("units"), (k % 5 * F.lit(Decimal("0.01"))).cast("decimal(18,2)").alias("fee"), *(pick(xs, n).alias(c) for c, (xs, n) in _LISTS.items()),
    )
    leg = lambda name, token, units: F.struct(F.lit(name).alias("leg_type"), token.alias("token"), units.cast("decimal(18,2)").alias("units"))
    bought = F.element_at(F.array(*map(F.lit, TOKENS)), ((F.floor(F.col("id") / 2) + 1) % len(TOKENS) + 1).cast("int"))
    legs = F.array(leg("sell_leg", F.col("token"), F.col("units")), leg("buy_leg", bought, (F.col("k") + 1) * F.lit(Decimal("0.25"))), leg("fee_leg", F.lit("NEAR"), F.col("fee") + F.lit(Decimal("0.01"))))
    legs = F.when(F.col("k") % 3 == 0, F.slice(legs, 1, 2)).when(F.col("k") % 3 == 1, legs)
    return t.withColumns({"legs": legs, "amount": F.col("units"), "selector": F.lit(None).cast("string"), "fmv_cad": F.when((F.col("chain") == "exchange") & (F.col("k") % 10 == 3), F.col("k") * F.lit(Decimal("0.5"))).cast("decimal(18,2)")})


def _linked_events(spark, sf_dir, event_type: str, offset: int) -> DataFrame:
    """Staking or lockup events: every second one has the movement's hash, the others lie k seconds after it."""
    t = movements(spark, sf_dir).filter(F.col("event_type") == event_type)
    fmv = ((F.col("k") % 40 + 10) * F.lit(Decimal("0.25"))).cast("decimal(18,2)")
    return t.select((F.col("id") + offset).alias("event_id"), "user_id", "wallet_id", F.when(F.col("k") % 2 == 0, F.col("tx_hash")).alias("tx_hash"), (F.col("ts_s") + F.col("k")).alias("event_s"), fmv.alias("fmv"), (F.col("units") + 1).cast("decimal(18,2)").alias("event_units"))


def staking(spark, sf_dir):
    return _linked_events(spark, sf_dir, "signup", 1_000_000_000)


def lockups(spark, sf_dir):
    return _linked_events(spark, sf_dir, "click", 2_000_000_000)


def classified(spark: SparkSession, sf_dir: str, chain: str) -> DataFrame:
    t = movements(spark, sf_dir).filter(F.col("chain") == chain)
    if chain == "exchange":
        return classify_stages(t, _owned(t).limit(0), catalogue.EXCHANGE)
    return classify_stages(t, _owned(t), catalogue.NEAR, staking(spark, sf_dir), lockups(spark, sf_dir), _spam())


def _spam():
    usd = F.when(F.col("id") % 5 > 0, F.col("units").cast("double") / 10000)
    return spam_score(F.lower("counterparty") == SPAM_PARTY, usd, F.col("direction"), F.lower("token").startswith(SPAM_TOKEN))


def _owned(t: DataFrame) -> DataFrame:
    return t.filter("user_id % 2 = 0").select("user_id", F.lit(OWN_PARTY).alias("account")).distinct()


def all_classified(spark, sf_dir):
    """Both pipelines in one pass: rules know their chain; only what is on chain can be spam, an own account's or linked."""
    on_chain = F.col("chain") == "near"
    t = movements(spark, sf_dir).withColumn("counterparty", F.when(on_chain, F.col("counterparty")))
    found = classify_stages(t, _owned(t), [*catalogue.NEAR, *catalogue.EXCHANGE], staking(spark, sf_dir), lockups(spark, sf_dir), F.when(on_chain, _spam()).otherwise(0.0))
    return found.withColumn("staking_event_id", F.when(on_chain, F.col("staking_event_id")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = movements(spark, sf_dir)
    s = staking(spark, sf_dir).select(F.col("event_id").alias("staking_event_id"), F.col("fmv").alias("staking_fmv"), F.col("event_units").alias("staking_units"))
    v = lockups(spark, sf_dir).select(F.col("event_id").alias("lockup_event_id"), F.col("fmv").alias("lockup_fmv"), F.col("event_units").alias("lockup_units"))
    moves = all_classified(spark, sf_dir).join(s, "staking_event_id", "left").join(v, "lockup_event_id", "left")
    day = F.floor(F.col("ts_s") / 86400)
    cents = lambda c: (c * 100).cast("long")
    daily = t.filter("event_type = 'error'").groupBy("token", day.alias("day")).agg((F.call_function("div", F.sum(cents(F.col("units"))), F.count("*")) * F.lit(Decimal("0.01"))).cast("decimal(18,2)").alias("usd"))
    minutes = t.filter("event_type = 'click'").select("token", F.col("ts_s").alias("price_s"), F.col("units").alias("price"))
    rates = t.groupBy(day.alias("rate_day")).agg(((F.count("*") % 100 * 10 + 13000) * F.lit(Decimal("0.0001"))).cast("decimal(8,4)").alias("rate")).filter((F.col("rate_day") + 4) % 7 % 6 != 0)
    return pool_events(moves, daily, minutes, rates)


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(events(spark, sf_dir), KEYS, ORDER)


# -- the same in SQL, from what the operators are to do ----------------------------
def _pick_sql(xs, n):
    return f"{_sql_list(xs)}[((event_id // {n}) % {len(xs)} + 1)::INT]"


_CASE = {chain: "CASE " + " ".join(f"WHEN {_rule_sql(r)} THEN '{r.name}'" for r in sorted(rules, key=lambda r: -r.priority)) + " END" for chain, rules in (("near", catalogue.NEAR), ("exchange", catalogue.EXCHANGE))}
_LINK = """{n}_at AS (SELECT w.id, coalesce((SELECT max(e.event_id) FROM {n} e WHERE e.user_id = w.user_id AND e.wallet_id = w.wallet_id AND e.tx_hash = w.tx_hash),
  (SELECT min_by(e.event_id, (e.event_s, e.event_id)) FROM {n} e WHERE e.user_id = w.user_id AND e.wallet_id = w.wallet_id AND e.event_s BETWEEN w.ts_s - 60 AND w.ts_s + 60)) AS event_id FROM decided w WHERE {test})"""
STAGES = f"""mv AS (SELECT event_id AS id, user_id, user_id * 10 + event_id % 2 AS wallet_id, 'h' || event_id AS tx_hash, (epoch_us(ts) // 1000000)::BIGINT AS ts_s, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'out' ELSE 'in' END AS direction, CASE WHEN event_id % 3 = 2 THEN 'exchange' ELSE 'near' END AS chain, value::DECIMAL(18,2) AS units, NULL AS selector, false AS is_own,
  {', '.join(f'{_pick_sql(xs, n)} AS {c}' for c, (xs, n) in _LISTS.items())}, {_pick_sql(TOKENS[1:] + TOKENS[:1], 2)} AS next_token FROM events),
t AS (SELECT *, (k % 5 * 0.01)::DECIMAL(18,2) AS fee, units AS amount, CASE WHEN chain = 'exchange' AND k % 10 = 3 THEN (k * 0.5)::DECIMAL(18,2) END AS fmv_cad FROM mv),
ruled AS (SELECT *, CASE WHEN chain = 'near' THEN {_CASE['near']} ELSE {_CASE['exchange']} END AS hit, chain = 'near' AND user_id % 2 = 0 AND coalesce(lower(counterparty) = '{OWN_PARTY}', false) AS owner,
  CASE WHEN chain <> 'near' THEN 0 WHEN lower(counterparty) = '{SPAM_PARTY}' THEN 0.99 ELSE CASE WHEN id % 5 > 0 AND units > 0 AND units < 10 THEN CASE WHEN direction = 'in' THEN 0.92 ELSE 0.46 END ELSE 0 END + CASE WHEN starts_with(lower(token), '{SPAM_TOKEN}') THEN 0.46 ELSE 0 END END AS spam FROM t),
decided AS (SELECT *, CASE WHEN spam >= 0.9 THEN 'spam' WHEN owner THEN 'own' WHEN hit IS NULL THEN 'fallback' ELSE 'rule' END AS stage,
  CASE WHEN spam >= 0.9 THEN 'spam' WHEN owner THEN CASE WHEN direction = 'in' THEN 'transfer_in' ELSE 'transfer_out' END ELSE coalesce({_CATEGORY}[hit], 'unknown') END AS category,
  CASE WHEN spam >= 0.9 THEN least(1.0, spam) WHEN owner THEN 0.95 ELSE coalesce({_CONFIDENCE}[hit], 0.3) END::DOUBLE AS confidence FROM ruled),
staking AS (SELECT id + 1000000000 AS event_id, user_id, wallet_id, CASE WHEN k % 2 = 0 THEN tx_hash END AS tx_hash, ts_s + k AS event_s, ((k % 40 + 10) * 0.25)::DECIMAL(18,2) AS fmv, (units + 1)::DECIMAL(18,2) AS event_units FROM t WHERE event_type = 'signup'),
lockups AS (SELECT id + 2000000000 AS event_id, user_id, wallet_id, CASE WHEN k % 2 = 0 THEN tx_hash END AS tx_hash, ts_s + k AS event_s, ((k % 40 + 10) * 0.25)::DECIMAL(18,2) AS fmv, (units + 1)::DECIMAL(18,2) AS event_units FROM t WHERE event_type = 'click'),
{_LINK.format(n='staking', test="chain = 'near' AND category = 'reward' AND stage IN ('rule', 'fallback')")},
{_LINK.format(n='lockups', test="chain = 'near' AND lower(counterparty) LIKE '%.lockup.near' AND category IN ('income', 'reward', 'deposit') AND stage IN ('rule', 'fallback')")},
classified AS (SELECT d.*, CASE WHEN stage = 'rule' THEN hit END AS rule, stage IN ('rule', 'fallback') AND confidence < 0.9 AS needs_review, s.event_id AS staking_event_id, l.event_id AS lockup_event_id FROM decided d LEFT JOIN staking_at s USING (id) LEFT JOIN lockups_at l USING (id))"""
_STAGE_COLUMNS = "id, stage, rule, category, confidence, needs_review"


@query("c04_near_pipeline", f"WITH {STAGES} SELECT {_STAGE_COLUMNS}, staking_event_id, lockup_event_id FROM classified WHERE chain = 'near'")
def c04(spark, sf_dir):
    """Spam, own accounts, rules, the fallback, then the links to staking and lockup events; with the stage that decided."""
    return classified(spark, sf_dir, "near").select(*_STAGE_COLUMNS.split(", "), "staking_event_id", "lockup_event_id").withColumn("confidence", F.col("confidence").cast("double"))


@query("c06_exchange_pipeline", f"WITH {STAGES} SELECT {_STAGE_COLUMNS} FROM classified WHERE chain = 'exchange'")
def c06(spark, sf_dir):
    """Exchange rows: rules, then the fallback."""
    return classified(spark, sf_dir, "exchange").select(*_STAGE_COLUMNS.split(", ")).withColumn("confidence", F.col("confidence").cast("double"))


_IN = lambda kind: "(" + ", ".join(f"'{c}'" for c in catalogue.KINDS[kind]) + ")"
EVENTS = f"""{STAGES},
days AS (SELECT token, ts_s // 86400 AS day, ((sum(units * 100)::BIGINT // count(*)) * 0.01)::DECIMAL(18,2) AS usd FROM t WHERE event_type = 'error' GROUP BY 1, 2),
rates AS (SELECT ts_s // 86400 AS rate_day, ((count(*) % 100 * 10 + 13000) * 0.0001)::DECIMAL(8,4) AS rate FROM t GROUP BY 1 HAVING ((ts_s // 86400) + 4) % 7 NOT IN (0, 6)),
fx AS (SELECT d.day, coalesce(max_by(r.rate, r.rate_day), 1.36)::DECIMAL(8,4) AS rate FROM (SELECT DISTINCT ts_s // 86400 AS day FROM t) d LEFT JOIN rates r ON r.rate_day BETWEEN d.day - 5 AND d.day GROUP BY 1),
x AS (SELECT c.*, s.fmv AS s_fmv, s.event_units AS s_units, l.fmv AS l_fmv, l.event_units AS l_units, k % 3 < 2 AS swap FROM classified c LEFT JOIN staking s ON s.event_id = c.staking_event_id LEFT JOIN lockups l ON l.event_id = c.lockup_event_id),
kinds AS (SELECT *, CASE WHEN category IN {_IN('acquire')} THEN 'acquire' WHEN category IN {_IN('dispose')} THEN CASE WHEN swap THEN 'swap' ELSE 'dispose' END WHEN category = 'trade' THEN CASE WHEN swap THEN 'swap' WHEN direction = 'out' THEN 'dispose' ELSE 'acquire' END
  WHEN category = 'fee' THEN 'fee' WHEN category IN {_IN('in')} THEN 'in' WHEN category IN {_IN('out')} THEN 'out' END AS way FROM x),
claims AS (
 SELECT id, 0 AS leg_no, 'whole' AS leg, user_id, ts_s, category, token, CASE way WHEN 'fee' THEN 'dispose' ELSE way END AS kind, CASE WHEN way = 'acquire' AND s_fmv IS NOT NULL THEN s_units WHEN way = 'acquire' AND l_fmv IS NOT NULL THEN l_units WHEN way = 'fee' AND fee > 0 THEN fee ELSE units END AS units,
  CASE WHEN way = 'dispose' THEN fee ELSE 0 END AS fee_units, way = 'dispose' AS upgrade, way IN ('acquire', 'dispose') AS priced, CASE WHEN way = 'acquire' THEN coalesce(s_fmv, l_fmv, fmv_cad) ELSE coalesce(fmv_cad, s_fmv, l_fmv) END AS known,
  CASE WHEN way = 'acquire' THEN CASE WHEN s_fmv IS NOT NULL THEN 'staking' WHEN l_fmv IS NOT NULL THEN 'vesting' ELSE 'airdrop' END END AS source_type FROM kinds WHERE way <> 'swap'
 UNION ALL SELECT id, 0, 'sell_leg', user_id, ts_s, category, token, 'dispose', units, 0, true, true, NULL, NULL FROM kinds WHERE way = 'swap'
 UNION ALL SELECT id, 1, 'buy_leg', user_id, ts_s, category, next_token, 'acquire', ((k + 1) * 0.25)::DECIMAL(18,2), 0, false, true, NULL, NULL FROM kinds WHERE way = 'swap'
 UNION ALL SELECT id, 2, 'fee_leg', user_id, ts_s, category, 'NEAR', 'fee', (fee + 0.01)::DECIMAL(18,2), 0, false, true, NULL, NULL FROM kinds WHERE way = 'swap' AND k % 3 = 1),
asked AS (SELECT q.*, fx.rate, (CASE WHEN q.token = 'USDC' THEN 1 ELSE d.usd END * fx.rate)::DECIMAL(24,6) AS day_cad FROM claims q JOIN fx ON fx.day = q.ts_s // 86400 LEFT JOIN days d ON d.token = q.token AND d.day = q.ts_s // 86400 WHERE q.priced),
want AS (SELECT *, known IS NULL AND token <> 'CAD' AND (day_cad IS NULL OR (upgrade AND units * day_cad > 500)) AS wanted FROM asked),
near_price AS (SELECT w.id, w.leg_no, min({{'gap': abs(m.ts_s - w.ts_s), 'at': m.ts_s, 'v': m.units}}) AS b FROM want w JOIN t m ON m.event_type = 'click' AND m.token = w.token AND m.ts_s BETWEEN w.ts_s - 3600 AND w.ts_s + 3600 WHERE w.wanted AND w.token <> 'USDC' GROUP BY 1, 2),
found AS (SELECT w.*, CASE WHEN wanted THEN (CASE WHEN token = 'USDC' THEN 1 ELSE n.b.v END * rate)::DECIMAL(24,6) END AS minute_cad, n.b.gap AS gap FROM want w LEFT JOIN near_price n USING (id, leg_no)),
priced AS (SELECT *, CASE WHEN known IS NOT NULL THEN 'known' WHEN token = 'CAD' THEN 'fiat' WHEN minute_cad IS NOT NULL THEN 'minute' WHEN day_cad IS NOT NULL THEN 'daily' END AS tier FROM found),
valued AS (SELECT id, leg_no, leg, user_id, token, ts_s, category, kind, units, fee_units, CASE tier WHEN 'known' THEN known WHEN 'fiat' THEN 1 WHEN 'minute' THEN minute_cad WHEN 'daily' THEN day_cad END::DECIMAL(24,6) AS price_cad, tier,
  CASE WHEN tier IN ('known', 'fiat') THEN false WHEN tier = 'minute' THEN coalesce(gap > 900, false) ELSE true END AS estimated, source_type FROM priced
 UNION ALL SELECT id, leg_no, leg, user_id, token, ts_s, category, kind, units, fee_units, NULL, NULL, false, source_type FROM claims WHERE NOT priced),
ev0 AS (SELECT *, (units * 100)::HUGEINT * (coalesce(price_cad, 0) * 1000000)::HUGEINT AS v, (fee_units * 100)::HUGEINT * (coalesce(price_cad, 0) * 1000000)::HUGEINT AS fx FROM valued),
ev AS (SELECT e.* EXCLUDE (fx), CASE WHEN e.leg = 'buy_leg' THEN coalesce(f.v, 0) ELSE e.fx END AS x FROM ev0 e LEFT JOIN ev0 f ON f.id = e.id AND f.kind = 'fee' WHERE e.kind <> 'fee')"""
_E8 = "100000000::HUGEINT"
POOLS = f"""{EVENTS},
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, token ORDER BY ts_s, id, leg_no) AS rn, (units * 100)::HUGEINT * 1000000 AS u FROM ev),
f AS (SELECT user_id, token, 0::BIGINT AS rn, 0::HUGEINT AS su, 0::HUGEINT AS sc, 0::HUGEINT AS used, 0::HUGEINT AS gain, 0::HUGEINT AS gone, false AS review FROM ev GROUP BY 1, 2
 UNION ALL SELECT user_id, token, rn, CASE WHEN kind IN ('acquire', 'in') THEN su + u ELSE greatest(0, su - u) END, CASE kind WHEN 'acquire' THEN sc + v + x WHEN 'dispose' THEN CASE WHEN u >= su THEN 0 ELSE sc - uc END ELSE sc END,
  CASE WHEN kind = 'dispose' THEN uc ELSE 0 END, CASE WHEN kind = 'dispose' THEN v - x - uc ELSE 0 END, CASE WHEN kind = 'dispose' THEN least(u, su) ELSE 0 END, kind = 'dispose' AND u > su
 FROM (SELECT e.*, f.su, f.sc, CASE WHEN f.su > 0 THEN (2 * least(e.u, f.su) * ((2 * f.sc * {_E8} + f.su) // (2 * f.su)) + {_E8}) // (2 * {_E8}) ELSE 0 END AS uc FROM f JOIN e ON e.user_id = f.user_id AND e.token = f.token AND e.rn = f.rn + 1)),
g AS (SELECT e.*, f.su, f.sc, f.used, f.gain, f.gone, f.review FROM f JOIN e USING (user_id, token, rn))"""


def dollars(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


@query("k02_events", f"WITH {EVENTS} SELECT id, leg_no, leg, user_id, token, category, kind, units::DOUBLE AS units, source_type FROM ev")
def k02_events(spark, sf_dir):
    """Which pools each classified movement moves, and how."""
    return events(spark, sf_dir).select("id", "leg_no", "leg", "user_id", "token", "category", "kind", *dollars("units"), "source_type")


@query("k03_income_rows", f"WITH {EVENTS} SELECT id, user_id, token, source_type, units::DOUBLE AS units, coalesce(price_cad, 0)::DOUBLE AS fmv_cad_per_unit, (v / 1e8)::DOUBLE AS income_cad, tier FROM ev WHERE source_type IS NOT NULL")
def k03(spark, sf_dir):
    """Income: units of the staking or lockup event where there is one, at its price, else at the resolved one."""
    e = events(spark, sf_dir).filter("source_type is not null")
    return e.select("id", "user_id", "token", "source_type", *dollars("units"), F.coalesce(F.col("price_cad").cast("double"), F.lit(0.0)).alias("fmv_cad_per_unit"), F.col("value").cast("double").alias("income_cad"), "tier")


@query("k04_disposal_values", f"WITH {EVENTS} SELECT id, leg_no, token, units::DOUBLE AS units, price_cad::DOUBLE AS price_cad, tier, estimated, (v / 1e8)::DOUBLE AS proceeds, (x / 1e8)::DOUBLE AS fee FROM ev WHERE kind = 'dispose'")
def k04(spark, sf_dir):
    """Disposals at the day's price, above 500 at the nearest minute's; fees go without proceeds."""
    e = events(spark, sf_dir).filter("kind = 'dispose'")
    return e.select("id", "leg_no", "token", *dollars("units", "price_cad"), "tier", "estimated", F.col("value").cast("double").alias("proceeds"), *dollars("fee"))


_SNAP = "id, leg_no, leg, user_id, token, kind, units::DOUBLE AS units, (su / 1e8)::DOUBLE AS units_after, (sc / 1e8)::DOUBLE AS cost_after, (used / 1e8)::DOUBLE AS cost_used, (gain / 1e8)::DOUBLE AS gain, review AS needs_review"


def _snapshot(df: DataFrame, *more: str) -> DataFrame:
    oversold = F.col("needs_review") & (F.col("kind") == "dispose")
    return df.select("id", "leg_no", "leg", "user_id", "token", "kind", *dollars("units", "units_after", "cost_after", "cost_used", "gain"), oversold.alias("needs_review"), *dollars(*more))


@query("k05_swap_pools", f"WITH RECURSIVE {POOLS} SELECT {_SNAP}, (x / 1e8)::DOUBLE AS fee FROM g WHERE leg <> 'whole'")
def k05(spark, sf_dir):
    """Both pools of each swap: the sell leg leaves one, the buy leg enters another with the fee leg's worth in its cost."""
    return _snapshot(pools(spark, sf_dir).filter("leg <> 'whole'"), "fee")


@query("k06_units_only", f"WITH RECURSIVE {POOLS} SELECT {_SNAP} FROM g WHERE kind IN ('in', 'out')")
def k06(spark, sf_dir):
    """Movements that aren't taxed change a pool's units, not below zero, and leave its cost."""
    return _snapshot(pools(spark, sf_dir).filter("kind in ('in', 'out')"))


@query("k09_chain_ledger", f"WITH RECURSIVE {POOLS} SELECT id, leg_no, user_id, token, strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d') AS disposal_date, (gone / 1e8)::DOUBLE AS units_disposed, ((v - x) / 1e8)::DOUBLE AS net_proceeds, (used / 1e8)::DOUBLE AS acb_used, (x / 1e8)::DOUBLE AS fees, (gain / 1e8)::DOUBLE AS gain, estimated, review AS needs_review FROM g WHERE kind = 'dispose'")
def k09_chain(spark, sf_dir):
    """The ledger of disposals at the end of the chain; an oversold one disposes of what was held."""
    p = pools(spark, sf_dir)
    before = F.coalesce(F.lag("units_after").over(Window.partitionBy(*KEYS).orderBy(*ORDER)), F.lit(0))
    p = p.withColumn("gone", F.least(F.col("units"), before)).filter("kind = 'dispose'")
    return p.select(
        "id", "leg_no", "user_id", "token", F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd").alias("disposal_date"), F.col("gone").cast("double").alias("units_disposed"), (F.col("value") - F.col("fee")).cast("double").alias("net_proceeds"),
        F.col("cost_used").cast("double").alias("acb_used"), F.col("fee").cast("double").alias("fees"), *dollars("gain"), "estimated", "needs_review",
    )


# -- superficial losses on the chain's pools ----------------------------------------
LOSSES = f"""{POOLS},
loss AS (SELECT l.*, (SELECT coalesce(sum(r.u), 0) FROM g r WHERE r.user_id = l.user_id AND r.token = l.token AND r.kind = 'acquire' AND r.ts_s BETWEEN l.ts_s - 2592000 AND l.ts_s + 2592000 AND NOT (l.leg <> 'whole' AND r.leg <> 'whole' AND r.id = l.id)) AS ru FROM g l WHERE l.kind = 'dispose' AND l.gain < 0),
rated AS (SELECT *, CASE WHEN gone > 0 THEN (2 * least(ru, gone) * {_E8} + gone) // (2 * gone) ELSE 0 END AS ratio8 FROM loss WHERE ru > 0),
denied AS (SELECT *, (2 * (-gain) * ratio8 + 100000000000000::HUGEINT) // (2 * 100000000000000::HUGEINT) AS denied100 FROM rated)"""


def _chain_losses(spark, sf_dir):
    """The chain's snapshots, written once, and its losses with what is denied of them."""
    snaps = Scratch(spark, "chain").save(pools(spark, sf_dir))
    before = F.coalesce(F.lag("units_after").over(Window.partitionBy(*KEYS).orderBy(*ORDER)), F.lit(0))
    swap = F.when(F.col("leg") != "whole", F.col("id"))
    sold = snaps.withColumn("gone", F.least(F.col("units"), before)).filter("kind = 'dispose' and gain < 0").select("id", "leg_no", *KEYS, "ts_s", F.col("gone").alias("units"), "gain", swap.alias("parent"))
    bought = snaps.filter("kind = 'acquire'").select(*KEYS, F.col("ts_s").alias("buy_s"), F.col("units").alias("bought"), swap.alias("parent"))
    return snaps, denied_losses(sold, bought, KEYS, "parent").filter("rebought > 0")


@query("k15_chain_superficial", f"WITH RECURSIVE {LOSSES} SELECT id, leg_no, user_id, token, (gain / 1e8)::DOUBLE AS gain, (ru / 1e8)::DOUBLE AS rebought, (ratio8 / 1e8)::DOUBLE AS ratio, (denied100 / 100)::DOUBLE AS denied FROM denied")
def k15_chain(spark, sf_dir):
    """Losses near purchases of the same token, of whatever source, but not the other leg of the same swap."""
    return _chain_losses(spark, sf_dir)[1].select("id", "leg_no", *KEYS, *dollars("gain", "rebought", "ratio", "denied"))


@query("k16_chain_later_cost", f"""WITH RECURSIVE {LOSSES}, hit AS (SELECT d.denied100, (SELECT min_by((g.id, g.leg_no), (g.ts_s, g.id, g.leg_no)) FROM g WHERE g.user_id = d.user_id AND g.token = d.token AND g.kind = 'acquire' AND g.ts_s > d.ts_s) AS k FROM denied d),
sums AS (SELECT k[1] AS id, k[2] AS leg_no, sum(denied100) AS added, count(*) AS losses FROM hit WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT g.id, g.leg_no, user_id, token, losses, (added / 100)::DOUBLE AS added, ((sc + added * 1000000) / 1e8)::DOUBLE AS cost_after, (((2 * (sc + added * 1000000) * {_E8} + su) // (2 * su)) / 1e8)::DOUBLE AS acb_per_unit FROM sums JOIN g USING (id, leg_no)""")
def k16_chain(spark, sf_dir):
    """What is denied enters the cost of the first later acquisition, and its cost a unit."""
    snaps, denied = _chain_losses(spark, sf_dir)
    out = into_later_cost(snaps, denied, KEYS, ORDER)
    return out.select("id", "leg_no", *KEYS, "losses", *dollars("added", "cost_after", "acb_per_unit"))
