"""Cost basis, gains, superficial losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import LEDGER, ORDER, ledger
from ..operators.folds import replay
from ..operators.joins import asof_join
from ..operators.lots import cut_pieces, positions
from ..operators.superficial import denied_losses
from ..scratch import Scratch
from .registry import query

KEYS = ["user_id", "token"]
_MONTH = 30 * 86400  # as operators.superficial has it

_E8 = "100000000::HUGEINT"
FOLD = f"""{LEDGER},
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, token ORDER BY ts, a, b, c, units, value) AS rn, (units * 100)::HUGEINT * 1000000 AS u, (value * 100)::HUGEINT * 1000000 AS v, (fee * 10000)::HUGEINT * 10000 AS x FROM ledger),
f AS (
 SELECT user_id, token, 0::BIGINT AS rn, 0::HUGEINT AS su, 0::HUGEINT AS sc, 0::HUGEINT AS used, 0::HUGEINT AS gain, 0::HUGEINT AS sold, false AS review FROM ledger GROUP BY user_id, token
 UNION ALL
 SELECT user_id, token, rn, CASE WHEN kind = 'acquire' THEN su + u ELSE su - least(u, su) END, CASE WHEN kind = 'acquire' THEN sc + v + x WHEN u >= su THEN 0 ELSE sc - uc END,
  CASE WHEN kind = 'acquire' THEN 0 ELSE uc END, CASE WHEN kind = 'acquire' THEN 0 ELSE v - x - uc END, CASE WHEN kind = 'acquire' THEN 0 ELSE least(u, su) END, kind = 'dispose' AND u > su
 FROM (SELECT e.*, f.su, f.sc, CASE WHEN f.su > 0 THEN (2 * least(e.u, f.su) * ((2 * f.sc * {_E8} + f.su) // (2 * f.su)) + {_E8}) // (2 * {_E8}) ELSE 0 END AS uc
   FROM f JOIN e ON e.user_id = f.user_id AND e.token = f.token AND e.rn = f.rn + 1)),
g AS (SELECT e.*, f.su, f.sc, f.used, f.gain, f.sold, f.review FROM f JOIN e USING (user_id, token, rn))"""


def snapshots(spark: SparkSession, sf_dir: str, method: str = "acb") -> DataFrame:
    return replay(ledger(spark, sf_dir), KEYS, ORDER, method)


def disposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).filter("kind = 'dispose'").withColumn("tax_year", F.year("ts"))


def money(c):
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


@query("k01_acb_pool", f"WITH RECURSIVE {FOLD} SELECT user_id, token, ts, a, b, c, kind, (su / 1e8)::DOUBLE AS units_after, (sc / 1e8)::DOUBLE AS cost_after, (used / 1e8)::DOUBLE AS cost_used, (gain / 1e8)::DOUBLE AS gain, review AS needs_review FROM g")
def k01(spark, sf_dir):
    return snapshots(spark, sf_dir).select("user_id", "token", "ts", "a", "b", "c", "kind", *(money(x).alias(x) for x in ("units_after", "cost_after", "cost_used", "gain")), "needs_review")


@query("k07_pool_violations", f"WITH RECURSIVE {FOLD} SELECT user_id, token, count(*) AS events, count(*) FILTER (review) AS oversold, count(*) FILTER (su < 0 OR sc < 0 OR (su = 0 AND sc <> 0)) AS broken FROM g GROUP BY user_id, token")
def k07(spark, sf_dir):
    broken = (F.col("units_after") < 0) | (F.col("cost_after") < 0) | ((F.col("units_after") == 0) & (F.col("cost_after") != 0))
    return snapshots(spark, sf_dir).groupBy("user_id", "token").agg(F.count("*").alias("events"), F.count_if("needs_review").alias("oversold"), F.count_if(broken).alias("broken"))


@query("k09_disposal_ledger", f"WITH RECURSIVE {FOLD} SELECT user_id, token, strftime(ts, '%Y-%m-%d') AS disposal_date, year(ts)::INT AS tax_year, a, b, c, units::DOUBLE AS units, value::DOUBLE AS proceeds, fee::DOUBLE AS fees, (gain / 1e8)::DOUBLE AS gain, review AS needs_review FROM g WHERE kind = 'dispose'")
def k09(spark, sf_dir):
    d = disposals(spark, sf_dir)
    return d.select("user_id", "token", F.date_format("ts", "yyyy-MM-dd").alias("disposal_date"), "tax_year", "a", "b", "c", money("units").alias("units"), money("value").alias("proceeds"), money("fee").alias("fees"), money("gain").alias("gain"), "needs_review")


def stored_disposals(spark, sf_dir) -> DataFrame:
    """The fold's disposals, written once for all that reads them."""
    kept = replay(ledger(spark, sf_dir).select(*KEYS, *ORDER, "ts_s", "kind", "fee"), KEYS, ORDER).filter("kind = 'dispose'").withColumn("tax_year", F.year("ts"))
    kept = kept.select(*KEYS, "ts_s", "ts", "a", "b", "c", "units", "value", "fee", "cost_used", "gain", "needs_review", "tax_year")
    return Scratch(spark, "disposals").save(kept)


def superficial(spark, sf_dir, sold: DataFrame | None = None) -> DataFrame:
    """Losses with what was bought of the same token within 30 days before or after, and the part denied."""
    losses = (stored_disposals(spark, sf_dir) if sold is None else sold).filter("gain < 0")
    buys = ledger(spark, sf_dir).filter("kind = 'acquire'")
    return denied_losses(losses, buys.select(*KEYS, F.col("ts_s").alias("buy_s"), F.col("units").alias("bought")), KEYS).filter("rebought > 0")


SUPERFICIAL = f"""{FOLD},
s AS (SELECT l.user_id, l.token, l.rn, l.ts, l.ts_s, l.a, l.b, l.c, l.units, l.value, l.u, l.gain, sum(r.u) AS ru, sum(r.units) AS rebought FROM g l JOIN ledger_buys r ON r.user_id = l.user_id AND r.token = l.token AND r.ts_s BETWEEN l.ts_s - {_MONTH} AND l.ts_s + {_MONTH} WHERE l.kind = 'dispose' AND l.gain < 0 GROUP BY ALL),
sl AS (SELECT *, (2 * least(ru, u) * {_E8} + u) // (2 * u) AS ratio8 FROM s),
sd AS (SELECT *, (2 * (-gain) * ratio8 + 100000000000000::HUGEINT) // (2 * 100000000000000::HUGEINT) AS denied100 FROM sl)""".replace("e AS (SELECT *", "ledger_buys AS (SELECT user_id, token, ts_s, units, (units * 100)::HUGEINT * 1000000 AS u FROM ledger WHERE kind = 'acquire'),\ne AS (SELECT *", 1)


@query("a02_capital_gains_by_token", f"""WITH RECURSIVE {SUPERFICIAL}, denied AS (SELECT year(ts)::INT AS tax_year, token, count(*) AS n, (sum(denied100) / 100)::DOUBLE AS denied FROM sd GROUP BY 1, 2),
t AS (SELECT year(ts)::INT AS tax_year, token, count(*) AS disposals, round((sum(value))::DOUBLE, 2) AS proceeds, round((sum(used) / 1e8)::DOUBLE, 2) AS acb_used, round((sum(fee))::DOUBLE, 2) AS fees,
 round((sum(gain) / 1e8)::DOUBLE, 2) AS net_gain, round((sum(CASE WHEN gain > 0 THEN gain ELSE 0 END) / 1e8)::DOUBLE, 2) AS gains, round((sum(CASE WHEN gain < 0 THEN gain ELSE 0 END) / 1e8)::DOUBLE, 2) AS losses, count(*) FILTER (review) AS flagged FROM g WHERE kind = 'dispose' GROUP BY 1, 2)
SELECT t.*, coalesce(n, 0) AS superficial, coalesce(denied, 0)::DOUBLE AS denied FROM t LEFT JOIN denied USING (tax_year, token)""")
def a02(spark, sf_dir):
    """By year and token; the fold is written once and read for the totals and for the superficial losses."""
    gain, sold = F.col("gain"), stored_disposals(spark, sf_dir)
    totals = sold.groupBy("tax_year", "token").agg(
        F.count("*").alias("disposals"), F.round(money(F.sum("value")), 2).alias("proceeds"), F.round(money(F.sum("cost_used")), 2).alias("acb_used"), F.round(money(F.sum("fee")), 2).alias("fees"), F.round(money(F.sum("gain")), 2).alias("net_gain"),
        F.round(money(F.sum(F.when(gain > 0, gain).otherwise(0))), 2).alias("gains"), F.round(money(F.sum(F.when(gain < 0, gain).otherwise(0))), 2).alias("losses"), F.count_if("needs_review").alias("flagged"),
    )
    denied = superficial(spark, sf_dir, sold).groupBy("tax_year", "token").agg(F.count("*").alias("superficial"), money(F.sum("denied")).alias("denied"))
    return totals.join(denied, ["tax_year", "token"], "left").withColumns({"superficial": F.coalesce("superficial", F.lit(0)), "denied": F.coalesce("denied", F.lit(0.0))})


@query("a03_capital_gains_summary", f"""WITH RECURSIVE {SUPERFICIAL}, denied AS (SELECT year(ts)::INT AS tax_year, count(*) AS n, (sum(denied100) / 100)::DOUBLE AS denied FROM sd GROUP BY 1),
t AS (SELECT year(ts)::INT AS tax_year, round((sum(CASE WHEN gain > 0 THEN gain ELSE 0 END) / 1e8)::DOUBLE, 2) AS total_gains, round((sum(CASE WHEN gain < 0 THEN -gain ELSE 0 END) / 1e8)::DOUBLE, 2) AS total_losses, round((sum(gain) / 1e8)::DOUBLE, 2) AS net, round((sum(gain) / 2e8)::DOUBLE, 2) AS taxable FROM g WHERE kind = 'dispose' GROUP BY 1)
SELECT t.*, coalesce(n, 0) AS superficial, coalesce(denied, 0)::DOUBLE AS denied FROM t LEFT JOIN denied USING (tax_year)""")
def a03(spark, sf_dir):
    gain, sold = F.col("gain"), stored_disposals(spark, sf_dir)
    totals = sold.groupBy("tax_year").agg(
        F.round(money(F.sum(F.when(gain > 0, gain).otherwise(0))), 2).alias("total_gains"), F.round(money(F.sum(F.when(gain < 0, -gain).otherwise(0))), 2).alias("total_losses"),
        F.round(money(F.sum("gain")), 2).alias("net"), F.round(money(F.sum("gain")) / 2, 2).alias("taxable"),
    )
    denied = superficial(spark, sf_dir, sold).groupBy("tax_year").agg(F.count("*").alias("superficial"), money(F.sum("denied")).alias("denied"))
    return totals.join(denied, "tax_year", "left").withColumns({"superficial": F.coalesce("superficial", F.lit(0)), "denied": F.coalesce("denied", F.lit(0.0))})


@query("r01_capital_gains_report", f"""WITH RECURSIVE {SUPERFICIAL} SELECT strftime(g.ts, '%Y-%m-%d') AS disposal_date, g.user_id, g.token, g.a, g.b, g.c, g.units::DOUBLE AS units, g.value::DOUBLE AS proceeds, (g.used / 1e8)::DOUBLE AS acb_used, g.fee::DOUBLE AS fees, (g.gain / 1e8)::DOUBLE AS gain,
 sd.rn IS NOT NULL AS is_superficial, (sd.denied100 / 100)::DOUBLE AS denied, g.review OR sd.rn IS NOT NULL AS needs_review FROM g LEFT JOIN sd ON sd.user_id = g.user_id AND sd.token = g.token AND sd.rn = g.rn WHERE g.kind = 'dispose'""")
def r01(spark, sf_dir):
    """Every disposal with what of its loss is denied; a superficial one needs a review."""
    sold = stored_disposals(spark, sf_dir)
    buys = ledger(spark, sf_dir).filter("kind = 'acquire'").select(*KEYS, F.col("ts_s").alias("buy_s"), F.col("units").alias("bought"))
    losses = denied_losses(sold.filter("gain < 0"), buys, KEYS).withColumn("denied", F.when(F.col("rebought") > 0, F.col("denied")))
    rows = losses.select(*sold.columns, "denied").unionByName(sold.filter("gain >= 0").withColumn("denied", F.lit(None).cast("decimal(24,2)")))
    flag = F.col("denied").isNotNull()
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("disposal_date"), *KEYS, "a", "b", "c", money("units").alias("units"), money("value").alias("proceeds"), money("cost_used").alias("acb_used"), money("fee").alias("fees"), money("gain").alias("gain"),
        flag.alias("is_superficial"), money("denied").alias("denied"), (F.col("needs_review") | flag).alias("needs_review"),
    )


@query("k15_superficial_losses", f"WITH RECURSIVE {SUPERFICIAL} SELECT user_id, token, ts, a, b, c, (gain / 1e8)::DOUBLE AS gain, rebought::DOUBLE AS rebought, (ratio8 / 1e8)::DOUBLE AS ratio, (denied100 / 100)::DOUBLE AS denied FROM sd")
def k15(spark, sf_dir):
    return superficial(spark, sf_dir).select("user_id", "token", "ts", "a", "b", "c", money("gain").alias("gain"), money("rebought").alias("rebought"), money("ratio").alias("ratio"), money("denied").alias("denied"))


@query("k16_denied_into_later_cost", f"""WITH RECURSIVE {SUPERFICIAL}, nx AS (
 SELECT sd.user_id, sd.token, sd.denied100, (SELECT min(q.ts_s) FROM ledger_buys q WHERE q.user_id = sd.user_id AND q.token = sd.token AND q.ts_s > sd.ts_s) AS at_s FROM sd)
 SELECT user_id, token, at_s AS buy_s, count(*) AS losses, (sum(denied100) / 100)::DOUBLE AS added FROM nx WHERE at_s IS NOT NULL GROUP BY 1, 2, 3""")
def k16(spark, sf_dir):
    """Denied losses go to the cost of the first later acquisition; several add up."""
    buys = ledger(spark, sf_dir).filter("kind = 'acquire'").select(*KEYS, F.col("ts_s").alias("buy_s")).withColumn("one", F.lit(1))
    later = asof_join(superficial(spark, sf_dir).select(*KEYS, "ts_s", "a", "b", "c", "denied"), buys, KEYS, "ts_s", "buy_s", ["one"], direction="forward", exact=False)
    return later.filter("buy_s is not null").groupBy(*KEYS, "buy_s").agg(F.count("*").alias("losses"), money(F.sum("denied")).alias("added"))


def _method(method):
    def run(spark, sf_dir):
        s = snapshots(spark, sf_dir, method)
        return s.groupBy("user_id", "token").agg(F.round(money(F.sum("cost_used")), 2).alias("cost_used"), F.round(money(F.sum("gain")), 2).alias("gain"), F.count_if("needs_review").alias("oversold"), F.round(money(F.max_by("units_after", F.struct(*ORDER))), 2).alias("units_left"))

    return run


LINE = f"""{FOLD.split(",{chr(10)}f AS (")[0]},
line0 AS (SELECT *, sum(CASE WHEN kind = 'acquire' THEN u ELSE 0 END) OVER w AS got, sum(CASE WHEN kind = 'dispose' THEN u ELSE 0 END) OVER w AS gone FROM e WINDOW w AS (PARTITION BY user_id, token ORDER BY rn)),
line1 AS (SELECT *, greatest(0, max(gone - got) OVER (PARTITION BY user_id, token ORDER BY rn)) AS lost FROM line0),
line AS (SELECT *, gone - lost AS sold_to, lag(gone - lost, 1, 0::HUGEINT) OVER p AS sold_from, lost > lag(lost, 1, 0::HUGEINT) OVER p AS oversold FROM line1 WINDOW p AS (PARTITION BY user_id, token ORDER BY rn)),
met AS (SELECT d.user_id, d.token, l.rn AS lot, d.rn AS sold, greatest(l.got - l.u, d.sold_from) AS x0, least(l.got, d.sold_to) AS x1, l.got - l.u AS l0, l.u AS lu, l.v + l.x AS cost
 FROM line d JOIN line l ON l.user_id = d.user_id AND l.token = d.token AND d.kind = 'dispose' AND l.kind = 'acquire' AND l.got > d.sold_from AND l.got - l.u < d.sold_to),
pieces AS (SELECT user_id, token, lot, sold, x1 - x0 AS units, (2 * cost * (x1 - l0) + lu) // (2 * lu) - (2 * cost * (x0 - l0) + lu) // (2 * lu) AS cost FROM met WHERE x1 > x0)"""


@query("k10_fifo_lots", f"""WITH {LINE}, used AS (SELECT user_id, token, sold AS rn, sum(cost) AS cost FROM pieces GROUP BY 1, 2, 3)
SELECT user_id, token, round((sum(coalesce(used.cost, 0)) / 1e8)::DOUBLE, 2) AS cost_used, round((sum(CASE WHEN kind = 'dispose' THEN v - x - coalesce(used.cost, 0) ELSE 0 END) / 1e8)::DOUBLE, 2) AS gain,
 count(*) FILTER (kind = 'dispose' AND oversold) AS oversold, round((max_by(got - sold_to, line.rn) / 1e8)::DOUBLE, 2) AS units_left FROM line LEFT JOIN used USING (user_id, token, rn) GROUP BY 1, 2""")
def k10(spark, sf_dir):
    """First in, first out, in closed form: which lots went with which disposals, without replaying them."""
    at = positions(ledger(spark, sf_dir), KEYS, ORDER)
    cost = cut_pieces(at, KEYS, [], []).filter("sold").groupBy(*KEYS).agg(F.sum("cost").alias("used"))
    bought, now = F.col("kind") == "acquire", F.struct(*ORDER)
    whole = lambda c: (F.coalesce(F.col(c).cast("decimal(28,8)"), F.lit(0)) * 100000000).cast("decimal(38,0)")
    sums = at.groupBy(*KEYS).agg(
        F.sum(F.when(~bought, whole("value") - whole("fee"))).alias("net"), F.count_if("oversold").alias("oversold"),
        F.coalesce(F.max(F.when(bought, F.col("to_"))), F.lit(0)).alias("got"), F.coalesce(F.max(F.when(~bought, F.col("to_"))), F.lit(0)).alias("sold"),
    )
    eighth = lambda c: F.round(c.cast("double") / 1e8, 2)
    used = F.coalesce("used", F.lit(0))
    return sums.join(cost, KEYS, "left").select(*KEYS, eighth(used).alias("cost_used"), eighth(F.coalesce("net", F.lit(0)) - used).alias("gain"), "oversold", eighth(F.col("got") - F.col("sold")).alias("units_left"))


def of_eighths(c: str):
    """A whole number of 1e-8 as a double."""
    return F.col(c).cast("double") / 1e8


@query("k10_lot_matches", f"""WITH {LINE} SELECT user_id, token, l.ts AS acquired, d.ts AS disposed, d.a, d.b, d.c, (sum(p.units) / 1e8)::DOUBLE AS units, (sum(p.cost) / 1e8)::DOUBLE AS cost, bool_or(d.oversold) AS needs_review
 FROM pieces p JOIN line l ON l.user_id = p.user_id AND l.token = p.token AND l.rn = p.lot JOIN line d ON d.user_id = p.user_id AND d.token = p.token AND d.rn = p.sold GROUP BY p.user_id, p.token, l.ts, d.ts, d.a, d.b, d.c""".replace("SELECT user_id, token, l.ts", "SELECT p.user_id, p.token, l.ts"))
def k10_matches(spark, sf_dir):
    """Every lot with every disposal that took from it; a disposal of more than was held needs a review."""
    pieces = cut_pieces(positions(ledger(spark, sf_dir), KEYS, ORDER), KEYS, ["ts"], ["ts", "a", "b", "c", "oversold"]).filter("sold")
    out = pieces.groupBy(*KEYS, F.col("lot_ts").alias("acquired"), F.col("sold_ts").alias("ts"), *(F.col(f"sold_{x}").alias(x) for x in "abc")).agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.bool_or("sold_oversold").alias("needs_review"))
    return out.select(*KEYS, "acquired", F.col("ts").alias("disposed"), "a", "b", "c", *(of_eighths(x).alias(x) for x in ("units", "cost")), "needs_review")


@query("k10_holdings", f"""WITH {LINE}, now AS (SELECT user_id, token, max(sold_to) AS sold FROM line WHERE kind = 'dispose' GROUP BY 1, 2), held AS (
 SELECT l.*, greatest(l.got - l.u, coalesce(now.sold, 0)) AS x0 FROM line l LEFT JOIN now USING (user_id, token) WHERE l.kind = 'acquire' AND l.got > coalesce(now.sold, 0))
SELECT user_id, token, ts AS acquired, count(*) AS lots, (sum(got - x0) / 1e8)::DOUBLE AS units, (sum((2 * (v + x) * u + u) // (2 * u) - (2 * (v + x) * (x0 - got + u) + u) // (2 * u)) / 1e8)::DOUBLE AS cost FROM held GROUP BY 1, 2, 3""")
def k10_holdings(spark, sf_dir):
    """The lots that are left, by day of acquisition."""
    pieces = cut_pieces(positions(ledger(spark, sf_dir), KEYS, ORDER), KEYS, ["ts"], [])
    held = pieces.filter("not sold").groupBy(*KEYS, F.col("lot_ts").alias("acquired")).agg(F.count_if("ends").alias("lots"), F.sum("units").alias("units"), F.sum("cost").alias("cost"))
    return held.select(*KEYS, "acquired", "lots", *(of_eighths(x).alias(x) for x in ("units", "cost")))


@query("k11_snapshot_replay", f"""WITH RECURSIVE {FOLD}, snap AS (SELECT user_id, token, rn, ts, kind, CASE WHEN kind = 'acquire' THEN u ELSE sold END AS u, CASE WHEN kind = 'acquire' THEN v + x ELSE 0 END AS cost FROM g WHERE CASE WHEN kind = 'acquire' THEN u ELSE sold END > 0),
p AS (SELECT *, sum(CASE WHEN kind = 'acquire' THEN u ELSE 0 END) OVER w AS got, sum(CASE WHEN kind = 'dispose' THEN u ELSE 0 END) OVER w AS gone FROM snap WINDOW w AS (PARTITION BY user_id, token ORDER BY rn)),
m AS (SELECT d.user_id, d.token, d.ts, greatest(l.got - l.u, d.gone - d.u) AS x0, least(l.got, d.gone) AS x1, l.got - l.u AS l0, l.u AS lu, l.cost FROM p d JOIN p l ON l.user_id = d.user_id AND l.token = d.token AND d.kind = 'dispose' AND l.kind = 'acquire' AND l.got > d.gone - d.u AND l.got - l.u < d.gone)
SELECT user_id, token, year(ts)::INT AS year, (sum(x1 - x0) / 1e8)::DOUBLE AS units, (sum((2 * cost * (x1 - l0) + lu) // (2 * lu) - (2 * cost * (x0 - l0) + lu) // (2 * lu)) / 1e8)::DOUBLE AS cogs FROM m GROUP BY 1, 2, 3""")
def k11(spark, sf_dir):
    """Lots restored from the snapshots of average-cost pools (units moved, cost of what came in), and the cost of goods sold by year."""
    s = replay(ledger(spark, sf_dir).select(*KEYS, *ORDER, "ts_s", "kind", "fee"), KEYS, ORDER)
    sold = F.col("units").cast("decimal(28,8)")
    moved = F.when(F.col("kind") == "dispose", F.when(F.col("needs_review"), F.col("held")).otherwise(sold)).otherwise(sold)
    held = F.lag("units_after", 1, 0).over(Window.partitionBy(*KEYS).orderBy(*ORDER))
    moves = s.withColumn("held", F.coalesce(held, F.lit(0))).withColumn("units_delta", moved).filter("units_delta > 0")
    moves = moves.select(*KEYS, *ORDER[:4], F.col("units").alias("listed"), "value", "fee", "ts_s", "kind", F.col("units_delta").alias("units"))
    moves = Scratch(spark, "restored").save(moves)  # read for the stretches and for the sums of slices
    pieces = cut_pieces(positions(moves, KEYS, [*ORDER[:4], "listed", "value"]), KEYS, [], ["ts"])
    out = pieces.filter("sold").groupBy(*KEYS, F.year("sold_ts").alias("year")).agg(F.sum("units").alias("u"), F.sum("cost").alias("c"))
    return out.select(*KEYS, "year", of_eighths("u").alias("units"), of_eighths("c").alias("cogs"))


query("k12_lifo_lots")(_method("lifo"))
EVENTS = FOLD.split(",\nf AS (")[0]
_FROM = "FROM e JOIN f ON e.user_id = f.user_id AND e.token = f.token AND e.rn = f.rn + 1"
_START = "SELECT user_id, token, 0::BIGINT AS rn, 0::HUGEINT AS su,"
UNROUNDED = f"""{EVENTS}, f AS ({_START} 0::DOUBLE AS sc, 0::DOUBLE AS used, 0::DOUBLE AS gain, false AS review FROM ledger GROUP BY ALL
 UNION ALL SELECT user_id, token, rn, CASE WHEN kind = 'acquire' THEN su + u WHEN su > 0 THEN su - u ELSE su END, CASE WHEN kind = 'acquire' THEN sc + (v + x)::DOUBLE ELSE sc - uc END, uc, CASE WHEN kind = 'dispose' AND su > 0 THEN (v - x)::DOUBLE - uc ELSE 0 END, kind = 'dispose' AND u > su
 FROM (SELECT e.*, f.su, f.sc, CASE WHEN e.kind = 'dispose' AND f.su > 0 THEN f.sc * e.u::DOUBLE / f.su::DOUBLE ELSE 0 END AS uc {_FROM})), g AS (SELECT e.ts, e.kind, f.* FROM f JOIN e USING (user_id, token, rn))"""
CENTS = f"""{EVENTS}, f AS ({_START} 0::HUGEINT AS sc, 0::HUGEINT AS used, 0::HUGEINT AS gain, false AS review FROM ledger GROUP BY ALL
 UNION ALL SELECT user_id, token, rn, CASE WHEN kind = 'acquire' THEN su + u ELSE su - least(u, su) END, CASE WHEN kind = 'acquire' THEN sc + v + x ELSE greatest(0, sc - uc) END, CASE WHEN kind = 'acquire' THEN 0 ELSE uc END, CASE WHEN kind = 'acquire' THEN 0 ELSE v - x - uc END, kind = 'dispose' AND u > su
 FROM (SELECT *, ((2 * least(u, su) * each + 100000000000000::HUGEINT) // 200000000000000::HUGEINT) * 1000000 AS uc FROM (SELECT *, q + CASE WHEN 2 * r > su OR (2 * r = su AND q % 2 = 1) THEN 1 ELSE 0 END AS each
 FROM (SELECT e.*, f.su, f.sc, CASE WHEN f.su > 0 THEN (f.sc * {_E8}) // f.su ELSE 0 END AS q, CASE WHEN f.su > 0 THEN (f.sc * {_E8}) % f.su ELSE 0 END AS r {_FROM})))), g AS (SELECT e.ts, e.kind, f.* FROM f JOIN e USING (user_id, token, rn))"""
_TOTALS = "SELECT user_id, token, round((sum(used) / 1e8)::DOUBLE, 2) AS cost_used, round((sum(gain) / 1e8)::DOUBLE, 2) AS gain, count(*) FILTER (review) AS oversold, round((max_by(su, rn) / 1e8)::DOUBLE, 2) AS units_left FROM g GROUP BY 1, 2"
query("k13_method_acb", f"WITH RECURSIVE {UNROUNDED} {_TOTALS}")(_method("unrounded"))
query("k14_cost_in_cents", f"WITH RECURSIVE {CENTS} {_TOTALS}")(_method("cents"))


@query("a35_gains_by_year", f"WITH RECURSIVE {UNROUNDED}, h AS (SELECT year(ts)::INT AS tax_year, token, gain / 1e8 AS gain FROM g WHERE kind = 'dispose') SELECT tax_year, token, count(*) AS disposals, round(sum(greatest(gain, 0)) / 2, 2) AS taxable, round(sum(greatest(-gain, 0)) / 2, 2) AS allowable FROM h GROUP BY 1, 2")
def a35(spark, sf_dir):
    """Half of the unrounded gains is taxable, half of the losses allowable."""
    d = snapshots(spark, sf_dir, "unrounded").filter("kind = 'dispose'")
    half = lambda c: F.round(money(F.sum(F.greatest(c, F.lit(0).cast("decimal(38,8)")))) / 2, 2)
    return d.groupBy(F.year("ts").alias("tax_year"), "token").agg(F.count("*").alias("disposals"), half(F.col("gain")).alias("taxable"), half(-F.col("gain")).alias("allowable"))


@query("w10_unstake_rewards", f"""WITH RECURSIVE {LEDGER}, m AS (SELECT *, CASE category WHEN 'stake' THEN 'acquire' WHEN 'unstake' THEN 'dispose' ELSE 'out' END AS move FROM ledger WHERE category IN ('stake', 'unstake', 'withdrawal')),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, token ORDER BY ts, a, b, c, units, value) AS rn FROM m), f AS (SELECT user_id, token, 0::BIGINT AS rn, 0::DECIMAL(18,2) AS held, 0::DECIMAL(18,2) AS reward FROM m GROUP BY ALL
 UNION ALL SELECT e.user_id, e.token, e.rn, (CASE e.move WHEN 'acquire' THEN held + units WHEN 'dispose' THEN greatest(0, held - units) ELSE 0 END)::DECIMAL(18,2), (CASE WHEN e.move = 'dispose' AND units > held AND held > 0 THEN units - held ELSE 0 END)::DECIMAL(18,2) {_FROM})
SELECT user_id, token, count(*) AS rewards, sum(reward)::DOUBLE AS units FROM f WHERE reward > 0 GROUP BY 1, 2""")
def w10(spark, sf_dir):
    """What came back on unstaking beyond what was staked."""
    kind = F.when(F.col("category") == "stake", "acquire").when(F.col("category") == "unstake", "dispose").otherwise("out")
    moves = ledger(spark, sf_dir).filter("category in ('stake', 'unstake', 'withdrawal')").withColumn("kind", kind)
    return replay(moves, KEYS, ORDER, "principal").filter("gain > 0").groupBy(*KEYS).agg(F.count("*").alias("rewards"), money(F.sum("gain")).alias("units"))



@query("k08_incremental_equals_full", f"WITH RECURSIVE {FOLD} SELECT user_id, token, (max_by(su, rn) / 1e8)::DOUBLE AS units_after, (max_by(sc, rn) / 1e8)::DOUBLE AS cost_after FROM g WHERE ts >= TIMESTAMP '1999-01-01' GROUP BY 1, 2")
def k08(spark, sf_dir):
    """Pools restored from the snapshots that an earlier run has stored, then only later movements replayed."""
    moves = ledger(spark, sf_dir)
    cut = F.lit("1999-01-01").cast("timestamp")
    old = replay(moves.filter(F.col("ts") < cut), KEYS, ORDER)
    seed = old.groupBy(*KEYS).agg(F.max_by(F.struct("units_after", "cost_after"), F.struct(*ORDER)).alias("s")).select(*KEYS, "s.*")
    stored = Scratch(spark, "snapshots").save(seed)  # what the earlier run leaves: a row a pool
    new = replay(moves.filter(F.col("ts") >= cut), KEYS, ORDER, seed=stored)
    last = new.groupBy(*KEYS).agg(F.max_by(F.struct("units_after", "cost_after"), F.struct(*ORDER)).alias("s"))
    return last.select(*KEYS, money("s.units_after").alias("units_after"), money("s.cost_after").alias("cost_after"))
