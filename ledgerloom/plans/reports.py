"""Reports on pools: what is held and at what gain, cost of goods sold, the portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ORDER, ledger
from ..operators.filters import fiscal_year_range
from ..operators.joins import latest
from ..operators.lots import cut_pieces, positions
from ..scratch import Scratch
from .chain import STAGES, movements
from .costbasis import FOLD, KEYS, LINE, money, snapshots
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]
YEAR, YEAR_END = 1998, 3
START, END = fiscal_year_range(YEAR, YEAR_END)  # END is the day after the last

_PRICE = "price AS (SELECT token, (sum(value * 100)::BIGINT // sum(units)::BIGINT) AS cents FROM ledger WHERE ts >= TIMESTAMP '2001-01-01' GROUP BY 1)"


def _last(s):
    return s.groupBy(*KEYS).agg(F.max_by(F.struct("units_after", "cost_after"), F.struct(*ORDER)).alias("s")).select(*KEYS, "s.*")


@query("r06_holdings", f"WITH RECURSIVE {FOLD}, {_PRICE}, h AS (SELECT user_id, token, max_by(su, rn) AS su, max_by(sc, rn) AS sc FROM g GROUP BY 1, 2) SELECT user_id, token, (su / 1e8)::DOUBLE AS units, CASE WHEN su > 0 THEN round(((2 * sc * 100000000::HUGEINT + su) // (2 * su) / 1e8)::DOUBLE, 6) ELSE 0 END AS acb_per_unit, (sc / 1e8)::DOUBLE AS cost, cents / 100 AS fmv_per_unit, round(su / 1e8 * cents / 100, 4) AS fmv, round(su / 1e8 * cents / 100 - sc / 1e8, 4) AS unrealized FROM h LEFT JOIN price USING (token)")
def r06(spark, sf_dir):
    """The latest pool of every user and token, and what it would bring at the price of the last year."""
    moves = ledger(spark, sf_dir)
    cents = F.call_function("div", F.sum(F.col("value") * 100).cast("long"), F.sum("units").cast("long"))
    price = moves.filter("ts >= timestamp_ntz '2001-01-01'").groupBy("token").agg(cents.alias("cents"))  # a row a token
    h = _last(snapshots(spark, sf_dir)).join(price, "token", "left")
    units, cost = money("units_after"), money("cost_after")
    fmv = units * F.col("cents") / 100
    each = F.when(F.col("units_after") > 0, F.round(cost / units, 6)).otherwise(0.0)
    return h.select(*KEYS, units.alias("units"), each.alias("acb_per_unit"), cost.alias("cost"), (F.col("cents") / 100).alias("fmv_per_unit"), F.round(fmv, 4).alias("fmv"), F.round(fmv - cost, 4).alias("unrealized"))


@query("r07_cogs", f"""WITH RECURSIVE {FOLD}, o AS (SELECT user_id, token, max_by(sc, rn) AS v FROM g WHERE ts < TIMESTAMP '{START}' GROUP BY 1, 2), c AS (SELECT user_id, token, max_by(sc, rn) AS v FROM g WHERE ts < TIMESTAMP '{END}' GROUP BY 1, 2),
a AS (SELECT user_id, token, sum(v + x) AS v FROM g WHERE kind = 'acquire' AND ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1, 2),
m AS (SELECT user_id, token, coalesce(o.v, 0) AS o, coalesce(a.v, 0) AS a, coalesce(c.v, 0) AS c FROM o FULL JOIN a USING (user_id, token) FULL JOIN c USING (user_id, token))
SELECT user_id, token, (o / 1e8)::DOUBLE AS opening, (a / 1e8)::DOUBLE AS acquisitions, (c / 1e8)::DOUBLE AS closing, ((o + a - c) / 1e8)::DOUBLE AS cogs FROM m""")
def r07(spark, sf_dir):
    """Average-cost inventory at the start and end of a fiscal year, what came in, and what the goods that went had cost (A09)."""
    s = Scratch(spark, "cogs").save(snapshots(spark, sf_dir).select(*KEYS, *ORDER, "kind", "fee", "cost_after"))
    start, end = F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")
    value = lambda df, name: df.groupBy(*KEYS).agg(F.max_by("cost_after", F.struct(*ORDER)).alias(name))
    bought = s.filter((F.col("kind") == "acquire") & (F.col("ts") >= start) & (F.col("ts") < end)).groupBy(*KEYS).agg(F.sum(F.col("value").cast("decimal(24,8)") + F.col("fee")).alias("acquisitions"))
    m = value(s.filter(F.col("ts") < start), "opening").join(bought, KEYS, "full").join(value(s.filter(F.col("ts") < end), "closing"), KEYS, "full")
    n = {c: F.coalesce(F.col(c).cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")) for c in ("opening", "acquisitions", "closing")}
    m = m.withColumns(n).withColumn("cogs", F.col("opening") + F.col("acquisitions") - F.col("closing"))
    return m.select(*KEYS, *(money(c).alias(c) for c in ("opening", "acquisitions", "closing", "cogs")))


@query("r07_cogs_fifo", f"WITH {LINE} SELECT p.user_id, p.token, (sum(p.units) / 1e8)::DOUBLE AS units, (sum(p.cost) / 1e8)::DOUBLE AS cogs FROM pieces p JOIN line d ON d.user_id = p.user_id AND d.token = p.token AND d.rn = p.sold WHERE year(d.ts) = {YEAR} GROUP BY 1, 2")
def r07_fifo(spark, sf_dir):
    """The same by lots, over the calendar year."""
    pieces = cut_pieces(positions(ledger(spark, sf_dir), KEYS, ORDER), KEYS, [], ["ts"])
    out = pieces.filter(F.col("sold") & (F.year("sold_ts") == YEAR)).groupBy(*KEYS).agg(F.sum("units").alias("u"), F.sum("cost").alias("c"))
    return out.select(*KEYS, (F.col("u").cast("double") / 1e8).alias("units"), (F.col("c").cast("double") / 1e8).alias("cogs"))


@query("r13_staking_positions", f"WITH {_MOVES} SELECT user_id, coalesce(counterparty, 'unknown') AS validator_id, max_by(units, (ts_s, id))::DOUBLE AS staked_amount FROM t WHERE event_type = 'purchase' GROUP BY 1, 2")
def r13(spark, sf_dir):
    """The portfolio's staking part: the latest deposit with each validator."""
    t = movements(spark, sf_dir).filter("event_type = 'purchase'").withColumn("validator_id", F.coalesce("counterparty", F.lit("unknown")))
    return latest(t, ["user_id", "validator_id"], [F.desc("ts_s"), F.desc("id")]).select("user_id", "validator_id", F.col("units").cast("double").alias("staked_amount"))
