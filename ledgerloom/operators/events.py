"""From classified movements to events of pools: what each does to which pool, at which price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .joins import nearest_join
from .pricing import EXACT_SECONDS, LARGE, NEAR_SECONDS, STABLE, with_rate
from .rule_catalogue import KINDS, SKIPPED

#: What counts as money worth 1, and what has no price.
FIAT = ("CAD", "USD")
UNPRICED = ("EUR", "GBP", "AUD", "JPY", "UNKNOWN")
AMOUNT = "decimal(28,8)"


def kind_of_event(category: Column, direction: Column, units: Column, swap: Column) -> Column:
    """acquire, dispose, swap, fee, in, out, or null for what moves no pool.

    A sale or trade with both legs is a swap; a trade without them goes by its direction."""
    out = F.when(category.isin(*SKIPPED), F.lit(None).cast("string")).when(category.isin(*KINDS["acquire"]), "acquire")
    out = out.when(category.isin(*KINDS["dispose"]), F.when(swap, "swap").otherwise("dispose"))
    out = out.when(category == "trade", F.when(swap, "swap").when((direction == "out") | (units < 0), "dispose").otherwise("acquire"))
    out = out.when(category == "fee", "fee")
    return out.when(category.isin(*KINDS["in"]), "in").when(category.isin(*KINDS["out"]), "out")


def resolve_prices(requests: DataFrame, daily: DataFrame, minutes: DataFrame, rates: DataFrame, key: list[str]) -> DataFrame:
    """requests (key, token, ts_s, units, upgrade, known) with price_cad, tier and estimated.

    known: an exact price or null. daily (token, day, usd), minutes (token, price_s, price) and rates (rate_day, rate) are in dollars. In order: the known
    price, fiat money at 1, the day's price; a large one that may be upgraded takes the nearest minute's instead, as does one without a price of the day."""
    token = F.col("token")
    r = with_rate(requests.withColumn("day", F.floor(F.col("ts_s") / 86400)), rates).drop("estimated").withColumn("rate", F.col("rate").cast("decimal(8,4)"))
    r = r.join(daily.select("token", "day", F.col("usd").cast("decimal(18,2)").alias("__usd")), ["token", "day"], "left")
    stable = token.isin(*STABLE)
    r = r.withColumns({"__open": F.col("known").isNull() & ~token.isin(*FIAT, *UNPRICED), "__usd": F.when(stable, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("__usd"))})
    r = r.withColumn("__daily", (F.col("__usd") * F.col("rate")).cast("decimal(24,6)"))
    large = F.col("upgrade") & F.coalesce(F.col("units") * F.col("__daily") > LARGE, F.lit(False))
    r = r.withColumn("__wanted", F.col("__open") & (F.col("__daily").isNull() | large))
    found = nearest_join(r.filter(F.col("__wanted") & ~stable).select(*key, "token", "ts_s"), minutes.select("token", "price_s", "price"), ["token"], "ts_s", "price_s", "price", NEAR_SECONDS)
    r = r.join(found.select(*key, F.col("price").cast("decimal(18,2)").alias("__minute"), F.col("gap").alias("__gap")), key, "left")
    r = r.withColumns({"__minute": F.when(F.col("__wanted"), (F.when(stable, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("__minute")) * F.col("rate")).cast("decimal(24,6)"))})
    tier = F.when(F.col("known").isNotNull(), "known").when(token.isin(*FIAT), "fiat").when(F.col("__open") & F.col("__minute").isNotNull(), "minute").when(F.col("__open") & F.col("__daily").isNotNull(), "daily")
    r = r.withColumn("tier", tier)
    price = F.when(F.col("tier") == "known", F.col("known").cast("decimal(24,6)")).when(F.col("tier") == "fiat", F.lit(1).cast("decimal(24,6)")).when(F.col("tier") == "minute", F.col("__minute")).when(F.col("tier") == "daily", F.col("__daily"))
    off = F.when(F.col("tier").isin("known", "fiat"), False).when(F.col("tier") == "minute", F.coalesce(F.col("__gap") > EXACT_SECONDS, F.lit(False))).otherwise(True)
    return r.withColumns({"price_cad": price, "estimated": off}).select(*requests.columns, "price_cad", "tier", "estimated")


def pool_events(moves: DataFrame, daily: DataFrame, minutes: DataFrame, rates: DataFrame) -> DataFrame:
    """id, leg_no, leg, user_id, token, ts_s, category, kind (acquire, dispose, in, out), units, value, fee, price_cad, tier, estimated and source_type.

    moves: id (unique), user_id, ts_s, category, direction, token, units, fee (in units), fmv_cad, staking_fmv, staking_units, lockup_fmv,
    lockup_units, and legs, an array of (leg_type, token, units) or null. A swap disposes of its sell leg and acquires its buy leg; the worth of its fee leg
    adds to the cost of what was bought. A fee disposes without proceeds. Movements in and out change units only."""
    c, none = F.col, F.lit(None)
    amount = lambda x: F.coalesce(x.cast(AMOUNT), F.lit(0).cast(AMOUNT))
    leg = lambda t: F.get(F.filter("legs", lambda x: x["leg_type"] == t), F.lit(0))
    m = moves.withColumns({"__sell": leg("sell_leg"), "__buy": leg("buy_leg"), "__fee": leg("fee_leg")})
    swap = c("__sell").isNotNull() & c("__buy").isNotNull()
    m = m.withColumn("__kind", kind_of_event(c("category"), c("direction"), c("units"), swap)).filter("__kind is not null")

    staked, vested = c("staking_fmv").isNotNull(), c("lockup_fmv").isNotNull()
    income = c("__kind") == "acquire"
    whole = F.when(income & staked, F.coalesce("staking_units", "units")).when(income & vested, F.coalesce("lockup_units", "units"))
    whole = whole.when((c("__kind") == "fee") & (c("fee") > 0), c("fee")).when(c("__kind").isin("in", "out") | ((c("category") == "trade") & (c("__kind") == "dispose")), F.abs("units")).otherwise(c("units"))
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)

    def event(no, name, token, kind, units, fee, upgrade, priced):
        return F.struct(F.lit(no).alias("leg_no"), F.lit(name).alias("leg"), token.alias("token"), kind.alias("kind"), amount(units).alias("units"), amount(fee).alias("fee_units"), flag(upgrade).alias("upgrade"), flag(priced).alias("priced"))

    single = event(0, "whole", c("token"), F.when(c("__kind") == "fee", "dispose").otherwise(c("__kind")), whole, F.when(c("__kind") == "dispose", c("fee")), c("__kind") == "dispose", c("__kind").isin("acquire", "dispose"))
    sides = [event(0, "sell_leg", c("__sell.token"), F.lit("dispose"), c("__sell.units"), none, True, True), event(1, "buy_leg", c("__buy.token"), F.lit("acquire"), c("__buy.units"), none, False, True)]
    paid = event(2, "fee_leg", c("__fee.token"), F.lit("fee"), c("__fee.units"), none, False, True)
    parts = F.when(c("__kind") != "swap", F.array(single)).when(c("__fee").isNotNull(), F.array(*sides, paid)).otherwise(F.array(*sides))
    e = m.withColumn("__e", F.explode(parts)).withColumn("__single", c("__e.leg") == "whole")

    income = c("__single") & (c("__e.kind") == "acquire")
    known = F.when(income & staked, c("staking_fmv")).when(income & vested, c("lockup_fmv")).when(c("__single"), F.coalesce("fmv_cad", "staking_fmv", "lockup_fmv"))
    source = F.when(income, F.when(staked, "staking").when(vested, "vesting").otherwise("airdrop"))
    e = e.select("id", "user_id", "ts_s", "category", "__e.*", F.when(c("__e.priced"), known).alias("known"), source.alias("source_type"))
    e = Scratch(moves.sparkSession, "events").save(e)  # read for prices, for those of minutes, and for what needs none
    asked = resolve_prices(e.filter("priced"), daily, minutes, rates, ["id", "leg_no"])
    moved = e.filter("not priced").withColumns({"price_cad": none.cast("decimal(24,6)"), "tier": none.cast("string"), "estimated": F.lit(False)})
    e = asked.unionByName(moved)
    price = F.coalesce("price_cad", F.lit(0)).cast("decimal(17,6)")
    times = lambda units: F.round(units.cast("decimal(20,8)") * price, 8).cast(AMOUNT)  # 38 digits hold every product
    e = e.withColumns({"value": times(c("units")), "fee": times(c("fee_units"))})
    added = F.max(F.when(c("kind") == "fee", c("value"))).over(Window.partitionBy("id"))
    e = e.withColumn("fee", F.when(c("leg") == "buy_leg", F.coalesce(added, F.lit(0).cast(AMOUNT))).otherwise(c("fee"))).filter("kind <> 'fee'")
    return e.select("id", "leg_no", "leg", "user_id", "token", "ts_s", "category", "kind", "units", "value", "fee", "price_cad", "tier", "estimated", "source_type")
