"""Stages of classification, and events of pools, on hand-made movements with known results."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rule_catalogue as catalogue
from ledgerloom.operators.events import pool_events
from ledgerloom.operators.folds import replay
from ledgerloom.operators.pipeline import classify_stages, linked

TX = "id long, user_id long, wallet_id long, tx_hash string, ts_s long, direction string, chain string, counterparty string, action_type string, method_name string, selector string, tx_type string, amount decimal(18,2)"


def tx(i, direction, party, action="TRANSFER", method=None, user=1, ts=1000, tag=None):
    return (i, user, user * 10, f"h{i}", ts, direction, "near", party, action, method, None, tag, D("1.00"))


def test_each_stage_decides_what_the_one_before_left(spark):
    rows = [
        tx(1, "in", "x.poolv1.near"), tx(2, "in", "Mine.near"), tx(3, "out", "mine.NEAR"), tx(4, "in", "spam.near"), tx(5, "in", "shop.near"), tx(6, "out", None, "FUNCTION_CALL", "mystery"),
        tx(7, "in", "a.lockup.near", ts=5000), tx(8, "in", "mine.near", user=2), tx(9, "in", "x.poolv1.near", ts=9000),
    ]
    t = spark.createDataFrame(rows, TX)
    owned = spark.createDataFrame([(1, "mine.near")], "user_id long, account string")
    events = "event_id long, user_id long, wallet_id long, tx_hash string, event_s long"
    staking = spark.createDataFrame([(100, 1, 10, "h1", 99999), (101, 1, 10, None, 9060), (102, 1, 10, None, 8940), (103, 2, 20, None, 9000)], events)
    lockups = spark.createDataFrame([(200, 1, 10, None, 5061), (201, 1, 10, None, 5060)], events)
    spam = F.when(F.col("counterparty") == "spam.near", 0.99).otherwise(0.0)
    got = {r.id: r for r in classify_stages(t, owned, catalogue.NEAR, staking, lockups, spam).collect()}
    assert {i: (r.stage, r.category) for i, r in got.items()} == {
        1: ("rule", "reward"), 2: ("own", "transfer_in"), 3: ("own", "transfer_out"), 4: ("spam", "spam"), 5: ("rule", "deposit"), 6: ("fallback", "unknown"), 7: ("rule", "deposit"), 8: ("rule", "deposit"), 9: ("rule", "reward"),
    }
    assert got[1].staking_event_id == 100 and got[9].staking_event_id == 102 and got[7].lockup_event_id == 201 and got[5].lockup_event_id is None
    assert got[1].needs_review and not got[2].needs_review and not got[4].needs_review and got[6].needs_review and not got[5].needs_review
    surer = F.struct(F.lit("income").alias("category"), F.lit(0.8).alias("confidence"))
    again = {r.id: r for r in classify_stages(t, owned, catalogue.NEAR, fallback=surer).collect()}
    assert (again[6].category, again[6].confidence) == ("income", 0.8) and again[5].category == "deposit"
    assert classify_stages(t.limit(0), owned, catalogue.NEAR, staking, lockups).count() == 0
    assert linked(t.limit(0), staking, "x").count() == 0


MOVE = "id long, user_id long, ts_s long, category string, direction string, token string, units decimal(18,2), fee decimal(18,2), fmv_cad decimal(18,2), staking_fmv decimal(18,2), staking_units decimal(18,2), lockup_fmv decimal(18,2), lockup_units decimal(18,2), legs array<struct<leg_type string, token string, units decimal(18,2)>>"
DAY = 86400 * 10


def events(spark, rows, daily=(), minutes=(), rates=((10, 1.0),)):
    full = [(i, 1, ts, cat, side, token, D(units), D(fee), *(None if x is None else D(x) for x in known), legs) for i, ts, cat, side, token, units, fee, known, legs in rows]
    return pool_events(
        spark.createDataFrame(full, MOVE), spark.createDataFrame([(t, d, D(p)) for t, d, p in daily], "token string, day long, usd decimal(18,2)"),
        spark.createDataFrame([(t, s, D(p)) for t, s, p in minutes], "token string, price_s long, price decimal(18,2)"), spark.createDataFrame([(d, D(str(r))) for d, r in rates], "rate_day long, rate decimal(8,4)"),
    )


def leg(kind, token, units):
    return (kind, token, D(units))


NONE = (None,) * 5


def test_a_swap_moves_two_pools_and_its_fee_enters_the_cost(spark):
    rows = [
        (1, DAY, "buy", "in", "USDC", "100", "0", NONE, None),
        (2, DAY + 60, "trade", "out", "USDC", "100", "0", NONE, [leg("sell_leg", "USDC", "100"), leg("buy_leg", "ETH", "0.5"), leg("fee_leg", "USDC", "2")]),
    ]
    e = events(spark, rows, daily=[("ETH", 10, "3000")], rates=[(10, 1.4)])
    got = {(r.token, r.kind): r for r in replay(e, ["user_id", "token"], ["ts_s", "id", "leg_no"]).collect()}
    assert float(got["USDC", "acquire"].cost_after) == 140
    sold, bought = got["USDC", "dispose"], got["ETH", "acquire"]
    assert (float(sold.value), float(sold.gain), float(sold.units_after), float(sold.cost_after)) == (140, 0, 0, 0)
    assert (float(bought.value), float(bought.fee), float(bought.cost_after), float(bought.acb_per_unit)) == (2100, 2.8, 2102.8, 4205.6)


def test_income_takes_the_event_that_it_is_linked_to(spark):
    rows = [
        (1, DAY, "reward", "in", "NEAR", "1", "0", ("7", "5", "1.5", None, None), None), (2, DAY, "income", "in", "NEAR", "1", "0", (None, None, None, "4", "2"), None),
        (3, DAY, "airdrop", "in", "NEAR", "1", "0", ("7", None, None, None, None), None), (4, DAY, "buy", "in", "NEAR", "2", "0", NONE, None), (5, DAY, "income", "in", "DUST", "2", "0", NONE, None),
    ]
    got = {r.id: r for r in events(spark, rows, daily=[("NEAR", 10, "3")]).collect()}
    assert {i: (float(r.units), float(r.value), r.source_type, r.tier) for i, r in got.items()} == {1: (1.5, 7.5, "staking", "known"), 2: (2, 8, "vesting", "known"), 3: (1, 7, "airdrop", "known"), 4: (2, 6, "airdrop", "daily"), 5: (2, 0, "airdrop", None)}
    assert [got[i].estimated for i in (1, 4, 5)] == [False, True, True]


def test_large_disposals_ask_for_the_minute(spark):
    sale = lambda i, units, ts=DAY, cat="sell": (i, ts, cat, "out", "NEAR", units, "1", NONE, None)
    rows = [sale(1, "100"), sale(2, "101"), sale(3, "101", DAY + 3000), sale(4, "101", DAY + 40000), sale(5, "1", DAY + 86400), sale(6, "200", cat="fee")]
    got = {r.id: r for r in events(spark, rows, daily=[("NEAR", 10, "5")], minutes=[("NEAR", DAY + 10, "6"), ("NEAR", DAY + 90000, "8")]).collect()}
    assert {i: (r.tier, float(r.price_cad), r.estimated) for i, r in got.items() if i != 6} == {1: ("daily", 5, True), 2: ("minute", 6, False), 3: ("minute", 6, True), 4: ("daily", 5, True), 5: ("minute", 8, True)}
    assert (float(got[1].value), float(got[1].fee)) == (500, 5)
    assert (float(got[6].units), float(got[6].value), float(got[6].fee), got[6].kind) == (1, 0, 0, "dispose")  # a fee of 1 goes, for nothing


def test_the_rest_of_the_dispatch(spark):
    rows = [
        (1, DAY, "trade", "out", "CAD", "5", "0", NONE, None), (2, DAY, "trade", "in", "CAD", "5", "0", NONE, [leg("sell_leg", "CAD", "1")]), (3, DAY, "deposit", "in", "NEAR", "-5", "0", NONE, None),
        (4, DAY, "stake", "out", "NEAR", "2", "0", NONE, None), (5, DAY, "spam", "in", "NEAR", "2", "0", NONE, None), (6, DAY, "mystery", "in", "NEAR", "2", "0", NONE, None), (7, DAY, "capital_loss", "in", "EUR", "2", "0", NONE, None),
    ]
    got = {r.id: r for r in events(spark, rows).collect()}
    assert {i: (r.kind, float(r.units), float(r.value)) for i, r in got.items()} == {1: ("dispose", 5, 5), 2: ("acquire", 5, 5), 3: ("in", 5, 0), 4: ("out", 2, 0), 7: ("dispose", 2, 0)}
    assert events(spark, []).count() == 0


@pytest.mark.parametrize("category,kind", [("nft_sale", "acquire"), ("loan_repay", "out"), ("liquidity_out", "in")])
def test_kinds(spark, category, kind):
    assert [r.kind for r in events(spark, [(1, DAY, category, "in", "CAD", "1", "0", NONE, None)]).collect()] == [kind]
