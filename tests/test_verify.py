"""Matches, merges, gaps and diagnoses on small tables with known results."""

from decimal import Decimal as D

from ledgerloom.operators import verify

DAY = 86400


def sides(spark, entries, transfers):
    e = spark.createDataFrame([(i, 1, 10, t, s, sym, D(a)) for i, t, s, sym, a in entries], "entry_id long, user_id long, wallet_id long, tx_type string, entry_s long, entry_symbol string, entry_amount decimal(18,4)")
    return e, spark.createDataFrame([(i, 1, s, sym, D(a)) for i, s, sym, a in transfers], "transfer_id long, user_id long, transfer_s long, transfer_symbol string, transfer_amount decimal(18,4)")


def test_signals_in_order_of_strength(spark):
    e, t = sides(spark, [(1, "buy", 1000, "BTC", "100"), (2, "buy", 50000, "BTC", "7"), (3, "buy", 60000, "ETH", "9"), (4, "buy", 1000, "BTC", "500"), (5, "buy", 1000, "X", "0")],
                 [(11, 1600, "BTC", "101"), (12, 1000, "ETH", "100"), (13, 70000, "BTC", "7"), (14, 60600, "NEAR", "9"), (15, 60601, "ETH", "9.05"), (16, 1700, "BTC", "505.06"), (17, 1001, "X", "0")])
    got = {r.entry_id: (r.transfer_id, r.score) for r in verify.best_matches(e, t).collect()}
    assert got == {1: (11, 0.85), 2: (13, 0.60), 3: (14, 0.80), 5: (17, 0.85)}


def test_merge_only_towards_the_chain(spark):
    e, t = sides(spark, [(1, "buy", 0, "BTC", "10"), (2, "sell", 100, "ETH", "10"), (3, "mystery", 200, "BTC", "10"), (4, "buy", 300, "XRP", "10")], [(11, 0, "BTC", "10"), (12, 100, "ETH", "10"), (13, 200, "BTC", "10"), (14, 300, "XRP", "10")])
    moves = spark.createDataFrame([(10, "BTC", "in", D(25), D(1)), (10, "BTC", "out", D(3), D(1)), (10, "ETH", "in", D(5), None)], "wallet_id long, token string, direction string, units decimal(18,2), fee decimal(18,2)")
    real = spark.createDataFrame([(10, "BTC", 1, 11), (10, "BTC", 2, None), (10, "ETH", 1, 4)], "wallet_id long, token string, verified_s long, actual long")
    got = {r.entry_id: (float(r.calculated), r.action) for r in verify.threshold_actions(verify.best_matches(e, t), moves, real).collect()}
    assert got == {1: (20, "auto_merged"), 2: (5, "flagged_for_review"), 3: (20, "flagged_for_review"), 4: (0, "flagged_for_review")}


def test_gaps_of_two_cents_and_more(spark):
    months = [31 * DAY * i for i in range(30)]
    moves = [(1, s, "in", D("1.00"), D("0.10")) for s in months] + [(2, 0, "in", D(1), None)] + [(3, 0, "in", D(1), None), (3, DAY, "out", D(1), None)]
    m = spark.createDataFrame(moves, "wallet_id long, ts_s long, direction string, units decimal(18,2), fee decimal(18,2)")
    held, balances = D(0), []
    for i, s in enumerate(months):
        held += D("0.90") + (D("5") if i in (2, 20) else D("0.02") if i == 25 else 0)
        balances.append((1, s - 10, held))
    archived = spark.createDataFrame([*balances, (3, 0, D(9))], "wallet_id long, at_s long, balance decimal(18,2)")
    got = verify.month_gaps(m, archived).collect()
    assert [(r.wallet_id, r.end_s, float(r.gap)) for r in got] == [(1, months[20], 5.0)]  # month 2 is older than the last 24, 0.02 isn't more than 0.02


def test_first_diagnosis_that_is_likelier_than_not(spark):
    rows = [("near", 0.0, 7, 10, 0.0, 0.0, 0, 0), ("near", 0.0, 85, 100, 0.0, 0.0, 700000, 3), ("eth", 10.0, 0, 10, 12.0, 2.0, 0, 1), ("eth", 10.0, 0, 0, 16.0, 2.0, 0, 1), ("eth", 10.0, 0, 0, 2.0, 2.0, None, None), ("near", None, 0, 0, 30.0, 2.0, 604800, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, chain string, difference double, rewards long, epochs long, fees_paid double, fees_tracked double, longest_silence long, misclassified long")
    got = {r.i: (r.diagnosis, r.confidence) for r in verify.diagnose(df).collect()}
    assert got == {0: ("missing_staking_rewards", 0.7), 1: ("unindexed_period", 0.6), 2: ("uncounted_fees", 0.75), 3: ("uncounted_fees", 0.55), 4: ("unknown", 0.0), 5: ("classification_error", 0.65)}
