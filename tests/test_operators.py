from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import filters
from ledgerloom.operators.components import components
from ledgerloom.operators.decode import legs, path_tokens, spam_score
from ledgerloom.operators.folds import ONE, Lots, Pool, replay
from ledgerloom.operators.joins import asof_join, nearest_join, range_join
from ledgerloom.operators.matching import greedy
from ledgerloom.operators.pricing import two_sources
from ledgerloom.operators.ranking import global_rank
from ledgerloom.operators.rule_catalogue import ALL, NEAR
from ledgerloom.operators.rules import Rule, classify
from ledgerloom.operators.upsert import upsert
from ledgerloom.scratch import Scratch


def units(*xs):
    return [int(x * ONE) for x in xs]


def test_pool_by_hand():
    p = Pool()
    p.step("acquire", *units(1000, 5000, 0))
    got, review = p.step("dispose", *units(300, 2400, 8))
    assert [x / ONE for x in got] == [700, 3500, 5, 1500, 892] and not review
    got, review = p.step("dispose", *units(900, 100, 0))
    assert got[:2] == [0, 0] and review


def test_lots_by_hand():
    p = Lots()
    p.step("acquire", *units(10, 50, 0)), p.step("acquire", *units(5, 50, 0))
    got, _ = p.step("dispose", *units(12, 180, 0))
    assert got[3] == 70 * ONE and got[1] == 30 * ONE
    q = Lots(last=True)
    q.step("acquire", *units(10, 50, 0)), q.step("acquire", *units(5, 50, 0))
    assert q.step("dispose", *units(8, 100, 0))[0][3] == 65 * ONE
    f, a = Lots(), Pool()
    for pool in (f, a):
        pool.step("acquire", *units(10, 50, 0)), pool.step("acquire", *units(10, 150, 0))
    assert f.step("dispose", *units(10, 200, 0))[0][4] == 150 * ONE and a.step("dispose", *units(10, 200, 0))[0][4] == 100 * ONE


def test_replay_conserves_cost(spark):
    rows = [(1 + i % 3, i, "acquire" if i % 4 else "dispose", Decimal(i % 7 + 1), Decimal(10 * i + 3), Decimal("0.5")) for i in range(200)]
    moves = spark.createDataFrame(rows, "k int, seq int, kind string, units decimal(18,2), value decimal(18,2), fee decimal(18,2)")
    for method in ("acb", "fifo", "lifo"):
        out = replay(moves, ["k"], ["seq"], method).toPandas()
        for k, g in out.groupby("k"):
            bought = sum(v + f for v, f, kind in zip(g.value, g.fee, g.kind) if kind == "acquire")
            last = g.sort_values("seq").iloc[-1]
            assert abs(bought - g.cost_used.sum() - last.cost_after) < Decimal("0.0001"), (method, k)
    assert replay(moves.limit(0), ["k"], ["seq"]).count() == 0


def test_time_joins(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), ("a", 20)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1), ("a", 19, 2), ("a", 25, 3), ("a", 20, 4)], "k string, rt long, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(asof_join(left, right, ["k"], "t", "rt", ["v"])) == sorted([("a", 10, 10, 1), ("a", 20, 20, 4), ("a", 20, 20, 4), ("b", 5, None, None)], key=str)
    assert rows(asof_join(left, right, ["k"], "t", "rt", ["v"], exact=False)) == sorted([("a", 10, None, None), ("a", 20, 19, 2), ("a", 20, 19, 2), ("b", 5, None, None)], key=str)
    assert rows(asof_join(left, right, ["k"], "t", "rt", ["v"], "forward", exact=False)) == sorted([("a", 10, 19, 2), ("a", 20, 25, 3), ("a", 20, 25, 3), ("b", 5, None, None)], key=str)
    assert rows(asof_join(left, right, ["k"], "t", "rt", ["v"], exact=False, tolerance=0)) == sorted([("a", 10, None, None), ("a", 20, None, None), ("a", 20, None, None), ("b", 5, None, None)], key=str)
    assert range_join(left, right, ["k"], "t", "rt", -1, 5).count() == 1 + 2 * 3
    assert rows(nearest_join(left, right, ["k"], "t", "rt", "v", 3)) == [("a", 10, 10, 1, 0), ("a", 20, 20, 4, 0), ("a", 20, 20, 4, 0)]


def test_nearest_forms_no_pairs(spark):
    import random

    rng = random.Random(5)
    right = [(rng.choice("ab"), rng.randrange(-40, 400), rng.choice((None, 1, 2, 3))) for _ in range(90)] + [(None, 5, 1), ("a", None, 1)]
    left = [(i, rng.choice("abc"), rng.randrange(-60, 430)) for i in range(300)] + [(300, None, 5), (301, "a", None), (302, "a", 7), (302, "a", 7)]
    out = nearest_join(spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, rt long, v int"), ["k"], "t", "rt", "v", 10)
    want = []
    for i, k, t in left:
        near = [(abs(at - t), at, v is not None, v) for key, at, v in right if None not in (k, t, at) and key == k and abs(at - t) <= 10]
        if near:
            gap, at, _, v = min(near, key=lambda x: x[:3] + (x[3] or 0,))
            want.append((i, k, t, at, v, gap))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[0] for r in got}) > 100
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "x", 1, True), (2, "y", 1, False)], "k int, v string, n int, sure boolean")
    new = spark.createDataFrame([(1, "z", 2, False), (2, "w", 2, False), (3, "q", 1, False)], old.schema)
    get = lambda df: {r.k: r.v for r in df.collect()}
    assert get(upsert(old, new, ["k"], "n")) == {1: "z", 2: "w", 3: "q"}
    assert get(upsert(old, new, ["k"], "n", mode="first")) == {1: "x", 2: "y", 3: "q"}
    assert get(upsert(old, new, ["k"], "n", guard="sure")) == {1: "x", 2: "w", 3: "q"}


def test_greedy_takes_each_side_once(spark):
    pairs = spark.createDataFrame([("s", 1, 10, 100, 110), ("s", 1, 11, 100, 111), ("s", 2, 10, 101, 110), ("s", 2, 12, 101, 120), ("t", 1, 10, 100, 110)], "k string, out_id int, in_id int, out_ts int, in_ts int")
    assert {(r.k, r.out_id, r.in_id) for r in greedy(pairs, ["k"]).collect()} == {("s", 1, 10), ("s", 2, 12), ("t", 1, 10)}


CALL = "chain string, action_type string, method_name string, tx_type string, direction string, counterparty string, amount long, selector string, is_own boolean"


def test_rules(spark):
    rows = [
        ("near", "function_call", "STAKE", None, "out", "x.poolv1.near", 1, None, False), ("near", "TRANSFER", None, None, "in", "system", 1, None, False), ("near", "FUNCTION_CALL", "ft_transfer", None, "in", "a", 1, None, True),
        ("near", "FUNCTION_CALL", "ft_transfer", None, "in", "a", 1, None, False), ("evm", None, None, None, "in", "a", 1, "0x", False), ("evm", None, None, None, "in", "a", 1, "0x38ED1739", False), ("exchange", None, None, "Sale", None, None, None, None, None), ("near", "TRANSFER", None, None, "IN", "a", 1, None, False),
    ]
    got = [r.c.category for r in spark.createDataFrame(rows, CALL).select(classify(ALL).alias("c")).collect()]
    assert got == ["stake", "reward", "transfer_in", "unknown", "deposit", "trade", "sell", "unknown"]
    ties = [Rule("first", "all", "a", 1, 5), Rule("second", "all", "b", 1, 5), Rule("above", "all", "c", 1, 9, direction="in")]
    got = [r.c.rule for r in spark.createDataFrame(rows[:2], CALL).select(classify(ties).alias("c")).collect()]
    assert got == ["first", "above"] and len({r.name for r in ALL}) == len(ALL) and len(NEAR) == 42


def test_swaps_and_paths(spark):
    path = "0x" + "a" * 40 + "0001f4" + "b" * 40 + "000bb8" + "C" * 40
    row = spark.createDataFrame([(path,)], "p string").select(path_tokens(F.col("p")).alias("t")).select("t", legs(F.col("t"), F.lit(1)).alias("l")).first()
    assert row.t == ["0x" + c * 40 for c in "abc"]
    assert [(x.leg_type, x.leg_index) for x in row.l] == [("parent", 0), ("sell_leg", 0), ("intermediate_leg_1", 1), ("buy_leg", 2), ("fee_leg", 3)]
    assert [x.needs_review for x in row.l] == [True, False, True, False, False]


def test_spam_signals(spark):
    rows = [("known", None, "out", False), ("x", 0.0005, "in", False), ("x", 0.0005, "out", False), ("x", 0.0, "in", False), ("x", None, "in", True), ("x", 0.0005, "in", True), ("x", 5.0, "in", None)]
    t = spark.createDataFrame(rows, "c string, usd double, direction string, tagged boolean")
    got = [round(r[0], 2) for r in t.select(spam_score(F.col("c") == "known", F.col("usd"), F.col("direction"), F.col("tagged"))).collect()]
    assert got == [0.99, 0.92, 0.46, 0.0, 0.46, 1.0, 0.0]


def test_scalars(spark):
    t = spark.createDataFrame([("1234567890123456789012345678",), ("5",), ("-5",), (None,)], "raw string")
    got = [r[0] for r in t.select(scalars.to_human_units(F.col("raw"), 24)).collect()]
    assert got == ["1234.567890123456789012345678", "0." + "0" * 23 + "5", "-0." + "0" * 23 + "5", None]
    n = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (1_700_000_000_123_456_789,)], "x long")
    assert {r[0] for r in n.select(scalars.to_epoch_seconds(F.col("x"))).collect()} == {1_700_000_000}
    assert filters.fiscal_year_range(2024, 12) == ("2024-01-01", "2025-01-01") and filters.fiscal_year_range(2024, 2) == ("2023-03-01", "2024-03-01")
    s = spark.createDataFrame([(1.0, 1.2), (1.0, 2.0), (None, 3.0), (4.0, None)], "a double, b double").select(two_sources(F.col("a"), F.col("b")))
    assert [r[0] for r in s.collect()] == [1.1, 1.0, 3.0, 4.0]
    sym = spark.createDataFrame([("usdc.x", "near", None), (None, "near", None), (None, "near", "btc"), ("zz", "near", None)], "t string, c string, a string")
    got = [r[0] for r in sym.select(scalars.symbol_of(F.col("t"), F.col("c"), F.col("a"), {"usdc.x": "USDC"}, {"near": "NEAR"})).collect()]
    assert got == ["USDC", "NEAR", "BTC", "ZZ"]
    scalars.register_functions(spark)
    assert spark.sql("select fmt_cad(2.005), fmt_cad(null), epoch_seconds(1700000000123)").first()[1:] == ("", 1700000000)


def test_components_and_ranks(spark):
    scratch = Scratch(spark, "test-graph")
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), scratch).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[101] == roots[103] == 100 and 200 not in roots and 0 not in roots
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    keys = spark.createDataFrame([(x * 7919 % 1000, x % 3) for x in range(1000)], "x long, y long").distinct()
    got = [(r.x, r.y) for r in global_rank(keys, ["x", "y"], scratch).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == keys.count()
