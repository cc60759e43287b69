"""FIFO in closed form against the fold that keeps a queue of lots."""

import random
from collections import deque
from fractions import Fraction

from ledgerloom.operators import lots

SCHEMA = "k string, ts_s long, n long, kind string, units decimal(20,8), value decimal(20,8), fee decimal(20,8)"
ORDER = ["ts_s", "n"]


def queue(moves):
    """By hand: pieces (lot, sold, units, cost), what is left, and oversold disposals."""
    held, pieces, over = deque(), {}, set()
    for _, _, n, kind, units, value, fee in moves:
        units = Fraction(units)
        if kind == "acquire":
            if units:
                held.append([n, units, Fraction(value) + Fraction(fee), units])
            continue
        while units and held:
            lot = held[0]
            take = min(units, lot[1])
            u, c = pieces.get((lot[0], n), (0, 0))
            pieces[lot[0], n] = (u + take, c + lot[2] * take / lot[3])
            lot[1] -= take
            units -= take
            if not lot[1]:
                held.popleft()
        if units:
            over.add(n)
    return pieces, {x[0]: x[1] for x in held}, over


def moves_of(seed, n=120):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice((0, 1, 40, 90)) * 86400
        kind = "acquire" if rng.random() < 0.55 else "dispose"
        units = rng.choice(("0", "1", "2.5", "10", "0.00000001", "33.33333333", "1000"))
        out.append((str(seed), t, i, kind, units, str(rng.randint(0, 500)), rng.choice(("0", "0.01", "8"))))
    return out


def run(spark, rows, **more):
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:4], *map(Decimal, r[4:])) for r in rows], SCHEMA)
    return lots.fifo(df, ["k"], ORDER, **more)


def test_equal_to_a_queue_of_lots(spark):
    rows = [r for seed in range(6) for r in moves_of(seed)]
    for more in ({}, {"slice_seconds": 86400 * 50, "stretch_lots": 1}):
        pieces, at = run(spark, rows, **more)
        got, flags = pieces.collect(), at.collect()
        for seed in range(6):
            want, left, over = queue(moves_of(seed))
            mine = {(r.lot_n, r.sold_n): (Fraction(r.units) / 10**8, Fraction(r.cost) / 10**8) for r in got if r.k == str(seed) and r.sold}
            assert set(mine) == set(want)
            assert all(mine[k][0] == u and abs(mine[k][1] - c) <= Fraction(2, 10**8) for k, (u, c) in want.items())
            assert {r.lot_n: Fraction(r.units) / 10**8 for r in got if r.k == str(seed) and not r.sold} == left
            assert {r.n for r in flags if r.k == str(seed) and r.oversold} == over


def test_parts_add_up_to_each_lot(spark):
    rows = moves_of(9, 200)
    pieces, _ = run(spark, rows)
    whole = {r[2]: Fraction(r[5]) + Fraction(r[6]) for r in rows if r[3] == "acquire" and Fraction(r[4])}
    sums = {}
    for r in pieces.collect():
        sums[r.lot_n] = sums.get(r.lot_n, 0) + Fraction(r.cost) / 10**8
    assert sums == whole


def test_known_cases(spark):
    """Lots 10 at 5 and 5 at 10: 8 cost 40; 12 cost 50 and 20; with two lots of 10 at 5 and 15, FIFO gains 150 on 10 sold at 20."""
    base = [("a", 1, 1, "acquire", "10", "50", "0"), ("a", 2, 2, "acquire", "5", "50", "0")]
    one, _ = run(spark, [*base, ("a", 3, 3, "dispose", "8", "96", "0")])
    assert [(r.lot_n, r.sold, int(r.units) / 1e8, int(r.cost) / 1e8) for r in one.orderBy("lot_n", "sold").collect()] == [(1, False, 2, 10), (1, True, 8, 40), (2, False, 5, 50)]
    two, _ = run(spark, [*base, ("a", 3, 3, "dispose", "12", "180", "0")])
    assert [(r.lot_n, int(r.cost) / 1e8) for r in two.filter("sold").orderBy("lot_n").collect()] == [(1, 50), (2, 20)]
    far, _ = run(spark, [("a", 1, 1, "acquire", "10", "50", "0"), ("a", 2, 2, "acquire", "10", "150", "0"), ("a", 3, 3, "dispose", "10", "200", "0")])
    assert 200 - sum(int(r.cost) / 1e8 for r in far.filter("sold").collect()) == 150


def test_cut_pieces_add_up_without_frames_that_look_ahead(spark):
    """Pieces as cut have the sums of whole ones, each lot that is left ends once, and no window goes over all later rows for every row."""
    from decimal import Decimal

    rows = [r for seed in range(3) for r in moves_of(seed)]
    df = spark.createDataFrame([(*r[:4], *map(Decimal, r[4:])) for r in rows], SCHEMA)
    cut = lots.cut_pieces(lots.positions(df, ["k"], ORDER), ["k"], ["n"], ["n"], 2)
    assert "currentrow$(), unboundedfollowing$()" not in cut._jdf.queryExecution().executedPlan().toString()
    whole, sums = lots.fifo(df, ["k"], ORDER)[0].collect(), {}
    got = cut.collect()
    assert len(got) > len(whole)
    for r in got:
        u, c, e = sums.get((r.k, r.lot_n, r.sold_n), (0, 0, 0))
        sums[r.k, r.lot_n, r.sold_n] = (u + r.units, c + r.cost, e + r.ends)
    assert {k: v[:2] for k, v in sums.items()} == {(r.k, r.lot_n, r.sold_n): (r.units, r.cost) for r in whole}
    left = [v[2] for (k, _, n), v in sums.items() if n is None]
    assert left and set(left) == {1}


def test_nothing_held_and_empty(spark):
    pieces, at = run(spark, [("a", 1, 1, "dispose", "5", "50", "0"), ("a", 2, 2, "acquire", "5", "50", "0")])
    assert [(r.sold, int(r.units)) for r in pieces.collect()] == [(False, 5 * 10**8)] and [r.oversold for r in at.orderBy("n").collect()] == [True, False]
    pieces, at = run(spark, [])
    assert pieces.count() == 0 and at.count() == 0


def test_wide_amounts_pass_the_buffers():
    import pyarrow as pa
    from decimal import Decimal

    from ledgerloom.operators.folds import decimals, unscaled

    values = [0, 1, -1, 2**63, -(2**70), 10**29 + 7]
    column = decimals(values)
    assert unscaled(column) == values and column.to_pylist()[1] == Decimal("0.00000001")
    assert unscaled(column.slice(3, 2)) == values[3:5]
    assert unscaled(decimals([5, -7])) == [5, -7] and unscaled(decimals([])) == []
    assert unscaled(pa.array([Decimal("1.5"), None], pa.decimal128(38, 8))) == [150000000, None]


def test_amounts_are_dealt_once(spark):
    """Decimals that eight places hold go to the fold as they are; others, and nulls, count as before."""
    from decimal import Decimal

    from ledgerloom.operators.folds import replay

    rows = [("a", 1, "acquire", Decimal("2.50"), 10.25, None), ("a", 2, "dispose", Decimal("1.25"), 7.0, Decimal("0.000000014"))]
    df = spark.createDataFrame(rows, "k string, n long, kind string, units decimal(18,2), value double, fee decimal(20,9)")
    out = replay(df, ["k"], ["n"])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "__units" not in plan and "__value" in plan and "__fee" in plan
    assert [(r.units_after, r.cost_after, r.gain) for r in out.orderBy("n").collect()] == [(Decimal("2.5"), Decimal("10.25"), 0), (Decimal("1.25"), Decimal("5.125"), Decimal("1.87499999"))]


def test_pools_start_where_keys_change():
    import pyarrow as pa

    from ledgerloom.operators.folds import starts, strings

    a, b = pa.array([1, 1, None, None, 2]), pa.array(["x", "x", "x", None, None])
    assert starts([a, b], None) == [True, False, True, True, True]
    assert starts([a, b], (1, "x")) == [False, False, True, True, True] and starts([a.slice(3), b.slice(3)], (None, None)) == [False, True]
    assert strings(pa.array(["in", None, "out", "in"]).slice(1)) == [None, "out", "in"]
