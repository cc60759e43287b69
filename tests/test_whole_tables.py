"""Queries that once read a part of their tables, against the whole job in DuckDB or by hand."""

import os

import pytest

from ledgerloom.adapters import onchain
from ledgerloom.operators.pricing import with_rate
from ledgerloom.plans import catalogue

from .test_queries import DATA, cell, duck  # noqa: F401

WHOLE = ("r03_ledger_report", "t02_review_queue", "w07_forward_fill", "j21_rate_lookback", "prc07_missing_days")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", WHOLE)
def test_reads_the_whole_table(spark, duck, name):  # noqa: F811
    df = catalogue.queries()[name](spark, DATA)
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = [tuple(cell(r[c]) for c in names) for r in df.collect()], [tuple(map(cell, r)) for r in rel.fetchall()]
    assert theirs and sorted(mine) == sorted(theirs)
    if name == "t02_review_queue":
        assert mine == theirs  # in order


def test_rate_lookback_has_no_single_window(spark):
    rows = spark.createDataFrame([(1, 10), (2, 15), (3, 16), (4, 9), (5, None), (6, 12), (6, 12)], "id int, day int")
    rates = spark.createDataFrame([(10, 1.5), (12, 2.5), (12, 2.0), (None, 9.0)], "rate_day int, rate double")
    out = with_rate(rows, rates)
    assert sorted((r.id, r.rate, r.estimated) for r in out.collect()) == [(1, 1.5, False), (2, 2.5, False), (3, 2.5, False), (4, 1.36, True), (5, 1.36, True), (6, 2.5, False), (6, 2.5, False)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def bridges(rows):
    """The reference's loop: transfers out and in of one user and symbol in time order, within 1 % of the amount in and 1,800 s, each used once."""
    found, used = set(), set()
    rows = sorted(rows, key=lambda r: (r.ts_s, r.id))
    for o in (r for r in rows if r.direction == "out"):
        for i in (r for r in rows if r.direction == "in"):
            a, b = round(o.value * 100), round(i.value * 100)
            close = abs(a - b) / b <= 0.01 if b else a == b
            if i.id not in used and (o.user_id, o.symbol) == (i.user_id, i.symbol) and o.chain != i.chain and close and abs(i.ts_s - o.ts_s) <= 1800:
                used.add(i.id)
                found.add((o.user_id, o.symbol, o.id, i.id))
                break
    return found


EVENTS = "event_id long, user_id long, event_type string, ts_s long, value double, props string"


def test_bridges_of_each_user(spark, tmp_path):
    import random

    rng = random.Random(11)
    rows = [(i, rng.randrange(3), rng.choice(("view", "click")), 900_000_000 + (i // 60) * 5000 + rng.randrange(2500), rng.choice((0.0, 10.0, 10.05, 10.1, 10.3, 99.0, 100.0)), "{}") for i in range(400)]
    rows += [(1000, 7, "view", 1000, 5.0, "{}"), (1004, 8, "click", 1001, 5.0, "{}"), (1002, 7, "click", 400, 5.0, "{}")]  # another user's in, and an in before its out
    events = spark.createDataFrame(rows, EVENTS).selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(ts_s) as ts", "value", "props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = bridges(onchain(spark, str(tmp_path)).collect())
    got = [(r.user_id, r.symbol, r.out_id, r.in_id) for r in catalogue.queries()["j08_bridge_greedy"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30 and (7, "NEAR", 1000, 1002) in want
