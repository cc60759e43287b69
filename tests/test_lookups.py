"""Call data, spread rules, pools' ratios, applied changes, the table function and streams with restarts and late rows."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.pools import register, register_batches
from ledgerloom.operators import changes, decode
from ledgerloom.operators.folds import ONE, Pool
from ledgerloom.streaming.commits import KINDS, PROVIDER, ROCKS, Commits, LatePools, late_pools, run_now


def word(n):
    return f"{n:064x}"


def test_call_paths(spark):
    a, b, c = ("11" * 20, "22" * 20, "33" * 20)
    path = a + "000bb8" + b + "0001f4" + c
    body = lambda at, n, p: "0xC04B8D59" + word(at) + word(7) * ((at - 32) // 32) + word(n) + p
    rows = {
        "three": body(160, len(path) // 2, path), "near": body(32, len(path) // 2, path + "00" * 9), "one": body(32, 20, a), "short": body(32, 10, "44" * 10), "cut": body(160, len(path) // 2, path[:-2]), "beyond": body(32, 20, a).replace(word(32), word(4096)),
        "huge": body(32, 20, a).replace(word(32), "f" * 64), "none": "0xc04b8d59", "odd": body(32, 20, a) + "0", "text": "0xc04b8d59" + "zz" * 64, "null": None, "bare": body(32, 20, a)[2:],
    }
    df = spark.createDataFrame(list(rows.items()), "k string, data string")
    got = {r.k: r.t for r in df.select("k", decode.call_path(F.col("data")).alias("t")).collect()}
    x = lambda *p: ["0x" + y for y in p]
    assert got == {"three": x(a, b, c), "near": x(a, b, c), "one": x(a), "bare": x(a), "short": [], **dict.fromkeys(("cut", "beyond", "huge", "none", "odd", "text", "null"))}


def test_rules_reach_all_users(spark):
    moves = spark.createDataFrame([(1, 1, "A.near", "SCAMcoin"), (2, 2, "a.NEAR", "sc"), (3, 3, None, "scamX"), (4, 4, "b.near", None)], "id long, user_id long, counterparty string, token string")
    rules = spark.createDataFrame([(1, "contract_address", "a.Near", True), (2, "token_symbol", "Scam", True), (3, "token_symbol", "s", True), (4, "token_symbol", "sc", False), (5, "token_symbol", "", True), (6, "other", "sc", True), (7, "token_symbol", None, True)], "rule_id long, rule_type string, value string, is_active boolean")
    got = {(r.rule_id, r.tx_id, r.user_id) for r in decode.spread_rules(moves, rules).collect()}
    assert got == {(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 3, 3), (3, 1, 1), (3, 2, 2), (3, 3, 3)}
    assert decode.spread_rules(moves, rules.limit(0)).count() == 0


def test_spread_rules_do_not_deal_movements_by_value(spark):
    moves = spark.range(50).selectExpr("id", "id as user_id", "'A.near' as counterparty", "'SCAM' as token")
    rules = spark.range(40).selectExpr("id as rule_id", "if(id % 2 = 0, 'contract_address', 'token_symbol') as rule_type", "if(id % 2 = 0, 'a.near', 'sc') as value", "true as is_active")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decode.spread_rules(moves, rules)
        assert out.count() == 50 * 40
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_spread_rules_take_few_bytes_a_row(spark, tmp_path):
    """The rows are movements times rules: written as they come, a movement's rules repeat those of the one before."""
    moves = spark.range(300).selectExpr("id", "id % 7 as user_id", "if(id % 3 = 0, null, 'a.near') as counterparty", "if(id % 2 = 0, 'SCAM', 'other') as token")
    rules = spark.range(20_000).selectExpr("id as rule_id", "if(id % 2 = 0, 'contract_address', 'token_symbol') as rule_type", "if(id % 2 = 0, 'A.near', 'sc') as value", "true as is_active")
    path = str(tmp_path / "out")
    decode.spread_rules(moves, rules).write.parquet(path)
    fits = moves.crossJoin(rules).filter("if(rule_type = 'contract_address', counterparty = 'a.near', token = 'SCAM')").select("rule_id", F.col("id").alias("tx_id"), "user_id")
    got = spark.read.parquet(path)
    assert got.count() == fits.count() == 350 * 10_000 and got.exceptAll(fits).isEmpty()
    assert sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) < 0.5 * 350 * 10_000


def test_first_pool_of_a_pair(spark):
    rows = [(3, ["x", "w"], ["2", "10"]), (2, ["w", "x"], ["0", "5"]), (1, ["w", "x", "y"], ["1", "1", "1"]), (4, ["w", "x"], ["9", "1"]), (5, ["w", "y"], ["9"]), (6, ["y", "w"], ["n/a", "3"]), (7, ["y", "w"], ["4", "1"]), (8, ["w", "w"], ["1", "1"]), (9, ["x", "y"], ["1", "1"])]
    df = spark.createDataFrame(rows, "pool_id long, tokens array<string>, amounts array<string>")
    assert sorted((r.token, r.price, r.pool_id) for r in decode.pool_prices(df, "w", F.lit(2.0)).collect()) == [("x", 10.0, 3), ("y", 0.5, 7)]


MOVES = "user_id long, token string, ts timestamp, id long, kind string, units decimal(18,2), value decimal(18,2), fee decimal(18,2)"


def moves(n_users=40):
    t0 = dt.datetime(2024, 1, 1)
    return [(u, "X", t0 + dt.timedelta(days=i), u * 100 + i, "dispose" if i % 3 == 2 else "acquire", D(i + 1), D(10 * (u + i)), D(1)) for u in range(n_users) for i in range(9)]


def test_changes_touch_only_their_folders(spark, tmp_path):
    path, keys, order = str(tmp_path / "pools"), ["user_id", "token"], ["ts", "id"]
    df = spark.createDataFrame(moves(), MOVES)
    changes.write_pools(df, path, keys, order, 16)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    edited = df.withColumn("value", F.when(F.col("user_id").isin(3, 7), F.col("value") * 2).otherwise(F.col("value")).cast("decimal(18,2)"))
    edits = spark.createDataFrame([(3, "X", dt.datetime(2024, 5, 2)), (7, "X", dt.datetime(2024, 5, 3)), (9, "X", dt.datetime(2024, 4, 1))], "user_id long, token string, edited_at timestamp")
    touched = changes.affected(edits, keys, F.lit("2024-05-01").cast("timestamp"))
    changes.apply_changes(spark, path, edited, touched, keys, order, 16)
    parts = {r.p for r in touched.select(changes.part_of(keys, 16).alias("p")).collect()}
    kept = {f for f in before if not any(f"part={p}/" in f for p in parts)}
    assert kept <= files() and (before - kept).isdisjoint(files())
    changes.write_pools(edited, str(tmp_path / "full"), keys, order, 16)
    rows = lambda p: sorted(map(str, spark.read.parquet(p).select(*keys, "id", "units_after", "cost_after", "gain").collect()))
    assert rows(path) == rows(str(tmp_path / "full"))


def test_fold_from_sql(spark):
    register(spark)
    df = spark.createDataFrame([(1, "X", dt.datetime(2024, 1, 1), 1, "acquire", D(1000), D(5000), D(0)), (1, "X", dt.datetime(2024, 1, 2), 2, "dispose", D(300), D(2400), D(8)), (2, "X", dt.datetime(2024, 1, 1), 3, "dispose", D(1), D(1), D(0))], MOVES)
    got = spark.sql("SELECT * FROM replay_pools(TABLE({t}) PARTITION BY (user_id, token) ORDER BY (ts, id)) ORDER BY id", t=df).collect()
    assert [(float(r.units_after), float(r.cost_after), float(r.gain), r.needs_review) for r in got] == [(1000, 5000, 0, False), (700, 3500, 892, False), (0, 0, 1, True)]
    with pytest.raises(Exception, match="method is one of"):
        spark.sql("SELECT * FROM replay_pools(TABLE({t}) PARTITION BY user_id ORDER BY ts, 'none')".replace(" ORDER BY ts, 'none')", " ORDER BY ts, method => 'none')"), t=df).collect()


def test_fold_from_sql_in_batches(spark):
    """The batch form gives the rows of the row form, also where batches end within a pool; null amounts count as zero."""
    rows = [*moves(5), (9, None, dt.datetime(2024, 1, 1), 900, "acquire", D("2.50"), None, D(1))]
    df = spark.createDataFrame(rows, MOVES)
    register(spark)
    register_batches(spark, "replay_moves", df.schema)
    call = "SELECT * FROM {}(TABLE({{t}}) PARTITION BY (user_id, token) ORDER BY (ts, id)) ORDER BY id"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = spark.sql(call.format("replay_moves"), t=df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and got == spark.sql(call.format("replay_pools"), t=df).collect()
    with pytest.raises(ValueError, match="method is one of"):
        register_batches(spark, "replay_moves", df.schema, "none")


def test_batches_are_committed_once(spark, tmp_path):
    commits = Commits(str(tmp_path / "t"))
    batch = spark.createDataFrame([(1, i, f"h{i}") for i in range(150)], "wallet_id long, block long, tx_hash string")
    commits.write(batch, 0)
    commits.write(batch, 0)
    commits.write(batch.withColumn("wallet_id", F.lit(2).cast("long")).limit(3), 1)
    assert commits.read(spark).count() == 153
    again = commits.replay(spark, 20)
    assert again.filter("wallet_id = 1").count() == 100 and again.agg(F.min("block"), F.max("block")).first()[:] == (21, 120)


def test_landings_are_written_by_all_tasks(spark, tmp_path):
    from ledgerloom.plans.streams import landings

    rows = spark.range(0, 900, 1, 3)
    for i in landings(rows, str(tmp_path / "in"), [2, 0, 1], 3):
        files = spark.read.parquet(str(tmp_path / "in")).selectExpr("input_file_name() as f", "pmod(hash(id), 3) as p").selectExpr("count(distinct f)", "count(distinct p)").first()
        assert files[1] == {2: 1, 0: 2, 1: 3}[i] and files[0] == 3 * files[1]
    assert spark.read.parquet(str(tmp_path / "in")).count() == 900


def test_late_movements_are_put_in_place(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "user_id long, token string, ts timestamp, seq long, kind string, units double, value double, fee double"
    acquire, dispose = (1, "X", t(1), 1, "acquire", 1000.0, 5000.0, 0.0), (1, "X", t(5), 2, "dispose", 300.0, 2400.0, 8.0)
    batches = [[dispose], [acquire], [(1, "X", t(40), 3, "dispose", 700.0, 100.0, 0.0)], [(1, "X", t(2), 4, "acquire", 5.0, 5.0, 0.0), (1, "X", t(39), 5, "acquire", 100.0, 500.0, 0.0)]]
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        got = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            commits = Commits(str(tmp_path / f"out{i}"))
            run_now(late_pools(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 10 * 86400), str(tmp_path / "ck"), commits.write)
            r = commits.read(spark).first()
            got.append((r.units_after, r.cost_after, r.gain, r.too_late))
    finally:
        spark.conf.set(PROVIDER, before)
    assert got[0] == (0, 0, 2392, 0)  # nothing was held yet
    assert got[1] == (700, 3500, 892, 0)  # the sale is replayed on what came late
    assert got[2] == (0, 0, 892 + 100 - 3500, 0)
    assert got[3][0] == 100 and got[3][3] == 1  # day 2 is before what is kept, day 39 is not


class OneValue:
    """State of one bucket, as a processor sees it."""

    def __init__(self):
        self.value, self.writes = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


def in_order(moves, keep):
    """Pools of movements (pool, at, a, kind, units, value, fee) that come in batches, from lists that are sorted and replayed from their start each time."""
    held, out = {}, {}
    for batch in moves:
        for name, *m in batch:
            at, base, late, kept = held.setdefault(name, [None, None, 0, []])
            if base and (m[0], m[1], m[3]) <= base[0]:
                held[name][2] += 1
            else:
                kept.append(m)
        for name in {x[0] for x in batch}:
            _, base, late, kept = held[name]
            kept.sort(key=lambda m: (m[0], m[1], m[3]))
            pool, gain, stay = Pool(), 0, []
            if base:
                pool.units, pool.cost, gain = base[1]
            edge = max((m[0] for m in kept), default=base and base[0][0]) - keep
            for m in kept:
                gain += pool.step(*m[2:])[0][4]
                if m[0] < edge:
                    base = ((m[0], m[1], m[3]), (pool.units, pool.cost, gain))
                else:
                    stay.append(m)
            held[name] = [None, base, late, stay]
            out[name] = (pool.units / ONE, pool.cost / ONE, gain / ONE, late, stay[-1][0] if stay else base[0][0])
        yield {name: out[name] for name in {x[0] for x in batch}}


@pytest.mark.parametrize(("keep", "wide"), [(10**6, False), (60, False), (60, True)])
def test_pools_of_a_bucket_come_and_go_at_once(keep, wide):
    rng, kinds = random.Random(7), ["acquire", "acquire", "dispose", "in", "out", "other"]
    amount = lambda: rng.randrange(1, 10**10) * (10**12 if wide and rng.random() < 0.01 else 1)
    # times wander on, so that movements become too old, and many are equal
    batches = [[(f"{rng.randrange(40)}:X y", (20 * b + rng.randrange(100)) * 10**6, rng.randrange(3), rng.choice(kinds), amount(), amount(), rng.randrange(10**7)) for _ in range(rng.choice([1, 30, 2000]))] for b in range(12)]
    p, n_late = LatePools(keep, ("a", "units")), 0
    p.pools = OneValue()
    for i, (batch, want) in enumerate(zip(batches, in_order(batches, keep * 10**6), strict=True)):
        df = pd.DataFrame({"bucket": 0, "pool": [m[0] for m in batch], "move": [" ".join(map(str, [*m[1:3], KINDS.index(m[3]), *m[4:]])) for m in batch]})
        got = pd.concat(p.handleInputRows((0,), iter([df[:700], df[700:]]), None))
        assert {r[0]: r[1:] for r in got.itertuples(index=False, name=None)} == want and p.pools.writes == i + 1
        n_late += sum(w[3] for w in want.values())
    assert (n_late > 0) == (keep == 60)
    pools, moves = p._unpack(*p.pools.value)
    assert sum(x["n"] for x in pools) == len(moves["at"]) and all(len(x["after"]) <= 1 + x["n"] / 64 for x in pools)
    assert wide or len(p.pools.value[1]) < 60 * len(moves["at"])


def test_late_pools_take_any_order_and_names(spark, tmp_path):
    """Of equal times the given columns count, nulls first; users and tokens may be null or hold signs of their own."""
    t = dt.datetime(2024, 1, 1)
    schema = "user_id long, token string, ts timestamp, a long, b int, kind string, units decimal(38,8), value decimal(38,8), fee decimal(22,4)"
    big = D(10) ** 20
    rows = [(-1, "x: y", t, 2, 1, "dispose", D(5), D(50), None), (-1, "x: y", t, 1, 2, "acquire", D(10), D(20), D("0.5")), (-1, "x: y", t, None, 2, "acquire", D(1), D(1), None), (None, None, t, 1, 1, "acquire", big, big, D(0)), (None, "", t, 1, 1, "acquire", D("0.00000001"), D(3), D(0)), (4, None, t, 1, 1, "gift", D(1), D(1), D(0))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    before, commits = spark.conf.get(PROVIDER), Commits(str(tmp_path / "out"))
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run_now(late_pools(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 86400, ("a", "b"), 3), str(tmp_path / "ck"), commits.write)
    finally:
        spark.conf.set(PROVIDER, before)
    got = {(r.user_id, r.token): (r.units_after, r.cost_after, r.gain) for r in commits.read(spark).collect()}
    used = D("21.5") / 11 * 5
    assert got.pop((-1, "x: y")) == pytest.approx((6, float(D("21.5") - used), float(50 - used)), abs=1e-6)
    assert got == {(None, None): (1e20, 1e20, 0), (None, ""): (1e-8, 3, 0), (4, None): (0, 0, 0)}
