"""Streams run to the end of what has landed, and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ORDER, ledger
from ..operators import rule_catalogue as catalogue
from ..operators.pipeline import classify_stages
from ..scratch import Scratch
from ..streaming.commits import PROVIDER, ROCKS, Commits, late_pools, run_now
from .chain import STAGES, movements
from .costbasis import FOLD
from .registry import query

_MOVES = STAGES.split(",\nruled AS (")[0]
SINCE = 1704585600 + 5 * 86400  # 12 January 2024: a block number is the second of its movement here


def landings(df, root: str, parts: list[int], of: int = 6, key: str = "id"):
    """Lands the parts of the rows, by the hash of their key, one after the other; as many files as there are tasks."""
    for i in parts:
        df.filter(F.pmod(F.hash(key), F.lit(of)) == i).write.mode("append").parquet(root)
        yield i


def _committed(spark, sf_dir) -> Commits:
    """Movements land a sixth at a time; each is a batch, streamed after a restart from the checkpoint, and one batch is written twice."""
    scratch = Scratch(spark, "stream")
    t = movements(spark, sf_dir).filter("chain = 'exchange'").withColumns({"block": F.col("ts_s"), "method_name": F.lit(None).cast("string")}).drop("legs")
    nobody = t.select("user_id", F.lit("").alias("account")).limit(0)
    commits = Commits(f"{scratch.root}/table", lambda df: classify_stages(df, nobody, catalogue.EXCHANGE).select("user_id", "wallet_id", "id", "tx_hash", "block", "stage", "category", "confidence"))
    seen = []

    def write(batch, batch_id):
        commits.write(batch, batch_id)
        if not seen:
            commits.write(batch, batch_id)  # as after a failure between the write and its log
        seen.append(batch_id)

    for _ in landings(t, f"{scratch.root}/landed", [0, 1, 2, 3, 4, 5]):
        run_now(spark.readStream.schema(t.schema).parquet(f"{scratch.root}/landed"), f"{scratch.root}/checkpoint", write)
    return commits


@query("st05_stream_classification", f"WITH {STAGES} SELECT id, wallet_id, stage, category, confidence FROM classified WHERE chain = 'exchange'")
def st05(spark, sf_dir):
    """Each batch is classified as it comes; over a restart and a batch written twice, every movement is there once."""
    return _committed(spark, sf_dir).read(spark).select("id", "wallet_id", "stage", "category", F.col("confidence").cast("double").alias("confidence"))


@query("st04_replay_from_block", f"WITH {_MOVES} SELECT wallet_id, tx_hash, ts_s AS block FROM t WHERE chain = 'exchange' AND ts_s > {SINCE} QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY ts_s, tx_hash) <= 100")
def st04(spark, sf_dir):
    """What a client that knows all up to a block is sent first: of each wallet the next rows, 100 at most."""
    return _committed(spark, sf_dir).replay(spark, SINCE).select("wallet_id", "tx_hash", "block")


@query("st06_late_pools", f"WITH RECURSIVE {FOLD} SELECT user_id, token, (max_by(su, rn) / 1e8)::DOUBLE AS units_after, (max_by(sc, rn) / 1e8)::DOUBLE AS cost_after, (sum(gain) / 1e8)::DOUBLE AS gain, 0::BIGINT AS too_late FROM g GROUP BY 1, 2")
def st06(spark, sf_dir):
    """Movements arrive in any order, a third of them at a time; the pools are those of all in order."""
    scratch = Scratch(spark, "late")
    moves = ledger(spark, sf_dir).select("user_id", "token", *ORDER, "kind", "fee")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        commits = Commits(f"{scratch.root}/table")
        for _ in landings(moves, f"{scratch.root}/landed", [2, 0, 1], 3, "a"):
            stream = spark.readStream.schema(moves.schema).parquet(f"{scratch.root}/landed")
            run_now(late_pools(stream, 20 * 366 * 86400, tuple(ORDER[1:])), f"{scratch.root}/checkpoint", commits.write)
    finally:
        spark.conf.set(PROVIDER, before)
    last = commits.read(spark).groupBy("user_id", "token").agg(F.max_by(F.struct("units_after", "cost_after", "gain", "too_late"), "batch").alias("s"))
    return last.select("user_id", "token", "s.*")
