"""Structured Streaming jobs: wallets' rows, windows with late data, and pools kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import ONE, Pool, scaled


def wallet_rows(stream: DataFrame, wallets: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows (tx_hash, account_id, direction, ts) of known wallets, each once within the watermark."""
    return stream.withWatermark("ts", late).join(wallets, "account_id").dropDuplicatesWithinWatermark(["account_id", "tx_hash", "direction"])


def windowed_totals(stream: DataFrame, keys: list[str], value: str, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; what comes after the watermark is left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, keys: list[str], gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def within(left: DataFrame, right: DataFrame, key: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams (left_ts, right_ts) at most seconds apart."""
    a, b = left.withWatermark("left_ts", late), right.withWatermark("right_ts", late)
    near = F.expr(f"right_ts BETWEEN left_ts - INTERVAL {seconds} SECONDS AND left_ts + INTERVAL {seconds} SECONDS")
    return a.join(b, (a[key] == b[key]) & near)


def pools(stream: DataFrame) -> DataFrame:
    """stream: user_id, token, ts, seq, kind, units, value, fee. The pool of each key after each batch.

    Movements are put in order within a batch; one that is older than the last that its pool has taken is not replayed but counted as late."""
    rows = stream.select("user_id", "token", F.unix_micros("ts").alias("at"), "seq", "kind", *(scaled(F.col(c)).cast("string").alias(c) for c in ("units", "value", "fee")))
    out = "user_id long, token string, units_after double, cost_after double, gain double, late long"
    state = "units string, cost string, gain string, at long, late long"

    def step(key, batches: Iterator[pd.DataFrame], held):
        pool, gain, at, late = Pool(), 0, -(2**62), 0
        if held.exists:
            units, cost, gain, at, late = held.get
            pool.units, pool.cost, gain = int(units), int(cost), int(gain)
        moves = pd.concat(list(batches)).sort_values(["at", "seq"])
        for m in moves.itertuples():
            if m.at < at:
                late += 1
                continue
            got, _ = pool.step(m.kind, int(m.units), int(m.value), int(m.fee))
            gain, at = gain + got[4], m.at
        held.update((str(pool.units), str(pool.cost), str(gain), int(at), int(late)))
        yield pd.DataFrame([[*key, pool.units / ONE, pool.cost / ONE, gain / ONE, late]], columns=["user_id", "token", "units_after", "cost_after", "gain", "late"])

    return rows.groupBy("user_id", "token").applyInPandasWithState(step, out, state, "update", "NoTimeout")
