"""Checks of balances against what chains and exchanges say: duplicates, merges, gaps, and what a difference may come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join, latest, range_join

# Scores of the signals, the scores from which a match is merged or shown, seconds and per cent within which two entries agree.
SAME_TIME_AND_ASSET, SAME_TIME, SAME_DAY_AND_ASSET = 0.85, 0.80, 0.60
MERGE_FROM, SHOW_FROM, MATCH_SECONDS, MATCH_PERCENT = 0.75, 0.50, 600, 1
GOES_OUT = ("send", "withdrawal", "sell", "trade")
COMES_IN = ("receive", "deposit", "buy", "reward", "interest", "staking_reward", "airdrop", "mining")
GAP_TOLERANCE, GAP_TIMES, LAST_CHECKPOINTS = "0.01", 2, 24
SILENCE_SECONDS = 7 * 86400


def best_matches(entries: DataFrame, transfers: DataFrame) -> DataFrame:
    """Of each exchange entry (entry_id, user_id, entry_s, entry_symbol, entry_amount) the on-chain transfer that agrees best, with score and signal.

    Amounts agree within 1 % of the transfer's; then the time (10 minutes) and the asset, the time alone, or the day and the asset count. Of equals the earliest."""
    soon = range_join(entries, transfers, ["user_id"], "entry_s", "transfer_s", -MATCH_SECONDS, MATCH_SECONDS)
    day = lambda c: F.floor(F.col(c) / 86400)
    left = entries.withColumns({"__day": day("entry_s"), "__symbol": F.col("entry_symbol")})
    right = transfers.withColumns({"__day": day("transfer_s"), "__symbol": F.col("transfer_symbol")})
    same_day = left.join(right, ["user_id", "__day", "__symbol"]).select(*soon.columns)
    same = F.col("entry_symbol") == F.col("transfer_symbol")
    mark = lambda df, score, signal: df.withColumns({"score": score, "signal": signal})
    pairs = mark(soon, F.when(same, SAME_TIME_AND_ASSET).otherwise(SAME_TIME), F.when(same, "amount_time_asset").otherwise("amount_time")).unionByName(mark(same_day, F.lit(SAME_DAY_AND_ASSET), F.lit("amount_day_asset")))
    close = F.when(F.col("transfer_amount") == 0, F.col("entry_amount") == 0).otherwise(100 * F.abs(F.col("entry_amount") - F.col("transfer_amount")) <= MATCH_PERCENT * F.abs(F.col("transfer_amount")))
    return latest(pairs.filter(close), ["entry_id"], [F.desc("score"), F.col("transfer_s"), F.col("transfer_id")])


def balances(moves: DataFrame, fees: str = "all") -> DataFrame:
    """Per wallet and token what came in less what went out less fees (of all movements, or with fees="out" of those that went out)."""
    sign = F.when(F.col("direction") == "in", F.col("units")).when(F.col("direction") == "out", -F.col("units")).otherwise(0)
    paid = F.col("fee") if fees == "all" else F.when(F.col("direction") == "out", F.col("fee"))
    return moves.groupBy("wallet_id", "token").agg(F.sum(sign - F.coalesce(paid, F.lit(0))).alias("calculated"))


def threshold_actions(matches: DataFrame, moves: DataFrame, verified: DataFrame) -> DataFrame:
    """matches (with wallet_id, entry_symbol, entry_amount, tx_type, score) with calculated, after, actual and action.

    From MERGE_FROM on a match is merged if the balance without the entry is nearer to the one on chain, and else shown, as are those from SHOW_FROM on.
    Without a balance on chain (verified: wallet_id, token, verified_s, actual; the latest that is not null counts), or for a type of neither direction, nothing is merged."""
    last = latest(verified.filter("actual is not null"), ["wallet_id", "token"], [F.desc("verified_s"), F.desc("actual")]).select("wallet_id", "token", "actual")
    m = matches.filter(F.col("score") >= SHOW_FROM).withColumn("token", F.upper("entry_symbol"))
    m = m.join(balances(moves), ["wallet_id", "token"], "left").join(last, ["wallet_id", "token"], "left").withColumn("calculated", F.coalesce("calculated", F.lit(0)))
    kind = F.lower(F.trim("tx_type"))
    after = F.when(kind.isin(*COMES_IN), F.col("calculated") - F.col("entry_amount")).when(kind.isin(*GOES_OUT), F.col("calculated") + F.col("entry_amount"))
    m = m.withColumn("after", after)
    better = F.abs(F.col("after") - F.col("actual")) < F.abs(F.col("calculated") - F.col("actual"))
    return m.withColumn("action", F.when((F.col("score") >= MERGE_FROM) & F.coalesce(better, F.lit(False)), "auto_merged").otherwise("flagged_for_review"))


def month_gaps(moves: DataFrame, archived: DataFrame) -> DataFrame:
    """Months whose change of the indexed balance differs from that of the archived one by over twice the tolerance.

    moves: wallet_id, ts_s, direction, units, fee; fees always lower a balance. archived: wallet_id, at_s, balance, asked at each month's last movement. Only
    the last 24 months with movements count; one without an archived balance is left out. One row a wallet and month goes through the windows."""
    sign = F.when(F.col("direction") == "in", F.col("units")).when(F.col("direction") == "out", -F.col("units")).otherwise(0)
    month = F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM")
    m = moves.groupBy("wallet_id", month.alias("month")).agg(F.sum(sign - F.coalesce("fee", F.lit(0))).alias("moved"), F.max("ts_s").alias("end_s"), F.count("*").alias("rows"))
    w = Window.partitionBy("wallet_id").orderBy("month")
    m = m.withColumns({"running": F.sum("moved").over(w), "__back": F.row_number().over(Window.partitionBy("wallet_id").orderBy(F.desc("month"))), "__n": F.sum("rows").over(Window.partitionBy("wallet_id"))})
    m = m.filter((F.col("__back") <= LAST_CHECKPOINTS) & (F.col("__n") >= 2)).drop("__back", "__n", "rows", "moved")
    m = asof_join(m, archived, ["wallet_id"], "end_s", "at_s", ["balance"]).filter("balance is not null")
    change = lambda c: F.col(c) - F.lag(c).over(w)
    m = m.withColumns({"delta_indexed": change("running"), "delta_onchain": change("balance"), "start_s": F.lag("end_s").over(w)})
    m = m.withColumn("gap", F.abs(F.col("delta_indexed") - F.col("delta_onchain")))
    return m.filter(F.col("gap") > GAP_TIMES * F.lit(GAP_TOLERANCE).cast("decimal(4,2)")).select("wallet_id", "month", "start_s", "end_s", "delta_indexed", "delta_onchain", "gap")


def staking_confidence(rewards: Column, epochs: Column) -> Column:
    """How sure it is that rewards are missing: by the share of epochs with a stake that lack one."""
    gap = (epochs - rewards) / epochs * 100
    return F.when(epochs > 0, F.when(gap > 20, 0.70).when(gap > 10, 0.50))


def fee_confidence(paid: Column, tracked: Column, difference: Column) -> Column:
    """How sure it is that fees are not counted: by how near their gap is to the difference of the balances."""
    gap = F.abs(paid - tracked)
    ratio = F.when((gap > 0) & (difference != 0), gap / F.abs(difference))
    return F.when(ratio.between(0.8, 1.2), 0.75).when(ratio.between(0.5, 1.5), 0.55)


def diagnose(rows: DataFrame) -> DataFrame:
    """rows with diagnosis and confidence: the first of four, in order, that is surer than 0.5; else unknown, 0.

    rows: chain, difference, rewards, epochs, fees_paid, fees_tracked, longest_silence (seconds), misclassified; nulls count as nothing seen."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    steps = [
        ("missing_staking_rewards", F.when(F.col("chain") == "near", staking_confidence(n("rewards"), n("epochs")))),
        ("uncounted_fees", fee_confidence(n("fees_paid"), n("fees_tracked"), n("difference"))),
        ("unindexed_period", F.when(n("longest_silence") > SILENCE_SECONDS, 0.60)),
        ("classification_error", F.when(n("misclassified") > 0, 0.65)),
    ]
    found = F.coalesce(*(F.when(sure > 0.5, F.struct(F.lit(name).alias("diagnosis"), sure.alias("confidence"))) for name, sure in steps), F.struct(F.lit("unknown").alias("diagnosis"), F.lit(0.0).alias("confidence")))
    return rows.withColumn("__d", found).select(*rows.columns, "__d.*")
