"""Classification in stages, each on what the one before left open, with the stage that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .decode import SPAM_FROM
from .joins import range_join
from .rules import FALLBACK_BELOW, REVIEW_BELOW, Rule, match

#: How sure a transfer between own accounts is, what stands in where nothing else decides, and how far a linked event may lie off.
OWN_CONFIDENCE, LINK_SECONDS = 0.95, 60
FALLBACK = ("unknown", 0.30)
LOCKUP_SUFFIX, LOCKUP_CATEGORIES = ".lockup.near", ("income", "reward", "deposit")


def linked(rows: DataFrame, events: DataFrame, out: str, within: int = LINK_SECONDS) -> DataFrame:
    """id and out: the event of the same user, wallet and hash, else the earliest within some seconds.

    rows: id, user_id, wallet_id, tx_hash, ts_s; events: event_id, user_id, wallet_id, tx_hash, event_s. Of several with one hash the last id counts."""
    on = ["user_id", "wallet_id"]
    rows = rows.select("id", *on, "tx_hash", "ts_s")
    hashed = events.filter("tx_hash is not null").groupBy(*on, "tx_hash").agg(F.max("event_id").alias("__by_hash"))
    rows = rows.join(hashed, [*on, "tx_hash"], "left")
    near = range_join(rows.filter("__by_hash is null").select("id", *on, "ts_s"), events.select(*on, "event_s", "event_id"), on, "ts_s", "event_s", -within, within)
    near = near.groupBy("id").agg(F.min(F.struct("event_s", "event_id")).alias("__near"))
    return rows.join(near, "id", "left").select("id", F.coalesce("__by_hash", "__near.event_id").alias(out))


def classify_stages(tx: DataFrame, owned: DataFrame, rules: list[Rule], staking: DataFrame | None = None, lockups: DataFrame | None = None, spam: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """tx with is_own, stage (spam, own, rule, fallback), rule, category, confidence, needs_review, and with staking or lockups their event ids.

    Spam ends it; so does a counterparty that the user owns (owned: user_id, account); then the rules; the fallback (a struct of
    category and confidence) is asked where no rule fits or one is less sure than FALLBACK_BELOW, and wins where it is surer.
    Rewards are linked to staking events, and what a lockup contract paid to lockup events. tx.id is unique; null counterparties are nobody's."""
    if fallback is None:
        fallback = F.struct(F.lit(FALLBACK[0]).alias("category"), F.lit(FALLBACK[1]).alias("confidence"))
    accounts = owned.select("user_id", F.lower("account").alias("__party")).distinct().withColumn("is_own", F.lit(True))
    t = tx.withColumn("__party", F.lower("counterparty")).join(accounts, ["user_id", "__party"], "left").withColumn("is_own", F.coalesce("is_own", F.lit(False)))
    t = match(t.withColumns({"__fallback": fallback, "__spam": F.lit(0.0) if spam is None else spam}), rules).withColumnsRenamed({c: f"__{c}" for c in ("rule", "category", "confidence")})
    sure, other = F.col("__confidence"), F.col("__fallback.confidence")
    none = F.col("__rule").isNull()
    asked = none | ((sure < FALLBACK_BELOW) & (other > sure))
    t = t.withColumn("stage", F.when(F.col("__spam") >= SPAM_FROM, "spam").when(F.col("is_own"), "own").when(asked, "fallback").otherwise("rule"))
    pick = lambda s, o, f, r: F.when(F.col("stage") == "spam", s).when(F.col("stage") == "own", o).when(F.col("stage") == "fallback", f).otherwise(r)
    side = F.when(F.col("direction") == "in", "transfer_in").otherwise("transfer_out")
    t = t.withColumns({
        "category": pick(F.lit("spam"), side, F.col("__fallback.category"), F.col("__category")), "confidence": pick(F.col("__spam"), F.lit(OWN_CONFIDENCE), other, sure),
        "rule": F.when(F.col("stage") == "rule", F.col("__rule")),
    })
    t = t.withColumn("needs_review", F.col("stage").isin("rule", "fallback") & (F.col("confidence") < REVIEW_BELOW))
    t = t.drop("__rule", "__category", "__confidence", "__fallback", "__spam")
    if staking is None and lockups is None:
        return t.drop("__party")
    t = Scratch(tx.sparkSession, "classified").save(t)  # what the links are looked up for, and what they are joined to
    decided = F.col("stage").isin("rule", "fallback")
    if staking is not None:
        t = t.join(linked(t.filter(decided & (F.col("category") == "reward")), staking, "staking_event_id"), "id", "left")
    if lockups is not None:
        paid = decided & F.col("__party").endswith(LOCKUP_SUFFIX) & F.col("category").isin(*LOCKUP_CATEGORIES)
        t = t.join(linked(t.filter(paid), lockups, "lockup_event_id"), "id", "left")
    return t.drop("__party")
