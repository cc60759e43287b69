"""One-to-one matching of transfers by a greedy pass in time order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join


def candidates(out_: DataFrame, in_: DataFrame, on: list[str], seconds: int, percent: float, both_ways: bool = False, of: str = "out") -> DataFrame:
    """Pairs of a transfer out (out_id, out_chain, out_ts, out_amount) and one in on another chain, near in time and amount, with a score.

    percent is of the amount out (above 0) or, with of="in", of the amount in; there two amounts of 0 agree."""
    pairs = range_join(out_, in_, on, "out_ts", "in_ts", -seconds if both_ways else 0, seconds)
    gap, base = F.abs(F.col("in_amount") - F.col("out_amount")), F.col(f"{of}_amount")
    off = F.when(base > 0, gap / base)
    if of == "in":
        off = off.when((base == 0) & (gap == 0), 0.0)
    near = pairs.filter((F.col("out_chain") != F.col("in_chain")) & (off <= percent / 100))
    score = F.round(1 - off / (percent / 100) * 0.5 - F.abs(F.col("in_ts") - F.col("out_ts")) / seconds * 0.5, 4)
    return near.withColumn("score", score)


def runs(out_: DataFrame, in_: DataFrame, on: list[str], seconds: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with run: of each key, transfers in time order are cut where two lie over seconds apart, which no pair spans."""
    out_, in_ = out_.filter("out_ts is not null"), in_.filter("in_ts is not null")
    times = out_.select(*on, F.col("out_ts").alias("t")).unionByName(in_.select(*on, F.col("in_ts").alias("t"))).distinct()
    w = Window.partitionBy(*on).orderBy("t")
    fresh = F.when(F.col("t") - F.lag("t").over(w) <= seconds, None).otherwise(F.col("t"))
    named = times.withColumn("run", fresh).withColumn("run", F.last("run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tuple(side.join(named.withColumnRenamed("t", ts), [*on, ts]) for side, ts in ((out_, "out_ts"), (in_, "in_ts")))


def greedy(pairs: DataFrame, on: list[str]) -> DataFrame:
    """Of the pairs, in order of out and then in time, those neither side of which is taken; keys stream through sorted partitions."""
    order = ["out_ts", "out_id", "in_ts", "in_id"]
    dealt = pairs.repartition(*on).sortWithinPartitions(*on, *order)
    names = dealt.columns

    def run(batches):
        at, outs, ins = None, set(), set()
        for batch in batches:
            cols = [batch.column(names.index(c)).to_pylist() for c in [*on, "out_id", "in_id"]]
            keep = []
            for *key, a, b in zip(*cols, strict=True):
                if key != at:
                    at, outs, ins = key, set(), set()
                yes = a not in outs and b not in ins
                if yes:
                    outs.add(a), ins.add(b)
                keep.append(yes)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema)
