"""Joins on time that Spark has no operator for, as equi-joins on buckets or one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, low: int, high: int) -> DataFrame:
    """Inner join where right_ts - left_ts is in [low, high] seconds and on agrees; right's columns but on must have other names.

    Right rows go to one bucket of the range's width; left rows to the two or three that their range touches."""
    width = max(1, high - low)
    bucket = lambda c: F.floor(c / width).cast("long")
    many = left.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(left_ts) + low), bucket(F.col(left_ts) + high))))
    one = right.withColumn("__bucket", bucket(F.col(right_ts)))
    gap = F.col(right_ts) - F.col(left_ts)
    return many.join(one, [*on, "__bucket"]).filter((gap >= low) & (gap <= high)).drop("__bucket")


def window_sum(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, low: int, high: int, values: dict[str, Column], slice_seconds: int = 90 * 86400) -> DataFrame:
    """left with the sums of right's values where right_ts - left_ts is in [low, high] and on agrees (0 where nothing is), without forming the pairs.

    Each left row asks twice for a running sum: after the last of its range, and before the first. Running sums are taken within slices of time of a key and
    shifted by the slices before, so a key with very many rows is many tasks. Equal left rows each keep theirs."""
    names = list(values)
    none = [F.lit(0).alias(f"__{n}") for n in names]
    ask = lambda shift, side: left.select(*on, (F.col(left_ts) + shift).alias("__t"), F.lit(side).alias("__side"), F.struct(*left.columns).alias("__l"), *none)
    rows = right.select(*on, F.col(right_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__l"), *(values[n].alias(f"__{n}") for n in names))
    rows = rows.unionByName(ask(low, 0)).unionByName(ask(high, 2)).withColumn("__slice", F.floor(F.col("__t") / slice_seconds))
    w = Window.partitionBy(*on, "__slice").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*on, "__slice").agg(*(F.sum(f"__{n}").alias(f"__all_{n}") for n in names)).select(*on, "__slice", *(F.coalesce(F.sum(f"__all_{n}").over(past), F.lit(0)).alias(f"__past_{n}") for n in names))
    points = rows.withColumns({f"__run_{n}": F.sum(f"__{n}").over(w) for n in names}).filter("__side <> 1").join(sums, [*on, "__slice"])
    upto = lambda n, side: F.max(F.when(F.col("__side") == side, F.col(f"__run_{n}") + F.col(f"__past_{n}")))
    found = points.groupBy("__l").agg((F.count("*") / 2).cast("int").alias("__copies"), *((upto(n, 2) - upto(n, 0)).alias(n) for n in names))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("__l.*", *names)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", exact: bool = True, tolerance: int | None = None) -> DataFrame:
    """left with the values (and right_ts) of the nearest right row before (or after) in time, null where there is none.

    Both sides are put in one order by on and time; a running last value carries the right rows to the left ones. Of right
    rows at the same time the largest values win."""
    back = direction == "backward"
    both_first = (0, 1) if exact == back else (1, 0)  # which side comes first at equal times, in the order of the scan
    pack = F.struct(F.col(right_ts).alias("__at"), *(F.col(v) for v in values))
    rows = left.withColumns({"__t": F.col(left_ts), "__side": F.lit(both_first[1]), "__r": F.lit(None)}).withColumn("__l", F.struct(*left.columns)).select(*on, "__t", "__side", "__l", "__r")
    other = right.select(*on, F.col(right_ts).alias("__t"), F.lit(both_first[0]).alias("__side"), F.lit(None).alias("__l"), pack.alias("__r"))
    order = [F.col("__t"), F.col("__side"), F.col("__r").asc_nulls_first()] if back else [F.col("__t").desc(), F.col("__side").desc(), F.col("__r").asc_nulls_first()]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(other).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__l is not null")
    if tolerance is not None:
        found = found.withColumn("__r", F.when(F.abs(F.col("__r.__at") - F.col("__t")) <= tolerance, F.col("__r")))
    return found.select("__l.*", F.col("__r.__at").alias(right_ts), *(F.col(f"__r.{v}").alias(v) for v in values))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, value: str, tolerance: int) -> DataFrame:
    """left with value and right_ts of the right row nearest in time within tolerance; of two as near, the earlier. Equal left rows each keep theirs.

    No pairs are formed: right rows are one a key and time, and both sides are put in order within slices of time of a key as long as the tolerance. A slice also
    gets the last right row of the one before and the first of the one after; running last values in both directions give the two nearest. So a key with very many rows is many tasks."""
    width = max(1, tolerance)
    slice_of = lambda c: F.floor(c / width).cast("long")
    there = lambda df, ts: df.filter(" and ".join(f"`{c}` is not null" for c in (*on, ts)))
    least = F.when(F.count_if(F.col(value).isNull()) == 0, F.min(value))  # of equal times the least value, null first
    one = there(right, right_ts).groupBy(*on, F.col(right_ts).alias("__at")).agg(least.alias("__v")).withColumn("__slice", slice_of(F.col("__at")))
    ends = one.groupBy(*on, "__slice").agg(*(f(x).alias(n) for f, x, n in ((F.min, "__at", "__at0"), (F.max, "__at", "__at1"))), F.min_by("__v", "__at").alias("__v0"), F.max_by("__v", "__at").alias("__v1"))
    edge = lambda i, shift: ends.select(*on, F.col(f"__at{i}").alias("__at"), F.col(f"__v{i}").alias("__v"), (F.col("__slice") + shift).alias("__slice"))
    served = one.select(*on, "__at", "__v", "__slice").unionByName(edge(0, -1)).unionByName(edge(1, 1))
    served = served.select(*on, "__slice", F.col("__at").alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct("__at", "__v").alias("__r"))
    asked = there(left, left_ts).select(*on, slice_of(F.col(left_ts)).alias("__slice"), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).alias("__r"))
    part = Window.partitionBy(*on, "__slice")
    upto = lambda *order: F.last("__r", ignorenulls=True).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = served.unionByName(asked).withColumns({"__before": upto("__t", "__side"), "__after": upto(F.desc("__t"), "__side")}).filter("__l is not null")
    gap = lambda c: F.abs(F.col(f"{c}.__at") - F.col("__t"))
    near = lambda c: F.when(gap(c) <= tolerance, F.struct(gap(c).alias("gap"), F.col(f"{c}.__at").alias("at"), F.col(f"{c}.__v").alias("v")))
    best = rows.withColumn("__b", F.least(near("__before"), near("__after"))).filter("__b is not null")
    return best.select("__l.*", F.col("__b.at").alias(right_ts), F.col("__b.v").alias(value), F.col("__b.gap").alias("gap"))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; Spark cuts each partition to n rows of a key before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
