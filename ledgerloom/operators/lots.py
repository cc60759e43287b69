"""First in, first out, in closed form.

A lot takes the stretch of the acquired units that it adds: from what was acquired before it
to what was acquired with it. A disposal takes a stretch of the same line, from what had
been disposed of before it. More than is held can't go: what was lost that way so far is
the largest excess of disposals over acquisitions up to now, so a running maximum gives it. Where the stretches of a lot and of a
disposal meet, that many units of the lot went with the disposal; the rest of the line is held.

All of it is window functions over parts of a key: running sums are taken within slices of time and shifted by
the sums of the slices before, and the line is cut into stretches of equal length, so a key with
very many rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice of time, and lots of mean size that a stretch of the line holds.
SLICE_SECONDS, STRETCH_LOTS = 90 * 86400, 4096
WHOLE = "decimal(38,0)"


def _whole(c: Column) -> Column:
    """A decimal as a whole number of 1e-8."""
    return (F.coalesce(c.cast("decimal(28,8)"), F.lit(0)) * F.lit(100000000)).cast(WHOLE)


def positions(moves: DataFrame, keys: list[str], order: list[str], ts_s: str = "ts_s", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """moves (keys, order, kind acquire or dispose, units) with from_, to_: the stretch of each on its key's line, in 1e-8 units, and oversold; and lot_mean, the key's mean lot (1 at least)."""
    nothing = F.lit(0).cast(WHOLE)
    of = lambda kind: F.when(F.col("kind") == kind, _whole(F.col("units"))).otherwise(nothing)
    part = [*keys, "__slice"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = moves.filter("kind in ('acquire', 'dispose')").withColumns({"__slice": F.floor(F.col(ts_s) / slice_seconds), "__a": of("acquire"), "__d": of("dispose")})
    rows = rows.withColumns({"__in": F.sum("__a").over(w).cast(WHOLE), "__out": F.sum("__d").over(w).cast(WHOLE)})
    rows = rows.withColumn("__over", (F.col("__out") - F.col("__in")).cast(WHOLE)).withColumns({"__most": F.max("__over").over(w), "__most_before": F.max("__over").over(before)})

    sums = rows.groupBy(*part).agg(F.sum("__a").cast(WHOLE).alias("a"), F.sum("__d").cast(WHOLE).alias("d"), F.max("__over").alias("m"), F.count_if(F.col("kind") == "acquire").alias("n"))  # a row a slice
    of_key = Window.partitionBy(*keys)
    mean = F.ceil(F.sum("a").over(of_key).cast(WHOLE) / F.greatest(F.lit(1), F.sum("n").over(of_key)))
    past = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__in0": F.coalesce(F.sum("a").over(past).cast(WHOLE), nothing), "__out0": F.coalesce(F.sum("d").over(past).cast(WHOLE), nothing)})
    sums = sums.withColumn("lot_mean", F.greatest(F.lit(1), mean).cast(WHOLE))
    sums = sums.withColumn("__top", (F.col("m") + F.col("__out0") - F.col("__in0")).cast(WHOLE)).withColumn("__lost0", F.greatest(nothing, F.coalesce(F.max("__top").over(past), nothing)))
    rows = rows.join(sums.select(*part, "__in0", "__out0", "__lost0", "lot_mean"), part)

    shift = F.col("__out0") - F.col("__in0")
    lost = lambda c: F.greatest(F.col("__lost0"), F.coalesce((F.col(c) + shift).cast(WHOLE), nothing))
    acquired, gone = (F.col("__in") + F.col("__in0")).cast(WHOLE), (F.col("__out") + F.col("__out0")).cast(WHOLE)
    bought = F.col("kind") == "acquire"
    to = F.when(bought, acquired).otherwise((gone - lost("__most")).cast(WHOLE))
    start = F.when(bought, (acquired - F.col("__a")).cast(WHOLE)).otherwise((gone - F.col("__d") - lost("__most_before")).cast(WHOLE))
    out = rows.withColumns({"from_": start, "to_": to, "oversold": ~bought & (lost("__most") > lost("__most_before"))})
    return out.select(*moves.columns, "from_", "to_", "oversold", "lot_mean")


def matches(at: DataFrame, keys: list[str], lot: Column, sold: Column, stretch_lots: int = STRETCH_LOTS) -> DataFrame:
    """keys, lot, sold, start and end: where the stretches of lots and disposals meet; of units that are held, sold is null.

    at: as positions has it; lot and sold are what is told of either. Lots cover the line without gaps, disposals a part from its start. The stretches are
    cut at the same places; within a cut, every end of a stretch ends a piece, which belongs to the next lot and the next disposal that end. Of a lot and a disposal that
    end together, one has the piece and the other one of no length. One running pass from the end of a cut to its start finds them."""
    bought, w = F.col("kind") == "acquire", F.col("__width")
    rows = at.filter("to_ > from_").select(*keys, "from_", "to_", (F.col("lot_mean") * stretch_lots).cast(WHOLE).alias("__width"), F.when(bought, lot).alias("lot"), F.when(~bought, sold).alias("sold"))
    rows = rows.withColumn("__cut", F.explode(F.sequence(F.call_function("div", F.col("from_"), w), F.call_function("div", F.col("to_") - 1, w))))
    end = F.least(F.col("to_"), ((F.col("__cut") + 1) * w).cast(WHOLE))
    ends = rows.select(*keys, "__cut", (F.col("__cut") * w).cast(WHOLE).alias("__begin"), end.alias("end"), "lot", "sold")
    back = Window.partitionBy(*keys, "__cut").orderBy(F.desc("end"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.withColumns({"start": F.coalesce(F.lead("end").over(back), F.col("__begin")), **{c: F.last(c, ignorenulls=True).over(upto) for c in ("lot", "sold")}})
    return pieces.filter("end > start").select(*keys, "lot", "sold", "start", "end")


def part_of(total: Column, from_: Column, to: Column, start: Column, end: Column) -> Column:
    """What start .. end takes of a total spread evenly over from_ .. to, in 1e-8, so that all parts add up to the total."""
    return _share(total, end - from_, to - from_) - _share(total, start - from_, to - from_)


def _share(total: Column, part: Column, whole: Column) -> Column:
    """total * part / whole, rounded half up; whole numbers that are not negative."""
    twice = (total.cast(WHOLE) * part.cast(WHOLE)).cast(WHOLE) * 2 + whole
    return F.call_function("div", twice.cast(WHOLE), (whole * 2).cast(WHOLE))


def cut_pieces(at: DataFrame, keys: list[str], lot: list[str], sold: list[str], stretch_lots: int = STRETCH_LOTS) -> DataFrame:
    """Pieces of stretches (at: as positions has it, with value and fee), for sums over them: keys, lot_<lot>, sold_<sold>, sold (false: still held), units and cost in 1e-8, and ends: whether its lot ends with it.

    lot and sold are the columns of at that are told of either; a piece that a cut goes through is several. A lot costs value + fee."""
    cost = (_whole(F.col("value")) + _whole(F.col("fee"))).cast(WHOLE)
    told = lambda names: [F.col(c).alias(c) for c in names]
    found = matches(at, keys, F.struct(*told(lot), cost.alias("__cost"), "from_", "to_"), F.struct(*told(sold), F.lit(True).alias("__sold")), stretch_lots)
    part = part_of(F.col("lot.__cost"), F.col("lot.from_"), F.col("lot.to_"), F.col("start"), F.col("end"))
    return found.select(
        *keys, *(F.col(f"lot.{c}").alias(f"lot_{c}") for c in lot), *(F.col(f"sold.{c}").alias(f"sold_{c}") for c in sold), F.col("sold").isNotNull().alias("sold"),
        (F.col("end") - F.col("start")).cast(WHOLE).alias("units"), part.alias("cost"), (F.col("end") == F.col("lot.to_")).alias("ends"),
    )


def fifo(moves: DataFrame, keys: list[str], order: list[str], ts_s: str = "ts_s", slice_seconds: int = SLICE_SECONDS, stretch_lots: int = STRETCH_LOTS) -> tuple[DataFrame, DataFrame]:
    """Pieces: keys, lot_<order>, sold_<order>, sold (false: still held), units and cost in 1e-8; and moves with their stretches.

    moves: keys, order, kind, and decimals units, value and fee; a lot costs value + fee."""
    at = positions(moves, keys, order, ts_s, slice_seconds)
    lot, sold = [f"lot_{c}" for c in order], [f"sold_{c}" for c in order]
    cut = cut_pieces(at, keys, order, order, stretch_lots)
    pieces = cut.groupBy(*keys, *lot, *sold, "sold").agg(F.sum("units").cast(WHOLE).alias("units"), F.sum("cost").alias("cost"))  # a piece that a cut went through is one again
    return pieces, at
