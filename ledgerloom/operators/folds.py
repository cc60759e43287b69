"""Cost-basis folds: pools and lots replayed in order, exact to eight decimals.

Rows are dealt by key and sorted within partitions; a fold streams through a partition
with one key's state at a time, so a long history needs no more memory than its pool
(or its open lots). Amounts are whole numbers of 1e-8 throughout.
"""

from __future__ import annotations

from collections import deque
from decimal import Context, Decimal
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE = 10**8
_WIDE, _LOW = Context(prec=60), (1 << 64) - 1


def scaled(c):
    """A decimal column as a whole number of 1e-8."""
    return F.round(F.coalesce(c.cast("decimal(38,8)"), F.lit(0)) * ONE).cast("decimal(38,0)")


def wide(c):
    """A decimal column with eight decimals; null counts as zero. Its unscaled value is a whole number of 1e-8."""
    return F.coalesce(c.cast("decimal(38,8)"), F.lit(0).cast("decimal(38,8)"))


def unscaled(column: pa.Array) -> list[int | None]:
    """The unscaled values of a decimal128 column, read from its buffer."""
    if not len(column):
        return []
    raw = np.frombuffer(column.buffers()[1], np.int64, 2 * len(column), 16 * column.offset)
    low, high = raw[::2], raw[1::2]
    if (high == low >> 63).all():
        out = low.tolist()
    else:
        out = [(h << 64) | (x & _LOW) for x, h in zip(low.tolist(), high.tolist(), strict=True)]
    return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out


def strings(column: pa.Array) -> list[str | None]:
    """A column of few different strings, each of them read once."""
    coded = column.dictionary_encode(null_encoding="encode")
    names = coded.dictionary.to_pylist()
    return [names[i] for i in coded.indices.to_numpy().tolist()]


def starts(columns: list[pa.Array], before: tuple | None) -> list[bool]:
    """Which rows (there are some) have other keys than the row before them; before: the keys that come before the first."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = before is None or tuple(c[0].as_py() for c in columns) != before
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return new.tolist()


def wholes(column: pa.Array) -> list[int]:
    """A decimal128 column of eight places at most as whole numbers of 1e-8; null counts as zero."""
    ones = 10 ** (8 - column.type.scale)
    values = unscaled(column)
    return values if ones == 1 and not column.null_count else [(x or 0) * ones for x in values]


def decimals(values: list[int]) -> pa.Array:
    """A decimal128(38, 8) column of whole numbers of 1e-8."""
    try:
        low = np.array(values, np.int64)
        data = np.stack([low, low >> 63], 1).tobytes()
    except OverflowError:  # some need more than 64 bits
        data = b"".join([x.to_bytes(16, "little", signed=True) for x in values])
    return pa.Array.from_buffers(pa.decimal128(38, 8), len(values), [None, pa.py_buffer(data)])


def half_up(a: int, b: int) -> int:
    """a / b rounded half away from zero."""
    q = (2 * abs(a) + b) // (2 * b)
    return q if a >= 0 else -q


class Pool:
    """Average cost. A disposal of more than is held is cut to what is held, and marked."""

    fields = ("units_after", "cost_after", "acb_per_unit", "cost_used", "gain")

    def __init__(self):
        self.units = self.cost = 0

    def move(self, kind: str, units: int, value: int, fee: int) -> tuple[int, int, int, bool]:
        """Takes one movement. Gives the cost of a unit and of all units of a disposal, its gain, and whether it is marked."""
        used = gain = each = 0
        review = False
        if kind == "acquire":
            self.units += units
            self.cost += value + fee
        elif kind == "dispose":
            review = units > self.units
            units = min(units, self.units)
            each = half_up(self.cost * ONE, self.units) if self.units else 0
            used = half_up(units * each, ONE)
            gain = value - fee - used
            self.units -= units
            self.cost = self.cost - used if self.units else 0
        elif kind == "in":
            self.units += units
        elif kind == "out":
            review = units > self.units
            self.units = max(0, self.units - units)
        return each, used, gain, review

    def step(self, kind: str, units: int, value: int, fee: int) -> tuple[list[int], bool]:
        each, used, gain, review = self.move(kind, units, value, fee)
        after = half_up(self.cost * ONE, self.units) if self.units else 0
        return [self.units, self.cost, each or after, used, gain], review


class Lots:
    """First in, first out; with last=True last in, first out."""

    fields = ("units_after", "cost_after", "acb_per_unit", "cost_used", "gain")

    def __init__(self, last: bool = False):
        self.lots, self.last, self.units, self.cost = deque(), last, 0, 0

    def step(self, kind: str, units: int, value: int, fee: int) -> tuple[list[int], bool]:
        used = gain = 0
        review = False
        if kind in ("acquire", "in"):
            cost = value + fee if kind == "acquire" else 0
            if units:
                self.lots.append([units, cost])
            self.units, self.cost = self.units + units, self.cost + cost
        elif kind in ("dispose", "out"):
            review = units > self.units
            left = min(units, self.units)
            self.units -= left
            while left:
                lot = self.lots[-1 if self.last else 0]
                take = min(left, lot[0])
                part = lot[1] if take == lot[0] else half_up(lot[1] * take, lot[0])
                lot[0], lot[1], left, used = lot[0] - take, lot[1] - part, left - take, used + part
                if not lot[0]:
                    self.lots.pop() if self.last else self.lots.popleft()
            self.cost -= used
            gain = value - fee - used if kind == "dispose" else 0
        return [self.units, self.cost, half_up(self.cost * ONE, self.units) if self.units else 0, used, gain], review


class Unrounded:
    """Average cost without rounding or clamp: more than is held may go, and then the pool is below zero; from an empty pool nothing goes."""

    fields = Pool.fields

    def __init__(self):
        self.units, self.cost = 0, Decimal(0)

    def step(self, kind: str, units: int, value: int, fee: int) -> tuple[list[int], bool]:
        used, gain, review = Decimal(0), Decimal(0), False
        if kind == "acquire":
            self.units, self.cost = self.units + units, _WIDE.add(self.cost, value + fee)
        elif kind == "dispose":
            review = units > self.units
            if self.units > 0:
                used = _WIDE.divide(_WIDE.multiply(self.cost, units), self.units)
                gain = _WIDE.subtract(Decimal(value - fee), used)
                self.units, self.cost = self.units - units, _WIDE.subtract(self.cost, used)
        each = _WIDE.divide(self.cost * ONE, self.units) if self.units else Decimal(0)
        return [self.units, *(int(x.to_integral_value(context=_WIDE)) for x in (self.cost, each, used, gain))], review


def half_even(a: int, b: int) -> int:
    """a / b, neither below zero, rounded to the nearest, halves to the even one."""
    q, r = divmod(a, b)
    return q + (2 * r > b or (2 * r == b and q % 2 == 1))


class Cents:
    """Average cost whose disposals cost whole cents; what rounding would take below zero stays zero."""

    fields = Pool.fields

    def __init__(self):
        self.units = self.cost = 0

    def step(self, kind: str, units: int, value: int, fee: int) -> tuple[list[int], bool]:
        used = gain = 0
        review = False
        each = half_even(self.cost * ONE, self.units) if self.units else 0
        if kind == "acquire":
            self.units, self.cost = self.units + units, self.cost + value + fee
        elif kind == "dispose":
            review = units > self.units
            units = min(units, self.units)
            used = half_up(units * each, 10**14) * 10**6
            gain = value - fee - used
            self.units, self.cost = self.units - units, max(0, self.cost - used)
        return [self.units, self.cost, each, used, gain], review


class Principal:
    """What was staked; an unstaking of more than that has the rest as reward (in gain), and then nothing is left. out takes all."""

    fields = Pool.fields

    def __init__(self):
        self.units = 0

    def step(self, kind: str, units: int, value: int, fee: int) -> tuple[list[int], bool]:
        reward = 0
        if kind == "acquire":
            self.units += units
        elif kind == "dispose":
            reward = units - self.units if units > self.units > 0 else 0
            self.units = max(0, self.units - units)
        elif kind == "out":
            self.units = 0
        return [self.units, 0, 0, 0, reward], False


METHODS = {"acb": Pool, "unrounded": Unrounded, "cents": Cents, "principal": Principal, "fifo": Lots, "lifo": lambda: Lots(last=True)}


def replay(events: DataFrame, keys: list[str], order: list[str], method: str = "acb", seed: DataFrame | None = None) -> DataFrame:
    """events: keys, order, kind (acquire, dispose, in, out) and decimals units, value, fee. Adds the pool after each event.

    seed (keys, units_after, cost_after; average cost only) is what each pool holds before the first event."""
    amounts = ["units", "value", "fee"]
    fits = lambda t: isinstance(t, T.DecimalType) and 0 <= t.scale <= 8
    read = {c: c if fits(events.schema[c].dataType) else f"__{c}" for c in amounts}  # what fits isn't dealt twice
    rows = events.withColumns({n: wide(F.col(c)) for c, n in read.items() if n != c})
    if seed is not None:
        start = seed.select(*keys, wide(F.col("units_after")).alias("__held"), wide(F.col("cost_after")).alias("__cost"))
        rows = rows.join(start, keys, "left")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    kept = [f for f in events.schema.fields]
    fields, make, money = Pool.fields, METHODS[method], T.DecimalType(38, 8)
    schema = T.StructType([*kept, *(T.StructField(f, money) for f in fields), T.StructField("needs_review", T.BooleanType())])
    place = {n: i for i, n in enumerate(rows.columns)}

    def run(batches):
        at, state = None, None
        for batch in batches:
            column = lambda n: batch.column(place[n])
            held = zip(unscaled(column("__held")), unscaled(column("__cost")), strict=True) if "__held" in place else repeat((None, None))
            if not batch.num_rows:
                continue
            keyed = [column(k) for k in keys]
            moves = zip(starts(keyed, at), strings(column("kind")), *(wholes(column(read[c])) for c in amounts), held)
            got, review = [], []
            at = tuple(c[-1].as_py() for c in keyed)
            for first, kind, units, value, fee, (units_held, cost_held) in moves:
                if first:
                    state = make()
                    if units_held is not None:
                        state.units, state.cost = units_held, cost_held
                out, flag = state.step(kind, units, value, fee)
                got.append(out)
                review.append(flag)
            arrays = [batch.column(place[f.name]) for f in kept]
            sums = [decimals(list(g)) for g in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *sums, pa.array(review, pa.bool_())], names=schema.names)

    return dealt.mapInArrow(run, schema)
