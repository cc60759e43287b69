"""Cost-basis folds as table functions for SQL: SELECT * FROM replay_pools(TABLE(moves) PARTITION BY (user_id, token) ORDER BY ts, id).

register makes one for tables of any columns, which Spark hands over row by row; register_batches makes one for tables
of given columns, which come and go as Arrow batches and so is the one for large tables.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.folds import METHODS, Pool, decimals, strings, wholes

_MONEY = T.DecimalType(38, 8)
_POOL = [*(T.StructField(f, _MONEY) for f in Pool.fields), T.StructField("needs_review", T.BooleanType())]


def _check(columns: list[str], method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    missing = {"kind", "units", "value", "fee"} - set(columns)
    if missing:
        raise ValueError(f"the table lacks {', '.join(sorted(missing))}")


def _whole(x) -> int:
    return int((Decimal(x or 0) * 10**8).to_integral_value())


class ReplayPools:
    """Each row of the table with its pool after it. The table has kind, units, value and fee, other columns pass through; method is a name of METHODS."""

    def __init__(self):
        self.fold = None

    @staticmethod
    def analyze(moves: AnalyzeArgument, method: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = "acb" if method is None else method.value
        _check(moves.dataType.names, name)
        return AnalyzeResult(schema=T.StructType([*moves.dataType.fields, *_POOL]))

    def eval(self, moves, method: str = "acb"):
        if self.fold is None:
            self.fold = METHODS[method]()
        got, review = self.fold.step(moves["kind"], _whole(moves["units"]), _whole(moves["value"]), _whole(moves["fee"]))
        yield (*moves, *(Decimal(x).scaleb(-8) for x in got), review)


def register(spark: SparkSession) -> None:
    """Makes replay_pools known to the session's SQL."""
    spark.udtf.register("replay_pools", udtf(ReplayPools))


def _wholes(column: pa.Array) -> list[int]:
    """Amounts as whole numbers of 1e-8, null as zero; decimals of no more places are read from their buffer."""
    if not pa.types.is_decimal128(column.type) or not 0 <= column.type.scale <= 8:
        return [_whole(x) for x in column.to_pylist()]
    return wholes(column)


def register_batches(spark: SparkSession, name: str, moves: T.StructType, method: str = "acb") -> None:
    """Makes name known to the session's SQL: replay_pools by one method, for tables that have the columns of moves in their order."""
    _check(moves.names, method)

    class ReplayBatches:
        """One pool's rows, in batches."""

        def __init__(self):
            self.fold = METHODS[method]()

        def eval(self, batch):
            rows = zip(strings(batch.column("kind")), *(_wholes(batch.column(c)) for c in ("units", "value", "fee")), strict=True)
            got = [self.fold.step(*r) for r in rows]
            sums = [decimals(list(c)) for c in zip(*(g for g, _ in got), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, pa.array([r for _, r in got], pa.bool_())], names=[*moves.names, *(f.name for f in _POOL)])

    spark.udtf.register(name, arrow_udtf(ReplayBatches, returnType=T.StructType([*moves.fields, *_POOL])))
