"""Predicates that the ledger's queries share."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What spam symbols contain.
SPAM_PATTERNS = ("%http%", "%visit%", "%claim%", "%.com%", "%.org%")


def fiscal_year_range(tax_year: int, year_end_month: int = 12) -> tuple[str, str]:
    """First day of the fiscal year that ends in tax_year, and the day after its last."""
    last = date(tax_year, year_end_month, monthrange(tax_year, year_end_month)[1])
    first = date(tax_year - 1 if year_end_month < 12 else tax_year, year_end_month % 12 + 1, 1)
    return first.isoformat(), (last + timedelta(days=1)).isoformat()


def looks_like_spam(symbol: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(symbol).like(p) for p in SPAM_PATTERNS))


def is_implicit_account(name: Column) -> Column:
    """64 characters, of which the first is a hex digit."""
    return (F.length(name) == 64) & name.rlike("^[0-9a-f]")


def all_of(start: str | None = None, end: str | None = None, equal: dict | None = None, search: tuple[str, tuple[str, ...]] | None = None, ts: str = "ts") -> Column:
    """The conjunction of the filters given; equality ignores case."""
    tests = [F.lit(True)]
    if start:
        tests.append(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end:
        tests.append(F.col(ts) < F.lit(end).cast("timestamp"))
    tests += [F.upper(F.col(c)) == str(v).upper() for c, v in (equal or {}).items()]
    if search:
        text, columns = search
        tests.append(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(text.lower()) for c in columns)))
    return reduce(lambda a, b: a & b, tests)
