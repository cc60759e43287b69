"""All queries of the reference's operators."""

from __future__ import annotations

from . import accounting, aggregates, chain, costbasis, domain, filters, imports, lookups, more, payloads, reports, streams, verification, views  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
