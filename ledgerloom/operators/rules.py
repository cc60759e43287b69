"""Classification rules compiled to one CASE expression: the first that fits in order of priority, then of listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A field that is None or empty asks nothing. selector: None don't care, "" must have none."""

    name: str
    chain: str
    category: str
    confidence: float
    priority: int
    action: tuple[str, ...] = ()
    method: tuple[str, ...] = ()
    tx_type: tuple[str, ...] = ()
    direction: str | None = None
    suffix: tuple[str, ...] = ()
    among: tuple[str, ...] = ()
    exact: str | None = None
    contains: str | None = None
    amount_above: int | None = None
    selector: str | None = None
    own: bool | None = None

    def condition(self, low: Callable[[str], str] = lambda c: f"lower(coalesce({c}, ''))", action: str = "upper(coalesce(action_type, ''))") -> str:
        """The rule as SQL text. low gives a field in lower case, action is action_type in upper case; both with '' for null."""
        tests, party = [], low("counterparty")
        if self.chain != "all":
            tests.append(f"chain = {quoted(self.chain)}")
        if self.action:
            tests.append(f"{action} IN ({', '.join(quoted(a.upper()) for a in self.action)})")
        for field, names in (("method_name", self.method), ("tx_type", self.tx_type), ("counterparty", self.among)):
            if names:
                tests.append(f"{low(field)} IN ({', '.join(quoted(x.lower()) for x in names)})")
        if self.direction:
            tests.append(f"direction = {quoted(self.direction)}")
        if self.suffix:
            tests.append("(" + " OR ".join(f"endswith({party}, {quoted(x.lower())})" for x in self.suffix) + ")")
        if self.exact is not None:
            tests.append(f"{party} = {quoted(self.exact.lower())}")
        if self.contains:
            tests.append(f"contains({party}, {quoted(self.contains.lower())})")
        if self.amount_above is not None:
            tests.append(f"amount > {self.amount_above}")
        if self.selector == "":
            tests.append(f"{low('selector')} IN ('', '0x')")
        elif self.selector:
            tests.append(f"{low('selector')} = {quoted(self.selector.lower())}")
        if self.own is not None:
            tests.append("is_own" if self.own else "NOT is_own")
        return " AND ".join(tests) or "true"


def quoted(text: str) -> str:
    """A literal of SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ranked(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -r.priority)


REVIEW_BELOW, FALLBACK_BELOW = 0.90, 0.70


def classify(rules: list[Rule]) -> Column:
    """A struct of rule, category and confidence; without a rule: unknown, 0.30."""
    found = lambda name, category, sure: f"named_struct('rule', {name}, 'category', {quoted(category)}, 'confidence', {sure}D)"
    cases = " ".join(f"WHEN {r.condition()} THEN {found(quoted(r.name), r.category, r.confidence)}" for r in ranked(rules))
    none = found("CAST(NULL AS STRING)", "unknown", 0.3)
    return F.expr(f"CASE {cases} ELSE {none} END" if cases else none)


_TEXTS = ("method_name", "tx_type", "counterparty", "selector")


def match(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with rule, category and confidence of the first rule that fits, null where none does.

    Texts are folded once, the rules are one CASE that gives a number, and that is looked up in the table of the rules."""
    order = ranked(rules)
    folded = rows.withColumns({f"__{n}": F.lower(F.coalesce(F.col(n), F.lit(""))) for n in _TEXTS} | {"__action": F.upper(F.coalesce(F.col("action_type"), F.lit("")))})
    cases = " ".join(f"WHEN {r.condition(lambda c: f'__{c}', '__action')} THEN {i}" for i, r in enumerate(order))
    known = rows.sparkSession.createDataFrame([(i, r.name, r.category, r.confidence) for i, r in enumerate(order)], "__i int, rule string, category string, confidence double")
    folded = folded.withColumn("__i", F.expr(f"CASE {cases} END" if cases else "CAST(NULL AS INT)")).drop(*(f"__{n}" for n in _TEXTS), "__action")
    return folded.join(F.broadcast(known), "__i", "left").drop("__i")  # a row a rule
