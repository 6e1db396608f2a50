"""Row predicates: column filters, date ranges, targets and insight conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operator names a filter may carry.
EQ = "equal_to"
NEQ = "not_equal_to"
EMPTY = "empty"
NON_EMPTY = "non_empty"
GRT = "greater_than"
LWT = "lower_than"
GEQ = "greater_than_equal_to"
LEQ = "lower_than_equal_to"
LIKE = "like"


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    values: tuple = ()


def filter_condition(f: Filter) -> Column:
    c, first = F.col(f.column), (f.values[0] if f.values else None)
    match f.operator:
        case "equal_to":
            return c.isin(list(f.values))
        case "not_equal_to":
            return ~c.isin(list(f.values))
        case "empty":
            return c.isNull() | (c.cast("string") == "")
        case "non_empty":
            return c.isNotNull() & (c.cast("string") != "")
        case "greater_than":
            return c > first
        case "greater_than_equal_to":
            return c >= first
        case "lower_than":
            return c < first
        case "lower_than_equal_to":
            return c <= first
        case "like":
            return c.like(first)
    raise ValueError(f"unknown filter operator {f.operator!r}")


def all_of(filters: list[Filter]) -> Column:
    """AND of all filters; no filters keep every row."""
    return reduce(and_, [filter_condition(f) for f in filters], F.lit(True))


def date_between(column: str, first, last) -> Column:
    return F.col(column).between(F.lit(first), F.lit(last))


def is_class(target: str, desired) -> Column:
    """1 where the target equals the desired class, else 0; a null target counts as 0."""
    return F.when(F.col(target) == F.lit(desired), 1).otherwise(0)


def is_above(target: str, cut: float) -> Column:
    return F.when(F.col(target) > F.lit(cut), 1).otherwise(0)


@dataclass(frozen=True)
class Condition:
    """One side of an insight: a number compared with a threshold, or a category value."""

    feature: str
    op: str  # '>=', '<', '=' or 'null'
    number: float | None = None
    text: str | None = None

    def predicate(self) -> Column:
        c = F.col(self.feature)
        if self.op == ">=":
            return c.cast("double") >= F.lit(self.number)
        if self.op == "<":
            return c.cast("double") < F.lit(self.number)
        if self.op == "null":
            return c.isNull()
        if self.op == "=":
            return c.cast("string") == F.lit(self.text)
        raise ValueError(f"unknown condition operator {self.op!r}")
