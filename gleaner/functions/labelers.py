"""Labels of a prediction window, as aggregates that combine on the map side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.sums import exact_mean, exact_sum


@dataclass(frozen=True)
class Labeler:
    """An aggregate over a window's events and what to make of it; the aggregate is null for an empty window."""

    name: str
    aggregate: Column
    finish: Callable[[Column], Column] = lambda x: x


def _counted(name: str, finish: Callable[[Column], Column]) -> Labeler:
    return Labeler(name, F.count(F.lit(1)), lambda n: finish(F.coalesce(n, F.lit(0))))


def event_count(name: str = "event_count") -> Labeler:
    return _counted(name, lambda n: n)


def churn(threshold: int = 0, name: str = "will_churn") -> Labeler:
    """1 when at most threshold events follow."""
    return _counted(name, lambda n: F.when(n <= threshold, 1).otherwise(0))


def will_purchase(name: str = "will_purchase") -> Labeler:
    return _counted(name, lambda n: F.when(n > 0, 1).otherwise(0))


def total_spend(column: str, name: str = "total_spend") -> Labeler:
    return Labeler(name, exact_sum(F.col(column)), lambda x: F.coalesce(x, F.lit(0.0)))


def average_value(column: str, name: str = "average_value") -> Labeler:
    return Labeler(name, exact_mean(F.col(column)), lambda x: F.coalesce(x, F.lit(0.0)))


# Aggregates a threshold label may use.
THRESHOLD_AGGREGATES = {"sum": exact_sum, "mean": exact_mean, "max": F.max, "min": F.min, "count": F.count}


def threshold(column: str, cut: float, how: str = "sum", name: str = "above_threshold") -> Labeler:
    """1 when the aggregate of the column reaches cut."""
    total = THRESHOLD_AGGREGATES[how](F.col(column).cast("double"))
    return Labeler(name, total, lambda x: F.when(F.coalesce(x, F.lit(0.0)) >= cut, 1).otherwise(0))
