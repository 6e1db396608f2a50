"""Results handed over bit by bit: microsegments of one depth at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from gleaner.operators.insights import Goal, conditions_of
from gleaner.operators.microsegments import counted_levels, microsegments_of


def microsegments_by_depth(
    df: DataFrame,
    insights: DataFrame,
    goal: Goal,
    max_depth: int = 3,
    top_n: int | None = None,
    min_support: float = 0.01,
) -> Iterator[tuple[int, DataFrame]]:
    """Yield (depth, microsegments); a depth is counted when it is asked for, so a caller can show or stop early."""
    conditions = conditions_of(insights, top_n)
    for depth, counted in counted_levels(df, conditions, goal, max_depth, min_support):
        yield depth, microsegments_of(counted, conditions, goal)
