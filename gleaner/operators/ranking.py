"""Top-k, mode, pages and importance selection, all with fixed tie-breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.aggregates import value_counts
from gleaner.plans.ordered import order_tie, running_totals


def top_categories(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values (null is one); equal counts go by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(k)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode): most frequent non-null value as text, the smallest of equals."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    top = counts.groupBy("column", "n").agg(F.min("value").alias("value"))
    return top.groupBy("column").agg(F.max_by("value", "n").alias("mode"))


def top_insights(insights: DataFrame, metric: str = "lift", n: int = 20, min_support=0.0, min_lift=0.0) -> DataFrame:
    """The n strongest insights by lift, rig or support."""
    kept = insights.filter((F.col("support") >= min_support) & (F.col("lift") >= min_lift))
    return kept.orderBy(F.desc(metric), "feature", "op", F.col("number"), F.col("text")).limit(n)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    pages: int
    has_next: bool
    has_previous: bool


SORTABLE = ("lift", "support", "rig", "support_count")
TOP_ROWS = 100_000


def paginate(df: DataFrame, page: int, size: int, sort_by: str = "lift", order: str = "desc", ties=()) -> Page:
    """One page of a sorted table.

    Pages that end within the first TOP_ROWS rows are cut from the table's top; for later ones, row numbers come
    from running totals, so a large table is not sorted in one task. Both ways give the same rows.
    """
    if sort_by not in SORTABLE:
        raise ValueError(f"sort_by must be one of {SORTABLE}")
    total = df.count()
    pages = max(1, -(-total // size))
    by = [F.desc(sort_by) if order == "desc" else F.asc(sort_by), *ties]
    first = (page - 1) * size
    if first + size <= TOP_ROWS:
        order = [*by, order_tie(df)]
        top = df.orderBy(*order).limit(first + size)
        numbered = top.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        numbered = running_totals(df, [], by, {"row_number": F.lit(1).cast("bigint")})
    rows = numbered.filter((F.col("row_number") > first) & (F.col("row_number") <= first + size))
    return Page(rows, total, pages, page < pages, page > 1)


def select_by_importance(importances: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Rows of (feature, importance) by rank or by value; asking for both is an error."""
    if top_k is not None and threshold is not None:
        raise ValueError("give either top_k or threshold, not both")
    if threshold is not None:
        importances = importances.filter(F.col("importance") >= threshold)
    ordered = importances.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top_k) if top_k is not None else ordered
