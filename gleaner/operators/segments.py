"""Segment analysis: which segments explain the change of a metric between two sets of rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.tables import with_facts

Metric = Callable[[Column], Column]  # given which rows count, an aggregate over them

BASELINE, COMPARISON = "baseline", "comparison"


def mean_metric(column: str) -> Metric:
    return lambda keep: F.avg(F.when(keep, F.col(column).cast("double")))


def sum_metric(column: str) -> Metric:
    return lambda keep: F.sum(F.when(keep, F.col(column).cast("double")))


def _sides(metric: Metric, name: str, sides: dict[str, Column]) -> list[Column]:
    out = []
    for side, keep in sides.items():
        out += [metric(keep).alias(f"{name}_{side}"), F.count(F.when(keep, 1)).alias(f"size_{side}")]
    return out


def overall_metrics(df: DataFrame, metric: Metric, name: str, baseline: Column, comparison: Column | None = None) -> DataFrame:
    """One row: metric and number of rows on each side, in one scan."""
    sides = {BASELINE: baseline} | ({COMPARISON: comparison} if comparison is not None else {})
    return df.agg(*_sides(metric, name, sides))


def dimension_sets(dimensions: list[str], depth: int = 1) -> list[tuple[str, ...]]:
    return [c for r in range(1, depth + 1) for c in combinations(dimensions, r)]


def segment_label(dimensions: list[str]) -> Column:
    """'dim:value' of the dimensions in use, joined by '<seg>'; needs a __set id from segment_metrics."""
    parts = [
        F.when(F.col(f"__in_{d}") == 0, F.concat(F.lit(f"{d}:"), F.coalesce(F.col(d).cast("string"), F.lit("None"))))
        for d in dimensions
    ]
    return F.concat_ws("<seg>", *parts)


def segment_metrics(
    df: DataFrame,
    metric: Metric,
    name: str,
    dimensions: list[str],
    baseline: Column,
    comparison: Column | None = None,
    depth: int = 1,
) -> DataFrame:
    """segment, and per side metric and size, for every set of up to depth dimensions; one scan with grouping sets.

    Both sides come from the same scan, so no join is needed to bring them together. A side
    without rows in a segment has null there.
    """
    sides = {BASELINE: baseline} | ({COMPARISON: comparison} if comparison is not None else {})
    sets = [[F.col(d) for d in s] for s in dimension_sets(dimensions, depth)]
    rows = df.filter(baseline if comparison is None else baseline | comparison)
    grouped = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"__in_{d}") for d in dimensions], *_sides(metric, name, sides)
    )
    out = grouped.select(segment_label(dimensions).alias("segment"), *[c for s in sides for c in (f"{name}_{s}", f"size_{s}")])
    for s in sides:
        out = out.withColumn(f"size_{s}", F.nullif(F.col(f"size_{s}"), F.lit(0)))
    return out


def merge_segments(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """Full outer join of two segment tables that were computed apart; a segment may miss on either side."""
    return baseline.join(comparison, "segment", "full_outer")


def segment_shares(merged: DataFrame, overall: DataFrame, name: str) -> DataFrame:
    """Shares of the overall metric and size on each side, and relative changes between the sides."""
    facts = overall.select([F.col(c).alias(c.replace(f"{name}_", f"{name}_overall_").replace("size_", "size_overall_")) for c in overall.columns])
    out = with_facts(merged, facts)
    sides = [s for s in (BASELINE, COMPARISON) if f"{name}_{s}" in merged.columns]
    made = {}
    for s in sides:
        made[f"value_pct_{s}"] = F.try_divide(F.col(f"{name}_{s}"), F.col(f"{name}_overall_{s}"))
        made[f"size_pct_{s}"] = F.try_divide(F.col(f"size_{s}"), F.col(f"size_overall_{s}"))
    if COMPARISON in sides:
        made[f"{name}_change"] = F.try_divide(F.col(f"{name}_comparison"), F.col(f"{name}_baseline")) - 1
        made["size_change"] = F.try_divide(F.col("size_comparison"), F.col("size_baseline")) - 1
    return out.withColumns(made)


def segment_impact(shares: DataFrame, name: str) -> DataFrame:
    """impact: the segment's metric change over the overall change, times its share of baseline rows; and abs_impact."""
    change = F.col(f"{name}_comparison") - F.col(f"{name}_baseline")
    overall = F.col(f"{name}_overall_comparison") - F.col(f"{name}_overall_baseline")
    impact = F.try_divide(change, overall) * F.col("size_pct_baseline")
    return shares.withColumns({"impact": impact, "abs_impact": F.abs(impact)})


def analyze_segments(
    df: DataFrame,
    metric: Metric,
    name: str,
    dimensions: list[str],
    baseline: Column,
    comparison: Column | None = None,
    depth: int = 1,
) -> DataFrame:
    """Segments with metrics, shares, changes and, with a comparison, impact."""
    overall = overall_metrics(df, metric, name, baseline, comparison)
    merged = segment_metrics(df, metric, name, dimensions, baseline, comparison, depth)
    shares = segment_shares(merged, overall, name)
    return shares if comparison is None else segment_impact(shares, name)
