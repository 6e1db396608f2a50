"""Lift, support and relative information gain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """Binary entropy in bits; 0 at both ends."""
    inner = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(inner)


def relative_information_gain(rate: Column, support: Column, baseline: Column) -> Column:
    """Share of the target's entropy that knowing 'in the segment or not' removes."""
    rest = F.when(support >= 1, baseline).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (baseline - rate * support) / (1 - support)))
    )
    base = entropy(baseline)
    left = support * entropy(rate) + (1 - support) * entropy(rest)
    return F.when(base <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (base - left) / base))


def segment_metrics(n: Column, pos: Column, total: int, positives: int) -> list[Column]:
    """support_count, support, class_rate, baseline_rate, lift and rig of segments with n rows, pos of them positive."""
    base = positives / total if total else 0.0
    rate = F.when(n > 0, pos / n).otherwise(0.0)
    support = n / F.lit(float(max(total, 1)))
    baseline = F.lit(float(base))
    lift = F.when(baseline > 0, rate / baseline).otherwise(0.0)
    return [
        n.cast("bigint").alias("support_count"),
        support.alias("support"),
        rate.alias("class_rate"),
        baseline.alias("baseline_rate"),
        lift.alias("lift"),
        relative_information_gain(rate, support, baseline).alias("rig"),
    ]
