"""Sums and means that do not depend on the order of rows, for numbers that are written with few decimal places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 12  # decimal places that add up exactly, with up to 26 digits before them


def exact_sum(x: Column) -> Column:
    """The sum of doubles, exact and then rounded once, if each has a decimal form of at most PLACES places.

    0.1 ten times is 1, not 0.9999999999999999. If any value has no such form, all are added as doubles.
    """
    x = x.cast("double")
    short = x.try_cast(f"decimal(38, {PLACES})")
    longer = F.count_if(x.isNotNull() & ~short.cast("double").eqNullSafe(x))
    return F.when(longer == 0, F.coalesce(F.try_sum(short).cast("double"), F.sum(x))).otherwise(F.sum(x))


def exact_mean(x: Column) -> Column:
    """exact_sum over the number of values; null without any."""
    return exact_sum(x) / F.nullif(F.count(x), F.lit(0))


def grid_units(df: DataFrame, columns: list[Column]) -> list[float]:
    """Per column of doubles the finest power of two whose multiples add up exactly over all rows; found in one scan."""
    sizes = [F.abs(x.cast("double")) for x in columns]
    tops = [F.max(F.when(a < float("inf"), a)).alias(f"t{i}") for i, a in enumerate(sizes)]
    rows, *found = df.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    powers = [math.frexp(top or 0.0)[1] + rows.bit_length() - 52 for top in found]
    return [math.ldexp(1.0, min(max(p, -900), 900)) for p in powers]


def split_on_grid(x: Column, unit: float) -> tuple[Column, Column]:
    """x as a multiple of unit and the rest, at most half of it; totals of both, added, are as good as rounded once."""
    on_grid = F.rint(x / F.lit(unit)) * F.lit(unit)
    return on_grid, F.when(F.abs(x) < float("inf"), x - on_grid).otherwise(0.0)
