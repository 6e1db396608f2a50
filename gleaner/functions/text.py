"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x, digits: int) -> Column:
    """x with a fixed number of decimals, rounded by its exact binary value and without thousands separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def percent(x, digits: int = 1) -> Column:
    return F.concat(fixed(x, digits), F.lit("%"))
