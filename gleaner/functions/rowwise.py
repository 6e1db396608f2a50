"""Features computed from one row: numeric transforms, pairs, dates, text, row statistics.

Numbers are cast to double first, so integer overflow cannot fail a job. Where a value
or divisor is null or out of range the result is 0 for log, sqrt, quotients and ratios.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, islice
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.types import Feature, feature

TRANSFORM = "transformation"
INTERACTION = "interaction"
RATIO = "ratio"
POLYNOMIAL = "polynomial"
CYCLICAL = "cyclical"
DATETIME_PART = "datetime"
TEXT = "text"
ROW = "row"


def number(name: str) -> Column:
    return F.col(name).cast("double")


def quotient(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def transforms(columns: list[str], kinds=("log", "sqrt", "square", "cube")) -> list[Feature]:
    forms = {
        "log": lambda x: F.log1p(F.when(x > 0, x).otherwise(0.0)),
        "sqrt": lambda x: F.sqrt(F.when(x >= 0, x).otherwise(0.0)),
        "square": lambda x: F.pow(x, F.lit(2.0)),
        "cube": lambda x: F.pow(x, F.lit(3.0)),
    }
    return [feature(f"{c}_{k}", TRANSFORM, [c], forms[k](number(c))) for c in columns for k in kinds]


def interactions(columns: list[str], kinds=("mult", "div", "add", "sub"), cap: int | None = None) -> list[Feature]:
    """Every pair in every kind; the first cap of them if the caller wants no more."""
    forms = {
        "mult": lambda a, b: a * b,
        "div": quotient,
        "add": lambda a, b: a + b,
        "sub": lambda a, b: a - b,
    }
    every = (
        feature(f"{a}_{k}_{b}", INTERACTION, [a, b], forms[k](number(a), number(b)))
        for a, b in combinations(columns, 2)
        for k in kinds
    )
    return list(islice(every, cap))


def powers(columns: list[str], degree: int = 3, bias: bool = False) -> list[Feature]:
    out = [feature("poly_bias", POLYNOMIAL, [], F.lit(1.0))] if bias else []
    return out + [
        feature(f"{c}_pow{d}", POLYNOMIAL, [c], F.pow(number(c), F.lit(float(d))))
        for c in columns
        for d in range(2, degree + 1)
    ]


def power_interactions(columns: list[str], degree: int = 2, interaction_only: bool = False) -> list[Feature]:
    products = [feature(f"{a}_x_{b}", POLYNOMIAL, [a, b], number(a) * number(b)) for a, b in combinations(columns, 2)]
    return ([] if interaction_only else powers(columns, degree)) + products


def ratios(pairs: list[tuple[str, str]], inverse: bool = True) -> list[Feature]:
    directed = [p for a, b in pairs for p in ([(a, b), (b, a)] if inverse else [(a, b)])]
    return [feature(f"{a}_ratio_{b}", RATIO, [a, b], quotient(number(a), number(b))) for a, b in directed]


def cyclical(column: str, period: float) -> list[Feature]:
    angle = number(column) * F.lit(2 * math.pi / period)
    return [
        feature(f"{column}_sin", CYCLICAL, [column], F.sin(angle)),
        feature(f"{column}_cos", CYCLICAL, [column], F.cos(angle)),
    ]


def datetime_parts(columns: list[str]) -> list[Feature]:
    """Calendar parts; a week starts on Sunday = 1 and weekends are days 1 and 7."""
    parts = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "dayofweek": F.dayofweek,
        "dayofyear": F.dayofyear,
        "weekofyear": F.weekofyear,
        "quarter": F.quarter,
        "is_weekend": lambda c: F.when(F.dayofweek(c).isin(1, 7), 1).otherwise(0),
    }
    return [feature(f"{c}_{n}", DATETIME_PART, [c], f(F.col(c))) for c in columns for n, f in parts.items()]


def string_stats(columns: list[str]) -> list[Feature]:
    stats = {
        "length": F.length,
        "word_count": lambda c: F.size(F.split(c, " ")),
        "unique_chars": lambda c: F.size(F.array_distinct(F.split(c, ""))),
    }
    return [feature(f"{c}_{n}", TEXT, [c], f(F.col(c))) for c in columns for n, f in stats.items()]


def row_stats(columns: list[str]) -> list[Feature]:
    """Across columns of one row; the mean is null if any value is, max and min skip nulls."""
    xs = [number(c) for c in columns]
    high, low = (F.greatest(*xs), F.least(*xs)) if len(xs) > 1 else (xs[0], xs[0])
    flags = lambda test: reduce(add, [F.when(test(x), 1).otherwise(0) for x in xs])
    return [
        feature("row_mean", ROW, columns, reduce(add, xs) / len(xs)),
        feature("row_max", ROW, columns, high),
        feature("row_min", ROW, columns, low),
        feature("row_range", ROW, columns, high - low),
        feature("row_zero_count", ROW, columns, flags(lambda x: x == 0)),
        feature("row_null_count", ROW, columns, flags(lambda x: x.isNull())),
    ]
