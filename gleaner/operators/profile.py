"""Profile of a whole table: summary, variables, correlations, alerts, advice, histograms, target checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.rowwise import number
from gleaner.functions.text import fixed, percent
from gleaner.operators.aggregates import by_carrier, distinct_counts, duplicate_count
from gleaner.operators.quality import rows_of, missing_report, per_column
from gleaner.operators.windows import percentile_features
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import LINEAR, quantiles
from gleaner.plans.tables import with_facts, written
from gleaner.plans.sums import tree_sum
from gleaner.sources.tables import exact_sample
from gleaner.types import (
    BOOLEAN,
    CATEGORICAL,
    CLASSIFICATION,
    DATETIME,
    NUMERICAL,
    Problem,
    columns_of,
    role_of,
)

# Names of variable types in a profile.
TYPE_NAMES = {CATEGORICAL: "Categorical", NUMERICAL: "Numeric", BOOLEAN: "Boolean", DATETIME: "DateTime"}


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: n, n_var, missing cells and duplicate rows with percentages, and columns per type."""
    cells = F.array(*[F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns])
    missing = F.aggregate(cells, F.lit(0), lambda a, x: a + x)
    per = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_cells_missing"))
    dup = duplicate_count(df).select(F.col("duplicates").alias("n_duplicates"))
    width = len(df.columns)
    share = lambda part, whole: F.when(whole > 0, part / whole * 100).otherwise(0.0)
    n, kinds = F.col("n"), [role_of(f.dataType) for f in df.schema.fields]
    return with_facts(per, dup).select(
        "n",
        F.lit(width).alias("n_var"),
        "n_cells_missing",
        share(F.col("n_cells_missing"), n * width).alias("p_cells_missing"),
        "n_duplicates",
        share(F.col("n_duplicates"), n).alias("p_duplicates"),
        *[F.lit(kinds.count(r)).alias(f"n_{r}") for r in TYPE_NAMES],
    )


def _seen_once(df: DataFrame) -> DataFrame:
    """column, n_distinct and n_unique (values that occur once), nulls left out."""
    parts = []
    for carrier, group in by_carrier(df, df.columns).items():
        wide = df.select(*[F.col(c).cast(carrier).alias(c) for c in group]).unpivot([], group, "column", "value")
        counts = wide.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        known = F.col("value").isNotNull()
        parts.append(
            counts.groupBy("column").agg(
                F.count("value").alias("n_distinct"),
                F.count(F.when(known & (F.col("n") == 1), 1)).alias("n_unique"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def profile_variables(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """One row per column: type, missing, distinct, unique, and for numbers mean, std, min, max, median, zeros, skewness."""
    numbers = columns_of(df, NUMERICAL)
    medians = quantiles(df, numbers, [0.5], LINEAR, limit)

    def measures(c: str) -> list[Column]:
        numeric = c in numbers
        x = number(c)
        only = lambda agg: agg if numeric else F.lit(None).cast("double")
        return [
            F.lit(TYPE_NAMES.get(role_of(df.schema[c].dataType), "Unsupported")).alias("type"),
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
            only(F.avg(x) if numeric else None).alias("mean"),
            only(F.stddev(x) if numeric else None).alias("std"),
            only(F.min(x) if numeric else None).alias("min"),
            only(F.max(x) if numeric else None).alias("max"),
            F.lit(medians[c][0] if numeric else None).cast("double").alias("median"),
            only(F.skewness(x) if numeric else None).alias("skewness"),
            (F.count(F.when(x == 0, 1)) if numeric else F.lit(0).cast("bigint")).alias("n_zeros"),
        ]

    per = per_column(df, {c: measures(c) for c in df.columns})
    joined = per.join(F.broadcast(_seen_once(df)), "column")  # one row per column
    return joined.select(
        "column",
        "type",
        "n_missing",
        (F.col("n_missing") / F.greatest(F.col("n"), F.lit(1)) * 100).alias("p_missing"),
        "n_distinct",
        "n_unique",
        ((F.col("n_unique") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"),
        "mean",
        "std",
        "min",
        "max",
        "median",
        "skewness",
        "n_zeros",
        "n",
    )


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of each column pair, over rows where both are known; null where one of them does not vary.

    A task multiplies its rows as matrices, batch by batch, into sums of all pairs; the matrices of the tasks are added
    up by a tree. So the plan and the jobs do not grow with the pairs. Values are taken from the columns' means, which
    keeps the sums accurate.
    """
    n = len(columns)
    shape = "a string, b string, correlation double"
    if n < 2:
        return df.sparkSession.createDataFrame([], shape)
    wide = df.select(F.array(*[number(f"`{c}`") for c in columns]).alias("x"))
    means = df.agg(*[F.avg(number(f"`{c}`")) for c in columns]).first()
    centre = np.array([m or 0.0 for m in means])

    def run(batches):
        total = np.zeros((4, n, n))  # rows, sums of a, of squares of a, of products, over rows that know a and b
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) - centre
            lost = batch.column("x").flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
            known = (~lost).astype(float)
            x = np.where(lost, 0.0, x)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    count, one, two, both = tree_sum(wide.mapInArrow(run, "sums binary"), (4, n, n))
    with np.errstate(all="ignore"):
        spread = two - one * one / count
        found = (both - one * one.T / count) / np.sqrt(spread * spread.T)
        varies = (spread > 1e-12 * two) & (spread.T > 1e-12 * two.T) & (count > 1)
    rows = [
        (a, b, float(np.clip(found[i, j], -1, 1)) if varies[i, j] or np.isnan(found[i, j]) and np.isnan(two[i, j]) else None)
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    ]
    return df.sparkSession.createDataFrame(rows, shape)


def spearman(df: DataFrame, columns: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Pearson correlation of average ranks; ranks are joined by value, so no column is sorted in one task."""
    ranked = percentile_features(df.select(*columns), columns, limit)
    plain = ranked.select(*[F.col(f"{c}_percentile").alias(c) for c in columns])
    return pearson(plain, columns)


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(method, a, b, correlation) for Pearson and Spearman."""
    columns = columns_of(df, NUMERICAL) if columns is None else columns
    return pearson(df, columns).withColumn("method", F.lit("pearson")).unionByName(
        spearman(df, columns).withColumn("method", F.lit("spearman"))
    )


# Limits at which a profile raises an alert.
ALERT_CORRELATION = 0.9
ALERT_SKEWNESS = 20.0
ALERT_ZEROS = 0.1
ALERT_CARDINALITY = 50
ALERT_MISSING = 0.05


def profile_alerts(df: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(column, alert): constant, unique, missing, skewed, zeros, high cardinality, high correlation, duplicates."""
    variables = written(profile_variables(df)) if variables is None else variables
    n = F.col("n")
    rules = {
        "CONSTANT": F.col("n_distinct") == 1,
        "UNIQUE": F.col("is_unique"),
        "MISSING": F.col("n_missing") / n > ALERT_MISSING,
        "SKEWED": F.abs(F.col("skewness")) > ALERT_SKEWNESS,
        "ZEROS": F.col("n_zeros") / n > ALERT_ZEROS,
        "HIGH_CARDINALITY": (F.col("type") == "Categorical") & (F.col("n_distinct") > ALERT_CARDINALITY),
    }
    out = rows_of(variables, [(cond, [F.lit(name).alias("alert")]) for name, cond in rules.items()])
    numbers = columns_of(df, NUMERICAL)
    if len(numbers) > 1:
        strong = pearson(df, numbers).filter(F.abs("correlation") > ALERT_CORRELATION)
        named = strong.select(F.explode(F.array("a", "b")).alias("column"), F.lit("HIGH_CORRELATION").alias("alert"))
        out = out.unionByName(named.distinct())
    dup = duplicate_count(df).filter(F.col("duplicates") > 0)
    return out.unionByName(dup.select(F.lit("Dataset").alias("column"), F.lit("DUPLICATES").alias("alert")))


# Rank of each priority when sorting advice.
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2}


def profile_recommendations(df: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(column, issue, action, priority, rank), high priority first."""
    variables = profile_variables(df) if variables is None else variables
    pct, distinct, skew = F.col("p_missing"), F.col("n_distinct"), F.col("skewness")

    def advice(issue, action, priority):
        priority = priority if isinstance(priority, Column) else F.lit(priority)
        return [issue.alias("issue"), F.lit(action).alias("action"), priority.alias("priority")]

    rows = rows_of(
        variables,
        [
            (
                pct > 30,
                advice(
                    F.concat(F.lit("often_null: "), percent(pct)),
                    "leave_out or fit_impute",
                    F.when(pct > 50, "high").otherwise("medium"),
                ),
            ),
            (
                (pct > 5) & (pct <= 30),
                advice(
                    F.concat(F.lit("some_null: "), percent(pct)),
                    "fit_impute",
                    "low",
                ),
            ),
            (
                (F.col("type") == "Categorical") & (distinct > 50),
                advice(
                    F.format_string("many_values: %d", distinct),
                    "group_rare or target_encode",
                    "medium",
                ),
            ),
            (
                ~F.col("is_unique") & (distinct == 1),
                advice(F.lit("single_value"), "leave_out", "high"),
            ),
            (
                F.abs(skew) > 2,
                advice(
                    F.concat(F.lit("long_tail: skewness "), fixed(skew, 2)),
                    "transforms log",
                    "medium",
                ),
            ),
        ],
    )
    rank = reduce(lambda e, kv: e.when(F.col("priority") == kv[0], kv[1]), PRIORITY_RANK.items(), F.when(F.lit(False), 3))
    return rows.withColumn("rank", rank).orderBy("rank", "column", "issue")


def profile_sample(df: DataFrame, max_rows: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The rows to profile (all of them, or exactly max_rows random ones if that is smaller) and how they were taken."""
    original = df.count()
    taken = df if max_rows is None or original <= max(1, max_rows) else exact_sample(df, max(1, max_rows), seed)
    # written only when sampled, so that every later job sees the same rows
    taken = taken if taken is df else written(taken)
    rows = original if taken is df else taken.count()
    info = [(taken is not df, original, rows, rows / original if original else 1.0)]
    schema = "sampled boolean, original_rows bigint, profiled_rows bigint, sample_ratio double"
    return taken, df.sparkSession.createDataFrame(info, schema)


def numeric_histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins between the extremes, the last one closed."""
    row = df.agg(*[a for c in columns for a in (F.min(number(c)), F.max(number(c)))]).first()
    spans = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns) if row[2 * i] is not None}

    def slot(c):
        low, high = spans[c]
        width = (high - low) / bins
        place = F.least(F.floor((number(c) - low) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        return F.when(F.col(c).isNotNull(), place.cast("int")).alias(c)

    long = df.select(*[slot(c) for c in spans]).unpivot([], list(spans), "column", "bin").filter("bin is not null")
    counts = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = [(c, b, lo + b * (hi - lo) / bins, lo + (b + 1) * (hi - lo) / bins) for c, (lo, hi) in spans.items() for b in range(bins)]
    table = df.sparkSession.createDataFrame(edges, "column string, bin int, low double, high double")
    return table.join(counts, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of every value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def validate_target(df: DataFrame, problem: Problem, max_classes: int = 10) -> list[str]:
    """Reasons why the problem does not fit the table; empty when it does. At most one job."""
    found = []
    if problem.target not in df.columns:
        return [f"target column {problem.target!r} not found"]
    kind = df.schema[problem.target].dataType
    role = role_of(kind)
    if problem.kind == CLASSIFICATION:
        if role not in (CATEGORICAL, BOOLEAN) and not isinstance(kind, T.IntegralType):
            found.append(f"{kind.simpleString()} is no class type; use text, boolean or integer")
        else:
            classes = distinct_counts(df, [problem.target]).first()["count_distinct"]
            if classes < 2:
                found.append(f"needs at least 2 classes, found {classes}")
            elif classes > max_classes:
                found.append(f"has {classes} classes, at most {max_classes} allowed")
    elif role != NUMERICAL or isinstance(kind, T.IntegerType):
        found.append(f"{kind.simpleString()} is no regression target; use a non-int number")
    if problem.date_column is not None:
        if problem.date_column not in df.columns:
            found.append(f"date column {problem.date_column!r} not found")
        elif role_of(df.schema[problem.date_column].dataType) != DATETIME:
            found.append(f"date column {problem.date_column!r} is not temporal")
    return found


def full_profile(df: DataFrame, max_rows: int | None = None) -> dict[str, DataFrame]:
    """All profile tables by name."""
    rows, info = profile_sample(df, max_rows)
    variables = written(profile_variables(rows))
    return {
        "sample": info,
        "summary": profile_summary(rows),
        "variables": variables,
        "missing": missing_report(rows),
        "alerts": profile_alerts(rows, variables),
        "recommendations": profile_recommendations(rows, variables),
    }
