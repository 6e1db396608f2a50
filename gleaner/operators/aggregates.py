"""Group aggregates, column summaries and KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import LINEAR, quantiles
from gleaner.plans.tables import with_facts, written

# Aggregate names and the Spark function each one means.
AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev,
    "count": F.count,
}


def group_stats(df: DataFrame, groups: list[str], columns: list[str], funcs=("mean", "sum")) -> DataFrame:
    """One row per group with {column}_{func}_by_{groups}."""
    tag = "_".join(groups)
    return df.groupBy(*groups).agg(*[AGGREGATES[f](c).alias(f"{c}_{f}_by_{tag}") for c in columns for f in funcs])


def group_agg_features(df: DataFrame, groups: list[str], columns: list[str], funcs=("mean", "sum")) -> DataFrame:
    """Every row with the statistics of its group; a null group key gets nulls.

    Statistics are aggregated first (combined on the map side) and looked up, rather than
    computed in a window, so that one large group is not sorted inside one task.
    """
    return lookup(df, group_stats(df, groups, columns, funcs), groups)


def value_counts(df: DataFrame, columns: list[str], keep=()) -> DataFrame:
    """(column, value, n) with values as text, all columns in one job; null is a value."""
    wide = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot(list(keep), columns, "column", "value").groupBy(*keep, "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


KEY_LENGTH = 32  # longer values are counted by their digests, so that no text is shuffled


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count_distinct, count and null_count of a text or boolean column.

    Values beyond KEY_LENGTH characters are known by their MD5 and their length.
    """

    def key(c: str):
        value = F.col(f"`{c}`").cast("string")
        digest = F.concat(F.md5(value), F.lit(":"), F.length(value).cast("string"))
        return F.when(F.length(value) > KEY_LENGTH, digest).otherwise(value).alias(c)

    counts = value_counts(df.select(*[key(c) for c in columns]), columns)
    return counts.groupBy("column").agg(
        F.count("value").alias("count_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )


def category_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and value: count of non-null rows and null_count (the null value has count 0)."""
    n, known = F.col("n"), F.col("value").isNotNull()
    return value_counts(df, columns).select(
        "column",
        "value",
        F.when(known, n).otherwise(0).alias("count"),
        F.when(known, 0).otherwise(n).alias("null_count"),
    )


def numeric_summary(df: DataFrame, columns: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Per column: count_distinct, count, null_count, mean, std, min, exact median, max."""
    medians = quantiles(df, columns, [0.5], LINEAR, limit)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    per = wide.unpivot([], columns, "column", "x").groupBy("column").agg(
        F.count("x").alias("count"),
        F.count(F.when(F.col("x").isNull(), 1)).alias("null_count"),
        F.avg("x").alias("mean"),
        F.stddev("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    distinct = distinct_counts(df, columns).select("column", "count_distinct")
    median = df.sparkSession.createDataFrame([(c, m[0]) for c, m in medians.items()], "column string, median double")
    return per.join(F.broadcast(distinct), "column").join(F.broadcast(median), "column")  # one row per column


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Per column: count_distinct skips nulls, count_values counts null as one more value.

    The exact form first reduces to distinct (column, value) pairs, spread over all tasks;
    approx keeps one small sketch per column instead.
    """
    parts = []
    for carrier, group in by_carrier(df, columns).items():
        wide = df.select(*[F.col(c).cast(carrier).alias(c) for c in group])
        long = wide.unpivot([], group, "column", "value")
        if approx:
            distinct = F.approx_count_distinct("value")
            nulls = F.max(F.col("value").isNull().cast("int"))
            parts.append(
                long.groupBy("column").agg(distinct.alias("count_distinct"), (distinct + nulls).alias("count_values"))
            )
        else:
            pairs = long.distinct()
            parts.append(
                pairs.groupBy("column").agg(
                    F.count("value").alias("count_distinct"), F.count(F.lit(1)).alias("count_values")
                )
            )
    return reduce(DataFrame.unionByName, parts)


def by_carrier(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Group columns by a type that holds their values exactly, so they can share one long column."""
    out: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        carrier = "string"
        if isinstance(kind, T.IntegralType):
            carrier = "bigint"
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            carrier = "double"
        out.setdefault(carrier, []).append(c)
    return out


def kpi(df: DataFrame, target: str, dimensions=(), metric: Column | tuple[Column, ...] | None = None) -> DataFrame:
    """Mean of the target as {target}_pct (or the given metrics), overall or per dimension values."""
    metrics = (F.avg(F.col(target).cast("double")).alias(f"{target}_pct"),) if metric is None else metric
    metrics = metrics if isinstance(metrics, tuple) else (metrics,)
    return df.groupBy(*dimensions).agg(*metrics)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return with_facts(counts, total).select("class", "n", (F.col("n") / F.col("__total")).alias("share"))


def baseline_rate(df: DataFrame, positive: Column) -> DataFrame:
    """total, positives and baseline_rate in one pass."""
    per = df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(positive), F.lit(0)).alias("positives"))
    return per.withColumn("baseline_rate", F.when(F.col("total") > 0, F.col("positives") / F.col("total")).otherwise(0.0))


def batch_quantiles(df: DataFrame, columns: list[str], probs: list[float], limit: int = GROUP_ROWS) -> DataFrame:
    """(feature, prob, value) for all columns; values are exact and taken from the data."""
    found = quantiles(df, columns, probs, limit=limit)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, value double")


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """rows, distinct_rows and duplicates (rows minus distinct rows).

    Rows are first counted by a hash; only those whose hash repeats are sent whole and compared.
    """
    columns = [F.col(f"`{c}`") for c in (subset or df.columns)]
    marked = df.select(*columns, F.xxhash64(*columns).alias("__h"))
    repeated = written(marked.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h"))
    equal = marked.join(repeated, "__h", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    again = equal.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    both = with_facts(df.agg(F.count(F.lit(1)).alias("n_rows")), again)
    return both.select("n_rows", (F.col("n_rows") - F.col("duplicates")).alias("distinct_rows"), "duplicates")


def select_by_cardinality(df: DataFrame, columns: list[str], max_values: int = 20, approx: bool = False) -> list[str]:
    """Columns with fewer than max_values distinct values; one job, one result row per column."""
    few = distinct_counts(df, columns, approx).filter(F.col("count_distinct") < max_values)
    keep = {r["column"] for r in few.collect()}
    return [c for c in columns if c in keep]


