"""Data quality: missing values, statistics, outliers, cardinality, score, issues, advice.

Every report is a table with one row per column. Statistics of all columns come from one
aggregate; distinct counts and quantiles have their own jobs because they must not gather
a column in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rowwise import number
from gleaner.functions.text import fixed, percent
from gleaner.operators.aggregates import distinct_counts, duplicate_count, value_counts
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import quantiles
from gleaner.plans.tables import with_facts, written
from gleaner.types import CATEGORICAL, DATETIME, NUMERICAL, columns_of


def per_column(df: DataFrame, aggregates: dict[str, list[Column]]) -> DataFrame:
    """One aggregate over df, laid out as one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *aggs) for c, aggs in aggregates.items()])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def missing_report(df: DataFrame) -> DataFrame:
    """column, null_count, empty_count (text only), total_missing, missing_pct."""
    texts = columns_of(df, CATEGORICAL)

    def counts(c: str) -> list[Column]:
        empty = F.count(F.when(F.col(c) == "", 1)) if c in texts else F.lit(0).cast("bigint")
        return [
            F.count(F.when(F.col(c).isNull(), 1)).alias("null_count"),
            empty.alias("empty_count"),
            F.count(F.lit(1)).alias("n_rows"),
        ]

    per = per_column(df, {c: counts(c) for c in df.columns})
    missing = F.col("null_count") + F.col("empty_count")
    pct = F.when(F.col("n_rows") > 0, missing / F.col("n_rows") * 100).otherwise(0.0)
    return per.select("column", "null_count", "empty_count", missing.alias("total_missing"), pct.alias("missing_pct"))


def numeric_stats(df: DataFrame, columns: list[str] | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """column, distinct_count (null counts as a value), mean, std, min, max, q1, median, q3, iqr, skewness, kurtosis."""
    columns = columns_of(df, NUMERICAL) if columns is None else columns
    found = quantiles(df, columns, [0.25, 0.5, 0.75], limit=limit)
    rows = [(c, *q, q[2] - q[0] if q[0] is not None else None) for c, q in found.items()]
    cuts = df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double"
    )

    def moments(c: str) -> list[Column]:
        x = number(c)
        return [
            F.avg(x).alias("mean"),
            F.stddev(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.skewness(x).alias("skewness"),
            F.kurtosis(x).alias("kurtosis"),
        ]

    per = per_column(df, {c: moments(c) for c in columns})
    distinct = distinct_counts(df, columns).select("column", F.col("count_values").alias("distinct_count"))
    return per.join(F.broadcast(cuts), "column").join(F.broadcast(distinct), "column")  # one row per column


def text_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, distinct_count, min/max/avg length and cardinality_ratio."""
    columns = columns_of(df, CATEGORICAL) if columns is None else columns

    def lengths(c: str) -> list[Column]:
        size = F.length(c)
        return [
            F.min(size).alias("min_length"),
            F.max(size).alias("max_length"),
            F.avg(size).alias("avg_length"),
            F.count(F.lit(1)).alias("n_rows"),
        ]

    per = per_column(df, {c: lengths(c) for c in columns})
    distinct = distinct_counts(df, columns).select("column", F.col("count_values").alias("distinct_count"))
    joined = per.join(F.broadcast(distinct), "column")  # one row per column
    ratio = F.when(F.col("n_rows") > 0, F.col("distinct_count") / F.col("n_rows")).otherwise(0.0)
    return joined.select("column", "distinct_count", "min_length", "max_length", "avg_length", ratio.alias("cardinality_ratio"))


def date_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min_date, max_date as zone-free timestamps."""
    columns = columns_of(df, DATETIME) if columns is None else columns
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return per_column(df, {c: [F.min(plain(c)).alias("min_date"), F.max(plain(c)).alias("max_date")] for c in columns})


def outlier_bounds(df: DataFrame, columns: list[str], method: str, t: float, limit: int = GROUP_ROWS):
    """{column: (low, high)}; columns without values or spread are left out."""
    if method == "iqr":
        found = quantiles(df, columns, [0.25, 0.75], limit=limit)
        return {c: (a - t * (b - a), b + t * (b - a)) for c, (a, b) in found.items() if a is not None}
    if method == "zscore":
        row = df.agg(*[a for c in columns for a in (F.avg(number(c)), F.stddev(number(c)))]).first()
        pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
        return {c: (m - t * s, m + t * s) for c, (m, s) in pairs.items() if s}
    raise ValueError(f"unknown outlier method {method!r}")


def outlier_report(df: DataFrame, method: str = "iqr", t: float = 1.5, limit: int = GROUP_ROWS) -> DataFrame:
    """column, method, lower_bound, upper_bound, outlier_count, outlier_pct; one job to fit, one to count."""
    bounds = outlier_bounds(df, columns_of(df, NUMERICAL), method, t, limit)

    def counts(c: str) -> list[Column]:
        low, high = bounds[c]
        out = F.count(F.when((number(c) < F.lit(low)) | (number(c) > F.lit(high)), 1))
        return [
            F.lit(method).alias("method"),
            F.lit(low).alias("lower_bound"),
            F.lit(high).alias("upper_bound"),
            out.alias("outlier_count"),
            (out / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100).alias("outlier_pct"),
        ]

    return per_column(df, {c: counts(c) for c in bounds})


def cardinality_report(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """column, distinct_count, cardinality_ratio, two flags, and the k most frequent values as an array."""
    columns = columns_of(df, CATEGORICAL) if columns is None else columns
    counts = written(value_counts(df, columns))
    per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("n_rows"))
    ratio = F.col("distinct_count") / F.col("n_rows")
    tops = [
        counts.filter(F.col("column") == c).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k) for c in columns
    ]
    top = reduce(DataFrame.unionByName, tops).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", F.col("n").alias("count")))).alias("t")
    )  # k rows per column
    tidy = F.transform("t", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))
    return per.join(F.broadcast(top), "column").select(
        "column",
        "distinct_count",
        ratio.alias("cardinality_ratio"),
        (F.col("distinct_count") > 50).alias("is_high_cardinality"),
        (ratio > 0.9).alias("is_potential_id"),
        tidy.alias("top_categories"),
    )


def column_report(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """What score, issues and advice need, one row per column; written once, as all three read it."""
    numbers, texts = columns_of(df, NUMERICAL), columns_of(df, CATEGORICAL)
    distinct = distinct_counts(df, df.columns).select("column", F.col("count_values").alias("distinct_count"))
    skew = per_column(df, {c: [F.skewness(number(c)).alias("skewness")] for c in numbers}) if numbers else None
    out = missing_report(df).join(F.broadcast(distinct), "column", "left")  # one row per column here and below
    if skew is None:
        out = out.withColumn("skewness", F.lit(None).cast("double"))
    else:
        out = out.join(F.broadcast(skew), "column", "left")
    rows = df.count()
    is_text = F.col("column").isin(texts) if texts else F.lit(False)
    is_number = F.col("column").isin(numbers) if numbers else F.lit(False)
    ratio = F.when(is_text, F.col("distinct_count") / F.lit(float(max(rows, 1)))).otherwise(0.0)
    return written(
        out.withColumns({"cardinality_ratio": ratio, "is_numeric": is_number, "n_rows": F.lit(rows).cast("bigint")})
    )


def quality_score(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row: 100 minus penalties for missing values, duplicate rows and constant columns."""
    report = column_report(df) if report is None else report
    pct = F.col("missing_pct")
    missing = F.when(pct > 50, 5).when(pct > 20, 3).when(pct > 5, 1).otherwise(0)
    constant = F.when(F.col("distinct_count") == 1, 2).otherwise(0)
    columns = report.agg(F.coalesce(F.sum(missing + constant), F.lit(0)).alias("column_penalty"))
    dup = duplicate_count(df)
    dup_pct = F.when(F.col("n_rows") > 0, F.col("duplicates") / F.col("n_rows") * 100).otherwise(0.0)
    both = with_facts(columns, dup)
    penalty = F.col("column_penalty") + F.when(dup_pct > 20, 10).when(dup_pct > 5, 5).otherwise(0)
    return both.select(
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - penalty), 1).alias("quality_score"),
        F.col("duplicates").alias("duplicate_count"),
    )


def rows_of(report: DataFrame, rules: list[tuple[Column, list[Column]]]) -> DataFrame:
    """One output row per rule that holds for a column; a rule is (condition, fields)."""
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(*fields)) for cond, fields in rules]))
    return report.select("column", F.explode(hits).alias("h")).select("column", "h.*")


def quality_issues(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """column, issue, severity."""
    report = column_report(df) if report is None else report
    pct, skew = F.col("missing_pct"), F.col("skewness")

    def issue(text, severity):
        text = text if isinstance(text, Column) else F.lit(text)
        return [text.alias("issue"), F.lit(severity).alias("severity")]

    return rows_of(
        report,
        [
            (pct > 50, issue(F.concat(F.lit("mostly_null: "), percent(pct)), "high")),
            ((pct > 20) & (pct <= 50), issue(F.concat(F.lit("often_null: "), percent(pct)), "medium")),
            (F.col("distinct_count") == 1, issue("single_value", "high")),
            (F.abs(skew) > 3, issue(F.concat(F.lit("long_tail: skewness "), fixed(skew, 2)), "low")),
            (F.col("cardinality_ratio") > 0.95, issue("nearly_unique", "low")),
        ],
    )


def quality_recommendations(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """column, action, priority."""
    report = column_report(df) if report is None else report
    pct, numeric = F.col("missing_pct"), F.col("is_numeric")
    some = (pct > 5) & (pct <= 50)

    def advice(text, priority):
        text = text if isinstance(text, Column) else F.lit(text)
        return [text.alias("action"), F.lit(priority).alias("priority")]

    return rows_of(
        report,
        [
            (pct > 50, advice(F.concat(F.lit("leave_out: null in "), percent(pct)), "high")),
            (some & numeric, advice(F.concat(F.lit("fit_impute median: null in "), percent(pct)), "medium")),
            (some & ~numeric, advice(F.concat(F.lit("fit_impute mode: null in "), percent(pct)), "medium")),
            (F.abs(F.col("skewness")) > 2, advice("transforms log", "low")),
            (F.col("distinct_count") == 1, advice("leave_out: carries nothing", "high")),
        ],
    )


