"""Finding out whether a table is a time series, and of what kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.aggregates import distinct_counts
from gleaner.operators.windows import seconds_of
from gleaner.plans.tables import with_facts, written
from gleaner.types import CATEGORICAL, DATETIME, columns_of

# Words that mark a main time column, and words that mark an entity column.
TIME_WORDS = ["timestamp", "date", "time", "created", "occurred", "transaction"]
ENTITY_WORDS = ["id", "customer", "user", "account", "product", "store", "entity"]

# Upper limits, in days between observations, of each frequency.
FREQUENCY_LIMITS = [
    ("seconds", 0.001),
    ("minutes", 0.05),
    ("hourly", 0.5),
    ("daily", 3.0),
    ("weekly", 14.0),
    ("monthly", 45.0),
    ("quarterly", 120.0),
    ("yearly", 400.0),
]


def time_column_scores(df: DataFrame) -> DataFrame:
    """(column, score): 10 for a telling name plus 5 times the share of distinct values."""
    columns = columns_of(df, DATETIME)
    named = [c for c in columns if any(w in c.lower() for w in TIME_WORDS)]
    rows = df.agg(F.count(F.lit(1)).alias("__rows"))
    bonus = F.when(F.col("column").isin(named), 10.0).otherwise(0.0) if named else F.lit(0.0)
    scored = with_facts(distinct_counts(df, columns), rows)
    return scored.select("column", (bonus + F.col("count_values") / F.col("__rows") * 5).alias("score"))


def primary_time_column(df: DataFrame) -> str | None:
    columns = columns_of(df, DATETIME)
    if len(columns) < 2:
        return columns[0] if columns else None
    return time_column_scores(df).orderBy(F.desc("score"), "column").first()["column"]


def entity_columns(df: DataFrame, time_column: str | None = None, words=tuple(ENTITY_WORDS)) -> DataFrame:
    """(column, cardinality_ratio) of text and integer columns named like an entity with neither few nor many values."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    candidates = [
        c
        for c in df.columns
        if c in [*columns_of(df, CATEGORICAL), *whole] and c != time_column and any(w in c.lower() for w in words)
    ]
    if not candidates:
        return df.sparkSession.createDataFrame([], "column string, cardinality_ratio double")
    rows = df.agg(F.count(F.lit(1)).alias("__rows"))
    ratio = F.col("count_values") / F.col("__rows")
    shares = with_facts(distinct_counts(df, candidates), rows).select("column", ratio.alias("cardinality_ratio"))
    return shares.filter((F.col("cardinality_ratio") > 0.0001) & (F.col("cardinality_ratio") < 0.5))


def temporal_profile(df: DataFrame, time_column: str, entities: list[str] | None = None) -> DataFrame:
    """One row: range in days, records, distinct times, null times, and records per entity."""
    t = F.col(time_column)
    seconds = seconds_of(df, time_column)
    per_time = df.groupBy(t.alias("t"), seconds.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("t").isNotNull()
    span = per_time.agg(
        F.min("t").alias("min_date"),
        F.max("t").alias("max_date"),
        ((F.max("s") - F.min("s")) / 86400.0).alias("date_range_days"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("total_records"),
        F.count("t").alias("unique_time_points"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_times"),
        F.sum("n").alias("n_rows"),
    )
    if entities:
        counts = df.groupBy(*entities).agg(F.count(F.lit(1)).alias("n"))
        per = counts.agg(
            F.avg("n").alias("avg_records_per_entity"),
            F.min("n").alias("min_records_per_entity"),
            F.max("n").alias("max_records_per_entity"),
            F.stddev("n").alias("stddev_records_per_entity"),
        )
        ratio = F.try_divide("stddev_records_per_entity", "avg_records_per_entity")
        return with_facts(span, per).withColumn(
            "has_regular_intervals", F.coalesce(ratio < 0.3, F.lit(False))
        )
    none = F.lit(None)
    return span.withColumns(
        {
            "avg_records_per_entity": F.try_divide("total_records", "unique_time_points"),
            "min_records_per_entity": none.cast("bigint"),
            "max_records_per_entity": none.cast("bigint"),
            "stddev_records_per_entity": none.cast("double"),
            "has_regular_intervals": F.lit(False),
        }
    )


def frequency() -> Column:
    """Name of the observation frequency, from a temporal_profile row."""
    gap = F.try_divide("date_range_days", "unique_time_points")
    name = F.when(F.coalesce(F.col("date_range_days"), F.lit(0.0)) == 0, "unknown")
    for label, limit in FREQUENCY_LIMITS:
        name = name.when(gap < limit, label)
    return name.otherwise("irregular")


def is_time_series(entities: bool, min_records: int = 3) -> Column:
    """Whether entities, or else time points, have enough records each; from a temporal_profile row."""
    if entities:
        return F.coalesce(F.col("avg_records_per_entity") >= min_records, F.lit(False))
    many = F.try_divide("n_rows", "unique_time_points") >= min_records
    return F.coalesce((F.col("unique_time_points") > 1) & many, F.lit(False))


def recommended_features(profile: DataFrame, entities: bool, min_records: int = 3) -> DataFrame:
    """(position, feature): operators of this library, with their main setting, that suit the series."""
    p = profile.withColumns({"__f": frequency(), "__ts": is_time_series(entities, min_records)})
    f, lit = F.col("__f"), F.lit
    deep = F.lit(entities) & (F.col("avg_records_per_entity") >= 10)
    slow, fast = f.isin("daily", "weekly"), f.isin("hourly", "minutes")
    chosen = [
        lit("datetime_parts"),
        lit("cyclical"),
        F.when(slow, "lag_features 7").when(f == "monthly", "lag_features 3").when(fast, "lag_features 24"),
        F.when(slow, "rolling_features 7").when(f == "monthly", "rolling_features 3").when(fast, "rolling_features 24"),
        F.when(F.col("date_range_days") > 365, "datetime_parts dayofyear"),
        F.when(f.isin("daily", "hourly"), "datetime_parts dayofweek"),
        F.when(deep, "ts_features efficient").otherwise("ts_features minimal"),
        lit("diff_features"),
    ]
    names = F.when(F.col("__ts"), F.array_compact(F.array(*chosen))).otherwise(F.array(lit("datetime_parts")))
    return p.select(F.posexplode(names).alias("position", "feature"))


def time_quality(profile: DataFrame) -> DataFrame:
    """(warning): null times, few distinct times, sparse series."""
    unique = F.try_divide("unique_time_points", "total_records")
    per_day = F.try_divide("total_records", "date_range_days")
    rules = [
        F.when(F.col("null_times") > 0, "null_times"),
        F.when(unique < 0.5, "low_time_uniqueness"),
        F.when((F.col("date_range_days") > 30) & (per_day < 0.1), "sparse"),
    ]
    return profile.select(F.explode(F.array_compact(F.array(*rules))).alias("warning"))


@dataclass(frozen=True)
class TimeSeriesInfo:
    is_time_series: bool
    time_column: str | None
    entity_columns: tuple[str, ...]
    frequency: str
    recommended: tuple[str, ...]
    warnings: tuple[str, ...]


def detect(df: DataFrame, min_records: int = 3) -> TimeSeriesInfo:
    """Everything about a table's time structure; the profile is written once and read by the rest."""
    time_column = primary_time_column(df)
    if time_column is None:
        return TimeSeriesInfo(False, None, (), "unknown", (), ("no datetime column",))
    found = {r["column"] for r in entity_columns(df, time_column).collect()}  # column names only
    entities = [c for c in df.columns if c in found]
    profile = written(temporal_profile(df, time_column, entities))
    facts = profile.select(frequency().alias("f"), is_time_series(bool(entities), min_records).alias("ts")).first()
    advice = recommended_features(profile, bool(entities), min_records).orderBy("position").collect()
    warnings = [r["warning"] for r in time_quality(profile).collect()]
    return TimeSeriesInfo(
        facts["ts"], time_column, tuple(entities), facts["f"], tuple(r["feature"] for r in advice), tuple(warnings)
    )
