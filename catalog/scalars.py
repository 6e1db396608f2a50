"""The scalar functions and plain aggregates the other operators are built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.plans.quantiles import group_quantiles
from gleaner.plans.tables import null_safe_join


@query(
    "h1_string_functions",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(len(string_split(text, ' ')) AS INTEGER) AS words, CAST(len(list_distinct(string_split(text, ''))) AS INTEGER) AS letters,
    source LIKE 'src1%' AS likely, nullif(lang, 'en') = '' AS is_empty FROM documents""",
)
def h1(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.length("text").alias("n"),
        F.size(F.split("text", " ")).alias("words"),
        F.size(F.array_distinct(F.split("text", ""))).alias("letters"),
        F.col("source").like("src1%").alias("likely"),
        (F.nullif("lang", F.lit("en")) == "").alias("is_empty"),
    )


@query(
    "h2_date_functions",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(dayofweek(ts) + 1 AS INTEGER) AS dw,
    CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(weekofyear(ts) AS INTEGER) AS w, CAST(quarter(ts) AS INTEGER) AS q, strftime(ts, '%Y-%m-%d') AS day_text FROM events""",
)
def h2(spark, d):
    parts = {"y": F.year, "m": F.month, "d": F.dayofmonth, "dw": F.dayofweek, "dy": F.dayofyear, "w": F.weekofyear, "q": F.quarter}
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    day = F.date_format(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd").alias("day_text")
    return table(spark, d, "events").select("event_id", *[f("ts").alias(n) for n, f in parts.items()], day)


@query(
    "h3_math_functions",
    """SELECT event_id, round(ln(1 + value), 6) AS log1p, round(sqrt(value), 6) AS root, round(pow(value, 1.5), 6) AS power, round(sin(value), 6) AS sine,
    round(cos(value), 6) AS cosine, round(abs(value - 50), 6) AS distance, round(greatest(value, 50, user_id) - least(value, 50, user_id), 6) AS spread FROM events""",
)
def h3(spark, d):
    v = F.col("value")
    three = [v, F.lit(50.0), F.col("user_id").cast("double")]
    return tidy(
        table(spark, d, "events").select(
            "event_id",
            F.log1p(v).alias("log1p"),
            F.sqrt(v).alias("root"),
            F.pow(v, F.lit(1.5)).alias("power"),
            F.sin(v).alias("sine"),
            F.cos(v).alias("cosine"),
            F.abs(v - 50).alias("distance"),
            (F.greatest(*three) - F.least(*three)).alias("spread"),
        )
    )


@query(
    "h4_null_and_conditional",
    """SELECT event_id, coalesce(v, -1.0) AS filled, v IS NULL AS missing, CASE WHEN v > 50 THEN 'high' ELSE 'low or null' END AS band
    FROM (SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) WHERE event_type IN ('error', 'view', 'click')""",
)
def h4(spark, d):
    kind = F.col("event_type")
    v = F.when(kind != "error", F.col("value"))
    return table(spark, d, "events").filter(kind.isin("error", "view", "click")).select(
        "event_id",
        F.coalesce(v, F.lit(-1.0)).alias("filled"),
        v.isNull().alias("missing"),
        F.when(v > 50, "high").otherwise("low or null").alias("band"),
    )


@query(
    "h5_aggregate_functions",
    """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total, count(*) AS n,
    count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS middle, round(kurtosis_pop(value), 6) AS kurt, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last,
    round(sum(pow(value - m, 3)) / count(*) / pow(var_pop(value), 1.5), 6) AS skew FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""",
)
def h5(spark, d):
    v = F.col("value")
    out = table(spark, d, "events").groupBy("event_type").agg(
        F.avg(v).alias("mean"),
        F.stddev(v).alias("std"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.round(F.sum(v), 4).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.kurtosis(v).alias("kurt"),
        F.min_by(v, "event_id").alias("first"),
        F.max_by(v, "event_id").alias("last"),
        F.skewness(v).alias("skew"),
    )
    middle = group_quantiles(table(spark, d, "events"), ["event_type"], ["value"], [0.5], {"value": ["middle"]})
    return tidy(null_safe_join(out, middle, ["event_type"]))
