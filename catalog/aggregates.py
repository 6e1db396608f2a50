"""Joins back, aggregates, windows, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.functions.predicates import is_class
from gleaner.operators import aggregates as agg
from gleaner.operators import ranking, windows

LINE = ["l_orderkey", "l_linenumber"]


@query(
    "c1_group_stats_joined",
    """SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER w, 4) AS l_extendedprice_mean_by_l_returnflag_l_linestatus,
    count(l_quantity) OVER w AS l_quantity_count_by_x FROM (SELECT *, nullif(l_returnflag, 'N') AS g FROM lineitem) t
    WINDOW w AS (PARTITION BY g, l_linestatus) QUALIFY g IS NOT NULL
    UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL FROM lineitem WHERE l_returnflag = 'N'""",
)
def c1(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    groups = ["l_returnflag", "l_linestatus"]
    out = agg.group_agg_features(df, groups, ["l_extendedprice"], ["mean"])
    out = agg.group_agg_features(out, groups, ["l_quantity"], ["count"])
    named = out.withColumnRenamed("l_quantity_count_by_l_returnflag_l_linestatus", "l_quantity_count_by_x")
    return tidy(named.select(*LINE, "l_extendedprice_mean_by_l_returnflag_l_linestatus", "l_quantity_count_by_x"), 4)


@query(
    "d1_group_agg_features",
    """SELECT o.o_orderkey, round(s.a, 6) AS o_totalprice_mean_by_o_custkey, round(s.b, 6) AS o_totalprice_sum_by_o_custkey,
    s.c AS o_totalprice_min_by_o_custkey, s.e AS o_totalprice_max_by_o_custkey,
    round(s.f, 6) AS o_totalprice_stddev_by_o_custkey, s.g AS o_totalprice_count_by_o_custkey
    FROM orders o LEFT JOIN (SELECT o_custkey, avg(o_totalprice) a, sum(o_totalprice) b, min(o_totalprice) c,
    max(o_totalprice) e, stddev_samp(o_totalprice) f, count(o_totalprice) g FROM orders GROUP BY 1) s USING (o_custkey)""",
)
def d1(spark, d):
    out = agg.group_agg_features(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], list(agg.AGGREGATES))
    return tidy(out.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), 6)


CATEGORY_COLUMNS = ["event_type", "user_text"]


def _nullish_events(spark, d):
    df = table(spark, d, "events")
    return df.select(
        F.nullif("event_type", F.lit("click")).alias("event_type"), F.col("user_id").cast("string").alias("user_text")
    )


@query(
    "d2_categorical_summary",
    """WITH e AS (SELECT nullif(event_type, 'click') AS a, CAST(user_id AS VARCHAR) AS b FROM events)
    SELECT 'event_type' AS "column", count(DISTINCT a) AS count_distinct, count(a) AS count, count(*) - count(a) AS null_count FROM e
    UNION ALL SELECT 'user_text', count(DISTINCT b), count(b), count(*) - count(b) FROM e""",
)
def d2(spark, d):
    return agg.category_summary(_nullish_events(spark, d), CATEGORY_COLUMNS)


@query(
    "d2_category_values",
    """WITH e AS (SELECT nullif(event_type, 'click') AS a, CAST(user_id AS VARCHAR) AS b FROM events)
    SELECT 'event_type' AS "column", a AS value, count(a) AS count, count(*) - count(a) AS null_count FROM e GROUP BY a
    UNION ALL SELECT 'user_text', b, count(b), count(*) - count(b) FROM e GROUP BY b""",
)
def d2_values(spark, d):
    return agg.category_values(_nullish_events(spark, d), CATEGORY_COLUMNS)


@query(
    "d3_numerical_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        count(DISTINCT {c}) AS count_distinct, round(quantile_cont({c}, 0.5), 4) AS median
        FROM (SELECT nullif(l_quantity, 1) AS l_quantity, l_extendedprice, l_linenumber FROM lineitem)"""
        for c in ["l_quantity", "l_extendedprice", "l_linenumber"]
    ),
)
def d3(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(1.0)))
    return tidy(agg.numeric_summary(df, ["l_quantity", "l_extendedprice", "l_linenumber"]), 4)


@query(
    "d4_boolean_summary",
    """SELECT 'big' AS "column", count(DISTINCT big) AS count_distinct, count(big) AS count, count(*) - count(big) AS null_count
    FROM (SELECT nullif(o_totalprice, 0) > 100000 AS big FROM orders)""",
)
def d4(spark, d):
    df = table(spark, d, "orders").select((F.nullif("o_totalprice", F.lit(0.0)) > 100000).alias("big"))
    return agg.category_summary(df, ["big"])


@query(
    "d5_kpi",
    """SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS returned_pct
    FROM lineitem GROUP BY 1""",
)
def d5(spark, d):
    df = table(spark, d, "lineitem").withColumn("returned", is_class("l_returnflag", "R"))
    return tidy(agg.kpi(df, "returned", ["l_linestatus"]))


@query(
    "d5_kpi_overall",
    "SELECT round(avg(o_totalprice), 4) AS o_totalprice_pct FROM orders",
)
def d5_overall(spark, d):
    return tidy(agg.kpi(table(spark, d, "orders"), "o_totalprice"), 4)


@query(
    "t3_custom_kpi",
    """SELECT o_orderpriority, round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS per_customer, count(*) AS size
    FROM orders GROUP BY 1""",
)
def t3(spark, d):
    metric = (
        (F.sum("o_totalprice") / F.countDistinct("o_custkey")).alias("per_customer"),
        F.count(F.lit(1)).alias("size"),
    )
    return tidy(agg.kpi(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], metric), 4)


@query(
    "d6_class_distribution",
    'SELECT o_orderstatus AS "class", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1',
)
def d6(spark, d):
    return tidy(agg.class_distribution(table(spark, d, "orders"), "o_orderstatus"))


DISTINCT_COLUMNS = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "d7_distinct_count",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS count_distinct, count(DISTINCT {c})
        + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS count_values FROM
        (SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"""
        for c in DISTINCT_COLUMNS
    ),
)
def d7(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return agg.distinct_counts(df, DISTINCT_COLUMNS)


@query("d7_distinct_count_approx_error", "SELECT * FROM (VALUES ('o_custkey', true), ('o_totalprice', true), ('o_orderdate', true), ('o_orderpriority', true)) v(\"column\", close)")
def d7_error(spark, d):
    orders = table(spark, d, "orders")
    rough = agg.distinct_counts(orders, DISTINCT_COLUMNS, approx=True).select("column", F.col("count_distinct").alias("rough"))
    exact = agg.distinct_counts(orders, DISTINCT_COLUMNS).join(rough, "column")
    gap = F.abs(F.col("rough") - F.col("count_distinct")) / F.col("count_distinct")
    return exact.select("column", (gap < 0.15).alias("close"))


@query("d7_distinct_count_approx")
def d7_approx(spark, d):
    return agg.distinct_counts(table(spark, d, "orders"), DISTINCT_COLUMNS, approx=True)


@query(
    "d8_baseline_rate",
    """SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS positives,
    round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS baseline_rate FROM lineitem""",
)
def d8(spark, d):
    return tidy(agg.baseline_rate(table(spark, d, "lineitem"), is_class("l_returnflag", "R")))


@query(
    "d9_batch_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS value FROM lineitem"
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
        for p in [0.1, 0.25, 0.5, 0.75, 0.9]
    ),
)
def d9(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    return agg.batch_quantiles(table(spark, d, "lineitem"), columns, [0.1, 0.25, 0.5, 0.75, 0.9])


EVENTS_WINDOW = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "e1_lag_features",
    f"""SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2,
    lag(value, 3) OVER w AS value_lag_3, lag(value, 7) OVER w AS value_lag_7 FROM events {EVENTS_WINDOW}""",
)
def e1(spark, d):
    out = windows.lag_features(table(spark, d, "events"), ["value"], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", *[f"value_lag_{k}" for k in (1, 2, 3, 7)])


@query(
    "e2_rolling_features",
    "SELECT event_id, "
    + ", ".join(
        f"round({fn}(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) "
        f"AS value_rolling_{name}_{w}"
        for w in (3, 7, 14)
        for name, fn in [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("sum", "sum")]
    )
    + " FROM events",
)
def e2(spark, d):
    funcs = ("mean", "std", "min", "max", "sum")
    out = windows.rolling_features(table(spark, d, "events"), ["value"], ["ts", "event_id"], ["user_id"], funcs=funcs)
    return tidy(out.drop("ts", "user_id", "event_type", "value", "props"), 6)


@query(
    "e3_diff_features",
    f"""SELECT event_id, round(value - lag(value, 1) OVER w, 6) AS value_diff_1, round(value - lag(value, 7) OVER w, 6) AS value_diff_7
    FROM events {EVENTS_WINDOW}""",
)
def e3(spark, d):
    out = windows.diff_features(table(spark, d, "events"), ["value"], ["ts", "event_id"], ["user_id"], [1, 7])
    return tidy(out.select("event_id", "value_diff_1", "value_diff_7"))


@query(
    "e4_pct_change",
    f"""SELECT event_id, round(CASE WHEN lag(v) OVER w <> 0 THEN (v - lag(v) OVER w) / abs(lag(v) OVER w) ELSE 0.0 END, 4)
    AS value_pct_change_1 FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 0.0 ELSE value END AS v
    FROM events) {EVENTS_WINDOW}""",
)
def e4(spark, d):
    kind = F.col("event_type")
    v = F.when(kind == "error", None).when(kind == "signup", 0.0).otherwise(F.col("value"))
    df = table(spark, d, "events").withColumn("value", v)
    out = windows.pct_change_features(df, ["value"], ["ts", "event_id"], ["user_id"])
    return tidy(out.select("event_id", "value_pct_change_1"), 4)


@query(
    "e5_entity_stats",
    """SELECT event_id, round(avg(value) OVER w, 4) AS value__mean, round(stddev_samp(value) OVER w, 4) AS value__std,
    min(value) OVER w AS value__min, max(value) OVER w AS value__max, round(sum(value) OVER w, 4) AS value__sum,
    count(value) OVER w AS value__count, round(max(value) OVER w - min(value) OVER w, 6) AS value__range
    FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def e5(spark, d):
    out = windows.entity_features(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"])
    return tidy(out.select("event_id", *[f"value__{s}" for s in ("mean", "std", "min", "max", "sum", "count", "range")]), 4)


@query(
    "e6_first_last",
    """SELECT event_id, first_value(value) OVER w AS value__first, last_value(value) OVER w AS value__last FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def e6(spark, d):
    out = windows.entity_features(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"])
    return out.select("event_id", "value__first", "value__last")


@query(
    "e7_cumulative",
    """SELECT event_id, round(sum(sqrt(value)) OVER w, 4) AS v_cum_sum, round(avg(sqrt(value)) OVER w, 6) AS v_cum_mean FROM events
    WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def e7(spark, d):
    df = table(spark, d, "events").withColumn("v", F.sqrt("value"))  # no value lies on a rounding edge
    out = windows.cumulative_features(df, ["v"], ["event_id"])
    return tidy(out.select("event_id", F.round("v_cum_sum", 4).alias("v_cum_sum"), "v_cum_mean"))


@query(
    "e7_percentile",
    """SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2)
    / count(*) OVER (), 6) AS l_quantity_percentile FROM lineitem""",
)
def e7_percentile(spark, d):
    out = windows.percentile_features(table(spark, d, "lineitem"), ["l_quantity"])
    return tidy(out.select(*LINE, "l_quantity_percentile"))


@query(
    "f1_top_categories",
    "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 10",
)
def f1(spark, d):
    return ranking.top_categories(table(spark, d, "part"), "p_type", 10)


@query(
    "f2_mode",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS mode FROM part GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"""
        for c in ["p_brand", "p_type", "p_size"]
    ),
)
def f2(spark, d):
    return ranking.modes(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("g1_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def g1(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "g2_duplicate_count",
    """SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS distinct_rows,
    (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem)""",
)
def g2(spark, d):
    return agg.duplicate_count(table(spark, d, "lineitem"), ["l_partkey", "l_quantity"])
