"""Insights, microsegments and everything that reads them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.functions import rowwise
from gleaner.operators import encode, insights, microsegments, prep, ranking
from gleaner.streaming.incremental import microsegments_by_depth
from gleaner.types import CLASSIFICATION, REGRESSION, Problem, add_features

RETURNED = Problem("l_returnflag", CLASSIFICATION, "R")
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_linestatus"]
SHAPE = ["feature", "op", "number", "text", "support_count", "support", "class_rate", "lift", "rig"]

# lineitem with some nulls in a number and in a category; y marks the positive class
BASE = """t AS (SELECT nullif(l_quantity, 7.0) AS l_quantity, l_extendedprice, l_discount, l_tax,
    nullif(l_linestatus, CASE WHEN l_linenumber = 1 THEN 'O' END) AS l_linestatus, l_shipdate, l_linenumber, l_orderkey,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
    b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""


def _lines(spark, d):
    df = table(spark, d, "lineitem")
    gone = (F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O")
    return df.withColumns(
        {
            "l_quantity": F.nullif("l_quantity", F.lit(7.0)),
            "l_linestatus": F.when(~gone, F.col("l_linestatus")),
        }
    )


def numeric_sql(c: str, bins: int = 10) -> str:
    """Counts on both sides of each distinct decile of one column."""
    probs = ", ".join(f"quantile_disc({c}, {i / bins})" for i in range(1, bins))
    return f"""SELECT '{c}' AS feature, op, CAST(x AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text,
    CASE op WHEN '>=' THEN count(*) FILTER ({c} >= x) ELSE count(*) FILTER ({c} < x) END AS n,
    CASE op WHEN '>=' THEN sum(y) FILTER ({c} >= x) ELSE sum(y) FILTER ({c} < x) END AS pos
    FROM t, (SELECT DISTINCT unnest([{probs}]) AS x FROM t), (VALUES ('>='), ('<')) s(op)
    WHERE (SELECT min({c}) < max({c}) FROM t) GROUP BY op, x"""


def category_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, CASE WHEN {c} IS NULL THEN 'null' ELSE '=' END AS op, CAST(NULL AS DOUBLE) AS number,
    CAST({c} AS VARCHAR) AS text, count(*) AS n, sum(y) AS pos FROM t GROUP BY {c}"""


def measured_sql(segments: str, support: float = 0.01, lift: float = 1.1, name: str = "i", base: str = BASE) -> str:
    """CTEs ending in one named i: kept insights with their metrics."""
    h = "CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END"
    return f"""WITH {base}, seg AS ({segments}),
    q AS (SELECT feature, op, number, text, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos, total, base, n / total AS s, coalesce(pos / n, 0) AS r FROM seg, b),
    q2 AS (SELECT *, CASE WHEN s >= 1 THEN base ELSE least(1, greatest(0, (base - r * s) / (1 - s))) END AS rc FROM q),
    {name} AS (SELECT feature, op, number, text, n AS support_count, s AS support, r AS class_rate, base AS baseline_rate, r / base AS lift,
    greatest(0, ({h.format(p="base")} - (s * ({h.format(p="r")}) + (1 - s) * ({h.format(p="rc")}))) / ({h.format(p="base")})) AS rig
    FROM q2 WHERE n >= {support} * total AND n > 0 AND r / base >= {lift})"""


OUT = """SELECT feature, op, number, text, CAST(support_count AS BIGINT) AS support_count, round(support, 6) AS support,
    round(class_rate, 6) AS class_rate, round(lift, 6) AS lift, round(rig, 6) AS rig FROM i"""
LOW = insights.Limits(min_support=0.001, min_lift=1.0)
ALL_SEGMENTS = " UNION ALL ".join([*map(numeric_sql, NUM), *map(category_sql, CAT)])


def _shaped(df: DataFrame) -> DataFrame:
    return tidy(df.select(*SHAPE))


def _all(spark, d, limits=LOW):
    df = _lines(spark, d)
    goal = insights.goal_of(df, RETURNED)
    return df, goal, insights.all_insights(df, RETURNED, limits, goal=goal, numbers=NUM, categories=CAT)


@query("m1_numeric_insights", measured_sql(ALL_SEGMENTS, 0.01, 1.0) + OUT)
def m1(spark, d):
    return _shaped(_all(spark, d, insights.Limits(min_lift=1.0))[2])


@query("m2_numeric_insights_batch", measured_sql(" UNION ALL ".join(map(numeric_sql, NUM)), 0.001, 1.0) + OUT)
def m2(spark, d):
    df = _lines(spark, d)
    return _shaped(insights.numeric_insights(df, NUM, insights.goal_of(df, RETURNED), LOW))


@query("m3_categorical_insights", measured_sql(" UNION ALL ".join(map(category_sql, ["l_linestatus", "l_linenumber"])), 0.0, 0.0) + OUT)
def m3(spark, d):
    df = _lines(spark, d)
    goal = insights.goal_of(df, RETURNED)
    return _shaped(insights.categorical_insights(df, ["l_linestatus", "l_linenumber"], goal, insights.Limits(0.0, 0.0)))


@query("m4_m5_metrics_and_limits", measured_sql(ALL_SEGMENTS, 0.2, 1.005) + OUT)
def m4(spark, d):
    return _shaped(_all(spark, d, insights.Limits(0.2, 1.005))[2])


REGRESSION_BASE = """t AS (SELECT o_custkey, o_orderpriority, o_orderstatus, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)
    THEN 1 ELSE 0 END AS y FROM orders), b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""


@query(
    "m1_insights_regression",
    measured_sql(
        " UNION ALL ".join([numeric_sql("o_custkey"), category_sql("o_orderpriority"), category_sql("o_orderstatus")]),
        0.01, 1.0, base=REGRESSION_BASE,
    ) + OUT,
)
def m1_regression(spark, d):
    problem = Problem("o_totalprice", REGRESSION)
    df = table(spark, d, "orders").drop("o_orderkey", "o_orderdate")
    return _shaped(insights.all_insights(df, problem, insights.Limits(0.01, 1.0)))


MINORITY_BASE = """t AS (SELECT o_totalprice, o_orderpriority, CASE WHEN o_orderstatus = (SELECT o_orderstatus FROM orders GROUP BY 1
    ORDER BY count(*), o_orderstatus LIMIT 1) THEN 1 ELSE 0 END AS y FROM orders), b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""


@query(
    "m1_insights_minority_class",
    measured_sql(" UNION ALL ".join([numeric_sql("o_totalprice"), category_sql("o_orderpriority")]), 0.01, 1.0, base=MINORITY_BASE) + OUT,
)
def m1_minority(spark, d):
    df = table(spark, d, "orders").drop("o_orderkey", "o_custkey", "o_orderdate")
    return _shaped(insights.all_insights(df, Problem("o_orderstatus"), insights.Limits(0.01, 1.0)))


ENGINEERED_BASE = """t AS (SELECT ln(1 + greatest(l_extendedprice, 0)) AS l_extendedprice_log, l_quantity * l_tax AS l_quantity_mult_l_tax,
    CASE WHEN l_tax <> 0 THEN l_quantity / l_tax ELSE 0 END AS l_quantity_ratio_l_tax, month(l_shipdate) AS l_shipdate_month,
    CAST(least(len(list_filter(s, lambda x: x <= l_extendedprice)) - 1, len(s) - 2) AS DOUBLE) AS l_extendedprice_binned,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem, (SELECT list_sort(list_distinct([quantile_disc(l_extendedprice, 0.0),
    quantile_disc(l_extendedprice, 0.2), quantile_disc(l_extendedprice, 0.4), quantile_disc(l_extendedprice, 0.6), quantile_disc(l_extendedprice, 0.8),
    quantile_disc(l_extendedprice, 1.0)])) AS s FROM lineitem)), b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""
ENGINEERED = ["l_extendedprice_log", "l_quantity_mult_l_tax", "l_quantity_ratio_l_tax", "l_shipdate_month"]
GROUPS_SQL = """SELECT feature, op, round(number, 6) AS number, text, support_count, round(lift, 6) AS lift, CASE feature
    WHEN 'l_extendedprice_log' THEN 'Transformation Features' WHEN 'l_quantity_mult_l_tax' THEN 'Interaction Features'
    WHEN 'l_quantity_ratio_l_tax' THEN 'Ratio Features' WHEN 'l_shipdate_month' THEN 'Datetime Features' ELSE 'Binned Features' END AS feature_group FROM i"""


@query(
    "m6_engineered_insights",
    measured_sql(" UNION ALL ".join([*map(numeric_sql, ENGINEERED), category_sql("l_extendedprice_binned")]), 0.001, 1.0, base=ENGINEERED_BASE)
    + GROUPS_SQL,
)
def m6(spark, d):
    df = table(spark, d, "lineitem")
    features = [
        *rowwise.transforms(["l_extendedprice"], ["log"]),
        *rowwise.interactions(["l_quantity", "l_tax"], ["mult"]),
        *rowwise.ratios([("l_quantity", "l_tax")], inverse=False),
        *[f for f in rowwise.datetime_parts(["l_shipdate"]) if f.spec.name.endswith("_month")],
        *encode.binned(encode.bin_splits(df, ["l_extendedprice"])),
    ]
    wide = add_features(df, features)
    found = insights.engineered_insights(wide, [f.spec for f in features], insights.goal_of(df, RETURNED), LOW)
    return tidy(found.select("feature", "op", "number", "text", "support_count", "lift", "feature_group"))


DATE_BASE = """t AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, CAST(dayofyear(l_shipdate) AS INTEGER) AS l_shipdate_dayofyear,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""


@query(
    "m7_datetime_insights",
    measured_sql(category_sql("l_shipdate_month") + " UNION ALL " + numeric_sql("l_shipdate_dayofyear"), 0.001, 1.0, base=DATE_BASE) + OUT,
)
def m7(spark, d):
    df = table(spark, d, "lineitem")
    parts = [f for f in rowwise.datetime_parts(["l_shipdate"]) if f.spec.name.endswith(("_month", "_dayofyear"))]
    wide = add_features(df, parts)
    return _shaped(insights.datetime_insights(wide, [f.spec.name for f in parts], insights.goal_of(df, RETURNED), LOW))


# microsegments: number the strongest conditions, test every row against them, count the rows of each combination
MICRO_BASE = """t AS (SELECT event_id, value, hour(ts) AS h, day(ts) AS dd, user_id, event_id % 1 AS z,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, CAST(row_number() OVER () AS INTEGER) AS rid FROM events),
    b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""
MICRO_COLUMNS = ["value", "h", "dd", "user_id"]


MICRO_SEGMENTS = " UNION ALL ".join(map(numeric_sql, MICRO_COLUMNS))
MICRO_PROBLEM = Problem("event_type", CLASSIFICATION, "purchase")


def _micro_frame(spark, d):
    df = table(spark, d, "events")
    return df.select("value", F.hour("ts").alias("h"), F.dayofmonth("ts").alias("dd"), "user_id", "event_type")


def _micro_insights(df):
    goal = insights.goal_of(df, MICRO_PROBLEM)
    return goal, insights.numeric_insights(df, MICRO_COLUMNS, goal, LOW)


def _named(found: DataFrame, conditions) -> DataFrame:
    """Name each combination by the positions of its conditions in the list of strongest ones."""
    rows = [(i, c.feature, c.op, c.number) for i, (c, _) in enumerate(conditions)]
    place = reduce(
        lambda e, r: lambda c: F.when((c["feature"] == r[1]) & (c["op"] == r[2]) & (c["number"] == r[3]), str(r[0])).otherwise(e(c)),
        rows,
        lambda c: F.lit(None).cast("string"),
    )
    members = F.array_join(F.transform("conditions", place), "&")
    return tidy(found.select("depth", members.alias("members"), "support_count", "support", "class_rate", "lift"))


# many conditions on many features, combined to depth 5: every combination without a limit. A condition is a string
# of bits, one per row, so a combination is an AND and a count
DEEP_COLUMNS = ["value", "h", "dd", "user_id", "wd", "mi", "k"]
DEEP_BASE = """t AS (SELECT value, hour(ts) AS h, day(ts) AS dd, user_id, dayofyear(ts) AS wd, minute(ts) AS mi, event_id % 97 AS k,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, CAST(row_number() OVER () AS INTEGER) AS rid FROM events),
    b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)"""
DEEP_TOP, DEEP_SUPPORT = 42, 0.03


def combined_sql(columns: list[str], top: int | None, support: float, deepest: int, rows: int) -> str:
    """Every combination of the conditions (the top strongest if given); rows bounds the rows of the table."""
    holds = " ".join(
        f"WHEN feature = '{c}' THEN CASE op WHEN '>=' THEN CAST({c} AS DOUBLE) >= number ELSE CAST({c} AS DOUBLE) < number END" for c in columns
    )
    levels = f"""l1 AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS members, id AS last, [feature] AS fs, lift AS best, bits FROM h, b
        WHERE bit_count(bits) >= {support} * total)"""
    for k in range(2, deepest + 1):
        levels += f""", l{k} AS MATERIALIZED (SELECT a.members || '&' || h.id AS members, h.id AS last, list_append(a.fs, h.feature) AS fs,
        greatest(a.best, h.lift) AS best, a.bits & h.bits AS bits FROM l{k - 1} a JOIN h ON h.id > a.last AND NOT list_contains(a.fs, h.feature), b
        WHERE bit_count(a.bits & h.bits) >= {support} * total)"""
    every = " UNION ALL ".join(f"SELECT {k} AS depth, members, bits, best FROM l{k}" for k in range(2, deepest + 1))
    return f""", top AS (SELECT *, row_number() OVER (ORDER BY lift DESC, feature, op, number, text) - 1 AS id FROM i
    QUALIFY row_number() OVER (ORDER BY lift DESC, feature, op, number, text) <= {top or 1_000_000}),
    h AS MATERIALIZED (SELECT id, any_value(feature) AS feature, any_value(lift) AS lift, bitstring_agg(rid, 1, {rows}) AS bits
        FROM t, top WHERE CASE {holds} END GROUP BY id),
    yes AS (SELECT bitstring_agg(rid, 1, {rows}) AS bits FROM t WHERE y = 1),
    {levels}, m AS (SELECT depth, members, best, bit_count(e.bits) AS n, bit_count(e.bits & yes.bits) AS pos FROM ({every}) e, yes)
    SELECT depth, members, CAST(n AS BIGINT) AS support_count, round(n / total, 6) AS support, round(pos / n, 6) AS class_rate,
    round(pos / n / base, 6) AS lift FROM m, b WHERE pos / n / base > best * (1.1 + (depth - 2) * 0.05)"""


@query("m8_microsegments_depth_5", measured_sql(" UNION ALL ".join(map(numeric_sql, DEEP_COLUMNS)), 0.001, 1.0, base=DEEP_BASE) + combined_sql(DEEP_COLUMNS, DEEP_TOP, DEEP_SUPPORT, 5, 1_000_000))
def m8_deep(spark, d):
    df = table(spark, d, "events")
    parts = [F.hour("ts").alias("h"), F.dayofmonth("ts").alias("dd"), F.dayofyear("ts").alias("wd"), F.minute("ts").alias("mi")]
    df = df.select("value", "user_id", "event_type", (F.col("event_id") % 97).alias("k"), *parts)
    goal = insights.goal_of(df, MICRO_PROBLEM)
    found = insights.numeric_insights(df, DEEP_COLUMNS, goal, LOW)
    segments = microsegments.microsegments(df, found, goal, 5, DEEP_TOP, min_support=DEEP_SUPPORT)
    return _named(segments, insights.conditions_of(found, DEEP_TOP))


# all conditions, to depth 3
ALL_COMBINATIONS = measured_sql(MICRO_SEGMENTS, 0.001, 1.0, base=MICRO_BASE) + combined_sql(MICRO_COLUMNS, None, 0.002, 3, 100_000)


@query("m8_microsegments", ALL_COMBINATIONS)
def m8(spark, d):
    df = _micro_frame(spark, d)
    goal, found = _micro_insights(df)
    return _named(microsegments.microsegments(df, found, goal, 3, min_support=0.002), insights.conditions_of(found))


@query("m12_microsegments_by_depth", ALL_COMBINATIONS)
def m12(spark, d):
    df = _micro_frame(spark, d)
    goal, found = _micro_insights(df)
    parts = [p for _, p in microsegments_by_depth(df, found, goal, 3, min_support=0.002)]
    return _named(reduce(DataFrame.unionByName, parts), insights.conditions_of(found))


@query(
    "m9_insight_summary",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0)
    + """SELECT count(*) AS total_insights, round(avg(lift), 6) AS avg_lift, round(max(lift), 6) AS max_lift, round(avg(rig), 6) AS avg_rig,
    (SELECT string_agg(DISTINCT feature, ',' ORDER BY feature) FROM (SELECT feature FROM i ORDER BY lift DESC, feature, op, number, text LIMIT 10)) AS top_features FROM i""",
)
def m9(spark, d):
    out = insights.insight_summary(_all(spark, d)[2])
    return tidy(out.withColumn("top_features", F.array_join("top_features", ",")))


@query(
    "m10_insight_table",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0)
    + """SELECT feature AS "Feature", CASE WHEN op = 'null' THEN feature || ' IS NULL' WHEN op = '=' THEN feature || ' = ''' || text || ''''
    ELSE feature || ' ' || op || ' ' || printf('%.3f', number) END AS "Condition", 'R' AS "Class", 'x' || printf('%.2f', lift) AS "Lift",
    round(lift, 6) AS "Lift_Value", printf('%.1f', support * 100) || '%' AS "Support", format('{:,}', support_count) AS "Support_Count",
    round(support, 6) AS "Support_Value", printf('%.3f', rig) AS "RIG", round(rig, 6) AS "RIG_Value", printf('%.1f', class_rate * 100) || '%' AS "Class_Rate",
    printf('%.1f', baseline_rate * 100) || '%' AS "Baseline_Rate", CASE feature WHEN 'l_linestatus' THEN 'Categorical Features' ELSE 'Numeric Features' END AS "Group",
    feature AS "Source" FROM i""",
)
def m10(spark, d):
    _, goal, found = _all(spark, d)
    return tidy(insights.insight_table(found, goal.label))


@query("m11_requery", measured_sql(ALL_SEGMENTS, 0.05, 1.001) + OUT + " ORDER BY i.lift DESC, feature, op, number, text LIMIT 10")
def m11(spark, d):
    store = insights.InsightStore.build(_lines(spark, d), RETURNED, numbers=NUM, categories=CAT)
    return _shaped(store.query(0.05, 1.001, 10))


@query("m13_insights_on_transformed", measured_sql(" UNION ALL ".join([numeric_sql("l_quantity_scaled"), category_sql("l_linestatus")]), 0.001, 1.0, base="""
    a AS (SELECT coalesce(nullif(l_quantity, 7.0), (SELECT quantile_disc(nullif(l_quantity, 7.0), 0.5) FROM lineitem)) AS q, l_linestatus,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
    t AS (SELECT (q - (SELECT avg(q) FROM a)) / (SELECT stddev_samp(q) FROM a) AS l_quantity_scaled, l_linestatus, y FROM a),
    b AS (SELECT count(*) AS total, sum(y) AS positives, sum(y) / count(*) AS base FROM t)""")
    + "SELECT feature, op, round(number, 6) AS number, text, support_count, round(lift, 6) AS lift FROM i")
def m13(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    options = prep.PrepOptions(outliers=None, rare_threshold=None)
    ready = prep.prepare(df.select("l_quantity", "l_linestatus", "l_returnflag"), ["l_quantity"], ["l_linestatus"], options)
    found = insights.all_insights(ready, RETURNED, LOW, numbers=["l_quantity_scaled"], categories=["l_linestatus"])
    return tidy(found.select("feature", "op", "number", "text", "support_count", "lift"))


@query(
    "m14_lift_support_frontier",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0)
    + """, p AS (SELECT feature, op, number, text, support * 100 AS support_pct, lift, rig FROM i ORDER BY lift DESC, feature, op, number, text LIMIT 20)
    SELECT feature, op, number, text, round(support_pct, 6) AS support_pct, round(lift, 6) AS lift, round(rig, 6) AS rig, round(k, 6) AS curve_constant,
    round(k / support_pct, 6) AS curve_lift FROM p, (SELECT quantile_cont(lift * support_pct, 0.75) AS k FROM p)""",
)
def m14(spark, d):
    return tidy(insights.lift_support_frontier(_all(spark, d)[2], 20))


@query(
    "m14_frontier_of_all_insights",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0)
    + """, p AS (SELECT feature, op, number, text, support * 100 AS support_pct, lift, rig FROM i)
    SELECT feature, op, number, text, round(support_pct, 6) AS support_pct, round(lift, 6) AS lift, round(rig, 6) AS rig, round(k, 6) AS curve_constant,
    round(k / support_pct, 6) AS curve_lift FROM p, (SELECT quantile_cont(lift * support_pct, 0.75) AS k FROM p)""",
)
def m14_all(spark, d):
    return tidy(insights.lift_support_frontier(_all(spark, d)[2]))


@query("f3_top_insights", measured_sql(ALL_SEGMENTS, 0.1, 1.001) + OUT + " ORDER BY i.rig DESC, feature, op, number, text LIMIT 7")
def f3(spark, d):
    return _shaped(ranking.top_insights(_all(spark, d)[2], "rig", 7, 0.1, 1.001))


@query(
    "f4_paginate",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0)
    + """SELECT feature, op, number, text, support_count, n AS row_number, (SELECT count(*) FROM i) AS total, (SELECT ceil(count(*) / 5)::INT FROM i) AS pages,
    (SELECT count(*) > 10 FROM i) AS has_next, true AS has_previous FROM (SELECT *, row_number() OVER (ORDER BY support_count DESC, feature, op, number, text) AS n FROM i)
    WHERE n > 5 AND n <= 10""",
)
def f4(spark, d):
    store = insights.InsightStore.build(_lines(spark, d), RETURNED, numbers=NUM, categories=CAT)
    page = ranking.paginate(store.rows, 2, 5, "support_count", "desc", ["feature", "op", "number", "text"])
    out = page.rows.select("feature", "op", "number", "text", "support_count", "row_number")
    facts = {"total": F.lit(page.total).cast("bigint"), "pages": F.lit(page.pages), "has_next": F.lit(page.has_next), "has_previous": F.lit(page.has_previous)}
    return out.withColumns(facts)


@query(
    "f5_select_by_importance",
    measured_sql(ALL_SEGMENTS, 0.001, 1.0) + "SELECT feature, round(max(rig), 6) AS importance FROM i GROUP BY 1 ORDER BY max(rig) DESC, feature LIMIT 3",
)
def f5(spark, d):
    best = _all(spark, d)[2].groupBy("feature").agg(F.max("rig").alias("importance"))
    return tidy(ranking.select_by_importance(best, top_k=3))
