"""Quality reports, profiles and time-series detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.operators import profile, quality, temporal
from gleaner.plans.tables import with_facts
from gleaner.types import REGRESSION, Problem

ORDER_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]

# orders with a column mostly null, one partly null, one partly empty and one constant
DIRTY = """(SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus, CASE WHEN o_orderpriority < '4' THEN o_totalprice END AS o_totalprice,
    o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' THEN '' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    'same' AS fixed, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 1e9 ELSE 1.0 END AS spike FROM orders)"""
DIRTY_ALL = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "fixed", "spike"]
DIRTY_NUM = ["o_orderkey", "o_totalprice", "spike"]
DIRTY_TEXT = ["o_orderstatus", "o_orderpriority", "fixed"]


def dirty(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"),
        F.when(p < "4", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(p == "1-URGENT", "").when(p != "5-LOW", p).alias("o_orderpriority"),
        F.lit("same").alias("fixed"),
        F.when((p == "1-URGENT") & (F.col("o_orderstatus") == "P"), 1e9).otherwise(1.0).alias("spike"),
    )


def _skew(c: str) -> str:
    """Population skewness from central moments."""
    return f"""(SELECT sum(pow(x - m, 3)) / count(x) / pow(sum(pow(x - m, 2)) / count(x), 1.5)
    FROM (SELECT CAST({c} AS DOUBLE) AS x, avg({c}) OVER () AS m FROM t WHERE {c} IS NOT NULL))"""


def _missing(columns, texts):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
        {f"count(*) FILTER ({c} = '')" if c in texts else "CAST(0 AS BIGINT)"} AS empty_count, count(*) AS n FROM t"""
        for c in columns
    )


MISSING = f"""m AS (SELECT "column", null_count, empty_count, null_count + empty_count AS total_missing,
    (null_count + empty_count) / n * 100 AS missing_pct FROM ({_missing(DIRTY_ALL, DIRTY_TEXT)}))"""


@query(
    "k1_missing_report",
    f'WITH t AS {DIRTY}, {MISSING} SELECT "column", null_count, empty_count, total_missing, round(missing_pct, 6) AS missing_pct FROM m',
)
def k1(spark, d):
    return tidy(quality.missing_report(dirty(spark, d)))


@query(
    "k2_numeric_stats",
    "WITH t AS (SELECT * REPLACE (nullif(l_linenumber, 3) AS l_linenumber) FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS distinct_count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        CAST(quantile_disc({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median,
        CAST(quantile_disc({c}, 0.75) AS DOUBLE) AS q3, round(CAST(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25) AS DOUBLE), 4) AS iqr,
        round({_skew(c)}, 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis FROM t"""
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    ),
)
def k2(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(3)))
    return tidy(quality.numeric_stats(df, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]), 4)


@query(
    "k3_text_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count, CAST(min(length({c})) AS INTEGER) AS min_length,
        CAST(max(length({c})) AS INTEGER) AS max_length, round(avg(length({c})), 6) AS avg_length,
        round(count(DISTINCT {c}) / count(*), 6) AS cardinality_ratio FROM documents"""
        for c in ["text", "lang", "source"]
    ),
)
def k3(spark, d):
    return tidy(quality.text_stats(table(spark, d, "documents")))


@query(
    "k4_date_stats",
    """SELECT 'l_shipdate' AS "column", CAST(min(l_shipdate) AS TIMESTAMP) AS min_date, CAST(max(l_shipdate) AS TIMESTAMP) AS max_date FROM lineitem""",
)
def k4(spark, d):
    return quality.date_stats(table(spark, d, "lineitem"))


def _outliers(method, low, high, source="orders", columns=ORDER_NUM):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{method}' AS method, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
        count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count, round(count(*) FILTER ({c} < lo OR {c} > hi) / count(*) * 100, 4) AS outlier_pct
        FROM {source}, (SELECT {low.format(c=c)} AS lo, {high.format(c=c)} AS hi FROM {source}) GROUP BY lo, hi"""
        for c in columns
    )


Q1, Q3 = "CAST(quantile_disc({c}, 0.25) AS DOUBLE)", "CAST(quantile_disc({c}, 0.75) AS DOUBLE)"


@query("k5_outlier_report_iqr", _outliers("iqr", f"{Q1} - 0.3 * ({Q3} - {Q1})", f"{Q3} + 0.3 * ({Q3} - {Q1})"))
def k5(spark, d):
    return tidy(quality.outlier_report(table(spark, d, "orders"), "iqr", 0.3), 4)


@query("k5_outlier_report_zscore", _outliers("zscore", "avg({c}) - 1.5 * stddev_samp({c})", "avg({c}) + 1.5 * stddev_samp({c})"))
def k5_z(spark, d):
    return tidy(quality.outlier_report(table(spark, d, "orders"), "zscore", 1.5), 4)


@query(
    "k6_cardinality_report",
    """WITH c AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM part GROUP BY {c}" for c in ["p_brand", "p_type", "p_name"])
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS k FROM c)
    SELECT col AS "column", count(*) AS distinct_count, round(count(*) / sum(n), 6) AS cardinality_ratio, count(*) > 50 AS is_high_cardinality,
    count(*) / sum(n) > 0.9 AS is_potential_id, string_agg(value || '=' || n, ';' ORDER BY k) FILTER (k <= 10) AS top FROM r GROUP BY col""",
)
def k6(spark, d):
    out = quality.cardinality_report(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])
    pairs = F.transform("top_categories", lambda e: F.concat(e["value"], F.lit("="), e["count"].cast("string")))
    return tidy(out.withColumn("top", F.array_join(pairs, ";")).drop("top_categories"))


COLUMNS = f"""{MISSING}, s AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS dc, "
    f"{_skew(c) if c in DIRTY_NUM else 'CAST(NULL AS DOUBLE)'} AS sk, "
    f"{'(count(DISTINCT ' + c + ') + max((' + c + ' IS NULL)::INT)) / count(*)' if c in DIRTY_TEXT else '0.0'} AS ratio, "
    f"{'true' if c in DIRTY_NUM else 'false'} AS num FROM t"
    for c in DIRTY_ALL
)}), r AS (SELECT * FROM m JOIN s ON m."column" = s.col)"""


@query(
    "k7_quality_score",
    f"""WITH t AS {DIRTY}, {COLUMNS} SELECT round(greatest(0.0, 100.0 - sum(CASE WHEN missing_pct > 50 THEN 5 WHEN missing_pct > 20 THEN 3
    WHEN missing_pct > 5 THEN 1 ELSE 0 END + CASE WHEN dc = 1 THEN 2 ELSE 0 END)), 1)::DOUBLE AS quality_score, CAST(0 AS BIGINT) AS duplicate_count FROM r""",
)
def k7(spark, d):
    return quality.quality_score(dirty(spark, d))


@query(
    "k7_quality_score_duplicates",
    """WITH t AS (SELECT l_returnflag, l_linestatus FROM lineitem)
    SELECT CAST(100 - CASE WHEN p > 20 THEN 10 WHEN p > 5 THEN 5 ELSE 0 END AS DOUBLE) AS quality_score, dup AS duplicate_count
    FROM (SELECT n - k AS dup, (n - k) / n * 100 AS p FROM (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS k))""",
)
def k7_dup(spark, d):
    return quality.quality_score(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


@query(
    "k8_quality_issues",
    f"""WITH t AS {DIRTY}, {COLUMNS}
    SELECT "column", printf('mostly_null: %.1f%%', missing_pct) AS issue, 'high' AS severity FROM r WHERE missing_pct > 50
    UNION ALL SELECT "column", printf('often_null: %.1f%%', missing_pct), 'medium' FROM r WHERE missing_pct > 20 AND missing_pct <= 50
    UNION ALL SELECT "column", 'single_value', 'high' FROM r WHERE dc = 1
    UNION ALL SELECT "column", printf('long_tail: skewness %.2f', sk), 'low' FROM r WHERE abs(sk) > 3
    UNION ALL SELECT "column", 'nearly_unique', 'low' FROM r WHERE ratio > 0.95""",
)
def k8(spark, d):
    return quality.quality_issues(dirty(spark, d))


@query(
    "k9_quality_recommendations",
    f"""WITH t AS {DIRTY}, {COLUMNS}
    SELECT "column", printf('leave_out: null in %.1f%%', missing_pct) AS action, 'high' AS priority FROM r WHERE missing_pct > 50
    UNION ALL SELECT "column", printf('fit_impute ' || CASE WHEN num THEN 'median' ELSE 'mode' END || ': null in %.1f%%', missing_pct), 'medium'
    FROM r WHERE missing_pct > 5 AND missing_pct <= 50
    UNION ALL SELECT "column", 'transforms log', 'low' FROM r WHERE abs(sk) > 2
    UNION ALL SELECT "column", 'leave_out: carries nothing', 'high' FROM r WHERE dc = 1""",
)
def k9(spark, d):
    return quality.quality_recommendations(dirty(spark, d))


@query(
    "k10_profile_summary",
    f"""WITH t AS {DIRTY} SELECT count(*) AS n, 7 AS n_var, CAST(sum({" + ".join(f"({c} IS NULL)::INT" for c in DIRTY_ALL)}) AS BIGINT) AS n_cells_missing,
    round(sum({" + ".join(f"({c} IS NULL)::INT" for c in DIRTY_ALL)}) / (count(*) * 7) * 100, 6) AS p_cells_missing,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n_duplicates, CAST(0 AS DOUBLE) AS p_duplicates,
    3 AS n_categorical, 3 AS n_numerical, 0 AS n_boolean, 1 AS n_datetime FROM t""",
)
def k10(spark, d):
    return tidy(profile.profile_summary(dirty(spark, d)))


def _variable(c):
    num = c in DIRTY_NUM
    kind = "Numeric" if num else ("DateTime" if c == "o_orderdate" else "Categorical")
    stat = lambda e: e if num else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*) * 100 AS p_missing,
        count(DISTINCT {c}) AS n_distinct, (SELECT count(*) FROM (SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) = 1)) AS n_unique,
        (SELECT count(*) FROM (SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) = 1)) = count(*) AS is_unique,
        {stat(f"avg({c})")} AS mean, {stat(f"stddev_samp({c})")} AS std, {stat(f"CAST(min({c}) AS DOUBLE)")} AS min,
        {stat(f"CAST(max({c}) AS DOUBLE)")} AS max, {stat(f"CAST(quantile_cont({c}, 0.5) AS DOUBLE)")} AS median,
        {stat(_skew(c))} AS skewness, {f"count(*) FILTER ({c} = 0)" if num else "CAST(0 AS BIGINT)"} AS n_zeros, count(*) AS n FROM t"""


VARIABLES = f"v AS ({' UNION ALL '.join(_variable(c) for c in DIRTY_ALL)})"


@query(
    "k11_profile_variables",
    f"""WITH t AS {DIRTY}, {VARIABLES} SELECT "column", type, n_missing, round(p_missing, 4) AS p_missing, n_distinct, n_unique, is_unique,
    round(mean, 4) AS mean, round(std, 4) AS std, min, max, round(median, 4) AS median, round(skewness, 4) AS skewness, n_zeros, n FROM v""",
)
def k11(spark, d):
    return tidy(profile.profile_variables(dirty(spark, d)), 4)


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR_PAIRS = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1 :]]


@query(
    "k12_correlations",
    "WITH r AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in CORR_COLUMNS)
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM {s}"
        for m, s in [("pearson", "lineitem"), ("spearman", "r")]
        for a, b in CORR_PAIRS
    ),
)
def k12(spark, d):
    return tidy(profile.correlations(table(spark, d, "lineitem"), CORR_COLUMNS))


@query(
    "k13_profile_alerts",
    f"""WITH t AS {DIRTY}, {VARIABLES}
    SELECT "column", 'CONSTANT' AS alert FROM v WHERE n_distinct = 1 UNION ALL SELECT "column", 'UNIQUE' FROM v WHERE is_unique
    UNION ALL SELECT "column", 'MISSING' FROM v WHERE n_missing / n > 0.05 UNION ALL SELECT "column", 'SKEWED' FROM v WHERE abs(skewness) > 20
    UNION ALL SELECT "column", 'ZEROS' FROM v WHERE n_zeros / n > 0.1
    UNION ALL SELECT "column", 'HIGH_CARDINALITY' FROM v WHERE type = 'Categorical' AND n_distinct > 50
    UNION ALL SELECT unnest([a, b]), 'HIGH_CORRELATION' FROM (SELECT 'o_orderkey' AS a, 'o_totalprice' AS b, corr(o_orderkey, o_totalprice) AS r FROM t
    UNION ALL SELECT 'o_orderkey', 'spike', corr(o_orderkey, spike) FROM t UNION ALL SELECT 'o_totalprice', 'spike', corr(o_totalprice, spike) FROM t) WHERE abs(r) > 0.9""",
)
def k13(spark, d):
    return profile.profile_alerts(dirty(spark, d))


@query(
    "k14_profile_recommendations",
    f"""WITH t AS {DIRTY}, {VARIABLES}, a AS (
    SELECT "column", printf('often_null: %.1f%%', p_missing) AS issue, 'leave_out or fit_impute' AS action,
    CASE WHEN p_missing > 50 THEN 'high' ELSE 'medium' END AS priority FROM v WHERE p_missing > 30
    UNION ALL SELECT "column", printf('some_null: %.1f%%', p_missing), 'fit_impute', 'low'
    FROM v WHERE p_missing > 5 AND p_missing <= 30
    UNION ALL SELECT "column", printf('many_values: %d', n_distinct), 'group_rare or target_encode', 'medium'
    FROM v WHERE type = 'Categorical' AND n_distinct > 50
    UNION ALL SELECT "column", 'single_value', 'leave_out', 'high' FROM v WHERE NOT is_unique AND n_distinct = 1
    UNION ALL SELECT "column", printf('long_tail: skewness %.2f', skewness), 'transforms log', 'medium'
    FROM v WHERE abs(skewness) > 2)
    SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM a""",
)
def k14(spark, d):
    return profile.profile_recommendations(dirty(spark, d))


@query("k15_profile_sample", "SELECT false AS sampled, count(*) AS original_rows, count(*) AS profiled_rows, CAST(1.0 AS DOUBLE) AS sample_ratio FROM lineitem")
def k15(spark, d):
    return profile.profile_sample(table(spark, d, "lineitem"))[1]


LARGE_SAMPLE = """SELECT n > 1000000 AS sampled, n AS original_rows, least(n, 1000000) AS profiled_rows, CAST(least(n, 1000000) / n AS DOUBLE) AS sample_ratio
    FROM (SELECT count(*) AS n FROM lineitem)"""


@query("k15_profile_sample_of_a_million", LARGE_SAMPLE)
def k15_large(spark, d):
    """Asking for a million rows profiles as many, or all there are."""
    return profile.profile_sample(table(spark, d, "lineitem"), 1_000_000)[1]


@query("k15_sample_is_taken", "SELECT true AS sampled, count(*) AS original_rows, true AS near, true AS ratio_agrees FROM lineitem")
def k15_sampled(spark, d):
    rows, info = profile.profile_sample(table(spark, d, "lineitem"), 3000)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.col("profiled_rows") - 3000) < 300
    agrees = (F.col("n") == F.col("profiled_rows")) & (F.abs(F.col("sample_ratio") * F.col("original_rows") - F.col("n")) < 0.01)
    return with_facts(info, n).select("sampled", "original_rows", near.alias("near"), agrees.alias("ratio_agrees"))


@query(
    "k16_value_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT 'l_extendedprice' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 10, 4) AS low, round(lo + (i + 1) * (hi - lo) / 10, 4) AS high,
    coalesce(n, 0) AS n FROM range(10) r(i) CROSS JOIN e LEFT JOIN c ON bin = i""",
)
def k16(spark, d):
    return tidy(profile.numeric_histogram(table(spark, d, "lineitem"), ["l_extendedprice"]), 4)


@query("k16_category_histogram", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def k16_category(spark, d):
    return profile.category_histogram(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "l1_primary_time_column",
    """SELECT 'ts' AS "column", round(5 * count(DISTINCT ts) / count(*), 6) AS score FROM events
    UNION ALL SELECT 'created', round(10 + 5 * count(DISTINCT date_trunc('day', ts)) / count(*), 6) FROM events""",
)
def l1(spark, d):
    df = table(spark, d, "events").withColumn("created", F.to_date("ts"))
    return tidy(temporal.time_column_scores(df))


@query(
    "l2_entity_columns",
    """SELECT * FROM (SELECT 'user_id' AS "column", round(count(DISTINCT user_id) / count(*), 6) AS cardinality_ratio FROM events
    UNION ALL SELECT 'event_id', round(count(DISTINCT event_id) / count(*), 6) FROM events) WHERE cardinality_ratio > 0.0001 AND cardinality_ratio < 0.5""",
)
def l2(spark, d):
    return tidy(temporal.entity_columns(table(spark, d, "events"), "ts"))


PROFILE = """p AS (SELECT min(ts) AS min_date, max(ts) AS max_date, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400 AS date_range_days,
    count(ts) AS total_records, count(DISTINCT ts) AS unique_time_points, count(*) - count(ts) AS null_times, count(*) AS n_rows,
    any_value(a) AS avg_records_per_entity, any_value(b) AS min_records_per_entity, any_value(c) AS max_records_per_entity,
    any_value(s) AS stddev_records_per_entity FROM t, (SELECT avg(n) a, min(n) b, max(n) c, stddev_samp(n) s
    FROM (SELECT count(*) AS n FROM t GROUP BY user_id)))"""
NULL_TIMES = "t AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts FROM events)"


def _null_times(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").withColumn("ts", F.when(kind != "error", F.col("ts")))


@query(
    "l3_temporal_profile",
    f"""WITH {NULL_TIMES}, {PROFILE} SELECT min_date, max_date, round(date_range_days, 6) AS date_range_days, total_records, unique_time_points,
    null_times, n_rows, round(avg_records_per_entity, 6) AS avg_records_per_entity, min_records_per_entity, max_records_per_entity,
    round(stddev_records_per_entity, 6) AS stddev_records_per_entity, stddev_records_per_entity / avg_records_per_entity < 0.3 AS has_regular_intervals FROM p""",
)
def l3(spark, d):
    return tidy(temporal.temporal_profile(_null_times(spark, d), "ts", ["user_id"]))


def _frequency_sql(source, time):
    return f"""SELECT '{source}' AS source, CASE WHEN g IS NULL OR span = 0 THEN 'unknown' WHEN g < 0.001 THEN 'seconds' WHEN g < 0.05 THEN 'minutes'
    WHEN g < 0.5 THEN 'hourly' WHEN g < 3 THEN 'daily' WHEN g < 14 THEN 'weekly' WHEN g < 45 THEN 'monthly' WHEN g < 120 THEN 'quarterly'
    WHEN g < 400 THEN 'yearly' ELSE 'irregular' END AS frequency, n / points >= 3 AND points > 1 AS is_time_series
    FROM (SELECT span, span / points AS g, points, n FROM (SELECT (epoch_us(max({time})) - epoch_us(min({time}))) / 1e6 / 86400 AS span,
    count(DISTINCT {time}) AS points, count(*) AS n FROM {source}))"""


@query("l4_l5_frequency", " UNION ALL ".join(_frequency_sql(s, t) for s, t in [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]))
def l4(spark, d):
    parts = []
    for source, time in [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]:
        p = temporal.temporal_profile(table(spark, d, source), time)
        parts.append(
            p.select(
                F.lit(source).alias("source"),
                temporal.frequency().alias("frequency"),
                temporal.is_time_series(False).alias("is_time_series"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "l6_recommend_features",
    """SELECT CAST(i AS INTEGER) AS position, f AS feature FROM (VALUES (0, 'datetime_parts'), (1, 'cyclical'), (2, 'lag_features 7'),
    (3, 'rolling_features 7'), (4, 'datetime_parts dayofyear'), (5, 'datetime_parts dayofweek'), (6, CASE WHEN (SELECT avg(n) FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) >= 10 THEN 'ts_features efficient' ELSE 'ts_features minimal' END), (7, 'diff_features')) v(i, f)""",
)
def l6(spark, d):
    p = temporal.temporal_profile(table(spark, d, "orders"), "o_orderdate", ["o_custkey"])
    return temporal.recommended_features(p, True)


@query(
    "l7_time_quality",
    f"""WITH {NULL_TIMES}, {PROFILE} SELECT 'null_times' AS warning FROM p WHERE null_times > 0
    UNION ALL SELECT 'low_time_uniqueness' FROM p WHERE unique_time_points / total_records < 0.5
    UNION ALL SELECT 'sparse' FROM p WHERE date_range_days > 30 AND total_records / date_range_days < 0.1""",
)
def l7(spark, d):
    return temporal.time_quality(temporal.temporal_profile(_null_times(spark, d), "ts", ["user_id"]))


@query("l5_is_time_series", """SELECT avg(n) >= 3 AS is_time_series FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""")
def l5(spark, d):
    p = temporal.temporal_profile(table(spark, d, "events"), "ts", ["user_id"])
    return p.select(temporal.is_time_series(True).alias("is_time_series"))


@query(
    "k17_validate_target",
    """SELECT 'o_orderstatus' AS target, 'classification' AS kind, CASE WHEN count(DISTINCT o_orderstatus) BETWEEN 2 AND 10 THEN 0 ELSE 1 END AS problems FROM orders
    UNION ALL SELECT 'o_custkey', 'classification', CASE WHEN count(DISTINCT o_custkey) BETWEEN 2 AND 10 THEN 0 ELSE 1 END FROM orders
    UNION ALL SELECT 'o_totalprice', 'regression', 0 UNION ALL SELECT 'o_orderpriority', 'regression', 1""",
)
def k17(spark, d):
    orders = table(spark, d, "orders")
    asked = [
        Problem("o_orderstatus"),
        Problem("o_custkey"),
        Problem("o_totalprice", REGRESSION),
        Problem("o_orderpriority", REGRESSION, None, "o_orderdate"),
    ]
    rows = [(p.target, p.kind, len(profile.validate_target(orders, p))) for p in asked]
    return spark.createDataFrame(rows, "target string, kind string, problems int")
