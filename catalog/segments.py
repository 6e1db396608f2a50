"""Segment analysis between two sets of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.operators import segments

BASE = "o_orderdate < TIMESTAMP '1996-01-01'"
COMP = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW'"
DIMENSIONS = ["o_orderpriority", "o_orderstatus"]


def _before():
    return F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")


def _after():
    return ~_before() & (F.col("o_orderpriority") != "5-LOW")


def _set_sql(dimensions: list[str]) -> str:
    label = " || '<seg>' || ".join(f"'{d}:' || {d}" for d in dimensions)
    return f"""SELECT {label} AS segment, avg(o_totalprice) FILTER ({BASE}) AS price_baseline, nullif(count(*) FILTER ({BASE}), 0) AS size_baseline,
    avg(o_totalprice) FILTER ({COMP}) AS price_comparison, nullif(count(*) FILTER ({COMP}), 0) AS size_comparison FROM orders
    WHERE ({BASE}) OR ({COMP}) GROUP BY {", ".join(dimensions)}"""


SEGMENTS = " UNION ALL ".join(map(_set_sql, [["o_orderpriority"], ["o_orderstatus"], DIMENSIONS]))
OVERALL = f"""SELECT avg(o_totalprice) FILTER ({BASE}) AS price_baseline, count(*) FILTER ({BASE}) AS size_baseline,
    avg(o_totalprice) FILTER ({COMP}) AS price_comparison, count(*) FILTER ({COMP}) AS size_comparison FROM orders"""
METRIC = segments.mean_metric("o_totalprice")


@query("r1_overall_metrics", f"SELECT round(price_baseline, 4) AS price_baseline, size_baseline, round(price_comparison, 4) AS price_comparison, size_comparison FROM ({OVERALL})")
def r1(spark, d):
    return tidy(segments.overall_metrics(table(spark, d, "orders"), METRIC, "price", _before(), _after()), 4)


@query("r2_segment_metrics", f"SELECT segment, round(price_baseline, 4) AS price_baseline, size_baseline, round(price_comparison, 4) AS price_comparison, size_comparison FROM ({SEGMENTS})")
def r2(spark, d):
    return tidy(segments.segment_metrics(table(spark, d, "orders"), METRIC, "price", DIMENSIONS, _before(), _after(), 2), 4)


@query(
    "c5_r3_segment_frame",
    f"SELECT segment, round(price_baseline, 4) AS price_baseline, size_baseline, round(price_comparison, 4) AS price_comparison, size_comparison FROM ({_set_sql(['o_orderpriority'])})",
)
def c5(spark, d):
    orders = table(spark, d, "orders")
    base = segments.segment_metrics(orders, METRIC, "price", ["o_orderpriority"], _before())
    late = segments.segment_metrics(orders, METRIC, "price", ["o_orderpriority"], _after())
    renamed = late.toDF("segment", "price_comparison", "size_comparison")
    return tidy(segments.merge_segments(base, renamed), 4)


IMPACT = f"""WITH s AS ({SEGMENTS}), o AS (SELECT price_baseline AS pb, size_baseline AS sb, price_comparison AS pc, size_comparison AS sc FROM ({OVERALL})),
    x AS (SELECT *, price_baseline / pb AS value_pct_baseline, size_baseline / sb AS size_pct_baseline, price_comparison / pc AS value_pct_comparison,
    size_comparison / sc AS size_pct_comparison, price_comparison / price_baseline - 1 AS price_change, size_comparison / size_baseline - 1 AS size_change FROM s, o)"""


@query(
    "r4_segment_shares",
    IMPACT
    + """SELECT segment, round(value_pct_baseline, 6) AS value_pct_baseline, round(size_pct_baseline, 6) AS size_pct_baseline, round(value_pct_comparison, 6) AS value_pct_comparison,
    round(size_pct_comparison, 6) AS size_pct_comparison, round(price_change, 6) AS price_change, round(size_change, 6) AS size_change FROM x""",
)
def r4(spark, d):
    out = segments.analyze_segments(table(spark, d, "orders"), METRIC, "price", DIMENSIONS, _before(), _after(), 2)
    sides = [f"{m}_pct_{s}" for m in ("value", "size") for s in ("baseline", "comparison")]
    return tidy(out.select("segment", *sides, "price_change", "size_change"))


@query(
    "r5_impact",
    IMPACT + """SELECT segment, round((price_comparison - price_baseline) / (pc - pb) * size_pct_baseline, 6) AS impact,
    round(abs((price_comparison - price_baseline) / (pc - pb) * size_pct_baseline), 6) AS abs_impact FROM x""",
)
def r5(spark, d):
    out = segments.analyze_segments(table(spark, d, "orders"), METRIC, "price", DIMENSIONS, _before(), _after(), 2)
    return tidy(out.select("segment", "impact", "abs_impact"))
