"""Labels, as-of aggregates, feature synthesis, time-series features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import query, rounded, table, tidy
from gleaner.functions import labelers, rowwise
from gleaner.operators import labels, synthesis, tsfeatures, windows
from gleaner.operators.asof import asof_aggregate
from gleaner.operators.grouped import combine_per_group
from gleaner.types import add_features

WINDOW = labels.LabelWindow("user_id", "ts", "5 days", minimum_data="3 days")
OVERLAP = labels.LabelWindow("user_id", "ts", "6 days", step="2 days", gap="1 day", minimum_data="3 days", num_examples=8)
SPANS = "s AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1)"


def cut_sql(step: str, cap: int | None = None) -> str:
    limit = f" QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cutoff_time) <= {cap}" if cap else ""
    return f"""{SPANS}, c AS (SELECT * FROM (SELECT user_id, unnest(generate_series(f + INTERVAL 3 DAY, l, INTERVAL {step})) AS cutoff_time
    FROM s WHERE f + INTERVAL 3 DAY <= l){limit})"""


def label_sql(expressions: dict[str, str], step="5 DAY", window="5 DAY", gap="0 DAY", cap=None) -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in expressions.items())
    return f"""WITH {cut_sql(step, cap)} SELECT c.user_id, cutoff_time, {made} FROM c LEFT JOIN events e ON e.user_id = c.user_id
    AND e.ts >= cutoff_time + INTERVAL {gap} AND e.ts < cutoff_time + INTERVAL {gap} + INTERVAL {window} GROUP BY c.user_id, cutoff_time"""


@query("n1_cutoff_times", f"WITH {cut_sql('5 DAY')} SELECT * FROM c")
def n1(spark, d):
    return labels.cutoff_times(table(spark, d, "events"), WINDOW)


@query("n2_make_labels", label_sql({"event_count": "count(event_id)"}))
def n2(spark, d):
    return labels.make_labels(table(spark, d, "events"), WINDOW)


@query(
    "c8_interval_join",
    label_sql(
        {"event_count": "count(event_id)", "total_spend": "round(coalesce(sum(value), 0.0), 6)"}, "2 DAY", "6 DAY", "1 DAY", 8
    ),
)
def c8(spark, d):
    return tidy(labels.make_labels(table(spark, d, "events"), OVERLAP, [labelers.event_count(), labelers.total_spend("value")]))


@query(
    "n3_to_n8_labelers",
    label_sql(
        {
            "will_churn": "CASE WHEN count(event_id) <= 8 THEN 1 ELSE 0 END",
            "total_spend": "round(coalesce(sum(value), 0.0), 6)",
            "will_purchase": "CASE WHEN count(event_id) > 0 THEN 1 ELSE 0 END",
            "average_value": "round(coalesce(avg(value), 0.0), 6)",
            "event_count": "count(event_id)",
            "rich": "CASE WHEN coalesce(sum(value), 0) >= 500 THEN 1 ELSE 0 END",
            "peak": "CASE WHEN coalesce(max(value), 0) >= 95 THEN 1 ELSE 0 END",
        }
    ),
)
def n3(spark, d):
    wanted = [
        labelers.churn(8),
        labelers.total_spend("value"),
        labelers.will_purchase(),
        labelers.average_value("value"),
        labelers.event_count(),
        labelers.threshold("value", 500.0, "sum", "rich"),
        labelers.threshold("value", 95.0, "max", "peak"),
    ]
    return tidy(labels.make_labels(table(spark, d, "events"), WINDOW, wanted))


def _single_label(name: str, expression: str, labeler):
    """Register one labeler on its own."""

    @query(name, label_sql({"label": expression}))
    def run(spark, d):
        made = labels.make_labels(table(spark, d, "events"), WINDOW, [labeler()])
        return tidy(made.toDF("user_id", "cutoff_time", "label"))


# labelers are made when the query runs, as column expressions need a session
_single_label("n3_churn", "CASE WHEN count(event_id) <= 8 THEN 1 ELSE 0 END", lambda: labelers.churn(8))
_single_label("n4_total_spend", "round(coalesce(sum(value), 0.0), 6)", lambda: labelers.total_spend("value"))
_single_label("n5_will_purchase", "CASE WHEN count(event_id) > 0 THEN 1 ELSE 0 END", labelers.will_purchase)
_single_label("n6_average_value", "round(coalesce(avg(value), 0.0), 6)", lambda: labelers.average_value("value"))
_single_label("n7_event_count", "count(event_id)", labelers.event_count)
_single_label(
    "n8_threshold", "CASE WHEN coalesce(avg(value), 0) >= 50 THEN 1 ELSE 0 END", lambda: labelers.threshold("value", 50.0, "mean")
)


@query(
    "n9_label_distribution",
    f"""WITH y AS ({label_sql({"will_churn": "CASE WHEN count(event_id) <= 8 THEN 1 ELSE 0 END"})})
    SELECT will_churn AS label, count(*) AS n, (SELECT count(*) FROM y) AS n_labels, (SELECT count(DISTINCT cutoff_time) FROM y) AS n_cutoffs FROM y GROUP BY 1""",
)
def n9(spark, d):
    made = labels.make_labels(table(spark, d, "events"), WINDOW, [labelers.churn(8)])
    return labels.label_distribution(made, "will_churn")


TEMPLATE_BASE = """s AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1), c AS (SELECT user_id, unnest(generate_series(f + INTERVAL 7 DAY, l,
    INTERVAL {w} DAY)) AS cutoff_time FROM s WHERE f + INTERVAL 7 DAY <= l)"""


def _template(name, window, expr):
    return f"""(WITH {TEMPLATE_BASE.format(w=window)} SELECT '{name}' AS template, c.user_id, cutoff_time, CAST(round({expr}, 6) AS DOUBLE) AS label
    FROM c LEFT JOIN events e ON e.user_id = c.user_id AND ts >= cutoff_time AND ts < cutoff_time + INTERVAL {window} DAY GROUP BY ALL)"""


@query(
    "n10_templates",
    " UNION ALL ".join(
        [
            _template("churn", 30, "CASE WHEN count(event_id) <= 0 THEN 1 ELSE 0 END"),
            _template("next_purchase", 7, "CASE WHEN count(event_id) > 0 THEN 1 ELSE 0 END"),
            _template("ltv", 90, "coalesce(sum(value), 0)"),
            _template("event_frequency", 7, "count(event_id)"),
        ]
    ).replace("GROUP BY ALL", "GROUP BY c.user_id, cutoff_time"),
)
def n10(spark, d):
    events = table(spark, d, "events")
    templates = {
        "churn": labels.customer_churn("user_id", "ts"),
        "next_purchase": labels.next_purchase("user_id", "ts"),
        "ltv": labels.customer_value("user_id", "ts", "value"),
        "event_frequency": labels.event_frequency("user_id", "ts"),
    }
    out = None
    for name, (window, labeler) in templates.items():
        made = labels.make_labels(events, window, [labeler])
        part = made.select(
            F.lit(name).alias("template"), "user_id", "cutoff_time", F.col(labeler.name).cast("double").alias("label")
        )
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query("n11_custom_labeler", label_sql({"label": "round(max(value) - min(value), 6)"}))
def n11(spark, d):
    ends = lambda pdf: {"lo": pdf["value"].min(), "hi": pdf["value"].max()}
    spread = lambda parts: parts["hi"].max() - parts["lo"].min()
    return tidy(labels.make_labels_with(table(spark, d, "events"), WINDOW, ends, spread, ["lo", "hi"]))


@query(
    "t1_custom_labeler_combined",
    "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1",
)
def t1(spark, d):
    def partial(pdf):
        return pdf.groupby("user_id", as_index=False).agg(lo=("value", "min"), hi=("value", "max"))

    def finish(pdf):
        out = pdf.groupby("user_id", as_index=False).agg(lo=("lo", "min"), hi=("hi", "max"))
        return out.assign(spread=out["hi"] - out["lo"])[["user_id", "spread"]]

    events = table(spark, d, "events").select("user_id", "event_id", "value")
    out = combine_per_group(
        events, ["user_id"], partial, "user_id long, lo double, hi double", finish, "user_id long, spread double", limit=60, many=True
    )
    return tidy(out)


WANTED = [
    ("COUNT(events)", "count", "user_id"),
    *[(f"{p.upper()}(events.value)", p, "value") for p in ("mean", "sum", "min", "max", "std")],
    ("NUM_UNIQUE(events.event_type)", "num_unique", "event_type"),
]


def _sevenths(spark, d):
    """events with values that lie on no rounding edge."""
    return table(spark, d, "events").withColumn("value", F.col("value") / 7)


def asof_sql(cuts: str, window: str | None) -> str:
    late = f"AND e.ts > cutoff_time - INTERVAL {window}" if window else ""
    return f"""WITH {cuts} SELECT c.user_id, cutoff_time, count(event_id) AS "COUNT(events)", round(avg(value), 6) AS "MEAN(events.value)",
    round(sum(value), 6) AS "SUM(events.value)", round(min(value), 6) AS "MIN(events.value)", round(max(value), 6) AS "MAX(events.value)",
    round(stddev_samp(value), 6) AS "STD(events.value)", count(DISTINCT event_type) AS "NUM_UNIQUE(events.event_type)"
    FROM c LEFT JOIN (SELECT * REPLACE (value / 7 AS value) FROM events) e ON e.user_id = c.user_id AND e.ts <= cutoff_time {late} GROUP BY c.user_id, cutoff_time"""


@query("c7_asof_many_cutoffs", asof_sql(cut_sql("5 DAY"), None))
def c7(spark, d):
    events = _sevenths(spark, d)
    cuts = labels.cutoff_times(events, WINDOW)
    return tidy(asof_aggregate(events, "user_id", "ts", cuts, "user_id", "cutoff_time", WANTED))


@query("c7_asof_training_window", asof_sql(cut_sql("5 DAY"), "8 DAY"))
def c7_window(spark, d):
    events = _sevenths(spark, d)
    cuts = labels.cutoff_times(events, WINDOW)
    return tidy(asof_aggregate(events, "user_id", "ts", cuts, "user_id", "cutoff_time", WANTED, "8 days"))


@query("c7_asof_one_cutoff", asof_sql(f"{SPANS}, c AS (SELECT user_id, f + INTERVAL 10 DAY AS cutoff_time FROM s)", "4 DAY"))
def c7_one(spark, d):
    events = _sevenths(spark, d)
    cuts = events.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("cutoff_time"))
    return tidy(asof_aggregate(events, "user_id", "ts", cuts, "user_id", "cutoff_time", WANTED, "4 days"))


SINGLE_SQL = """SELECT o_orderkey, price, cust, price + cust AS "price + cust",
    price - cust AS "price - cust", price * cust AS "price * cust",
    price / cust AS "price / cust",
    (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2) / count(*) OVER () AS "PERCENTILE(price)",
    (rank() OVER (ORDER BY cust) + (count(*) OVER (PARTITION BY cust) - 1) / 2) / count(*) OVER () AS "PERCENTILE(cust)",
    sum(price) OVER w AS "CUM_SUM(price)", sum(cust) OVER w AS "CUM_SUM(cust)",
    avg(price) OVER w AS "CUM_MEAN(price)", avg(cust) OVER w AS "CUM_MEAN(cust)"
    FROM (SELECT o_orderkey, sqrt(o_totalprice) AS price, sqrt(o_custkey) AS cust FROM orders)
    WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"""


def _order_numbers(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.sqrt("o_totalprice").alias("price"), F.sqrt("o_custkey").alias("cust")
    )


# running sums and products are large, so they are compared to fewer digits
SINGLE_ROUNDED = r"""SELECT o_orderkey, round(COLUMNS('^CUM_SUM.*|.* \* .*'), 2), round(COLUMNS('^(price|cust|CUM_MEAN.*|PERCENTILE.*|.* [-+/] .*)$'), 6) FROM {source}"""


def _single_rounded(df):
    wide = lambda c: c.startswith("CUM_SUM") or " * " in c
    return df.select("o_orderkey", *[rounded(F.col(f"`{c}`"), 2 if wide(c) else 6).alias(c) for c in df.columns[1:]])


@query("o1_dfs_single", SINGLE_ROUNDED.format(source=f'({SINGLE_SQL})'))
def o1(spark, d):
    return _single_rounded(synthesis.dfs_single(_order_numbers(spark, d), "o_orderkey"))


@query("o7_quick_dfs", SINGLE_ROUNDED.format(source=f"({SINGLE_SQL})"))
def o7(spark, d):
    return _single_rounded(synthesis.quick_dfs(_order_numbers(spark, d), "o_orderkey"))


def _shop(spark, d):
    price = (F.col("o_totalprice") / 7).alias("o_totalprice")
    return synthesis.EntitySet(
        {
            "nation": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"),
            "region": table(spark, d, "region"),
            "customer": table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"),
            "orders": table(spark, d, "orders").withColumn("o_totalprice", price),
            "lineitem": table(spark, d, "lineitem").select("l_orderkey", "l_quantity"),
        },
        {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"},
        (
            synthesis.Relationship("nation", "n_nationkey", "customer", "c_nationkey"),
            synthesis.Relationship("region", "r_regionkey", "nation", "n_regionkey"),
            synthesis.Relationship("customer", "c_custkey", "orders", "o_custkey"),
            synthesis.Relationship("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ),
        {"orders": "o_orderdate"},
    )


def _aggs(expr: str, label: str, primitives="MEAN SUM MIN MAX STD") -> str:
    call = {"MEAN": "avg", "SUM": "sum", "MIN": "min", "MAX": "max", "STD": "stddev_samp"}
    return ", ".join(f'round({call[p]}({expr}), 4) AS "{p}({label})"' for p in primitives.split())


def shop_sql(orders: str = "orders", extra: str = "", lines: str = "lineitem") -> str:
    return f"""l AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS me, sum(l_quantity) AS su, min(l_quantity) AS mi, max(l_quantity) AS ma,
    stddev_samp(l_quantity) AS sd FROM {lines} GROUP BY 1), oo AS (SELECT o.*, coalesce(n, 0) AS n, me, su, mi, ma, sd FROM {orders} o LEFT JOIN l ON l_orderkey = o_orderkey),
    a AS (SELECT o_custkey, count(*) AS k, count(DISTINCT o_orderstatus) AS u1, count(DISTINCT o_orderpriority) AS u2,
    {_aggs("o_totalprice / 7", "orders.o_totalprice")}, {_aggs("n", "orders.COUNT(lineitem)")}, {_aggs("me", "orders.MEAN(lineitem.l_quantity)")},
    {_aggs("su", "orders.SUM(lineitem.l_quantity)")}, {_aggs("mi", "orders.MIN(lineitem.l_quantity)")}, {_aggs("ma", "orders.MAX(lineitem.l_quantity)")},
    {_aggs("sd", "orders.STD(lineitem.l_quantity)")} FROM oo GROUP BY 1)
    SELECT c_custkey, {extra} c_acctbal, coalesce(k, 0) AS "COUNT(orders)", coalesce(u1, 0) AS "NUM_UNIQUE(orders.o_orderstatus)",
    coalesce(u2, 0) AS "NUM_UNIQUE(orders.o_orderpriority)", a.* EXCLUDE (o_custkey, k, u1, u2)"""


DIRECT = """, n_name AS "nation.n_name", r_name AS "nation.region.r_name" FROM cust LEFT JOIN a ON o_custkey = c_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
SHOP_PLAN = synthesis.Synthesis("customer", transforms=())


def _close(df):
    """Sums and minima of counts come as whole numbers; compare them as such."""
    return tidy(df, 4)


def _whole(sql: str) -> str:
    out = sql
    for p in ("SUM", "MIN", "MAX"):
        call = {"SUM": "sum", "MIN": "min", "MAX": "max"}[p]
        out = out.replace(f'round({call}(n), 4) AS "{p}(orders.COUNT(lineitem))"', f'CAST({call}(n) AS BIGINT) AS "{p}(orders.COUNT(lineitem))"')
    return out


@query("o2_o3_o4_dfs_multi", _whole("WITH cust AS (SELECT * FROM customer), " + shop_sql() + DIRECT))
def o2(spark, d):
    return _close(synthesis.dfs_multi(_shop(spark, d), SHOP_PLAN))


CUT = """cust AS (SELECT * FROM customer JOIN (SELECT o_custkey AS ck, min(o_orderdate) + INTERVAL 900 DAY AS cutoff_time FROM orders GROUP BY 1) ON ck = c_custkey),
    seen AS (SELECT o.* FROM orders o JOIN cust ON o_custkey = c_custkey WHERE o_orderdate <= cutoff_time AND o_orderdate > cutoff_time - INTERVAL 700 DAY),
    parts AS (SELECT lineitem.* FROM lineitem JOIN seen ON l_orderkey = o_orderkey)"""


@query("o5_dfs_cutoff", _whole(f"WITH {CUT}, " + shop_sql("seen", "cutoff_time,", "parts") + DIRECT))
def o5(spark, d):
    es = _shop(spark, d)
    first = es.tables["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.min("o_orderdate") + F.expr("INTERVAL 900 DAY")).alias("cutoff_time")
    )
    plan = synthesis.Synthesis("customer", transforms=(), training_window="700 days")
    return _close(synthesis.dfs_multi(es, plan, first))


MANY_CUTS = """cust AS (SELECT c.*, f + to_days(CAST(days AS INTEGER)) AS cutoff_time FROM customer c JOIN (SELECT o_custkey AS ck, min(o_orderdate) AS f FROM orders GROUP BY 1) ON ck = c_custkey,
    (VALUES (300), (600), (900)) v(days) WHERE days = 900 OR c_custkey % 2 = 0),
    seen AS (SELECT o.* REPLACE (o_totalprice * 0.6180339887::DOUBLE AS o_totalprice), cutoff_time AS ct FROM orders o JOIN cust ON o_custkey = c_custkey WHERE o_orderdate <= cutoff_time AND o_orderdate > cutoff_time - INTERVAL 700 DAY),
    parts AS (SELECT * REPLACE (l_quantity * 0.6180339887::DOUBLE AS l_quantity) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM seen))"""


def _per_cutoff(sql: str) -> str:
    """The matrix with a row per customer and cutoff, and running totals along them."""
    sql = sql.replace("a AS (SELECT o_custkey, count(*) AS k", "a AS (SELECT o_custkey, ct, count(*) AS k").replace("FROM oo GROUP BY 1)", "FROM oo GROUP BY 1, 2)")
    sql = sql.replace("EXCLUDE (o_custkey, k, u1, u2)", "EXCLUDE (o_custkey, ct, k, u1, u2)").replace("a ON o_custkey = c_custkey", "a ON o_custkey = c_custkey AND ct = cutoff_time")
    return sql.replace(', n_name AS "nation.n_name"', ', round(sum(c_acctbal) OVER (ORDER BY c_custkey, cutoff_time ROWS UNBOUNDED PRECEDING), 2) AS "CUM_SUM(c_acctbal)", n_name AS "nation.n_name"')


@query("o5_dfs_many_cutoffs", _per_cutoff(_whole(f"WITH {MANY_CUTS}, " + shop_sql("seen", "cutoff_time,", "parts") + DIRECT)).replace(", 4) AS", ", 3) AS"))
def o5_many(spark, d):
    """One cutoff for customers with odd keys, three for the others; all features at each."""
    es = _shop(spark, d)
    es.tables["lineitem"] = es.tables["lineitem"].withColumn("l_quantity", F.col("l_quantity") * 0.6180339887)  # no ties in rounding
    es.tables["orders"] = es.tables["orders"].withColumn("o_totalprice", F.col("o_totalprice") * 0.6180339887)
    first = es.tables["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("f"))
    days = F.when(F.col("c_custkey") % 2 == 0, F.array(*map(F.lit, (300, 600, 900)))).otherwise(F.array(F.lit(900)))
    cuts = first.select("c_custkey", "f", F.explode(days).alias("n")).select("c_custkey", (F.col("f") + F.make_dt_interval(days=F.col("n"))).alias("cutoff_time"))
    plan = synthesis.Synthesis("customer", transforms=("cum_sum",), training_window="700 days")
    made = tidy(synthesis.dfs_multi(es, plan, cuts), 3)
    return made.withColumn("CUM_SUM(c_acctbal)", F.round("`CUM_SUM(c_acctbal)`", 2))


@query(
    "o2_dfs_multi_transforms",
    """SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, coalesce(n, 0) AS "COUNT(orders)", round(sum(c_acctbal) OVER w, 2) AS "CUM_SUM(c_acctbal)",
    round(avg(c_acctbal) OVER w / 7, 4) AS "CUM_MEAN(c_acctbal) / 7" FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
    WINDOW w AS (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)""",
)
def o2_transforms(spark, d):
    plan = synthesis.Synthesis("customer", aggregations=("count",), transforms=("cum_sum", "cum_mean"), max_depth=1)
    made = synthesis.dfs_multi(_shop(spark, d), plan).drop("nation.n_name")
    some = ["c_custkey", "c_acctbal", "`COUNT(orders)`", F.round("`CUM_SUM(c_acctbal)`", 2).alias("CUM_SUM(c_acctbal)")]
    return tidy(made.select(*some, (F.col("`CUM_MEAN(c_acctbal)`") / 7).alias("CUM_MEAN(c_acctbal) / 7")), 4)


def _whole_shop(spark, d):
    """Orders with all columns of their lines and customers."""
    tables = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")}
    lines = tables["lineitem"].withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return synthesis.EntitySet(
        tables | {"lineitem": lines},
        {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line"},
        (
            synthesis.Relationship("customer", "c_custkey", "orders", "o_custkey"),
            synthesis.Relationship("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ),
        {"orders": "o_orderdate"},
    )


STACKED = {
    "MEAN(lineitem.l_quantity)": "me",
    "SUM(lineitem.l_extendedprice * l_discount)": "cut",
    "STD(lineitem.l_discount + l_tax)": "sd",
    "NUM_UNIQUE(lineitem.l_linestatus)": "u",
    "customer.c_acctbal": "c_acctbal",
    "COUNT(lineitem) + MEAN(lineitem.l_quantity)": "n + me",
    "o_totalprice - customer.c_acctbal": "o_totalprice - c_acctbal",
    "MAX(lineitem.l_tax) * customer.c_acctbal": "mx * c_acctbal",
    "MEAN(lineitem.l_quantity) / SUM(lineitem.l_extendedprice)": "me / su",
}


@query(
    "o2_transforms_of_aggregates",
    f"""WITH l AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS me, sum(l_extendedprice * l_discount) AS cut, stddev_samp(l_discount + l_tax) AS sd,
    count(DISTINCT l_linestatus) AS u, max(l_tax) AS mx, sum(l_extendedprice) AS su FROM lineitem GROUP BY 1),
    j AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(u, 0) AS u, me, cut, sd, mx, su, c_acctbal FROM orders o LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, {", ".join(f'round({e}, 5) AS "{n}"' if n[:3] != "NUM" else f'{e} AS "{n}"' for n, e in STACKED.items())} FROM j""",
)
def o2_stacked(spark, d):
    """Sums of products of a child's columns, and sums, products and quotients of aggregates and parent columns."""
    plan = synthesis.Synthesis("orders", transforms=synthesis.PAIR_TRANSFORMS, names=tuple(STACKED))
    made = synthesis.dfs_multi(_whole_shop(spark, d), plan)
    return tidy(made.select("o_orderkey", *[F.col(f"`{n}`") for n in STACKED]), 5)


@query(
    "o6_reapply_features",
    """SELECT c_custkey, count(o_orderkey) AS "COUNT(orders)", round(avg(o_totalprice / 7), 4) AS "MEAN(orders.o_totalprice)" FROM customer
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY 1""",
)
def o6(spark, d):
    es = _shop(spark, d)
    matrix = synthesis.dfs_multi(es, SHOP_PLAN).select("c_custkey", "`COUNT(orders)`", "`MEAN(orders.o_totalprice)`")
    saved = synthesis.feature_names(matrix, SHOP_PLAN, es).to_json()
    finished = {**es.tables, "orders": es.tables["orders"].filter(F.col("o_orderstatus") == "F")}
    return _close(synthesis.reapply_features(saved, synthesis.EntitySet(finished, es.index, es.relationships, es.time)))


@query("c3_features_joined_back", """SELECT c_custkey, c_name, c_acctbal, round(m, 4) AS mean_price FROM customer
    LEFT JOIN (SELECT o_custkey, avg(o_totalprice / 7) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def c3(spark, d):
    customers = table(spark, d, "customer")
    plan = synthesis.Synthesis("customer", aggregations=("mean",), transforms=(), max_depth=1)
    matrix = synthesis.dfs_multi(_shop(spark, d), plan)
    joined = customers.join(matrix.select("c_custkey", F.col("`MEAN(orders.o_totalprice)`").alias("mean_price")), "c_custkey", "left")
    return tidy(joined.select("c_custkey", "c_name", "c_acctbal", "mean_price"), 4)


MINIMAL_SQL = """round(sum(value), 4) AS value__sum_values, round(quantile_cont(value, 0.5), 6) AS value__median, round(avg(value), 6) AS value__mean,
    count(value) AS value__length, round(stddev_pop(value), 6) AS value__standard_deviation, round(var_pop(value), 6) AS value__variance,
    round(sqrt(avg(value * value)), 6) AS value__root_mean_square, max(value) AS value__maximum, max(abs(value)) AS value__absolute_maximum, min(value) AS value__minimum"""


@query("p1_ts_features_minimal", f"SELECT user_id, {MINIMAL_SQL} FROM events GROUP BY 1")
def p1(spark, d):
    return tidy(tsfeatures.ts_features(table(spark, d, "events"), "user_id", "ts", ["value"]))


@query("c4_ts_features_joined", """SELECT event_id, round(avg(value) OVER w, 6) AS value__mean, max(value) OVER w AS value__maximum FROM events WINDOW w AS (PARTITION BY user_id)""")
def c4(spark, d):
    events = table(spark, d, "events")
    features = tsfeatures.ts_features(events, "user_id", "ts", ["value"], include={"mean", "maximum"})
    return tidy(events.join(features, "user_id", "left").select("event_id", "value__mean", "value__maximum"))


def _lagged(k):
    return f"lag(x, {k}) OVER w AS b{k}, lead(x, {k}) OVER w AS f{k}"


def _peak(s):
    return " AND ".join(f"x > b{k} AND x > f{k}" for k in range(1, s + 1))


EFFICIENT_SQL = f"""WITH v AS (SELECT user_id, event_id, ts, value AS x FROM events),
    g AS (SELECT user_id, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s, max(x) AS hi, min(x) AS lo FROM v GROUP BY 1),
    r AS (SELECT v.*, n, m, s, hi, lo, row_number() OVER w AS p, {", ".join(_lagged(k) for k in range(1, 6))} FROM v JOIN g USING (user_id)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    q AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, x > m ORDER BY p) AS run_a, p - row_number() OVER (PARTITION BY user_id, x < m ORDER BY p) AS run_b FROM r),
    sa AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, run_a, count(*) AS c FROM q WHERE x > m GROUP BY ALL) GROUP BY 1),
    sb AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, run_b, count(*) AS c FROM q WHERE x < m GROUP BY ALL) GROUP BY 1),
    z AS (SELECT user_id, {re.sub(r"\bvalue\b", "x", MINIMAL_SQL)}, round(sum(x * x), 4) AS value__abs_energy,
    round(sum(pow(x - m, 3)) / count(*) / pow(any_value(s), 3), 6) AS value__skewness, round(kurtosis_pop(x), 6) AS value__kurtosis,
    round(avg(abs(x - b1)), 6) AS value__mean_abs_change, round(sum(x - b1) / (count(*) - 1), 6) AS value__mean_change,
    round(sum(abs(x - b1)), 6) AS value__absolute_sum_of_changes, round(sqrt(sum(pow(x - b1, 2))), 6) AS value__cid_ce,
    count(*) FILTER (x > m) AS value__count_above_mean, count(*) FILTER (x < m) AS value__count_below_mean,
    round(min(CASE WHEN x = hi THEN (p - 1) / n END), 6) AS value__first_location_of_maximum, round(max(CASE WHEN x = hi THEN p / n END), 6) AS value__last_location_of_maximum,
    round(min(CASE WHEN x = lo THEN (p - 1) / n END), 6) AS value__first_location_of_minimum, round(max(CASE WHEN x = lo THEN p / n END), 6) AS value__last_location_of_minimum,
    round(regr_slope(x, p - 1), 6) AS value__linear_trend_slope, round(regr_intercept(x, p - 1), 6) AS value__linear_trend_intercept,
    round(corr(x, p - 1), 6) AS value__linear_trend_rvalue,
    {", ".join(f"round(count(*) FILTER (abs(x - m) > {k} * s) / count(*), 6) AS value__ratio_beyond_{k}_sigma" for k in (1, 2, 3))},
    {", ".join(f"round(sum((x - m) * (b{k} - m)) / ((count(*) - {k}) * any_value(s) * any_value(s)), 6) AS value__autocorrelation_lag_{k}" for k in (1, 2, 3))},
    {", ".join(f"count(*) FILTER ({_peak(k)}) AS value__number_peaks_{k}" for k in (1, 3, 5))},
    CAST(count(DISTINCT x) < count(*) AS INTEGER) AS value__has_duplicate,
    {", ".join(f'round(quantile_cont(x, {k}), 6) AS value__quantile_{round(100 * k)}' for k in (0.1, 0.25, 0.75, 0.9))} FROM r GROUP BY 1)
    SELECT z.*, coalesce(sa.c, 0) AS value__longest_strike_above_mean, coalesce(sb.c, 0) AS value__longest_strike_below_mean
    FROM z LEFT JOIN sa USING (user_id) LEFT JOIN sb USING (user_id)"""


@query("p2_ts_features_efficient", EFFICIENT_SQL)
def p2(spark, d):
    out = tsfeatures.ts_features(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["value"], "efficient")
    digits = {"value__sum_values": 4, "value__abs_energy": 4}
    doubles = {f.name for f in out.schema if f.dataType.typeName() == "double"}
    return out.select(*[rounded(F.col(f"`{c}`"), digits.get(c, 6)).alias(c) if c in doubles else F.col(f"`{c}`") for c in out.columns])


@query("p3_custom_ts_features", "SELECT user_id, round(max(value) - min(value), 6) AS spread, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
def p3(spark, d):
    def part(pdf):
        return {"lo": pdf["value"].min(), "hi": pdf["value"].max(), "n": float(len(pdf))}

    def whole(parts):
        return {"spread": parts["hi"].max() - parts["lo"].min(), "n": parts["n"].sum()}

    events = table(spark, d, "events").drop("props")
    return tidy(tsfeatures.ts_features_with(events, "user_id", part, whole, ["lo", "hi", "n"], ["spread", "n"]))


@query(
    "p4_impute_features",
    """WITH f AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'inf'::DOUBLE WHEN 'signup' THEN '-inf'::DOUBLE WHEN 'click' THEN NULL ELSE value END AS v FROM events),
    k AS (SELECT quantile_cont(v, 0.5) AS mid, min(v) AS lo, max(v) AS hi FROM f WHERE v IS NOT NULL AND NOT isinf(v))
    SELECT event_id, round(CASE WHEN v IS NULL THEN mid WHEN isinf(v) AND v > 0 THEN hi WHEN isinf(v) THEN lo ELSE v END, 6) AS v FROM f, k""",
)
def p4(spark, d):
    kind = F.col("event_type")
    v = F.when(kind == "error", float("inf")).when(kind == "signup", float("-inf")).when(kind == "click", None).otherwise(F.col("value"))
    return tidy(tsfeatures.impute_features(table(spark, d, "events").select("event_id", v.alias("v")), ["v"]))


@query("p5_select_relevant")
def p5(spark, d):
    documents = add_features(table(spark, d, "documents"), rowwise.string_stats(["text"]))
    marked = documents.withColumn("long", (F.col("n_chars") > 2000).cast("double"))
    kept = tsfeatures.select_relevant(marked, ["doc_id", "text_length", "text_word_count", "text_unique_chars"], "long")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query(
    "p6_native_basic",
    """SELECT user_id, round(avg(value), 6) AS value__mean, round(stddev_samp(value), 6) AS value__std, round(min(value), 6) AS value__min, round(max(value), 6) AS value__max,
    round(sum(value), 4) AS value__sum, count(value) AS value__count, round(max(value) - min(value), 6) AS value__range, round(arg_min(value, (ts, event_id)), 6) AS value__first,
    round(arg_max(value, (ts, event_id)), 6) AS value__last, round(var_samp(value), 6) AS value__variance, round(regr_slope(value, epoch_us(ts) / 1e6), 9) AS value__trend,
    round(quantile_cont(value, 0.5), 6) AS value__median FROM (SELECT * REPLACE (value / 7 AS value) FROM events) GROUP BY 1""",
)
def p6(spark, d):
    out = windows.entity_profile(_sevenths(spark, d), "user_id", ["ts", "event_id"], ["value"])
    digits = {"value__sum": 4, "value__trend": 9}
    return out.select(
        "user_id", *[F.round(c, digits.get(c, 6)).alias(c) if c != "value__count" else F.col(c) for c in out.columns[1:]]
    )
