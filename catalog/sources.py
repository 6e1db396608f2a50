"""Sources, samples, names, filters and predicates."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import query, table
from gleaner.functions.predicates import (
    EMPTY,
    EQ,
    GEQ,
    GRT,
    LEQ,
    LIKE,
    LWT,
    NEQ,
    NON_EMPTY,
    Condition,
    Filter,
    all_of,
    date_between,
    is_above,
    is_class,
)
from gleaner.operators import encode
from gleaner.operators.aggregates import select_by_cardinality
from gleaner.plans.quantiles import LINEAR, quantiles
from gleaner.plans.tables import shared_folder, with_facts
from gleaner.sources import models, tables
from gleaner.types import CATEGORICAL, DATETIME, NUMERICAL, columns_of


@query(
    "a2_sanitize_names",
    'SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS "region_key" FROM nation',
)
def a2(spark, d):
    raw = table(spark, d, "nation").toDF("nation.key", "nation name", "region.key")
    return tables.sanitize_names(raw)


@query("a3_cap_rows", "SELECT 1000 AS n_rows, (SELECT count(*) FROM lineitem) > 1000 AS truncated")
def a3(spark, d):
    rows, truncated = tables.cap_rows(table(spark, d, "lineitem"), 1000)
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("truncated", F.lit(truncated))


@query(
    "a4_dataset_info",
    """SELECT position, "column", dtype, (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns FROM (VALUES
    (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
    (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'))
    AS t(position, "column", dtype)""",
)
def a4(spark, d):
    return tables.dataset_info(table(spark, d, "orders"))


@query(
    "a5_auto_cast_timestamp",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders",
)
def a5(spark, d):
    orders = table(spark, d, "orders")
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("at"))
    cast = tables.auto_cast_timestamp(text, "at")
    return cast.select("o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("a9_bounded_sample")
def a9(spark, d):
    return tables.bounded_sample(table(spark, d, "lineitem"), 5000)


@query("a10_table_size")
def a10(spark, d):
    size = tables.table_size(table(spark, d, "documents"))
    row = (size.rows, size.mean_row_bytes, size.total_bytes, size.fits, size.suggested_rows)
    return spark.createDataFrame([row], "n_rows bigint, mean_row_bytes double, total_bytes double, fits boolean, suggested_rows bigint")


@query("a11_split_by_key", "SELECT count(*) AS n_rows, 0 AS in_both FROM lineitem")
def a11(spark, d):
    train, test = tables.split_by_key(table(spark, d, "lineitem"), ["l_orderkey"])
    both = train.select("l_orderkey").distinct().join(test.select("l_orderkey").distinct(), "l_orderkey")
    whole = train.unionByName(test).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_facts(whole, both.agg(F.count(F.lit(1)).alias("in_both")))


@query("a11_split")
def a11_random(spark, d):
    train, test = tables.split(table(spark, d, "orders"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("b1_select_by_role_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def b1_numeric(spark, d):
    df = table(spark, d, "lineitem")
    return df.select(*columns_of(df, NUMERICAL))


@query("b1_select_by_role_other", "SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def b1_other(spark, d):
    df = table(spark, d, "lineitem")
    return df.select(*columns_of(df, CATEGORICAL), *columns_of(df, DATETIME))


@query(
    "b2_build_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A')
    AND l_linestatus NOT IN ('O') AND l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02
    AND l_tax < 0.07 AND l_returnflag LIKE 'R%' AND l_linestatus IS NOT NULL AND l_linestatus <> ''""",
)
def b2(spark, d):
    filters = [
        Filter("l_returnflag", EQ, ("R", "A")),
        Filter("l_linestatus", NEQ, ("O",)),
        Filter("l_quantity", GRT, (10,)),
        Filter("l_quantity", LEQ, (40,)),
        Filter("l_discount", GEQ, (0.02,)),
        Filter("l_tax", LWT, (0.07,)),
        Filter("l_returnflag", LIKE, ("R%",)),
        Filter("l_linestatus", NON_EMPTY),
    ]
    return table(spark, d, "lineitem").filter(all_of(filters)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("b2_build_filter_empty", "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NULL OR event_type = ''")
def b2_empty(spark, d):
    df = table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("click")))
    return df.filter(all_of([Filter("event_type", EMPTY)])).select("event_id")


@query(
    "b3_date_range_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
)
def b3(spark, d):
    inside = date_between("o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(1996, 12, 31))
    return table(spark, d, "orders").filter(inside).select("o_orderkey", "o_totalprice")


@query(
    "b4_binarize_target",
    "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'O') = 'F' THEN 1 ELSE 0 END AS label FROM orders",
)
def b4(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return df.select("o_orderkey", is_class("o_orderstatus", "F").alias("label"))


@query(
    "b5_positive_indicator",
    """SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)
    THEN 1 ELSE 0 END AS positive FROM orders""",
)
def b5(spark, d):
    df = table(spark, d, "orders")
    cut = quantiles(df, ["o_totalprice"], [0.5], LINEAR)["o_totalprice"][0]
    return df.select("o_orderkey", is_above("o_totalprice", cut).alias("positive"))


@query(
    "b6_condition_to_predicate",
    """SELECT count(*) FILTER (l_quantity >= 25) AS at_least, count(*) FILTER (l_quantity < 25) AS below,
    count(*) FILTER (nullif(l_returnflag, 'N') = 'R') AS equal, count(*) FILTER (nullif(l_returnflag, 'N') IS NULL) AS is_null
    FROM lineitem""",
)
def b6(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))
    marks = {
        "at_least": Condition("l_quantity", ">=", number=25.0),
        "below": Condition("l_quantity", "<", number=25.0),
        "equal": Condition("l_returnflag", "=", text="R"),
        "is_null": Condition("l_returnflag", "null"),
    }
    return df.agg(*[F.count_if(c.predicate()).alias(n) for n, c in marks.items()])


@query(
    "b7_select_by_cardinality",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
)
def b7(spark, d):
    df = table(spark, d, "lineitem").withColumn("key_text", F.col("l_orderkey").cast("string"))
    kept = select_by_cardinality(df, columns_of(df, CATEGORICAL), 20)
    return df.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"))


@query("a1_read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(spark, d):
    source = table(spark, d, "customer")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    source.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, schema=source.schema)


@query("a1_read_csv_inferred", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def a1_inferred(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "nation").write.option("header", True).option("sep", ";").csv(path)
    return tables.read_csv(spark, path, sep=";")


@query("a6_save_and_load_table", "SELECT * FROM supplier WHERE s_acctbal > 0")
def a6(spark, d):
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    tables.save_table(table(spark, d, "supplier"), path)
    tables.save_table(tables.load_table(spark, path).filter("s_acctbal > 0"), path)  # replaces what it reads
    return tables.load_table(spark, path)


@query("a7_save_and_load_model", "SELECT o_orderkey, CAST(0 AS DOUBLE) AS difference FROM orders")
def a7(spark, d):
    orders = table(spark, d, "orders")
    before, model = encode.one_hot_assemble(orders, ["o_orderpriority"], ["o_totalprice"])
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(model, path)
    after = models.load_model(path).transform(orders).select(F.col("o_orderkey").alias("k"), F.col("features").alias("again"))
    gap = F.aggregate(
        F.zip_with(vector_to_array("features"), vector_to_array("again"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x
    )
    return before.join(after, F.col("o_orderkey") == F.col("k")).select("o_orderkey", gap.alias("difference"))


@query("a8_conform_schema", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(NULL AS BIGINT) AS o_orderpriority FROM orders")
def a8(spark, d):
    schema = T.StructType().add("o_orderkey", T.LongType()).add("o_totalprice", T.StringType()).add("o_orderpriority", T.LongType())
    return tables.conform_schema(table(spark, d, "orders"), schema)[0]


@query(
    "a8_schema_mismatches",
    """SELECT "column", expected, found, CASE "column" WHEN 'o_orderpriority' THEN (SELECT count(o_orderpriority) FROM orders WHERE try_cast(o_orderpriority AS BIGINT) IS NULL)
    WHEN 'o_custkey' THEN (SELECT count(*) FROM orders WHERE o_custkey > 127) ELSE 0 END AS lost
    FROM (VALUES ('o_totalprice', 'string', 'double'), ('o_orderpriority', 'bigint', 'string'), ('o_custkey', 'tinyint', 'bigint'), ('o_new', 'date', NULL)) v("column", expected, found)""",
)
def a8_mismatches(spark, d):
    schema = T.StructType().add("o_orderkey", T.LongType()).add("o_totalprice", T.StringType()).add("o_orderpriority", T.LongType())
    schema = schema.add("o_custkey", T.ByteType()).add("o_new", T.DateType())
    return tables.conform_schema(table(spark, d, "orders"), schema)[1]


@query("a9_first_rows", "SELECT least(count(*), 20000) AS n_rows, count(*) > 20000 AS truncated FROM lineitem")
def a9_first(spark, d):
    rows, truncated = tables.cap_rows(table(spark, d, "lineitem"), 20_000)
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("truncated", F.lit(truncated))


@query("a9_sample_is_bounded", "SELECT true AS enough, true AS bounded, count(*) AS whole FROM lineitem")
def a9_bounds(spark, d):
    lines = table(spark, d, "lineitem")
    some = tables.bounded_sample(lines, 2000).agg(F.count(F.lit(1)).alias("n"))
    whole = tables.bounded_sample(lines, 10**9).agg(F.count(F.lit(1)).alias("whole"))
    both = with_facts(some, whole)
    return both.select((F.col("n") > 1500).alias("enough"), (F.col("n") <= 2200).alias("bounded"), "whole")


@query("a10_table_size_fixed_width", "SELECT count(*) AS n_rows, CAST(24 AS DOUBLE) AS mean_row_bytes, CAST(count(*) * 24 AS DOUBLE) AS total_bytes FROM orders")
def a10_fixed(spark, d):
    size = tables.table_size(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
    return spark.createDataFrame([(size.rows, size.mean_row_bytes, size.total_bytes)], "n_rows bigint, mean_row_bytes double, total_bytes double")
