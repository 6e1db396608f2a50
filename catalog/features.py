"""Generated features and preprocessing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.functions import rowwise
from gleaner.operators import encode, prep
from gleaner.types import add_features

KEY = ["l_orderkey", "l_linenumber"]
NUM = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, d):
    """lineitem with some nulls, zeros and negatives."""
    df = table(spark, d, "lineitem")
    return df.withColumns(
        {
            "l_quantity": F.nullif(F.col("l_quantity") - 3, F.lit(7.0)),
            "l_discount": F.nullif("l_discount", F.lit(0.05)),
        }
    )


LINES = "(SELECT * REPLACE (nullif(l_quantity - 3, 7.0) AS l_quantity, nullif(l_discount, 0.05) AS l_discount) FROM lineitem)"


def _made(df, features, digits=6, key=KEY):
    return tidy(add_features(df, features).select(*key, *[f"`{f.spec.name}`" for f in features]), digits)


def _sql(expressions: dict[str, str], source=LINES, key=KEY, digits=6) -> str:
    return f"SELECT {', '.join(key)}, " + ", ".join(f'round({e}, {digits}) AS "{n}"' for n, e in expressions.items()) + f" FROM {source}"


def _quotient(a, b):
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0.0 END"


@query("i1_log", _sql({f"{c}_log": f"ln(1 + CASE WHEN {c} > 0 THEN {c} ELSE 0.0 END)" for c in NUM}))
def i1(spark, d):
    return _made(_lines(spark, d), rowwise.transforms(NUM, ["log"]))


@query("i2_sqrt", _sql({f"{c}_sqrt": f"sqrt(CASE WHEN {c} >= 0 THEN {c} ELSE 0.0 END)" for c in NUM}))
def i2(spark, d):
    return _made(_lines(spark, d), rowwise.transforms(NUM, ["sqrt"]))


@query(
    "i3_square_cube",
    _sql({k: v for c in NUM for k, v in {f"{c}_square": f"pow({c}, 2.0)", f"{c}_cube": f"pow({c}, 3.0)"}.items()}),
)
def i3(spark, d):
    return _made(_lines(spark, d), rowwise.transforms(NUM, ["square", "cube"]))


@query(
    "i4_interactions",
    _sql(
        {
            k: v
            for a, b in combinations(NUM, 2)
            for k, v in {
                f"{a}_mult_{b}": f"{a} * {b}",
                f"{a}_div_{b}": _quotient(a, b),
                f"{a}_add_{b}": f"{a} + {b}",
                f"{a}_sub_{b}": f"{a} - {b}",
            }.items()
        }
    ),
)
def i4(spark, d):
    return _made(_lines(spark, d), rowwise.interactions(NUM))


@query(
    "i5_polynomial",
    _sql({"poly_bias": "CAST(1.0 AS DOUBLE)"} | {f"{c}_pow{k}": f"pow({c}, {k}.0)" for c in NUM for k in (2, 3)}),
)
def i5(spark, d):
    return _made(_lines(spark, d), rowwise.powers(NUM, 3, bias=True))


@query(
    "i6_polynomial_interactions",
    _sql({f"{c}_pow2": f"pow({c}, 2.0)" for c in NUM} | {f"{a}_x_{b}": f"{a} * {b}" for a, b in combinations(NUM, 2)}),
)
def i6(spark, d):
    return _made(_lines(spark, d), rowwise.power_interactions(NUM))


@query(
    "i7_ratios",
    _sql(
        {
            f"{a}_ratio_{b}": _quotient(a, b)
            for a, b in [("l_quantity", "l_discount"), ("l_discount", "l_quantity"), ("l_tax", "l_quantity"), ("l_quantity", "l_tax")]
        }
    ),
)
def i7(spark, d):
    return _made(_lines(spark, d), rowwise.ratios([("l_quantity", "l_discount"), ("l_tax", "l_quantity")]))


@query("i8_cyclical", _sql({"l_quantity_sin": "sin(2 * pi() * l_quantity / 12)", "l_quantity_cos": "cos(2 * pi() * l_quantity / 12)"}))
def i8(spark, d):
    return _made(_lines(spark, d), rowwise.cyclical("l_quantity", 12))


@query(
    "i9_datetime_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate_dayofweek,
    CAST(dayofyear(o_orderdate) AS INTEGER) AS o_orderdate_dayofyear, CAST(weekofyear(o_orderdate) AS INTEGER) AS o_orderdate_weekofyear,
    CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS o_orderdate_is_weekend
    FROM orders""",
)
def i9(spark, d):
    return _made(table(spark, d, "orders"), rowwise.datetime_parts(["o_orderdate"]), key=["o_orderkey"])


@query(
    "i10_string_stats",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST(len(string_split(text, ' ')) AS INTEGER) AS text_word_count,
    CAST(len(list_distinct(string_split(text, ''))) AS INTEGER) AS text_unique_chars FROM documents""",
)
def i10(spark, d):
    return _made(table(spark, d, "documents"), rowwise.string_stats(["text"]), key=["doc_id"])


def _bin_sql(c: str, source: str, bins: int = 5) -> str:
    return f"""(SELECT list_sort(list_distinct([{", ".join(f"quantile_disc({c}, {i / bins})" for i in range(bins + 1))}])) FROM {source})"""


@query(
    "i11_quantile_bin",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice IS NULL THEN NULL ELSE
    CAST(least(len(list_filter(s, lambda x: x <= l_extendedprice)) - 1, len(s) - 2) AS DOUBLE) END AS l_extendedprice_binned,
    CASE WHEN l_quantity IS NULL THEN NULL ELSE CAST(least(len(list_filter(q, lambda x: x <= l_quantity)) - 1, len(q) - 2) AS DOUBLE) END AS l_quantity_binned
    FROM {LINES} l, (SELECT {_bin_sql("l_extendedprice", LINES)} AS s, {_bin_sql("l_quantity", LINES)} AS q)""",
)
def i11(spark, d):
    out = encode.quantile_bin(_lines(spark, d), ["l_extendedprice", "l_quantity"])
    return out.select(*KEY, "l_extendedprice_binned", "l_quantity_binned")


@query(
    "i12_target_encode",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_linestatus, nullif(l_returnflag, 'A') AS f,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS y FROM lineitem),
    g AS (SELECT avg(y) AS m FROM t),
    a AS (SELECT l_linestatus AS k, (count(y) * avg(y) + 10 * any_value(m)) / (count(y) + 10) AS e FROM t, g GROUP BY 1),
    b AS (SELECT f AS k, (count(y) * avg(y) + 10 * any_value(m)) / (count(y) + 10) AS e FROM t, g GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(coalesce(a.e, m), 4) AS l_linestatus_target_enc, round(coalesce(b.e, m), 4) AS f_target_enc
    FROM t CROSS JOIN g LEFT JOIN a ON a.k = l_linestatus LEFT JOIN b ON b.k = f""",
)
def i12(spark, d):
    df = table(spark, d, "lineitem").select(
        *KEY,
        "l_linestatus",
        F.nullif("l_returnflag", F.lit("A")).alias("f"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("y"),
    )
    out = encode.target_encode(df, ["l_linestatus", "f"], "y", 10.0)
    return tidy(out.select(*KEY, "l_linestatus_target_enc", "f_target_enc"), 4)


@query(
    "i13_row_stats",
    f"""SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS row_mean,
    greatest(l_quantity, l_discount, l_tax) AS row_max, least(l_quantity, l_discount, l_tax) AS row_min,
    round(greatest(l_quantity, l_discount, l_tax) - least(l_quantity, l_discount, l_tax), 6) AS row_range,
    CAST(coalesce((l_quantity = 0)::INT, 0) + coalesce((l_discount = 0)::INT, 0) + coalesce((l_tax = 0)::INT, 0) AS INTEGER) AS row_zero_count,
    CAST((l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT AS INTEGER) AS row_null_count FROM {LINES}""",
)
def i13(spark, d):
    return _made(_lines(spark, d), rowwise.row_stats(NUM))


MANY = [f"c{i:02}" for i in range(20)]  # small whole numbers, so that sums do not depend on the order of rows
MANY_PAIRS = [(a, b, k) for a, b in combinations(MANY, 2) for k in ("mult", "div", "add", "sub")]


def _many_sql() -> str:
    forms = {"mult": "{a} * {b}", "div": "CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0 END", "add": "{a} + {b}", "sub": "{a} - {b}"}
    sums = ", ".join(f"CAST(sum(round(({forms[k].format(a=a, b=b)}) * 1000)) AS BIGINT) AS {a}_{k}_{b}" for a, b, k in MANY_PAIRS)
    columns = ", ".join(f"CAST((p_partkey * {i + 1} + p_size) % 17 AS DOUBLE) AS {c}" for i, c in enumerate(MANY))
    return f"SELECT name AS feature, value AS total FROM (UNPIVOT (SELECT {sums} FROM (SELECT {columns} FROM part)) ON *)"


@query("i4_interactions_of_twenty_columns", _many_sql())
def i4_many(spark, d):
    """All 760 features of 190 pairs, each one summed up over all rows."""
    number = lambda i: ((F.col("p_partkey") * (i + 1) + F.col("p_size")) % 17).cast("double")
    df = table(spark, d, "part").select(*[number(i).alias(c) for i, c in enumerate(MANY)])
    return _totals(df, rowwise.interactions(MANY))


def _totals(df, features):
    """(feature, total): thousandths of every feature, rounded and summed up where the rows are.

    A row is never made into a row per feature. Features are added up some at a time, since the code of one aggregate
    over hundreds of them is too long to be compiled.
    """
    found = []
    for k in range(0, len(features), 40):
        names = [f.spec.name for f in features[k : k + 40]]
        sums = add_features(df, features[k : k + 40]).agg(*[F.sum(F.round(F.col(f"`{c}`") * 1000)).cast("bigint").alias(c) for c in names])
        found.append(sums.unpivot([], [F.col(f"`{c}`") for c in names], "feature", "total"))
    return reduce(DataFrame.unionAll, found).filter(F.col("total").isNotNull())


@query(
    "i14_generate_all",
    f"""SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(l_quantity, 0.0)), 6) AS l_quantity_log,
    round(l_quantity * l_tax, 6) AS l_quantity_mult_l_tax, CAST(least(len(list_filter(s, lambda x: x <= l_tax)) - 1, len(s) - 2) AS DOUBLE) AS l_tax_binned,
    CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, CAST(length(l_linestatus) AS INTEGER) AS l_linestatus_length, 7 + 3 * 4 + 3 * 4 + 3 + 8 + 3 AS n_columns
    FROM lineitem, (SELECT {_bin_sql("l_tax", "lineitem")} AS s)""",
)
def i14(spark, d):
    df = table(spark, d, "lineitem").drop("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    out = encode.generate_all(df, exclude=["l_returnflag", "l_orderkey"])
    some = ["l_quantity_log", "l_quantity_mult_l_tax", "l_tax_binned", "l_shipdate_month", "l_linestatus_length"]
    return tidy(out.select(*KEY, *some)).withColumn("n_columns", F.lit(len(out.columns)))


ALL_NUMBERS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _every_sql() -> str:
    """Every automatic feature of lineitem by name, each one summed up on a scale that differences in last digits leave alone."""
    x = {c: f"CAST({c} AS DOUBLE)" for c in ALL_NUMBERS}
    made = dict(x)
    for c, v in x.items():
        made |= {f"{c}_log": f"ln(1 + greatest({v}, 0.0))", f"{c}_sqrt": f"sqrt(greatest({v}, 0.0))", f"{c}_square": f"{v} * {v}", f"{c}_cube": f"{v} * {v} * {v}"}
        made[f"{c}_binned"] = f"least(len(list_filter(s_{c}, lambda y: y <= {v})) - 1, len(s_{c}) - 2)"
    for k, a in enumerate(ALL_NUMBERS):
        for b in ALL_NUMBERS[k + 1 :]:
            made |= {f"{a}_mult_{b}": f"{x[a]} * {x[b]}", f"{a}_add_{b}": f"{x[a]} + {x[b]}", f"{a}_sub_{b}": f"{x[a]} - {x[b]}"}
            made[f"{a}_div_{b}"] = f"CASE WHEN {b} <> 0 THEN {x[a]} / {x[b]} ELSE 0 END"
    parts = {"year": "year", "month": "month", "day": "day", "dayofweek": "1 + dayofweek", "dayofyear": "dayofyear", "weekofyear": "weekofyear", "quarter": "quarter"}
    made |= {f"l_shipdate_{n}": f"{f}(l_shipdate)" for n, f in parts.items()}
    made["l_shipdate_is_weekend"] = "CASE WHEN dayofweek(l_shipdate) IN (0, 6) THEN 1 ELSE 0 END"
    made |= {"l_linestatus_length": "length(l_linestatus)", "l_linestatus_word_count": "len(string_split(l_linestatus, ' '))"}
    made["l_linestatus_unique_chars"] = "len(list_distinct(string_split(l_linestatus, '')))"
    sums = ", ".join(f"CAST(sum(sign({e}) * floor(ln(1 + abs({e})) * 1000)) AS BIGINT) AS {n}" for n, e in made.items())
    cuts = ", ".join(f"{_bin_sql(c, 'lineitem')} AS s_{c}" for c in ALL_NUMBERS)
    return f"WITH cuts AS (SELECT {cuts}) SELECT name AS feature, value AS total FROM (UNPIVOT (SELECT {sums} FROM lineitem, cuts) ON *)"


@query("i14_every_feature", _every_sql())
def i14_every(spark, d):
    """All features of all columns of lineitem, target and key left out."""
    df = table(spark, d, "lineitem")
    wide = encode.generate_all(df, exclude=["l_returnflag", "l_orderkey"])
    made = [c for c in wide.columns if c not in df.columns or c in ALL_NUMBERS]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in made])).alias("f"))
    x = F.col("f.x")
    return long.groupBy("f.feature").agg(F.sum(F.signum(x) * F.floor(F.log(1 + F.abs(x)) * 1000)).cast("bigint").alias("total"))


@query("i15_one_hot_assemble")
def i15(spark, d):
    df = table(spark, d, "lineitem")
    out, _ = encode.one_hot_assemble(df, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"])
    names = encode.vector_names(out)
    return out.select(*KEY, F.size(F.array(*[F.lit(n) for n in names])).alias("n_slots"))


@query("i16_index_and_scale")
def i16(spark, d):
    out, _ = encode.index_and_scale(table(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"], ["o_totalprice"])
    return out.select("o_orderkey", "label", vector_to_array("features")[0].alias("first_slot"))


def _median(c):
    return f"(SELECT quantile_disc({c}, 0.5) FROM {LINES})"


@query(
    "j1_impute",
    f"""SELECT l_orderkey, l_linenumber, coalesce(l_quantity, {_median("l_quantity")}) AS median_quantity,
    round(coalesce(l_discount, (SELECT avg(l_discount) FROM {LINES})), 6) AS mean_discount, coalesce(l_quantity, -1.0) AS constant_quantity,
    coalesce(nullif(l_returnflag, 'R'), (SELECT f FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'
    GROUP BY 1) ORDER BY n DESC, f LIMIT 1)) AS mode_flag FROM {LINES}""",
)
def j1(spark, d):
    df = _lines(spark, d).withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    df = df.withColumn("constant_quantity", F.col("l_quantity"))
    steps = [
        prep.fit_impute(df, ["l_quantity"], prep.MEDIAN),
        prep.fit_impute(df, ["l_discount"], prep.MEAN),
        prep.fit_impute(df, ["constant_quantity"], prep.CONSTANT, -1.0),
        prep.fit_impute(df, ["l_returnflag"], prep.MODE),
    ]
    for step in steps:
        df = prep.apply_step(df, step)
    return tidy(
        df.select(
            *KEY,
            F.col("l_quantity").alias("median_quantity"),
            F.col("l_discount").alias("mean_discount"),
            "constant_quantity",
            F.col("l_returnflag").alias("mode_flag"),
        )
    )


@query("j1_impute_drop", f"SELECT l_orderkey, l_linenumber FROM {LINES} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def j1_drop(spark, d):
    df = _lines(spark, d)
    return prep.apply_step(df, prep.fit_impute(df, ["l_quantity", "l_discount"], prep.DROP)).select(*KEY)


IQR = f"""(SELECT quantile_disc(l_extendedprice, 0.25) - 0.5 * (quantile_disc(l_extendedprice, 0.75) - quantile_disc(l_extendedprice, 0.25)) AS lo,
    quantile_disc(l_extendedprice, 0.75) + 0.5 * (quantile_disc(l_extendedprice, 0.75) - quantile_disc(l_extendedprice, 0.25)) AS hi FROM {LINES})"""


@query("j2_cap_iqr", f"SELECT l_orderkey, l_linenumber, round(greatest(lo, least(hi, l_extendedprice)), 6) AS l_extendedprice FROM {LINES}, {IQR}")
def j2(spark, d):
    df = _lines(spark, d)
    return tidy(prep.apply_step(df, prep.fit_iqr(df, ["l_extendedprice"], prep.CAP, 0.5)).select(*KEY, "l_extendedprice"))


@query("j2_remove_iqr", f"SELECT l_orderkey, l_linenumber FROM {LINES}, {IQR} WHERE l_extendedprice BETWEEN lo AND hi")
def j2_remove(spark, d):
    df = _lines(spark, d)
    return prep.apply_step(df, prep.fit_iqr(df, ["l_extendedprice"], prep.REMOVE, 0.5)).select(*KEY)


Z = f"(SELECT avg(l_quantity) - stddev_samp(l_quantity) AS lo, avg(l_quantity) + stddev_samp(l_quantity) AS hi FROM {LINES})"


@query(
    "j3_cap_zscore",
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity IS NOT NULL THEN greatest(lo, least(hi, l_quantity)) END, 6) AS l_quantity
    FROM {LINES}, {Z}""",
)
def j3(spark, d):
    df = _lines(spark, d)
    return tidy(prep.apply_step(df, prep.fit_zscore(df, ["l_quantity"], prep.CAP, 1.0)).select(*KEY, "l_quantity"))


@query("j3_remove_zscore", f"SELECT l_orderkey, l_linenumber FROM {LINES}, {Z} WHERE l_quantity BETWEEN lo AND hi")
def j3_remove(spark, d):
    df = _lines(spark, d)
    return prep.apply_step(df, prep.fit_zscore(df, ["l_quantity"], prep.REMOVE, 1.0)).select(*KEY)


@query(
    "j4_group_rare",
    """WITH t AS (SELECT p_partkey, nullif(p_type, (SELECT min(p_type) FROM part)) AS p_type FROM part),
    c AS (SELECT p_type, count(*) / (SELECT count(*) FROM t) AS f FROM t GROUP BY 1)
    SELECT p_partkey, CASE WHEN t.p_type IS NULL THEN NULL WHEN f < 0.05 THEN 'RARE' ELSE t.p_type END AS p_type
    FROM t LEFT JOIN c ON t.p_type = c.p_type""",
)
def j4(spark, d):
    part = table(spark, d, "part")
    low = part.agg(F.min("p_type")).first()[0]
    df = part.select("p_partkey", F.nullif("p_type", F.lit(low)).alias("p_type"))
    return prep.group_rare(df, ["p_type"], 0.05)


def _scale_sql(centre: str, width: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, round((l_quantity - c) / w, 6) AS l_quantity_scaled
    FROM {LINES}, (SELECT {centre} AS c, {width} AS w FROM {LINES})"""


def _scaled(spark, d, method):
    df = _lines(spark, d)
    return tidy(prep.apply_step(df, prep.fit_scale(df, ["l_quantity"], method)).select(*KEY, "l_quantity_scaled"))


@query("j5_scale_standard", _scale_sql("avg(l_quantity)", "stddev_samp(l_quantity)"))
def j5(spark, d):
    return _scaled(spark, d, "standard")


@query("j6_scale_minmax", _scale_sql("min(l_quantity)", "max(l_quantity) - min(l_quantity)"))
def j6(spark, d):
    return _scaled(spark, d, "minmax")


@query("j7_scale_robust", _scale_sql("quantile_disc(l_quantity, 0.5)", "quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25)"))
def j7(spark, d):
    return _scaled(spark, d, "robust")


@query(
    "j8_prepare",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, {_median("l_quantity")}) AS q, l_returnflag AS f FROM {LINES}),
    b AS (SELECT quantile_disc(q, 0.25) AS q1, quantile_disc(q, 0.75) AS q3 FROM a),
    c AS (SELECT l_orderkey, l_linenumber, f, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), q)) AS q FROM a, b),
    r AS (SELECT f, count(*) / (SELECT count(*) FROM c) AS share FROM c GROUP BY 1),
    s AS (SELECT avg(q) AS m, stddev_samp(q) AS w FROM c)
    SELECT l_orderkey, l_linenumber, q AS l_quantity, CASE WHEN share < 0.3 THEN 'RARE' ELSE c.f END AS l_returnflag,
    round((q - m) / w, 6) AS l_quantity_scaled FROM c JOIN r ON c.f = r.f CROSS JOIN s""",
)
def j8(spark, d):
    options = prep.PrepOptions(rare_threshold=0.3)
    out = prep.prepare(_lines(spark, d), ["l_quantity"], ["l_returnflag"], options)
    return tidy(out.select(*KEY, "l_quantity", "l_returnflag", "l_quantity_scaled"))


@query(
    "i15_one_hot_slots",
    """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER)::DOUBLE AS l_returnflag_R, CAST(l_returnflag = 'A' AS INTEGER)::DOUBLE AS l_returnflag_A,
    CAST(l_linestatus = 'O' AS INTEGER)::DOUBLE AS l_linestatus_O, l_quantity FROM lineitem""",
)
def i15_slots(spark, d):
    out, _ = encode.one_hot_assemble(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity")), ["l_returnflag", "l_linestatus"], ["q"])
    names = encode.vector_names(out)
    slot = lambda n: vector_to_array("features")[names.index(n)]
    shown = ["l_returnflag_R", "l_returnflag_A", "l_linestatus_O"]
    return out.select(*KEY, *[slot(n).alias(n) for n in shown], slot("q").alias("l_quantity"))


@query(
    "i16_scaled_values",
    """SELECT o_orderkey, CAST(k AS DOUBLE) AS label, round(o_totalprice / s, 6) AS scaled FROM orders JOIN (SELECT o_orderstatus AS st,
    row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS k FROM orders GROUP BY 1) ON st = o_orderstatus CROSS JOIN (SELECT stddev_samp(o_totalprice) AS s FROM orders)""",
)
def i16_scaled(spark, d):
    out, _ = encode.index_and_scale(table(spark, d, "orders"), "o_orderstatus", [], ["o_totalprice"])
    return tidy(out.select("o_orderkey", "label", vector_to_array("features")[0].alias("scaled")))
