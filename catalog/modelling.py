"""Training, metrics, explanation, search and comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table, tidy
from gleaner.functions import rowwise
from gleaner.models import compare, evaluate, explain, search, train
from gleaner.operators.encode import one_hot_assemble, vector_names
from gleaner.plans.tables import with_facts
from gleaner.sources.tables import split_by_key
from gleaner.types import CLASSIFICATION, REGRESSION, add_features

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_linestatus"]
KEYS = ["l_orderkey", "l_linenumber"]
TREES = train.TreeSettings()  # the defaults of the operator: 100 rounds


def _lines(spark, d, kind=CLASSIFICATION):
    """Train and test frames of lineitem, and the names of the vector slots."""
    df = table(spark, d, "lineitem")
    label = (F.col("l_returnflag") == "R") if kind == CLASSIFICATION else F.col("l_extendedprice")
    numbers = NUMBERS if kind == CLASSIFICATION else [*[n for n in NUMBERS if n != "l_extendedprice"], "l_partkey"]
    ready, _ = one_hot_assemble(df, CATEGORIES, numbers)
    names = vector_names(ready)
    frame = ready.select(*KEYS, label.cast("double").alias("label"), "features")
    return (*split_by_key(frame, ["l_orderkey"]), names)


def _fitted(spark, d, name, kind=CLASSIFICATION):
    fit_on, test, names = _lines(spark, d, kind)
    return train.estimator(name, kind, trees=TREES).fit(train.spread(fit_on)), train.spread(test), names


def _measured(spark, d, name, kind=CLASSIFICATION):
    model, test, _ = _fitted(spark, d, name, kind)
    predictions = train.predict(model, test)
    if kind == CLASSIFICATION:
        return tidy(train.metrics(train.positive_score(predictions), kind, "score"))
    return tidy(train.metrics(predictions, kind))


@query("q1_boosted_trees")
def q1(spark, d):
    return _measured(spark, d, "boosted_trees")


@query("q1_boosted_trees_regression")
def q1_regression(spark, d):
    return _measured(spark, d, "boosted_trees", REGRESSION)


@query("q2_logistic_regression")
def q2(spark, d):
    return _measured(spark, d, "linear")


@query("q3_decision_tree")
def q3(spark, d):
    return _measured(spark, d, "decision_tree")


@query("q4_linear_regression")
def q4(spark, d):
    return _measured(spark, d, "linear", REGRESSION)


@query("q5_random_forest")
def q5(spark, d):
    return _measured(spark, d, "random_forest")


@query(
    "q6_naive_baseline",
    """WITH m AS (SELECT o_orderstatus AS c FROM orders GROUP BY 1 ORDER BY count(*) DESC, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END LIMIT 1)
    SELECT round(count(*) FILTER (o_orderstatus = c) / count(*), 6) AS accuracy, CASE any_value(c) WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END::DOUBLE AS prediction
    FROM orders, m""",
)
def q6(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    df = table(spark, d, "orders").select(label.alias("label"))
    guessed = train.naive_baseline(df, df, CLASSIFICATION)
    found = evaluate.classification_metrics(guessed).select("accuracy")
    return tidy(with_facts(found, guessed.agg(F.max("prediction").alias("prediction"))))


@query(
    "q6_naive_baseline_regression",
    """SELECT round(avg(pow(o_totalprice - m, 2)), 0) AS mse, round(avg(abs(o_totalprice - m)), 4) AS mae, round(sqrt(avg(pow(o_totalprice - m, 2))), 4) AS rmse, CAST(0 AS DOUBLE) AS r2
    FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)""",
)
def q6_regression(spark, d):
    df = table(spark, d, "orders").select(F.col("o_totalprice").alias("label"))
    found = evaluate.regression_metrics(train.naive_baseline(df, df, REGRESSION))
    return tidy(found.withColumn("mse", F.round("mse", 0)), 4).withColumn("r2", F.abs(F.round("r2", 6)))


@query("q7_train_all_baselines")
def q7(spark, d):
    fit_on, test, _ = _lines(spark, d)
    runs, _ = train.train_all_baselines(fit_on, test, CLASSIFICATION)
    return tidy(compare.comparison_table(runs, "auc"))


SCORED = """(SELECT CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.0 ELSE 2.0 END AS y, CASE WHEN l_quantity > 35 THEN 1.0 WHEN l_quantity > 15 THEN 2.0 ELSE 0.0 END AS z FROM lineitem)"""


@query(
    "q8_classification_metrics",
    f"""WITH t AS {SCORED}, k AS (SELECT c, count(*) FILTER (y = c) AS actual, count(*) FILTER (z = c) AS guessed, count(*) FILTER (y = c AND z = c) AS hit
    FROM t, (VALUES (0.0), (1.0), (2.0)) v(c) GROUP BY c), p AS (SELECT *, hit / guessed AS pr, hit / actual AS re FROM k)
    SELECT round(sum(hit) / sum(actual), 6) AS accuracy, round(sum(2 * pr * re / (pr + re) * actual) / sum(actual), 6) AS f1,
    round(sum(pr * actual) / sum(actual), 6) AS "precision", round(sum(re * actual) / sum(actual), 6) AS recall FROM p""",
)
def q8(spark, d):
    q = F.col("l_quantity")
    y = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).otherwise(2.0)
    z = F.when(q > 35, 1.0).when(q > 15, 2.0).otherwise(0.0)
    df = table(spark, d, "lineitem").select(y.alias("label"), z.alias("prediction"))
    return tidy(evaluate.classification_metrics(df))


@query(
    "q8_auc",
    """WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS k FROM lineitem)
    SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""",
)
def q8_auc(spark, d):
    df = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return tidy(evaluate.exact_auc(df, "label", "l_quantity"))


@query(
    "q9_regression_metrics",
    """SELECT round(avg(pow(y - z, 2)), 4) AS mse, round(sqrt(avg(pow(y - z, 2))), 6) AS rmse, round(avg(abs(y - z)), 6) AS mae,
    round(1 - avg(pow(y - z, 2)) / var_pop(y), 6) AS r2 FROM (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS z FROM lineitem)""",
)
def q9(spark, d):
    df = table(spark, d, "lineitem")
    pairs = df.select((df.l_extendedprice / 1000).alias("label"), (df.l_quantity * 1.5).alias("prediction"))
    out = evaluate.regression_metrics(pairs)
    return tidy(out.withColumn("mse", F.round("mse", 4)))


@query("q10_predict")
def q10(spark, d):
    model, test, _ = _fitted(spark, d, "boosted_trees")
    return train.predict(model, test).select(*KEYS, "label", "prediction")


@query("q11_feature_importances")
def q11(spark, d):
    model, _, names = _fitted(spark, d, "boosted_trees")
    return explain.feature_importances(spark, model, names)


@query("q12_split_impact")
def q12(spark, d):
    model, _, names = _fitted(spark, d, "boosted_trees")
    return explain.split_impact(spark, explain.read_trees(spark, model), names)


@query("q13_feature_impact")
def q13(spark, d):
    model, _, names = _fitted(spark, d, "boosted_trees")
    return explain.feature_impact(explain.split_impact(spark, explain.read_trees(spark, model), names))


@query("q14_attribution_summary")
def q14(spark, d):
    model, test, names = _fitted(spark, d, "boosted_trees")
    explained = explain.contributions(test, explain.read_trees(spark, model), KEYS)
    return tidy(explain.attribution_summary(explained, names))


@query("q14_permutation_importance")
def q14_permuted(spark, d):
    model, test, names = _fitted(spark, d, "boosted_trees")
    return tidy(explain.permutation_importance(test, explain.read_trees(spark, model), names))


@query("q15_explain_rows")
def q15(spark, d):
    model, test, names = _fitted(spark, d, "boosted_trees")
    explained = explain.contributions(test, explain.read_trees(spark, model), KEYS)
    return explain.explain_rows(explained, names, KEYS)


@query("q16_model_search")
def q16(spark, d):
    fit_on, _, _ = _lines(spark, d)
    return search.model_search(fit_on, CLASSIFICATION, KEYS).leaderboard


@query("q16_importance_of_the_winner")
def q16_importance(spark, d):
    fit_on, _, names = _lines(spark, d)
    found = search.model_search(fit_on, CLASSIFICATION, KEYS)
    named = spark.createDataFrame(list(enumerate(names)), "slot int, feature string")
    return found.importance.join(F.broadcast(named), "slot").select(F.lit(found.best_family).alias("family"), "feature", "importance")


@query("q16_out_of_fold")
def q16_oof(spark, d):
    fit_on, _, _ = _lines(spark, d, REGRESSION)
    return search.model_search(fit_on, REGRESSION, KEYS).out_of_fold


@query("q17_compare_feature_sets")
def q17(spark, d):
    df = table(spark, d, "lineitem")
    made = [*rowwise.transforms(["l_extendedprice"], ["log"]), *rowwise.interactions(["l_quantity", "l_tax"], ["mult", "div"])]
    wide = add_features(df, made)
    sets = {
        "original": (df, CATEGORIES, NUMBERS),
        "engineered": (wide, CATEGORIES, [*NUMBERS, *[f.spec.name for f in made]]),
    }
    runs = compare.compare_feature_sets(sets, F.col("l_returnflag") == "R", ["l_orderkey"], CLASSIFICATION, trees=TREES)
    return tidy(runs)


# runs derived from orders: one per priority and status, scored by mean price
RUNS = """(SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS experiment_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'Baseline ' ELSE '' END || o_orderpriority AS name,
    o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 'original' WHEN 'O' THEN 'engineered' ELSE 'other' END AS feature_set, avg(o_totalprice) / 100000 AS score
    FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def _runs(spark, d, metric="score"):
    per = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg((F.avg("o_totalprice") / 100000).alias(metric))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    sets = F.when(status == "F", "original").when(status == "O", "engineered").otherwise("other")
    order = F.expr("row_number() OVER (ORDER BY o_orderpriority, o_orderstatus)")  # one row per run
    return per.select(
        order.alias("experiment_id"),
        F.when(priority == "5-LOW", F.concat(F.lit("Baseline "), priority)).otherwise(priority).alias("name"),
        priority.alias("model"),
        sets.alias("feature_set"),
        metric,
    )


def improvement_sql(direction: str) -> str:
    best, worst = ("DESC", "ASC") if direction == "up" else ("ASC", "DESC")
    pick = lambda where, order: f"(SELECT {{c}} FROM r {where} ORDER BY score {order}, experiment_id LIMIT 1)"

    def line(name, a, b):
        return f"SELECT {name} AS comparison, {a.format(c='score')} AS s, {b.format(c='score')} AS t, {a.format(c='model')} AS m, {b.format(c='model')} AS w"

    lines = [
        line("'feature_engineering'", pick("WHERE feature_set = 'original'", best), pick("WHERE feature_set = 'engineered'", best)),
        line("'vs_baseline'", pick("WHERE name LIKE 'Baseline%'", worst), pick("", best)),
        *[
            line(f"'model_selection_{s}'", pick(f"WHERE feature_set = '{s}'", worst), pick(f"WHERE feature_set = '{s}'", best))
            for s in ("original", "engineered", "other")
        ],
    ]
    return f"""WITH r AS {RUNS} SELECT comparison, round(s, 6) AS from_score, round(t, 6) AS to_score, round(t - s, 6) AS absolute_improvement,
    round((t - s) / s * 100, 4) AS percentage_improvement, m AS from_model, w AS to_model FROM ({" UNION ALL ".join(lines)})"""


def _improved(df):
    return tidy(df.withColumn("percentage_improvement", F.round("percentage_improvement", 4)))


@query("q18_comparison_table", f"WITH r AS {RUNS} SELECT * REPLACE (CAST(experiment_id AS INTEGER) AS experiment_id, round(score, 6) AS score), CAST(row_number() OVER (ORDER BY r.score DESC, experiment_id) AS INTEGER) AS rank FROM r")
def q18(spark, d):
    return tidy(compare.comparison_table(_runs(spark, d), "score"))


@query("q18_improvements", improvement_sql("up"))
def q18_improvements(spark, d):
    return _improved(compare.improvements(_runs(spark, d), "score"))


@query("q18_improvements_smaller_is_better", improvement_sql("down"))
def q18_smaller(spark, d):
    return _improved(compare.improvements(_runs(spark, d, "rmse"), "rmse"))


# properties of fitted models that SQL can state


@query("q4_least_squares_line", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def q4_line(spark, d):
    df = table(spark, d, "lineitem")
    ready, _ = one_hot_assemble(df, [], ["l_quantity"])
    model = train.estimator("linear", REGRESSION).fit(ready.select(F.col("l_extendedprice").alias("label"), "features"))
    return tidy(spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 4)


@query("q11_importances_sum_to_one", "SELECT CAST(1 AS DOUBLE) AS total, 6 AS features FROM (SELECT count(*) FROM lineitem)")
def q11_total(spark, d):
    model, _, names = _fitted(spark, d, "random_forest")
    per = explain.feature_importances(spark, model, names)
    return tidy(per.agg(F.sum("importance").alias("total"), F.count(F.lit(1)).cast("int").alias("features")))


@query("q14_contributions_add_up", "SELECT l_orderkey, l_linenumber, CAST(0 AS DOUBLE) AS gap FROM lineitem")
def q14_additive(spark, d):
    fit_on, test, _ = _lines(spark, d)
    model = train.estimator("random_forest", CLASSIFICATION).fit(train.spread(fit_on))
    rows = train.positive_score(train.predict(model, fit_on.unionByName(test)))
    explained = explain.contributions(rows, explain.read_trees(spark, model), [*KEYS, "score"])
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base_value")
    return explained.select(*KEYS, F.abs(F.round(total - F.col("score"), 6)).alias("gap"))


@query("q16_one_prediction_per_row", "SELECT o_orderkey, CAST(1 AS BIGINT) AS predictions FROM orders")
def q16_once(spark, d):
    orders = table(spark, d, "orders")
    ready, _ = one_hot_assemble(orders, ["o_orderpriority"], ["o_custkey"])
    frame = ready.select("o_orderkey", F.col("o_totalprice").alias("label"), "features")
    grids = {"decision_tree": {"maxDepth": [1, 2]}}
    found = search.model_search(frame, REGRESSION, ["o_orderkey"], quick=True, grids=grids)
    return found.out_of_fold.groupBy("o_orderkey").agg(F.count("prediction").alias("predictions"))


STUMP = ["l_quantity", "l_discount", "l_tax"]  # few distinct values each, so that every value is a cut point


@query(
    "q1_first_split_of_boosted_trees",
    f"""WITH m AS (SELECT avg(l_extendedprice) AS base FROM lineitem),
    v AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {k} AS slot, {c} AS x, l_extendedprice AS y FROM lineitem" for k, c in enumerate(STUMP))}),
    per AS (SELECT feature, slot, x, count(*) AS n, sum(base - y) AS g FROM v, m GROUP BY feature, slot, x),
    cut AS (SELECT feature, slot, x, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER (PARTITION BY feature) AS nt, sum(g) OVER (PARTITION BY feature) AS gt
    FROM per WINDOW w AS (PARTITION BY feature ORDER BY x)),
    best AS (SELECT *, nt - nl AS nr, gt - gl AS gr FROM cut WHERE nl < nt ORDER BY gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) DESC, slot, x LIMIT 1)
    SELECT feature, CAST(x AS DOUBLE) AS threshold, round(base, 2) AS base, round(-0.1 * gl / (nl + 1), 2) AS left_value, round(-0.1 * gr / (nr + 1), 2) AS right_value,
    CAST(nl AS BIGINT) AS left_rows, CAST(nr AS BIGINT) AS right_rows FROM best, m""",
)
def q1_stump(spark, d):
    """What the first split of boosted trees must be, with its leaf values."""
    ready, _ = one_hot_assemble(table(spark, d, "lineitem"), [], STUMP)
    frame = ready.select(F.col("l_extendedprice").cast("double").alias("label"), "features")
    model = train.estimator("boosted_trees", REGRESSION, trees=train.TreeSettings(depth=1, rounds=1)).fit(frame)
    t = model.trees[0]
    row = (
        STUMP[t["feature"][0]], t["threshold"][0], round(model.base, 2), round(t["value"][1], 2), round(t["value"][2], 2),
        t["rows"][1], t["rows"][2],
    )
    return spark.createDataFrame(
        [row], "feature string, threshold double, base double, left_value double, right_value double, left_rows bigint, right_rows bigint"
    )


@query(
    "q14_contributions_of_a_given_tree",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_quantity <= 25) AS nq, count(*) FILTER (l_quantity <= 25 AND l_discount <= 0.05) AS nqd,
    avg(l_extendedprice) FILTER (l_quantity <= 25 AND l_discount <= 0.05) AS a, avg(l_extendedprice) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS b,
    avg(l_extendedprice) FILTER (l_quantity > 25) AS z FROM lineitem),
    f AS (SELECT l_orderkey, l_linenumber, l_quantity <= 25 AS q, l_discount <= 0.05 AS d, nq / n AS s, nqd / nq AS r, a, b, z FROM lineitem, c),
    e AS (SELECT *, s * (r * a + (1 - r) * b) + (1 - s) * z AS none, CASE WHEN q THEN r * a + (1 - r) * b ELSE z END AS with_q,
    s * CASE WHEN d THEN a ELSE b END + (1 - s) * z AS with_d, CASE WHEN NOT q THEN z WHEN d THEN a ELSE b END AS whole FROM f)
    SELECT l_orderkey, l_linenumber, round(none, 2) AS base_value, round((with_q - none + whole - with_d) / 2, 2) AS of_quantity,
    round((with_d - none + whole - with_q) / 2, 2) AS of_discount FROM e""",
)
def q14_given(spark, d):
    """Contributions by a tree of three leaves whose values and covers come from the table, against their definition."""
    df = table(spark, d, "lineitem")
    price, low, cheap = F.col("l_extendedprice"), F.col("l_quantity") <= 25, F.col("l_discount") <= 0.05
    c = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low).alias("nq"), F.count_if(low & cheap).alias("nqd"),
        F.avg(F.when(low & cheap, price)).alias("a"), F.avg(F.when(low & ~cheap, price)).alias("b"), F.avg(F.when(~low, price)).alias("z"),
    ).first()
    nodes = {
        0: explain.Node(0.0, c["n"], 0.0, 0, 25.0, None, 1, 2),
        1: explain.Node(0.0, c["nq"], 0.0, 1, 0.05, None, 3, 4),
        2: explain.Node(c["z"], c["n"] - c["nq"], 0.0),
        3: explain.Node(c["a"], c["nqd"], 0.0),
        4: explain.Node(c["b"], c["nq"] - c["nqd"], 0.0),
    }
    ready, _ = one_hot_assemble(df, [], ["l_quantity", "l_discount"])
    made = explain.contributions(ready, explain.Trees([nodes]), ["l_orderkey", "l_linenumber"])
    two = lambda x: F.round(x, 2)
    return made.select(
        "l_orderkey", "l_linenumber", two(F.col("base_value")).alias("base_value"),
        two(F.col("contributions")[0]).alias("of_quantity"), two(F.col("contributions")[1]).alias("of_discount"),
    )
