"""Edge cases on small tables: nulls, zeros, constants, ties, single rows."""

import datetime as dt
import itertools
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import labelers, rowwise
from gleaner.functions.predicates import Condition, Filter, all_of
from gleaner.models import compare, evaluate, explain, search, train
from gleaner.operators import asof, encode, synthesis, insights, labels, microsegments, prep, profile, quality, ranking, segments, temporal, windows
from gleaner.operators import aggregates as agg
from gleaner.plans.tables import shared_folder, written
from gleaner.sources import models as saved
from gleaner.sources import tables
from gleaner.streaming.incremental import microsegments_by_depth
from gleaner.types import CLASSIFICATION, REGRESSION, FeatureSpec, Problem, add_features, columns_of


@pytest.fixture(scope="module")
def nulls(spark):
    rows = [(1, 4.0, 2.0, "a"), (2, None, 0.0, ""), (3, -9.0, None, None), (4, 0.0, -1.0, "a")]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c string")


def one(df):
    return [tuple(r) for r in df.collect()]


def test_roles_cover_all_numeric_and_time_types(spark):
    df = spark.sql("select 1Y a, 2S b, 3L c, 1.5BD d, true e, date'2024-01-01' f, timestamp_ntz'2024-01-01' g, 'x' h")
    assert columns_of(df, "numerical") == ["a", "b", "c", "d"]
    assert columns_of(df, "datetime") == ["f", "g"] and columns_of(df, "boolean") == ["e"]


def test_null_rules_of_row_features(nulls):
    got = one(add_features(nulls, [*rowwise.transforms(["a"], ["log", "sqrt"]), *rowwise.ratios([("a", "b")])]).orderBy("id").select("a_log", "a_sqrt", "a_ratio_b", "b_ratio_a"))
    assert got[0] == (math.log1p(4), 2.0, 2.0, 0.5)
    assert got[1] == (0.0, 0.0, 0.0, 0.0)  # null a: zeros; zero b: zero
    assert got[2][:3] == (0.0, 0.0, 0.0) and got[2][3] is None  # null over -9 stays null
    assert got[3] == (0.0, 0.0, 0.0, 0.0)


def test_large_integers_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62, 2**62)], "a bigint, b bigint")
    row = add_features(df, [*rowwise.interactions(["a", "b"]), *rowwise.powers(["a"])]).first()
    assert row["a_mult_b"] == 2.0**124 and row["a_add_b"] == 2.0**63


def test_interactions_of_all_pairs_unless_fewer_are_asked_for():
    names = [f"c{i}" for i in range(60)]
    assert len(rowwise.interactions(names)) == 4 * math.comb(60, 2) and len(rowwise.interactions(names, cap=500)) == 500


def test_row_stats(nulls):
    got = one(add_features(nulls, rowwise.row_stats(["a", "b"])).orderBy("id").select("row_mean", "row_max", "row_range", "row_zero_count", "row_null_count"))
    assert got == [(3.0, 4.0, 2.0, 0, 0), (None, 0.0, 0.0, 1, 1), (None, -9.0, 0.0, 0, 1), (-0.5, 0.0, 1.0, 1, 0)]


def test_filters(nulls):
    keep = lambda *f: sorted(r[0] for r in nulls.filter(all_of(list(f))).select("id").collect())
    assert keep() == [1, 2, 3, 4]
    assert keep(Filter("c", "empty")) == [2, 3] and keep(Filter("c", "non_empty")) == [1, 4]
    assert keep(Filter("c", "equal_to", ("a",)), Filter("a", "greater_than", (1,))) == [1]
    assert keep(Filter("a", "not_equal_to", (4.0,))) == [3, 4]
    with pytest.raises(ValueError):
        all_of([Filter("a", "near", (1,))])


def test_names(spark):
    assert tables.sanitize_names(spark.range(1).toDF("a.b c")).columns == ["a_b_c"]
    with pytest.raises(ValueError, match="collide"):
        tables.sanitize_names(spark.sql("select 1 `a.b`, 2 `a b`"))


def test_csv_save_load_and_conform(spark, nulls, tmp_path):
    nulls.write.option("header", True).csv(str(tmp_path / "in"))
    read = tables.read_csv(spark, str(tmp_path / "in"))
    assert dict(read.dtypes) == {"id": "int", "a": "double", "b": "double", "c": "string"} and read.count() == 4
    path = str(tmp_path / "t")
    tables.save_table(read, path)
    tables.save_table(tables.load_table(spark, path).filter("id < 3"), path)
    assert tables.load_table(spark, path).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "t"]
    schema = T.StructType().add("id", T.LongType()).add("c", T.IntegerType()).add("new", T.StringType())
    out, report = tables.conform_schema(read, schema)
    assert out.schema.simpleString() == schema.simpleString() and out.filter("c is not null").count() == 0
    assert sorted(one(report)) == [("c", "int", "string", 2), ("id", "bigint", "int", 0), ("new", "string", None, 0)]


def test_row_caps_keep_each_partitions_share(spark, tmp_path):
    spark.range(1000).repartition(8).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    some = tables.first_rows(df, 333)
    assert some.count() == 333 == some.distinct().count() and one(some) == one(tables.first_rows(df, 333))
    assert "Limit" not in some._jdf.queryExecution().toString()
    assert tables.first_rows(df, 0).count() == 0 and tables.first_rows(df, 5000).count() == 1000
    drawn = tables.bounded_sample(df, 50)
    assert 20 < drawn.count() <= 55 and sorted(one(drawn)) == sorted(one(tables.bounded_sample(df, 50)))
    assert tables.cap_rows(df.limit(0), 3)[0].count() == 0 and not tables.cap_rows(df.limit(0), 3)[1]


def test_timestamp_formats_by_shape(spark):
    as_text = lambda values: spark.createDataFrame([(v,) for v in values], "v string")
    assert tables.timestamp_format(as_text(["31/12/2020", "01/02/2021", None]), "v") == "dd/MM/yyyy"
    assert tables.timestamp_format(as_text(["12/31/2020", "01/02/2021"]), "v") == "MM/dd/yyyy"
    assert tables.timestamp_format(as_text(["31-12-2020 10:00:00"] * 2 + ["2020/12/31"] * 18), "v") == "yyyy/MM/dd"
    assert tables.timestamp_format(as_text(["2020-12-31 10:00:00"]), "v") is None
    with pytest.raises(ValueError):
        tables.timestamp_format(as_text(["99/99/2020", "x"]), "v")


def test_long_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("a" * 500,), ("a" * 499 + "b",), ("a" * 500,), ("short",), (None,)], "t string")
    assert one(agg.category_summary(df, ["t"])) == [("t", 3, 4, 1)]


def test_capping_sampling_sizing_and_splitting(spark):
    df = spark.range(1000).withColumn("s", F.lit("abcd"))
    assert tables.cap_rows(df, 1000)[1] is False and tables.cap_rows(df, 999)[1] is True
    assert 60 < tables.bounded_sample(df, 100).count() <= 110 and tables.bounded_sample(df, 100, sample=False).count() == 100
    size = tables.table_size(df, limit_bytes=5000)
    assert size.rows == 1000 and not size.fits and 0 < size.suggested_rows < 1000
    a, b = tables.split_by_key(df, ["id"])
    c, d = tables.split_by_key(df.repartition(5), ["id"])
    assert sorted(one(a)) == sorted(one(c)) and a.count() + b.count() == 1000 and 750 < a.count() < 850


@pytest.mark.parametrize("pattern", ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S"])
def test_timestamp_formats(spark, pattern):
    days = [dt.datetime(2024, 1, 25) + dt.timedelta(days=i) for i in range(40)]
    text = [d.strftime(pattern) for d in days]
    df = spark.createDataFrame([(t,) for t in [*text, "junk", "junk"]], "d string")
    parsed = [r[0] for r in tables.auto_cast_timestamp(df, "d").collect()]
    assert parsed[:40] == days and parsed[40:] == [None, None]
    mixed = spark.createDataFrame([(t,) for t in text + ["junk"] * 10], "d string")
    with pytest.raises(ValueError, match="timestamps"):
        tables.auto_cast_timestamp(mixed, "d")


def test_group_stats_keep_null_groups_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", 7.0)], "g string, x double")
    got = sorted(one(agg.group_agg_features(df, ["g"], ["x"], ["mean", "stddev"])), key=lambda r: r[1])
    assert got[2] == (None, 5.0, None, None) and got[0][2] == 2.0 and got[3][3] is None


def test_pct_change_and_first_last(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 5.0, None, 10.0, 5.0])], "k int, t int, x double")
    got = [r["x_pct_change_1"] for r in windows.pct_change_features(df, ["x"], ["t"], ["k"]).orderBy("t").collect()]
    assert got == [0.0, 0.0, None, 0.0, -0.5]
    row = windows.entity_profile(df, "k", "t", ["x"]).first()
    assert (row["x__first"], row["x__last"], row["x__median"], row["x__count"]) == (0.0, 5.0, 5.0, 4)


def test_mode_and_top_categories_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "c string")
    assert one(ranking.modes(df, ["c"])) == [("c", "a")]
    assert one(ranking.top_categories(df, "c", 3)) == [("a", 2), ("b", 2), (None, 1)]


def test_pages_cover_everything_once(spark):
    df = spark.range(11).withColumn("lift", F.col("id") % 3)
    pages = [ranking.paginate(df, p, 4, ties=["id"]) for p in (1, 2, 3)]
    assert sorted(r["id"] for p in pages for r in p.rows.collect()) == list(range(11))
    assert [(p.has_previous, p.has_next, p.pages) for p in pages] == [(False, True, 3), (True, True, 3), (True, False, 3)]
    with pytest.raises(ValueError):
        ranking.paginate(df, 1, 4, sort_by="id")


def test_importance_selection(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.2)], "feature string, importance double")
    assert [r[0] for r in ranking.select_by_importance(df, top_k=2).collect()] == ["b", "a"]
    assert ranking.select_by_importance(df, threshold=0.3).count() == 1
    with pytest.raises(ValueError):
        ranking.select_by_importance(df, 1, 0.5)


def test_bins_are_right_open_and_keep_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    cuts = encode.bin_splits(df, ["x"], 5)["x"]
    assert cuts == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    got = {r["x"]: r["x_binned"] for r in encode.quantile_bin(df, ["x"]).collect()}
    assert got[2.0] == 1.0 and got[10.0] == 4.0 and got[None] is None
    same = spark.createDataFrame([(1.0,)] * 3, "x double")
    assert encode.quantile_bin(same, ["x"]).columns == ["x"]


def test_generated_features_leave_the_target_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, "u", 0), (3.0, 4.0, "v", 1)], "a double, b double, s string, y int")
    made = encode.plan_features(df, exclude=["y"])
    assert all("y" not in f.spec.inputs for f in made)
    spec = made[0].spec
    assert FeatureSpec.from_json(spec.to_json()) == spec


def test_unseen_categories_are_zeros(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, x double")
    out, model = encode.one_hot_assemble(df, ["c"], ["x"])
    assert encode.vector_names(out) == ["c_a", "c_b", "x"]
    fresh = spark.createDataFrame([("z", 5.0), (None, 6.0)], "c string, x double")
    assert [list(r["features"].toArray()) for r in model.transform(fresh).collect()] == [[0, 0, 5], [0, 0, 6]]


def test_prepare_reuses_fitted_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (3.0, None), (100.0, "a")], "x double, c string")
    fitted = prep.fit_prepare(df, ["x"], ["c"], prep.PrepOptions(rare_threshold=0.3))
    fresh = spark.createDataFrame([(None, None), (1e6, "zzz")], "x double, c string")
    got = one(fitted.apply(fresh))
    assert got[0][:2] == (2.0, "a") and got[1][0] < 10 and got[1][1] == "RARE"
    assert {r["kind"] for r in fitted.parameters(df).collect()} == {"impute", "cap", "scale"}


def test_columns_without_spread_are_not_scaled(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "same double, x double")
    for method in ("standard", "minmax", "robust"):
        assert "same" not in prep.fit_scale(df, ["same", "x"], method).params


def test_rare_values_are_the_same_by_broadcast_and_by_sorting(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 2 + ["c", None]], "v string")
    inline = sorted(one(prep.group_rare(df, ["v"], 0.2)), key=str)
    monkeypatch.setattr("gleaner.plans.lookup.BROADCAST_CELLS", 0)
    monkeypatch.setattr("gleaner.plans.lookup.GROUP_ROWS", 3)
    assert sorted(one(prep.group_rare(df, ["v"], 0.2)), key=str) == inline
    assert inline.count(("RARE",)) == 1 and (None,) in inline


def test_quality_of_constant_and_duplicates(spark):
    df = spark.createDataFrame([("k", 1.0)] * 8 + [("k", 2.0)] * 2, "g string, x double")
    assert quality.quality_score(df).first()["quality_score"] == 88.0  # duplicates 10, constant 2
    assert one(quality.quality_issues(df)) == [("g", "single_value", "high")]
    empty = df.limit(0)
    assert quality.missing_report(empty).count() == 2 and quality.quality_score(empty).first()["quality_score"] == 100.0


def test_outliers_without_spread_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "x double, y double")
    assert [r["column"] for r in quality.outlier_report(df, "iqr").collect()] == ["x"]


def test_profile_sample_and_targets(spark):
    df = spark.range(500).withColumn("c", (F.col("id") % 12).cast("string")).withColumn("y", F.col("id") % 2 == 0)
    taken, info = profile.profile_sample(df, 100)
    row = info.first()
    assert row["sampled"] and row["profiled_rows"] == taken.count() <= 110
    check = lambda *a, **k: profile.validate_target(df, Problem(*a, **k))
    assert check("y") == [] and check("id", REGRESSION) == []
    assert "12 classes" in check("c")[0] and "not found" in check("nope")[0]
    assert check("c", REGRESSION) and "not temporal" in check("y", CLASSIFICATION, None, "c")[0]
    assert set(profile.full_profile(df)) == {"sample", "summary", "variables", "missing", "alerts", "recommendations"}


def test_a_profile_takes_exactly_the_rows_asked_for(spark):
    df = spark.range(9000, numPartitions=7)
    taken, info = profile.profile_sample(df, 1001)
    ids = [r["id"] for r in taken.collect()]
    assert tuple(info.first()) == (True, 9000, 1001, 1001 / 9000) and len(set(ids)) == 1001
    assert 4000 < np.mean(ids) < 5000 and max(ids) > 8500
    assert sorted(ids) == sorted(r["id"] for r in profile.profile_sample(df, 1001)[0].collect())
    assert profile.profile_sample(df, 9000)[1].first()["sampled"] is False


def test_detects_a_time_series(spark):
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id div 5 as int))")
    df = spark.range(200).withColumn("created", day).withColumn("user_id", (F.col("id") % 5).cast("string")).drop("id")
    info = temporal.detect(df)
    assert info.is_time_series and info.frequency == "daily" and info.entity_columns == ("user_id",)
    assert "lag_features 7" in info.recommended and info.warnings == ("low_time_uniqueness",)
    assert not temporal.detect(spark.range(3)).is_time_series


# insights


@pytest.fixture(scope="module")
def mined(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        x, z, c = float(rng.integers(0, 20)), float(rng.integers(0, 8)), rng.choice(["p", "q", None])
        rows.append((x, z, c, int(x >= 12 and z < 3 or rng.random() < 0.1)))
    return spark.createDataFrame(rows, "x double, z double, c string, y int").repartition(5).persist(), rows


def test_insights_against_counting(mined):
    df, rows = mined
    goal = insights.goal_of(df, Problem("y", CLASSIFICATION, 1))
    found = insights.all_insights(df, Problem("y", CLASSIFICATION, 1), insights.Limits(0.0, 0.0), goal=goal).collect()
    base = sum(r[3] for r in rows) / len(rows)
    for r in found:
        at = {"x": 0, "z": 1, "c": 2}[r["feature"]]
        test = {">=": lambda v: v >= r["number"], "<": lambda v: v < r["number"], "=": lambda v: v == r["text"], "null": lambda v: v is None}[r["op"]]
        inside = [row[3] for row in rows if test(row[at])]
        rate = sum(inside) / len(inside) if inside else 0.0
        assert r["support_count"] == len(inside) and r["lift"] == pytest.approx(rate / base)
        assert -1e-12 <= r["rig"] <= 1
    by_value = [r["support"] for r in found if r["feature"] == "c"]
    assert sum(by_value) == pytest.approx(1) and any(r["op"] == "null" for r in found)


def test_insights_do_not_depend_on_partitioning(mined):
    df, _ = mined
    p = Problem("y", CLASSIFICATION, 1)
    a, b = (sorted(map(str, insights.all_insights(d, p).collect())) for d in (df, df.repartition(1).orderBy("z")))
    assert a == b and a


def test_missing_class_means_the_minority(mined, spark):
    df, rows = mined
    assert insights.goal_of(df, Problem("y")).positives == min(sum(r[3] for r in rows), sum(1 - r[3] for r in rows))
    tied = spark.createDataFrame([("b",), ("a",)], "y string")
    assert insights.goal_of(tied, Problem("y")).label == "a"


def test_constant_column_has_no_insight(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert insights.all_insights(df, Problem("y", CLASSIFICATION, 1)).count() == 0


def test_microsegments_against_counting(mined):
    df, rows = mined
    problem = Problem("y", CLASSIFICATION, 1)
    goal = insights.goal_of(df, problem)
    single = insights.all_insights(df, problem, insights.Limits(0.01, 1.0), goal=goal)
    top = insights.conditions_of(single, 20)
    place = {"x": 0, "z": 1, "c": 2}
    holds = lambda c, r: {">=": lambda v: v >= c.number, "<": lambda v: v < c.number, "=": lambda v: v == c.text, "null": lambda v: v is None}[c.op](r[place[c.feature]])
    base, expected = sum(r[3] for r in rows) / len(rows), {}
    for depth in (2, 3):
        usable = top
        for combo in itertools.combinations(range(len(usable)), depth):
            if len({usable[i][0].feature for i in combo}) < depth:
                continue
            inside = [r[3] for r in rows if all(holds(usable[i][0], r) for i in combo)]
            if len(inside) >= 0.01 * len(rows) and sum(inside) / len(inside) / base > max(usable[i][1] for i in combo) * (1.1 + 0.05 * (depth - 2)):
                expected[tuple(usable[i][0] for i in combo)] = len(inside)
    got = microsegments.microsegments(df, single, goal, 3, 20).collect()
    assert {tuple(Condition(*c) for c in r["conditions"]): r["support_count"] for r in got} == expected and expected
    steps = list(microsegments_by_depth(df, single, goal, 3, 20))
    assert sum(s.count() for _, s in steps) == len(expected) and [d for d, _ in steps] == sorted(d for d, _ in steps)


def test_no_number_of_combinations_is_left_out(spark):
    """Forty conditions on forty features that all hold everywhere: every combination has full support."""
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    conditions = [(Condition(f"f{i}", ">=", number=0.0), 1.0) for i in range(40)]
    df = df.select("x", *[(F.col("x") + i).alias(f"f{i}") for i in range(40)])
    goal = insights.Goal(F.col("x") >= 25, "up", 50, 25)
    levels = dict(microsegments.counted_levels(df, conditions, goal, 4, 0.01))
    assert [levels[d].count() for d in (2, 3, 4)] == [math.comb(40, d) for d in (2, 3, 4)]
    assert {tuple(r) for level in levels.values() for r in level.select("n", "pos").distinct().collect()} == {(50, 25)}


def test_levels_of_many_jobs_and_no_conditions(mined, monkeypatch):
    df, _ = mined
    problem = Problem("y", CLASSIFICATION, 1)
    goal = insights.goal_of(df, problem)
    single = insights.all_insights(df, problem, insights.Limits(0.01, 1.0), goal=goal)
    shown = lambda: sorted((tuple(r["combo"]), r["support_count"], r["lift"]) for r in microsegments.microsegments(df, single, goal, 3).collect())
    whole = shown()
    monkeypatch.setattr(microsegments, "COMBINATIONS_PER_JOB", 150)
    assert shown() == whole and whole
    assert microsegments.microsegments(df, single.limit(0), goal).collect() == []


def test_more_conditions_than_one_word(mined):
    df, rows = mined
    goal = insights.goal_of(df, Problem("y", CLASSIFICATION, 1))
    conditions = [Condition("x", ">=", number=i / 4) for i in range(100)]
    combos = [(0, 99), (61, 62), (5, 70)]
    got = {tuple(r["combo"]): (r["n"], r["pos"]) for r in microsegments.combination_counts(df, conditions, combos, goal.positive).collect()}
    for combo in combos:
        inside = [r[3] for r in rows if all(r[0] >= j / 4 for j in combo)]
        assert got.get(combo, (0, 0)) == (len(inside), sum(inside))


def test_store_filters_what_it_computed_once(mined):
    df, _ = mined
    problem = Problem("y", CLASSIFICATION, 1)
    store = insights.InsightStore.build(df, problem)
    direct = insights.in_order(insights.all_insights(df, problem, insights.Limits(0.1, 1.2)))
    assert [tuple(r) for r in store.query(0.1, 1.2, None).collect()] == [tuple(r) for r in direct.collect()]


# labels


def test_labels_of_a_sparse_history(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(1, at(0), 1.0), (1, at(8), 2.0), (1, at(21), 4.0), (2, at(0), 9.0)]
    events = spark.createDataFrame(rows, "e int, t timestamp_ntz, v double")
    w = labels.LabelWindow("e", "t", "7 days", minimum_data="7 days")
    got = one(labels.make_labels(events, w, [labelers.event_count(), labelers.churn(), labelers.total_spend("v")]).orderBy("cutoff_time"))
    assert got == [(1, at(7), 1, 0, 2.0), (1, at(14), 0, 1, 0.0), (1, at(21), 1, 0, 4.0)]
    gapped = labels.LabelWindow("e", "t", "7 days", gap="7 days", minimum_data="1 day", num_examples=1)
    assert one(labels.make_labels(events, gapped)) == [(1, at(1), 1)]
    assert labels.cutoff_times(events.limit(0), w).count() == 0


# models


def test_classification_metrics_and_auc(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.8), (0, 0, 0.1)], "label int, prediction int, score double")
    row = evaluate.classification_metrics(df, score="score").first()
    assert row["accuracy"] == pytest.approx(0.6) and row["recall"] == pytest.approx(0.6)
    assert row["auc"] == pytest.approx((3 + 1.5) / 6)
    assert evaluate.exact_auc(df.filter("label = 1"), "label", "score").first()["auc"] is None


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), rng.choice(["u", "v", "w"])) for i in range(400)]
    rows = [(*r, float(r[1] > 0.3 and r[2] < 2 or r[3] == "u")) for r in rows]
    df = spark.createDataFrame(rows, "id int, x double, z double, c string, label double")
    ready, _ = encode.one_hot_assemble(df, ["c"], ["x", "z"])
    return ready.select("id", "label", "features").persist(), encode.vector_names(ready)


@pytest.mark.parametrize("name", ["boosted_trees", "decision_tree", "random_forest"])
@pytest.mark.parametrize("kind", [CLASSIFICATION, REGRESSION])
def test_contributions_add_up(spark, learned, name, kind):
    df, names = learned
    model = train.estimator(name, kind, trees=train.TreeSettings(rounds=6)).fit(df)
    trees = explain.read_trees(spark, model)
    explained = explain.contributions(df, trees, ["id"])
    total = explained.select("id", (F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base_value")).alias("total"))
    predictions = model.transform(df)
    if kind == REGRESSION:
        raw = predictions.select("id", F.col("prediction").alias("raw"))
    else:
        scored = train.positive_score(predictions)
        raw = scored.select("id", (F.log(F.col("score") / (1 - F.col("score"))) if name == "boosted_trees" else F.col("score")).alias("raw"))
    worst = total.join(raw, "id").agg(F.max(F.abs(F.col("total") - F.col("raw")))).first()[0]
    assert worst < 1e-6


def test_contributions_are_shapley_values(spark, learned):
    """Against the definition: average marginal effect over all orders of the features."""
    df, names = learned
    model = train.estimator("decision_tree", REGRESSION).fit(df)
    trees = explain.read_trees(spark, model)

    def expected(x, known, node=0):
        n = trees.nodes[0][node]
        if n.feature < 0:
            return n.value
        if n.feature in known:
            left = x[n.feature] <= n.threshold if n.categories is None else x[n.feature] in n.categories
            return expected(x, known, n.left if left else n.right)
        parts = [(trees.nodes[0][c].cover / n.cover) * expected(x, known, c) for c in (n.left, n.right)]
        return sum(parts)

    rows = explain.contributions(df.limit(5), trees, ["id"]).collect()
    for r in rows:
        x, m = r["values"], len(names)
        for i in range(m):
            effects = []
            for order in itertools.permutations(range(m)):
                before = set(order[: order.index(i)])
                effects.append(expected(x, before | {i}) - expected(x, before))
            assert r["contributions"][i] == pytest.approx(np.mean(effects), abs=1e-9)


def test_splits_and_explanations(spark, learned):
    df, names = learned
    model = train.estimator("boosted_trees", CLASSIFICATION, trees=train.TreeSettings(rounds=3)).fit(df)
    trees = explain.read_trees(spark, model)
    splits = explain.split_impact(spark, trees, names)
    impact = explain.feature_impact(splits).collect()
    assert sum(r["num_splits"] for r in impact) == splits.count() and {r["feature"] for r in impact} <= set(names)
    long = explain.explain_rows(explain.contributions(df.filter("id = 7"), trees, ["id"]), names, ["id"], top=2)
    assert long.count() == len(names) and long.filter("in_top").groupBy("direction").count().agg(F.max("count")).first()[0] <= 2
    assert explain.feature_importances(spark, model, names).first()["importance"] > 0


def test_search_gives_every_row_one_prediction(learned):
    df, _ = learned
    found = search.model_search(df, CLASSIFICATION, ["id"], quick=True, grids={"decision_tree": {"maxDepth": [1, 4]}})
    assert found.best_params == {"maxDepth": 4} and found.metric == "auc"
    assert found.out_of_fold.count() == 400 == found.out_of_fold.select("id").distinct().count()


def test_baselines_and_saved_models(spark, learned, tmp_path):
    df, names = learned
    runs, models = train.train_all_baselines(df, df, CLASSIFICATION, ("naive", "linear", "decision_tree"))
    best = compare.best_baseline(runs, "accuracy").first()
    assert best["name"] == "decision_tree" and runs.count() == 3 and best["num_features"] == len(names)
    assert runs.filter("name = 'naive'").first()["auc"] == 0.5
    path = str(tmp_path / "m")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["label"], outputCol="v")]).fit(df)
    saved.save_model(pipeline, path)
    assert saved.load_model(path).transform(df).columns[-1] == "v"


def test_segments_missing_on_one_side(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0), ("c", 1, 5.0)]
    df = spark.createDataFrame(rows, "g string, late int, m double")
    out = segments.analyze_segments(df, segments.mean_metric("m"), "m", ["g"], F.col("late") == 0, F.col("late") == 1)
    got = {r["segment"]: r for r in out.collect()}
    assert got["g:b"]["size_comparison"] is None and got["g:c"]["m_baseline"] is None and got["g:c"]["impact"] is None
    assert got["g:a"]["impact"] == pytest.approx((3 - 1) / (4 - 1) * 0.5)


# streams and shared folders


def test_row_features_work_on_a_stream(spark, nulls, tmp_path):
    nulls.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(nulls.schema).parquet(str(tmp_path / "s"))
    step = prep.fit_iqr(nulls, ["a"])
    wide = prep.apply_step(add_features(stream.filter(all_of([Filter("id", "greater_than", (1,))])), rowwise.transforms(["a"])), step)
    q = wide.writeStream.format("memory").queryName("features").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("features").count() == 3


def test_written_tables_go_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    before = set(os.listdir(folder))
    assert written(spark.range(3)).count() == 3
    assert len(set(os.listdir(folder)) - before) == 1


def test_specs_are_plain_json():
    assert json.loads(FeatureSpec("a", "log", ("x",)).to_json())["inputs"] == ["x"]


def test_a_second_cutoff_changes_no_other_row(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    users = spark.createDataFrame([(1, 2.5), (2, 1.0), (3, 0.5)], "u long, w double")
    orders = spark.createDataFrame([(i, 1 + i % 3, t(1 + i), 10 * i, "ab"[i % 2]) for i in range(20)], "o long, u long, t timestamp_ntz, x long, s string")
    lines = spark.createDataFrame([(i, i % 20, float(i)) for i in range(60)], "l long, o long, q double")
    links = (synthesis.Relationship("users", "u", "orders", "u"), synthesis.Relationship("orders", "o", "lines", "o"))
    es = synthesis.EntitySet({"users": users, "orders": orders, "lines": lines}, {"users": "u", "orders": "o", "lines": "l"}, links, {"orders": "t"})
    cuts = [(1, t(10)), (2, t(12)), (3, t(15))]
    plan = synthesis.Synthesis("users", transforms=("cum_sum",), max_depth=2)
    one, two = (synthesis.dfs_multi(es, plan, spark.createDataFrame(c, "u long, cutoff_time timestamp_ntz")) for c in (cuts, [*cuts, (3, t(18))]))
    assert one.dtypes == two.dtypes and len(one.columns) > 12
    rows = lambda df: {(r["u"], r["cutoff_time"]): tuple(r) for r in df.collect()}
    first, second = rows(one), rows(two)
    assert len(second) == 4 and all(second[k][:-1] == v[:-1] for k, v in first.items())
    assert second[3, t(18)][one.columns.index("COUNT(orders)")] > second[3, t(15)][one.columns.index("COUNT(orders)")]


def test_asof_types_do_not_follow_the_cutoffs(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, t(2), 2**60 + 1), (1, t(3), 1), (2, t(2), 5)], "k long, t timestamp_ntz, x long")
    wanted = [("s", "sum", "x"), ("lo", "min", "x"), ("m", "mean", "x"), ("n", "count", "k")]
    made = [asof.asof_aggregate(rows, "k", "t", spark.createDataFrame(c, "k long, c timestamp_ntz"), "k", "c", wanted) for c in ([(1, t(5))], [(1, t(5)), (1, t(9))])]
    assert made[0].dtypes == made[1].dtypes
    assert {r["s"] for m in made for r in m.collect()} == {2**60 + 2}


def test_pages_are_the_same_in_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "id int, lift double").repartition(4)
    page = lambda p: sorted(map(tuple, ranking.paginate(df, p, 7).rows.collect()), key=lambda r: r[-1])
    near = [page(p) for p in range(1, 8)]
    monkeypatch.setattr(ranking, "TOP_ROWS", 0)
    assert [page(p) for p in range(1, 8)] == near and sum(map(len, near)) == 40


def test_registered_models_are_whole(spark, monkeypatch):
    """Registered boosted trees take the operator's rounds, and the searches all families, grids and folds."""
    import inspect

    from catalog import modelling

    assert inspect.signature(search.model_search).parameters["rounds"].default == train.TreeSettings().rounds == 100
    asked = []

    class Asked(Exception):
        pass

    def noted(*args, **named):
        asked.append(named)
        raise Asked

    for owner, name in ((train, "estimator"), (search, "model_search"), (compare, "compare_feature_sets")):
        monkeypatch.setattr(owner, name, noted)
    for query in (modelling.q1, modelling.q17, modelling.q16, modelling.q16_oof):
        with pytest.raises(Asked):
            query(spark, "/root/testdata/sf0.001")
    assert [a["trees"].rounds for a in asked[:2]] == [100, 100] and asked[2:] == [{}, {}]


def _shop_at_cutoffs(spark, line_time):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rng = np.random.default_rng(6)
    users = [(u, float(u)) for u in range(4)]
    orders = [(o, int(rng.integers(0, 3)), t(int(rng.integers(0, 40))), float(rng.integers(0, 9)), "abc"[o % 3]) for o in range(60)]
    lines = [(i, int(rng.integers(0, 60)), t(int(rng.integers(0, 40))), float(rng.integers(1, 6))) for i in range(150)]
    visits = [(v, int(rng.integers(0, 4)), float(v % 5)) for v in range(30)]
    es = synthesis.EntitySet(
        {
            "users": spark.createDataFrame(users, "u long, w double"),
            "orders": spark.createDataFrame(orders, "o long, u long, t timestamp_ntz, x double, s string"),
            "lines": spark.createDataFrame(lines, "l long, o long, lt timestamp_ntz, q double"),
            "visits": spark.createDataFrame(visits, "v long, u long, y double"),
        },
        {"users": "u", "orders": "o", "lines": "l", "visits": "v"},
        tuple(synthesis.Relationship(*r) for r in (("users", "u", "orders", "u"), ("orders", "o", "lines", "o"), ("users", "u", "visits", "u"))),
        {"orders": "t"} | ({"lines": "lt"} if line_time else {}),
    )
    cuts = [(u, t(d)) for u in range(4) for d in range(1, 41, 3)]
    return es, cuts, orders, lines, visits


@pytest.mark.parametrize("line_time", [False, True])
@pytest.mark.parametrize("window", [None, "9 days"])
def test_features_at_many_cutoffs_against_counting(spark, line_time, window):
    es, cuts, orders, lines, visits = _shop_at_cutoffs(spark, line_time)
    plan = synthesis.Synthesis("users", ("mean", "sum", "max", "count", "num_unique"), ("add",), training_window=window)
    made = synthesis.dfs_multi(es, plan, spark.createDataFrame(cuts, "u long, cutoff_time timestamp_ntz"))
    got = {(r["u"], r["cutoff_time"]): r for r in made.collect()}
    assert len(got) == len(cuts)
    span = dt.timedelta(days=9) if window else dt.timedelta(days=9999)
    seen = lambda at, cut: cut - span < at <= cut
    for u, cut in cuts:
        mine = [o for o in orders if o[1] == u and seen(o[2], cut)]
        per = {o[0]: [x[3] for x in lines if x[1] == o[0] and (not line_time or seen(x[2], cut))] for o in mine}
        r = got[u, cut]
        assert r["COUNT(orders)"] == len(mine) and r["NUM_UNIQUE(orders.s)"] == len({o[4] for o in mine})
        assert r["SUM(orders.COUNT(lines))"] == (sum(len(v) for v in per.values()) if mine else None)
        filled = [sum(v) for v in per.values() if v]
        assert r["MAX(orders.SUM(lines.q))"] == (max(filled) if filled else None)
        assert r["MEAN(orders.x)"] == (pytest.approx(sum(o[3] for o in mine) / len(mine)) if mine else None)
        assert r["SUM(visits.y)"] == (sum(v[2] for v in visits if v[1] == u) if any(v[1] == u for v in visits) else None)
        both = r["COUNT(orders) + SUM(visits.y)"]
        assert both == (None if r["SUM(visits.y)"] is None else r["COUNT(orders)"] + r["SUM(visits.y)"])


def test_rows_do_not_multiply_with_cutoffs(spark, monkeypatch):
    """Child rows are stacked and written once, however many cutoffs there are; no table of a row per cutoff is made."""
    es, cuts, *_ = _shop_at_cutoffs(spark, False)
    kept = []
    whole = synthesis.written

    def noted(df):
        out = whole(df)
        kept.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(synthesis, "written", noted)
    plan = synthesis.Synthesis("users", ("mean", "count"), ())
    synthesis.dfs_multi(es, plan, spark.createDataFrame(cuts, "u long, cutoff_time timestamp_ntz")).collect()
    assert [n for columns, n in kept if "t" in columns] == [60]


def test_depths_of_stacked_transforms(spark):
    es, *_ = _shop_at_cutoffs(spark, False)
    names = lambda depth, **more: synthesis.dfs_multi(es, synthesis.Synthesis("users", ("sum",), ("multiply",), max_depth=depth, **more)).columns
    one, two = names(1), names(2)
    assert not any("*" in n for n in one) and "w * SUM(orders.x)" in two
    assert "SUM(orders.SUM(lines.q))" in two and not any("*" in n and "SUM(orders.SUM" in n for n in two)
    three = names(3)
    assert "SUM(orders.x * SUM(lines.q))" in three and "SUM(orders.x) * SUM(orders.SUM(lines.q))" in three and len(set(three)) == len(three)
    assert names(3, names=("SUM(orders.x * SUM(lines.q))",)) == ["u", "SUM(orders.x * SUM(lines.q))"]


def test_pearson_against_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 30)) @ rng.normal(size=(30, 30)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(30)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`c.{i}` double" for i in range(30))).repartition(5)
    expected = pdf.corr()
    for most in (None, 1):
        if most:
            monkeypatch.setattr("gleaner.plans.sums.SUMS_BYTES", most)
        got = profile.pearson(df, list(pdf.columns)).collect()
        assert len(got) == 435
        for r in got:
            if "c.4" in (r["a"], r["b"]):
                assert r["correlation"] is None
            else:
                assert r["correlation"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-9)
    assert profile.pearson(df, ["c.0"]).collect() == [] and profile.pearson(df.limit(0), ["c.0", "c.1"]).first()["correlation"] is None


def test_percentiles_of_many_columns_take_as_many_jobs(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(float(v) for v in rng.integers(0, 9, 12)) for _ in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(12)))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(columns):
        group = f"percentile-{len(columns)}"
        context.setJobGroup(group, "")
        made = windows.percentile_features(df, columns)
        context.setJobGroup("other", "")
        return made, len(tracker.getJobIdsForGroup(group))

    (few, a), (many, b) = jobs(["c0", "c1"]), jobs(df.columns)
    assert a == b
    pdf = pd.DataFrame(rows, columns=df.columns)
    got = many.toPandas()
    for c in df.columns:
        assert sorted(got[f"{c}_percentile"]) == pytest.approx(sorted(pdf[c].rank() / len(pdf)))
    assert few.columns == [*df.columns, "c0_percentile", "c1_percentile"]


def test_totals_of_many_features_make_no_row_per_feature(spark):
    from catalog import features as made_of
    from gleaner.functions import rowwise

    df = spark.range(1, 4).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(1, 11)])
    features = rowwise.interactions(df.columns)
    totals = made_of._totals(df, features)
    assert "Generate" not in totals._jdf.queryExecution().executedPlan().toString()
    found = {r["feature"]: r["total"] for r in totals.collect()}
    assert len(found) == len(features) == 180
    assert found["c2_mult_c3"] == 84_000 and found["c1_sub_c10"] == -54_000 and found["c1_div_c2"] == 1500
    assert made_of._totals(df.limit(0), features).collect() == []


def test_distinct_counts_do_not_copy_the_other_aggregates(spark):
    parents = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "p long, own double")
    rows = [(1, 1, 2.5, "a", "x"), (2, 1, 3.5, "a", "y"), (3, 2, 1.0, None, "z"), (4, 1, 1.5, "b", None)]
    children = spark.createDataFrame(rows, "c long, p long, amount double, first string, second string")
    es = synthesis.EntitySet({"up": parents, "down": children}, {"up": "p", "down": "c"}, (synthesis.Relationship("up", "p", "down", "p"),), {})
    made = synthesis.dfs_multi(es, synthesis.Synthesis("up", transforms=(), max_depth=1))
    copied = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Expand" in line]
    assert copied and not any("amount" in line for line in copied)
    found = {r["p"]: r.asDict() for r in made.collect()}
    names = ("COUNT(down)", "NUM_UNIQUE(down.first)", "NUM_UNIQUE(down.second)", "SUM(down.amount)")
    assert [tuple(found[p][n] for n in names) for p in (1, 2, 3)] == [(3, 2, 2, 7.5), (1, 0, 1, 1.0), (0, 0, 0, None)]
