"""The ways for groups too large for one task, forced by tiny limits, against brute force in pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import asof, grouped, labels, tsfeatures, windows
from gleaner.operators.profile import spearman
from gleaner.plans import lookup as lookup_module
from gleaner.plans.ordered import look_back, running_totals
from gleaner.plans.quantiles import DISCRETE, LINEAR, group_quantiles, quantiles, value_ranks

LIMIT = 40


@pytest.fixture(scope="module")
def frame(spark):
    """Two thirds of the rows belong to key 1, some to null, the rest to small groups."""
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.66, 1, rng.integers(2, 30, n)).astype(float)
    key[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"i": np.arange(n), "k": key, "x": np.round(rng.normal(size=n), 1)})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    rows = [(int(i), None if np.isnan(k) else int(k), None if np.isnan(x) else float(x)) for i, k, x in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "i bigint, k bigint, x double").repartition(7)
    return df.persist(), pdf


def collect(df, by="i"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def plain_window(df, columns):
    return collect(df.select("*", *columns(Window.partitionBy("k").orderBy("i"))))


@pytest.mark.parametrize("limit", [7, LIMIT, 10**6])
def test_look_back_equals_plain_window(frame, limit):
    df, _ = frame
    columns = lambda w: [
        F.lag("x", 3).over(w).alias("a"),
        F.avg("x").over(w.rowsBetween(-5, -1)).alias("b"),
        F.lead("x", 2).over(w).alias("c"),
    ]
    got = collect(look_back(df, ["k"], ["i"], columns, 5, 2, limit))
    pd.testing.assert_frame_equal(got, plain_window(df, columns), check_dtype=False)


@pytest.mark.parametrize("limit", [7, LIMIT, 10**6])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals(frame, limit, keys):
    df, pdf = frame
    got = collect(running_totals(df, keys, ["i"], {"pos": F.lit(1).cast("bigint"), "total": F.coalesce("x", F.lit(0.0))}, limit))
    groups = pdf.assign(x=pdf.x.fillna(0), one=1, g=pdf.k.fillna(-1) if keys else 0).groupby("g")
    np.testing.assert_array_equal(got["pos"], groups["one"].cumsum())
    np.testing.assert_allclose(got["total"], groups["x"].cumsum(), atol=1e-9)


def test_running_totals_with_ties_are_a_permutation(frame):
    df, _ = frame
    got = running_totals(df, [], [F.lit(1)], {"pos": F.lit(1).cast("bigint")}, 20).toPandas()
    assert sorted(got["pos"]) == list(range(1, 601))


@pytest.mark.parametrize("kind", [DISCRETE, LINEAR])
@pytest.mark.parametrize("limit", [10, 10**6])
def test_quantiles(frame, kind, limit):
    df, pdf = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df.withColumn("same", F.lit(2.5)).withColumn("none", F.lit(None).cast("double")), ["x", "i", "same", "none"], probs, kind, limit)
    method = "inverted_cdf" if kind == DISCRETE else "linear"
    np.testing.assert_allclose(got["x"], np.quantile(pdf.x.dropna(), probs, method=method))
    np.testing.assert_allclose(got["i"], np.quantile(pdf.i, probs, method=method))
    assert got["same"] == [2.5] * 6 and got["none"] == [None] * 6


def test_direct_quantiles_are_exact_on_many_rows(spark):
    df = spark.range(0, 300_007, numPartitions=11).select((F.col("id") * 7919 % 300_007).cast("double").alias("x"))
    got = quantiles(df, ["x"], [0.001, 0.1, 0.5, 0.77, 0.999])["x"]
    assert got == [math.ceil(p * 300_007) - 1 for p in (0.001, 0.1, 0.5, 0.77, 0.999)]


def test_quantiles_do_not_depend_on_the_sample(frame, monkeypatch):
    import gleaner.plans.quantiles as q

    df, pdf = frame
    monkeypatch.setattr(q, "SAMPLE_ROWS", 3)
    assert quantiles(df, ["i"], [0.37], DISCRETE, 5)["i"] == [np.quantile(pdf.i, 0.37, method="inverted_cdf")]


def test_group_quantiles(frame):
    df, pdf = frame
    names = {"x": ["q25", "q50"]}
    wide, small = (group_quantiles(df, ["k"], ["x"], [0.25, 0.5], names, limit).toPandas().sort_values("k") for limit in (LIMIT, 10**6))
    pd.testing.assert_frame_equal(wide.reset_index(drop=True), small.reset_index(drop=True))
    hot = wide[wide.k == 1].iloc[0]
    np.testing.assert_allclose([hot.q25, hot.q50], np.quantile(pdf[pdf.k == 1].x.dropna(), [0.25, 0.5]))


def test_value_ranks_are_average_ranks(frame):
    df, pdf = frame
    got = value_ranks(df, "x", 10).toPandas().set_index("value")["avg_rank"]
    expected = pdf.x.dropna().rank().groupby(pdf.x).first()
    np.testing.assert_allclose(got.sort_index(), expected.sort_index())


def test_spearman(frame):
    df, pdf = frame
    both = df.withColumn("y", F.col("x") * F.col("x") + F.col("i") / 100).dropna()
    got = spearman(both, ["x", "y"], 10).first()["correlation"]
    known = pdf.dropna()
    assert got == pytest.approx(known.x.rank().corr((known.x**2 + known.i / 100).rank()))


@pytest.mark.parametrize("make", [windows.lag_features, windows.rolling_features, windows.diff_features, windows.pct_change_features, windows.cumulative_features])
def test_window_features_do_not_depend_on_the_limit(frame, make):
    df, _ = frame
    a, b = (collect(make(df, ["x"], ["i"], ["k"], limit=limit)) for limit in (25, 10**6))
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)


@pytest.mark.parametrize("mode", ["minimal", "efficient"])
def test_series_features_do_not_depend_on_the_limit(frame, mode):
    df, _ = frame
    a, b = (tsfeatures.ts_features(df, "k", "i", ["x"], mode, limit=limit).toPandas().sort_values("k").reset_index(drop=True) for limit in (30, 10**6))
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)


@pytest.mark.parametrize("window", [None, "3 hours"])
def test_asof_does_not_depend_on_the_limit(spark, frame, window):
    df, _ = frame
    at = lambda c: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col(c).cast("int")))
    rows = df.withColumn("t", at("i"))
    cuts = spark.range(0, 600, 50).crossJoin(spark.createDataFrame([(1,), (5,), (7,)], "k bigint")).select("k", at("id").alias("c"))
    wanted = [("n", "count", "k"), ("s", "sum", "x"), ("lo", "min", "x"), ("sd", "std", "x"), ("u", "num_unique", "x")]
    a, b = (asof.asof_aggregate(rows, "k", "t", cuts, "k", "c", wanted, window, limit).toPandas().sort_values(["k", "c"]).reset_index(drop=True) for limit in (20, 10**6))
    pd.testing.assert_frame_equal(a, b)
    direct = cuts.withColumnRenamed("k", "e").join(rows, (F.col("e") == F.col("k")) & (F.col("t") <= F.col("c")) & (F.col("t") > F.col("c") - F.expr(f"interval {window or '9 years'}")), "left")
    direct = direct.groupBy("e", "c").agg(F.count("k").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.stddev("x").alias("sd"), F.countDistinct("x").alias("u"))
    expected = direct.toPandas().sort_values(["e", "c"]).reset_index(drop=True).rename(columns={"e": "k"})
    pd.testing.assert_frame_equal(b, expected, check_dtype=False)


def test_bounded_python_groups(frame):
    df, pdf = frame
    largest = []

    def partial(p):
        largest.append(len(p))
        return pd.DataFrame({"k": [p.k.iloc[0]], "n": [len(p)], "most": [len(p)]})

    def finish(p):
        return pd.DataFrame({"k": [p.k.iloc[0]], "n": [p.n.sum()], "most": [p.most.max()]})

    got = grouped.combine_per_group(df.dropna(subset=["k"]), ["k"], partial, "k double, n long, most long", finish, "k double, n long, most long", LIMIT).toPandas()
    np.testing.assert_array_equal(got.sort_values("k").n, pdf.dropna(subset=["k"]).groupby("k").size())
    assert got.most.max() <= LIMIT


def test_measures_of_a_group_of_equal_rows(spark):
    """A group above the limit whose rows are all the same is still cut into slices."""
    df = spark.range(0, 500).select(F.lit(1).alias("k"), F.lit(2.0).alias("x")).unionByName(spark.createDataFrame([(2, 5.0)], "k int, x double"))
    part = lambda p: {"n": float(len(p)), "s": p.x.sum(), "most": float(len(p))}
    whole = lambda ps: {"mean": ps.s.sum() / ps.n.sum(), "n": ps.n.sum(), "most": ps.most.max()}
    got = {r.k: r for r in grouped.measure_per_group(df, ["k"], part, whole, ["n", "s", "most"], ["mean", "n", "most"], LIMIT).collect()}
    assert (got[1]["mean"], got[1]["n"], got[2]["mean"]) == (2.0, 500.0, 5.0) and got[1]["most"] <= LIMIT


def test_python_features_and_labels_of_hot_groups(spark, frame):
    df, pdf = frame
    part = lambda p: {"lo": p.x.min(), "hi": p.x.max()}
    whole = lambda ps: {"spread": ps.hi.max() - ps.lo.min()}
    got, one = (tsfeatures.ts_features_with(df.dropna(subset=["k"]), "k", part, whole, ["lo", "hi"], ["spread"], limit).toPandas().sort_values("k").reset_index(drop=True) for limit in (LIMIT, 10**6))
    pd.testing.assert_frame_equal(got, one)
    events = df.select("k", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("i").cast("int"))).alias("t"), "x").dropna()
    window = labels.LabelWindow("k", "t", "2 hours", minimum_data="1 hour")
    a, b = (labels.make_labels_with(events, window, part, lambda ps: ps.hi.max() - ps.lo.min(), ["lo", "hi"], limit=limit).toPandas().sort_values(["k", "cutoff_time"]).reset_index(drop=True) for limit in (LIMIT, 10**6))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) and a.label.notna().any()


@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_gives_the_same_rows_in_every_way(frame, monkeypatch, null_safe):
    df, _ = frame
    stats = df.groupBy("k").agg(F.avg("x").alias("a.b"))
    key = lambda r: str(tuple(r))
    expected = sorted(map(key, lookup_module.lookup(df, stats, ["k"], null_safe).collect()))
    monkeypatch.setattr(lookup_module, "BROADCAST_CELLS", 0)
    for limit in (LIMIT, 10**6):
        assert sorted(map(key, lookup_module.lookup(df, stats, ["k"], null_safe, limit).collect())) == expected


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_equal_rows_and_ties_come_in_one_order_in_every_way(spark, threshold):
    """All rows of a hot key equal, or tied in the order: slices stay small, and limits change nothing."""
    rows = [(1, 5, "same")] * 300 + [(1, 6, f"t{i % 7}") for i in range(60)] + [(2, 5, "other"), (2, 5, "another")]
    df = spark.createDataFrame(rows, "k int, o int, x string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for limit in (LIMIT, 10**6):
            totals = running_totals(df, ["k"], ["o"], {"n": F.lit(1).cast("bigint")}, limit=limit)
            back = look_back(df, ["k"], ["o"], lambda w: [F.lag("x").over(w).alias("p")], 1, limit=limit)
            made = sorted(map(tuple, totals.collect())), sorted(tuple(map(str, r)) for r in back.collect())
            first = made if limit == LIMIT else first
            assert made == first
        assert [n for k, *_, n in made[0] if k == 1] != [] and sorted(n for k, *_, n in made[0] if k == 1) == list(range(1, 361))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_slices_of_equal_rows_are_small(spark):
    from gleaner.plans import ordered

    df = spark.range(0, 5000).select(F.lit(1).alias("k"), F.lit(2).alias("o"))
    sliced, _ = ordered._in_slices(df, ["k"], [F.col("o")], 5000, 500)
    assert max(r["count"] for r in sliced.groupBy("__slice").count().collect()) <= 1000


def test_salted_lookup(frame, monkeypatch):
    df, _ = frame
    stats = df.groupBy("k").agg(F.avg("x").alias("m"))
    expected = sorted(str(tuple(r)) for r in lookup_module.lookup(df, stats, ["k"]).collect())
    monkeypatch.setattr(lookup_module, "BROADCAST_CELLS", 0)
    assert sorted(str(tuple(r)) for r in lookup_module.lookup(df, stats, ["k"], limit=LIMIT).collect()) == expected
