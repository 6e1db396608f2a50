"""Groups of Python functions: whole ones, however batches cut them, with keys and types as they are."""

import datetime as dt

import pandas as pd
import pytest

from gleaner.operators.grouped import combine_per_group, measure_per_group


@pytest.mark.parametrize("batch", [3, 10_000])
def test_groups_over_batches(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        big = 2**62 + 1  # no double
        rows = [(big, i, float(i)) for i in range(20)] + [(None, None, 5.0), (None, 3, 6.0), (7, 1, None)]
        df = spark.createDataFrame(rows, "k bigint, i bigint, v double")
        part = lambda g: {"n": float(len(g)), "s": g["v"].sum(), "w": float(g["i"].dtype == "int64")}
        whole = lambda p: {"n": p["n"].sum(), "s": p["s"].sum(), "w": p["w"].min()}
        for limit in (5, 100):
            made = measure_per_group(df, ["k"], part, whole, ["n", "s", "w"], ["n", "s", "w"], limit)
            assert {tuple(r) for r in made.collect()} == {(big, 20.0, 190.0, 1.0), (None, 2.0, 11.0, 0.0), (7, 1.0, 0.0, 1.0)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_few_calls_for_many_small_groups(spark, tmp_path):
    def partial(pdf):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        return pdf.groupby("k", as_index=False).agg(n=("t", "count"))

    df = spark.range(3000).selectExpr("id % 1000 AS k", "timestamp_seconds(id) AS t")
    made = combine_per_group(df, ["k"], partial, "k long, n long", lambda p: p.groupby("k", as_index=False).sum(), "k long, n long", many=True)
    assert {r["n"] for r in made.collect()} == {3} and made.count() == 1000
    assert (tmp_path / "calls").stat().st_size < 100


def test_times_are_those_of_the_session(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12))], "k bigint, t timestamp")
    part = lambda g: {"h": float(pd.Timestamp(g["t"].iloc[0]).hour)}
    made = measure_per_group(df, ["k"], part, lambda p: {"h": p["h"].max()}, ["h"], ["h"])
    assert made.first()["h"] == df.selectExpr("hour(t)").first()[0]
