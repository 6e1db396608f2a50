"""Sums at a cut: what rows add up to must not depend on their order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.functions import labelers
from gleaner.functions.sums import exact_mean, exact_sum
from gleaner.operators import labels


@pytest.mark.parametrize("how, cut", [("sum", 1.0), ("mean", 0.1)])
def test_a_label_at_its_cut(spark, how, cut):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [(1, at(n), 0.1) for n in range(11)]  # the first lies before the cutoff; doubles give 0.9999999999999999
    events = spark.createDataFrame(rows, "u bigint, t timestamp_ntz, v double").coalesce(1)
    w = labels.LabelWindow("u", "t", "30 days", minimum_data="1 hours")
    made = labels.make_labels(events, w, [labelers.threshold("v", cut, how), labelers.total_spend("v"), labelers.average_value("v")])
    assert tuple(made.first())[2:] == (1, 1.0, 0.1)


def test_numbers_without_a_short_decimal_form(spark):
    def found(values):
        return tuple(spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum(F.col("x")), exact_mean(F.col("x"))).first())

    assert found([1e300, 1e300]) == (2e300, 1e300) and found([1e-20, None]) == (1e-20, 1e-20) and found([None, None]) == (None, None)
    assert found([float("inf"), 1.0])[0] == float("inf") and str(found([float("nan"), 1.0])[0]) == "nan"
    assert found([1e25, 1e25, 1.0])[0] == pytest.approx(2e25)
