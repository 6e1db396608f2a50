"""Last digits: running sums do not lose small values, and results are rounded as SQL rounds."""

from pyspark.sql import functions as F

from catalog import rounded
from gleaner.operators import windows


def test_running_sums_keep_small_values(spark):
    rows = [(0, 2.0**53), (1, 1.0), (2, 1.0), (3, 1.0), (4, None), (5, 1.0)]  # doubles from 2 ** 53 on are two apart
    for limit in (2, 100):
        made = windows.cumulative_features(spark.createDataFrame(rows, "i int, v double"), ["v"], ["i"], limit=limit)
        assert [r[0] for r in made.orderBy("i").select("v_cum_sum").collect()] == [2.0**53, 2.0**53, 2.0**53 + 2, 2.0**53 + 4, None, 2.0**53 + 4]


def test_running_sums_of_infinities(spark):
    rows = [(0, 1.5), (1, float("inf")), (2, 2.0)]
    made = windows.cumulative_features(spark.createDataFrame(rows, "i int, v double"), ["v"], ["i"])
    assert [r[0] for r in made.orderBy("i").select("v_cum_sum").collect()] == [1.5, float("inf"), float("inf")]


def test_rounding_a_last_bit_below_a_tie(spark):
    x = 47.472812499999996  # times a million, this is 47472812.5
    row = spark.range(1).select(rounded(F.lit(x), 6), rounded(F.lit(-x), 6), rounded(F.lit(None).cast("double"), 6)).first()
    assert x * 1e6 % 1 == 0.5 and tuple(row) == (47.472813, -47.472813, None)
