"""Features of a series are added up in its order, not in that of the files."""

from gleaner.operators import tsfeatures


def test_features_follow_time_and_not_rows(spark):
    values = [1e16, 1.0, -1e16, 3.0]  # added up in this order 3, backwards 4
    rows = [(1, t, v) for t, v in enumerate(values)]
    for given in (rows, rows[::-1]):
        events = spark.createDataFrame(given, "u bigint, t int, v double").coalesce(1)
        made = tsfeatures.ts_features(events, "u", "t", ["v"], "efficient").first()
        assert (made["v__sum_values"], made["v__mean"]) == (3.0, 0.75)
