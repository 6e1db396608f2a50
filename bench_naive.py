"""Plain forms of some headline queries, to measure what the shared jobs save."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import insights as queries
from catalog import table
from gleaner.operators import insights


def insights_per_column(spark, d):
    """Quantiles, extremes, one wide aggregate per column, one grouped count per category."""
    df = queries._lines(spark, d).withColumn("__y", (F.col("l_returnflag") == "R").cast("int"))
    df.agg(F.count(F.lit(1)), F.sum("__y")).first()
    for c in queries.NUM:
        df.agg(F.min(c), F.max(c)).first()
        cuts = df.agg(F.percentile_approx(c, [i / 10 for i in range(1, 10)], 1_000_000)).first()[0]
        sides = [(F.col(c) >= t, F.col(c) < t) for t in sorted(set(cuts))]
        df.agg(*[a for pair in sides for s in pair for a in (F.sum(F.when(s, 1)), F.sum(F.when(s, F.col("__y"))))]).first()
    for c in queries.CAT:
        df.groupBy(c).agg(F.count(F.lit(1)), F.sum("__y")).collect()


def microsegments_per_batch(spark, d):
    """One aggregate of conditional sums per 50 combinations."""
    df = queries._micro_frame(spark, d)
    goal, found = queries._micro_insights(df)
    top = insights.conditions_of(found, 18)
    combos = [
        c
        for depth in (2, 3)
        for c in combinations(range(len(top)), depth)
        if len({top[i][0].feature for i in c}) == depth
    ]
    for at in range(0, len(combos), 50):
        aggs = []
        for c in combos[at : at + 50]:
            both = F.lit(True)
            for i in c:
                both = both & top[i][0].predicate()
            aggs += [F.sum(F.when(both, 1).otherwise(0)), F.sum(F.when(both, goal.positive).otherwise(0))]
        df.agg(*aggs).first()


def stats_per_column(spark, d):
    df = table(spark, d, "lineitem")
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]:
        df.select(c).distinct().count()
        df.agg(
            F.avg(c), F.stddev(c), F.min(c), F.max(c), F.skewness(c), F.kurtosis(c),
            F.percentile_approx(c, 0.25), F.percentile_approx(c, 0.5), F.percentile_approx(c, 0.75),
        ).first()


def summary_per_column(spark, d):
    df = table(spark, d, "lineitem")
    for c in ["l_quantity", "l_extendedprice", "l_linenumber"]:
        df.agg(F.countDistinct(c), F.count(c), F.avg(c), F.stddev(c), F.min(c), F.median(c), F.max(c)).first()


def series_features_on_the_driver(spark, d):
    """Entity series collected as one pandas frame."""
    pdf = table(spark, d, "events").select("user_id", "ts", "event_id", "value").toPandas().sort_values(["user_id", "ts", "event_id"])
    for _, g in pdf.groupby("user_id"):
        x = g["value"]
        x.agg(["sum", "mean", "std", "min", "max", "median", "skew", "kurt"])
        [x.autocorr(k) for k in (1, 2, 3)]
        x.quantile([0.1, 0.25, 0.75, 0.9])


def entity_windows(spark, d):
    """A window over the entity per statistic."""
    w = Window.partitionBy("user_id")
    df = table(spark, d, "events")
    for name, f in {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}.items():
        df = df.withColumn(name, f("value").over(w))
    df.write.format("noop").mode("overwrite").save()


FORMS = {
    "m1_numeric_insights": insights_per_column,
    "m8_microsegments": microsegments_per_batch,
    "k2_numeric_stats": stats_per_column,
    "d3_numerical_summary": summary_per_column,
    "p2_ts_features_efficient": series_features_on_the_driver,
    "e5_entity_stats": entity_windows,
}

