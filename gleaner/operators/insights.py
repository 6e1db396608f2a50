"""Insights: single conditions on a feature that raise the rate of the positive class.

All thresholds of all numeric features come from one grouped count. Each row maps every
feature to a bucket number; (feature, bucket) counts combine on the map side to at most
features x bins rows, and threshold counts are sums over buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import rowwise
from gleaner.functions.lift import segment_metrics
from gleaner.functions.predicates import Condition, is_above, is_class
from gleaner.functions.rowwise import number
from gleaner.functions.text import fixed, percent
from gleaner.operators.aggregates import baseline_rate, distinct_counts
from gleaner.operators.encode import BINNED
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import LINEAR, quantiles
from gleaner.plans.tables import with_facts, written
from gleaner.types import CATEGORICAL, NUMERICAL, REGRESSION, FeatureSpec, Problem, columns_of

NUMERIC_GROUP = "Numeric Features"
CATEGORICAL_GROUP = "Categorical Features"
BINNED_GROUP = "Binned Features"
DATETIME_GROUP = "Datetime Features"
OTHER_GROUP = "Other Engineered Features"

# Display group of each kind of generated feature.
GROUP_OF_KIND = {
    rowwise.INTERACTION: "Interaction Features",
    rowwise.TRANSFORM: "Transformation Features",
    rowwise.RATIO: "Ratio Features",
    "time_series": "Time-Series Features",
    rowwise.DATETIME_PART: DATETIME_GROUP,
    BINNED: BINNED_GROUP,
}


@dataclass(frozen=True)
class Goal:
    """The positive class made concrete, with the table's totals."""

    positive: Column
    label: str
    total: int
    positives: int


@dataclass(frozen=True)
class Limits:
    min_support: float = 0.01
    min_lift: float = 1.1
    n_bins: int = 10


def minority_class(df: DataFrame, target: str):
    """The rarest non-null class, the smallest of equals; None for a target without values."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
    row = counts.orderBy("__n", target).first()
    return None if row is None else row[target]


def goal_of(df: DataFrame, problem: Problem, limit: int = GROUP_ROWS) -> Goal:
    """Positive means the desired class (the minority class if none is named), or above the exact median."""
    if problem.kind == REGRESSION:
        cut = quantiles(df, [problem.target], [0.5], LINEAR, limit)[problem.target][0]
        positive, label = is_above(problem.target, cut), f"> {cut}"
    else:
        desired = minority_class(df, problem.target) if problem.desired is None else problem.desired
        positive, label = is_class(problem.target, desired), str(desired)
    row = baseline_rate(df, positive).first()
    return Goal(positive, label, row["total"], row["positives"])


def thresholds(df: DataFrame, columns: list[str], n_bins: int = 10, limit: int = GROUP_ROWS) -> dict[str, list[float]]:
    """Distinct inner quantiles per column; columns that are constant or empty are left out."""
    found = quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)], limit=limit)
    return {c: sorted(set(q[1:-1])) for c, q in found.items() if q[0] is not None and q[0] != q[-1]}


def _finish(segments: DataFrame, goal: Goal, limits: Limits) -> DataFrame:
    n, pos = F.col("n"), F.col("pos")
    measured = segments.select(
        "feature", "op", "number", "text", "condition_type", *segment_metrics(n, pos, goal.total, goal.positives)
    )
    return measured.filter(
        (F.col("support_count") >= limits.min_support * goal.total) & (F.col("lift") >= limits.min_lift)
    )


def _grouped(insights: DataFrame, groups: dict[str, str], default: str) -> DataFrame:
    special = {f: g for f, g in groups.items() if g != default}
    name = reduce(lambda e, kv: e.when(F.col("feature") == kv[0], kv[1]), special.items(), F.when(F.lit(False), ""))
    return insights.withColumn("feature_group", name.otherwise(default))


def numeric_segments(df: DataFrame, cuts: dict[str, list[float]], positive: Column) -> DataFrame:
    """(feature, op, number, n, pos) for 'at least' and 'below' each threshold; nulls are in neither."""

    features = list(cuts)
    stride = max(len(t) for t in cuts.values()) + 1

    def place(i: int, c: str) -> Column:
        """Feature and bucket as one integer, the cheapest key to group by."""
        case = F.when(F.col(c).isNull(), None)
        for j, t in reversed(list(enumerate(cuts[c], 1))):
            case = case.when(number(c) >= F.lit(t), j + i * stride)
        return case.otherwise(i * stride).cast("int").alias(c)

    long = df.select(positive.alias("__pos"), *[place(i, c) for i, c in enumerate(features)])
    long = long.unpivot(["__pos"], features, "feature", "place").filter(F.col("place").isNotNull())
    counts = long.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("__pos").alias("pos"))
    rows = [(k * stride + b, c, i, float(t)) for k, c in enumerate(features) for b in range(len(cuts[c]) + 1) for i, t in enumerate(cuts[c], 1)]
    marks = df.sparkSession.createDataFrame(rows, "place int, feature string, i int, number double")
    at_least = F.col("place") % stride >= F.col("i")
    side = lambda cond, x: F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0))
    # both sides hold at most features x bins x bins rows
    per = counts.join(F.broadcast(marks), "place").groupBy("feature", "i", "number").agg(
        F.array(
            F.struct(F.lit(">=").alias("op"), side(at_least, "n").alias("n"), side(at_least, "pos").alias("pos")),
            F.struct(F.lit("<").alias("op"), side(~at_least, "n").alias("n"), side(~at_least, "pos").alias("pos")),
        ).alias("sides")
    )
    return per.select("feature", "number", F.inline("sides")).select("feature", "op", "number", "n", "pos")


def numeric_insights(
    df: DataFrame,
    columns: list[str],
    goal: Goal,
    limits: Limits = Limits(),
    groups: dict[str, str] | None = None,
    cuts: dict[str, list[float]] | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Threshold insights of all columns in one job after the quantiles (or with given thresholds)."""
    cuts = thresholds(df, columns, limits.n_bins, limit) if cuts is None else cuts
    cuts = {c: t for c, t in cuts.items() if t}
    if not cuts:
        return empty_insights(df)
    segments = numeric_segments(df, cuts, goal.positive).withColumns(
        {"text": F.lit(None).cast("string"), "condition_type": F.lit("numeric_threshold")}
    )
    return _grouped(_finish(segments, goal, limits), groups or {}, NUMERIC_GROUP)


def categorical_insights(
    df: DataFrame, columns: list[str], goal: Goal, limits: Limits = Limits(), groups: dict[str, str] | None = None
) -> DataFrame:
    """One insight per value, null being a value; counts of all columns come from one job."""
    if not columns:
        return empty_insights(df)
    wide = df.select(goal.positive.alias("__pos"), *[F.col(c).cast("string").alias(c) for c in columns])
    counts = wide.unpivot(["__pos"], columns, "feature", "text").groupBy("feature", "text").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__pos").alias("pos")
    )
    segments = counts.withColumns(
        {
            "op": F.when(F.col("text").isNull(), "null").otherwise("="),
            "number": F.lit(None).cast("double"),
            "condition_type": F.lit("categorical"),
        }
    )
    return _grouped(_finish(segments, goal, limits), groups or {}, CATEGORICAL_GROUP)


INSIGHT_SCHEMA = (
    "feature string, op string, number double, text string, condition_type string, support_count bigint, "
    "support double, class_rate double, baseline_rate double, lift double, rig double, feature_group string"
)


def empty_insights(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], INSIGHT_SCHEMA)


def engineered_insights(df: DataFrame, specs: list[FeatureSpec], goal: Goal, limits: Limits = Limits()) -> DataFrame:
    """Insights of generated columns: bins as categories, the rest by thresholds, grouped by feature kind."""
    groups = {s.name: GROUP_OF_KIND.get(s.kind, OTHER_GROUP) for s in specs}
    bins = [s.name for s in specs if s.kind == BINNED]
    numbers = [s.name for s in specs if s.kind != BINNED and s.name in columns_of(df, NUMERICAL)]
    return numeric_insights(df, numbers, goal, limits, groups).unionByName(
        categorical_insights(df, bins, goal, limits, groups)
    )


FEW_VALUES = 31  # calendar parts with up to so many distinct values are categories


def datetime_insights(df: DataFrame, columns: list[str], goal: Goal, limits: Limits = Limits()) -> DataFrame:
    """Calendar parts of at most FEW_VALUES distinct values as categories, others by thresholds."""
    if not columns:
        return categorical_insights(df, [], goal, limits, {})
    counted = distinct_counts(df, columns).filter(F.col("count_distinct") <= FEW_VALUES).collect()  # a row per column
    few = {r["column"] for r in counted}
    groups = dict.fromkeys(columns, DATETIME_GROUP)
    return categorical_insights(df, [c for c in columns if c in few], goal, limits, groups).unionByName(
        numeric_insights(df, [c for c in columns if c not in few], goal, limits, groups)
    )


def all_insights(
    df: DataFrame,
    problem: Problem,
    limits: Limits = Limits(),
    specs: list[FeatureSpec] = (),
    goal: Goal | None = None,
    categories: list[str] | None = None,
    numbers: list[str] | None = None,
) -> DataFrame:
    """Insights of original and generated columns, the target left out."""
    goal = goal_of(df, problem) if goal is None else goal
    made = {s.name for s in specs} | {problem.target}
    numbers = columns_of(df, NUMERICAL, made) if numbers is None else numbers
    categories = columns_of(df, CATEGORICAL, made) if categories is None else categories
    groups = {s.name: GROUP_OF_KIND.get(s.kind, OTHER_GROUP) for s in specs}
    bins = [s.name for s in specs if s.kind == BINNED]
    made_numbers = [s.name for s in specs if s.kind != BINNED and s.name in columns_of(df, NUMERICAL)]
    # one job for all numeric columns and one for all categories, whatever group they belong to
    return numeric_insights(df, numbers + made_numbers, goal, limits, groups).unionByName(
        categorical_insights(df, categories + bins, goal, limits, groups)
    )


def in_order(insights: DataFrame, n: int | None = None) -> DataFrame:
    """Strongest first, with a total order."""
    ordered = insights.orderBy(F.desc("lift"), "feature", "op", "number", "text")
    return ordered if n is None else ordered.limit(n)


def conditions_of(insights: DataFrame, n: int | None = None) -> list[tuple[Condition, float]]:
    """The conditions with their lifts, the strongest first (the first n if given).

    They are expressions for the driver to build; their number follows from features and bins, never from rows.
    """
    return [(Condition(r["feature"], r["op"], r["number"], r["text"]), r["lift"]) for r in in_order(insights, n).collect()]


def insight_summary(insights: DataFrame) -> DataFrame:
    """One row: number of insights, mean and best lift, mean gain, features among the ten strongest."""
    totals = insights.agg(
        F.count(F.lit(1)).alias("total_insights"),
        F.coalesce(F.avg("lift"), F.lit(0.0)).alias("avg_lift"),
        F.coalesce(F.max("lift"), F.lit(0.0)).alias("max_lift"),
        F.coalesce(F.avg("rig"), F.lit(0.0)).alias("avg_rig"),
    )
    top = in_order(insights, 10).agg(F.sort_array(F.collect_set("feature")).alias("top_features"))  # ten rows
    return with_facts(totals, top)


def condition_text() -> Column:
    """Readable form of an insight's condition."""
    return (
        F.when(F.col("op") == "=", F.concat("feature", F.lit(" = '"), "text", F.lit("'")))
        .when(F.col("op") == "null", F.concat("feature", F.lit(" IS NULL")))
        .otherwise(F.concat_ws(" ", "feature", "op", fixed("number", 3)))
    )


def insight_table(insights: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """Display columns of the n strongest insights."""
    rows = insights if n is None else in_order(insights, n)
    return rows.select(
        F.col("feature").alias("Feature"),
        condition_text().alias("Condition"),
        F.lit(label).alias("Class"),
        F.concat(F.lit("x"), fixed("lift", 2)).alias("Lift"),
        F.col("lift").alias("Lift_Value"),
        percent(F.col("support") * 100).alias("Support"),
        F.format_number("support_count", 0).alias("Support_Count"),
        F.col("support").alias("Support_Value"),
        fixed("rig", 3).alias("RIG"),
        F.col("rig").alias("RIG_Value"),
        percent(F.col("class_rate") * 100).alias("Class_Rate"),
        percent(F.col("baseline_rate") * 100).alias("Baseline_Rate"),
        F.col("feature_group").alias("Group"),
        F.col("feature").alias("Source"),
    )


def lift_support_frontier(insights: DataFrame, n: int | None = None) -> DataFrame:
    """Points (support %, lift, rig) of all insights, or the n strongest, and the lift at that support on the 75th-percentile curve."""
    points = in_order(insights, n).select(
        "feature", "op", "number", "text", (F.col("support") * 100).alias("support_pct"), "lift", "rig"
    )
    curve = points.agg(F.percentile(F.col("lift") * F.col("support_pct"), F.lit(0.75)).alias("curve_constant"))  # n rows
    return with_facts(points, curve).withColumn("curve_lift", F.col("curve_constant") / F.col("support_pct"))


@dataclass(frozen=True)
class InsightStore:
    """Insights computed once with low limits and written; stricter questions only filter them."""

    goal: Goal
    rows: DataFrame

    @staticmethod
    def build(df: DataFrame, problem: Problem, specs=(), low: Limits = Limits(0.001, 1.0), **columns) -> InsightStore:
        goal = goal_of(df, problem)
        return InsightStore(goal, written(all_insights(df, problem, low, specs, goal, **columns)))

    def query(self, min_support: float = 0.01, min_lift: float = 1.1, top: int | None = None) -> DataFrame:
        kept = self.rows.filter(
            (F.col("support_count") >= min_support * self.goal.total) & (F.col("lift") >= min_lift)
        )
        return in_order(kept, top)
