"""Comparing runs: ranking, best run, and how much features or models improved the metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.models.train import TreeSettings, train_all_baselines
from gleaner.operators.encode import one_hot_assemble
from gleaner.sources.tables import split_by_key

# Metrics where a smaller value is better.
SMALLER_IS_BETTER = {"rmse", "mse", "mae", "log_loss"}


def compare_feature_sets(
    sets: dict[str, tuple[DataFrame, list[str], list[str]]], label: Column, keys: list[str], kind: str,
    names=("decision_tree", "boosted_trees"), trees: TreeSettings = TreeSettings(),
) -> DataFrame:
    """Train the same models on several versions of a table (name: frame, categories, numbers); a table of runs.

    Every version uses the same rows for training, as the split depends on key values only.
    """
    runs = None
    for i, (name, (df, categories, numbers)) in enumerate(sets.items()):
        train, test = split_by_key(df, keys)
        fitted_on, model = one_hot_assemble(train, categories, numbers)
        ready = [
            part.select(label.cast("double").alias("label"), "features") for part in (fitted_on, model.transform(test))
        ]
        table, _ = train_all_baselines(ready[0], ready[1], kind, names, name, trees=trees, first_id=i * len(names))
        runs = table if runs is None else runs.unionByName(table)
    return runs


def _signed(metric: str) -> Column:
    """The metric turned so that larger is better."""
    return -F.col(metric) if metric in SMALLER_IS_BETTER else F.col(metric)


def comparison_table(runs: DataFrame, metric: str) -> DataFrame:
    """Runs with their rank, the best first; runs are finished trainings, so there are few of them."""
    order = Window.orderBy(F.desc(_signed(metric)), "experiment_id")
    return runs.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    return runs.orderBy(F.desc(_signed(metric)), "experiment_id").limit(1)


def best_baseline(runs: DataFrame, metric: str) -> DataFrame:
    return best_run(runs, metric)


def improvements(runs: DataFrame, metric: str) -> DataFrame:
    """(comparison, from_score, to_score, absolute, percentage, from_model, to_model).

    feature_engineering: best original against best engineered run; vs_baseline: weakest
    baseline against best run; model_selection_{set}: weakest against best model of a set.
    """
    score, value = _signed(metric), F.col(metric)
    best = lambda cond: F.max_by(F.when(cond, F.struct(value.alias("v"), F.col("model").alias("m"))), F.when(cond, score))
    worst = lambda cond: F.min_by(F.when(cond, F.struct(value.alias("v"), F.col("model").alias("m"))), F.when(cond, score))
    any_run = F.lit(True)
    baseline = F.lower("name").contains("baseline") | F.lower("name").contains("naive")
    of = lambda s: F.col("feature_set") == s
    whole = runs.agg(
        F.array(
            F.struct(F.lit("feature_engineering").alias("comparison"), best(of("original")).alias("a"), best(of("engineered")).alias("b")),
            F.struct(F.lit("vs_baseline").alias("comparison"), worst(baseline).alias("a"), best(any_run).alias("b")),
        ).alias("c")
    ).select(F.inline("c"))
    per_set = (
        runs.groupBy("feature_set")
        .agg(F.count(F.lit(1)).alias("n"), worst(any_run).alias("a"), best(any_run).alias("b"))
        .filter(F.col("n") > 1)
        .select(F.concat(F.lit("model_selection_"), "feature_set").alias("comparison"), "a", "b")
    )
    both = whole.unionByName(per_set).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    change = F.col("b.v") - F.col("a.v")
    return both.select(
        "comparison",
        F.col("a.v").alias("from_score"),
        F.col("b.v").alias("to_score"),
        change.alias("absolute_improvement"),
        F.when(F.col("a.v") > 0, change / F.col("a.v") * 100).otherwise(0.0).alias("percentage_improvement"),
        F.col("a.m").alias("from_model"),
        F.col("b.m").alias("to_model"),
    )
