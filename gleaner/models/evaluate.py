"""Metrics of predictions, each from grouped counts or sums rather than collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.ordered import GROUP_ROWS, running_totals
from gleaner.plans.tables import with_facts, written


def exact_auc(df: DataFrame, label: str, score: str, limit: int = GROUP_ROWS) -> DataFrame:
    """One row: area under the ROC curve by rank sums, ties at half; null when a class is missing.

    Rows are first counted per distinct score, and ranks are running totals of those counts.
    """
    counts = written(
        df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("pos")
        )
    )
    placed = running_totals(counts, [], ["s"], {"upto": F.col("n")}, limit)
    rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = placed.agg(
        F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q")
    )
    p = F.col("p").cast("double")
    return sums.select(F.try_divide(F.col("r") - p * (p + 1) / 2, p * F.col("q")).alias("auc"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = None) -> DataFrame:
    """One row: accuracy, f1, precision and recall weighted by class size, and auc if a score is given."""
    cells = df.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("z")).agg(
        F.count(F.lit(1)).alias("n")
    )  # classes x classes rows
    by_class, by_guess = Window.partitionBy("y"), Window.partitionBy("z")
    rows = cells.withColumns({"actual": F.sum("n").over(by_class), "guessed": F.sum("n").over(by_guess)})
    total = F.sum("n")
    right = rows.groupBy("y").agg(
        F.max("actual").alias("actual"),
        F.coalesce(F.max(F.when(F.col("y") == F.col("z"), F.col("n"))), F.lit(0)).alias("hit"),
        F.coalesce(F.max(F.when(F.col("y") == F.col("z"), F.col("guessed"))), F.lit(0)).alias("guessed"),
        total.alias("n"),
    )
    precision = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))
    recall = F.col("hit") / F.col("actual")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    weighted = lambda x: F.sum(x * F.col("actual")) / F.sum("actual")
    out = right.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        weighted(f1).alias("f1"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
    )
    if score is None:
        return out
    return with_facts(out, exact_auc(df, label, score))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae and r2, in one aggregate."""
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    mse = F.avg(error * error)
    return df.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )
