"""Features that need fitted values: bins, target encoding, index and vector stages, and everything at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import rowwise
from gleaner.functions.rowwise import number
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import quantiles
from gleaner.plans.tables import written
from gleaner.types import CATEGORICAL, DATETIME, NUMERICAL, Feature, add_features, columns_of, feature

BINNED = "binned"
ENCODED = "encoded"


def bin_splits(df: DataFrame, columns: list[str], bins: int = 5, limit: int = GROUP_ROWS) -> dict[str, list[float]]:
    """Distinct quantiles at 0, 1/bins, ..., 1 for each column, found together."""
    found = quantiles(df, columns, [i / bins for i in range(bins + 1)], limit=limit)
    return {c: sorted({v for v in q if v is not None}) for c, q in found.items()}


def bin_of(x: Column, splits: list[float]) -> Column:
    """Index of the right-open bin holding x; the last bin also holds its upper end; null stays null."""
    case = F.when(x.isNull(), None)
    for i, upper in enumerate(splits[1:-1]):
        case = case.when(x < F.lit(upper), float(i))
    return case.otherwise(float(len(splits) - 2))


def binned(splits: dict[str, list[float]]) -> list[Feature]:
    """{column}_binned for columns with at least two bins."""
    return [
        feature(f"{c}_binned", BINNED, [c], bin_of(number(c), cuts)) for c, cuts in splits.items() if len(cuts) > 2
    ]


def quantile_bin(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    return add_features(df, binned(bin_splits(df, columns, bins)))


def target_encode(df: DataFrame, columns: list[str], target: str, smoothing: float = 1.0) -> DataFrame:
    """{column}_target_enc: (n * group mean + smoothing * mean) / (n + smoothing), the mean for unknown values.

    Statistics of all columns come from one job; each column then looks its own up.
    """
    overall = df.agg(F.avg(number(target))).first()[0]
    wide = df.select(number(target).alias("__y"), *[F.col(c).cast("string").alias(c) for c in columns])
    n, mean = F.count("__y"), F.avg("__y")
    smoothed = F.coalesce((n * mean + smoothing * F.lit(overall)) / (n + smoothing), F.lit(overall))
    stats = wide.unpivot(["__y"], columns, "__column", "__value").filter(F.col("__value").isNotNull())
    stats = written(stats.groupBy("__column", "__value").agg(smoothed.alias("__enc")))
    out = df
    for c in columns:
        table = stats.filter(F.col("__column") == c).select("__value", "__enc")
        found = lookup(out.withColumn("__value", F.col(c).cast("string")), table, ["__value"])
        out = found.select(*out.columns, F.coalesce("__enc", F.lit(overall)).alias(f"{c}_target_enc"))
    return out


@dataclass(frozen=True)
class GenerateOptions:
    numeric: bool = True
    interactions: bool = True
    binning: bool = True
    datetime: bool = True
    text: bool = True
    interaction_cap: int | None = None


def plan_features(df: DataFrame, exclude=(), options: GenerateOptions = GenerateOptions()) -> list[Feature]:
    """All automatic features of a table, the target left out; only the bins need a job."""
    numbers = columns_of(df, NUMERICAL, exclude)
    out = []
    if options.numeric:
        out += rowwise.transforms(numbers)
    if options.interactions:
        out += rowwise.interactions(numbers, cap=options.interaction_cap)
    if options.binning:
        out += binned(bin_splits(df, numbers))
    if options.datetime:
        out += rowwise.datetime_parts(columns_of(df, DATETIME, exclude))
    if options.text:
        out += rowwise.string_stats(columns_of(df, CATEGORICAL, exclude))
    return out


def generate_all(df: DataFrame, exclude=(), options: GenerateOptions = GenerateOptions()) -> DataFrame:
    return add_features(df, plan_features(df, exclude, options))


def one_hot_assembler(categories: list[str], numbers: list[str], output: str = "features") -> Pipeline:
    """Index, one-hot encode and assemble.

    The indexer's last level is 'unseen or null'; dropping it gives such values zeros in all slots.
    Rows with a null number are left out.
    """
    stages = []
    if categories:
        indexed, hot = [f"{c}__index" for c in categories], [f"{c}__onehot" for c in categories]
        stages += [
            StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        ]
        stages.append(VectorAssembler(inputCols=[*hot, *numbers], outputCol=output, handleInvalid="skip"))
    else:
        stages.append(VectorAssembler(inputCols=numbers, outputCol=output, handleInvalid="skip"))
    return Pipeline(stages=stages)


def one_hot_assemble(
    df: DataFrame, categories: list[str], numbers: list[str], train: DataFrame | None = None
) -> tuple[DataFrame, PipelineModel]:
    """Add the feature vector; the encoders may be fitted on another frame."""
    model = one_hot_assembler(categories, numbers).fit(df if train is None else train)
    helpers = [f"{c}__{kind}" for c in categories for kind in ("index", "onehot")]
    return model.transform(df).drop(*helpers), model


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, in order, from its ML attributes."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    return [a["name"].replace("__onehot", "") for a in sorted((a for g in groups for a in g), key=lambda a: a["idx"])]


def index_and_scale(df: DataFrame, target: str, categories: list[str], numbers: list[str]) -> tuple[DataFrame, PipelineModel]:
    """Indexed target as label, and the assembled vector scaled to unit deviation without centring."""
    assembler = one_hot_assembler(categories, numbers, "raw_features")
    label = StringIndexer(inputCol=target, outputCol="label", stringOrderType="frequencyDesc", handleInvalid="skip")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True)
    model = Pipeline(stages=[label, *assembler.getStages(), scaler]).fit(df)
    helpers = [f"{c}__{kind}" for c in categories for kind in ("index", "onehot")]
    return model.transform(df).drop(*helpers), model
