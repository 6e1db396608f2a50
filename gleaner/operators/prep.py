"""Preprocessing: fit parameters in a few jobs for all columns, then apply them to any table.

A fitted step holds its parameters as plain values, one or a few per column. Only the
list of frequent categories can be long, so it stays a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rowwise import number
from gleaner.operators.aggregates import value_counts
from gleaner.operators.ranking import modes
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.quantiles import quantiles
from gleaner.plans.tables import written

MEAN, MEDIAN, MODE, CONSTANT, DROP = "mean", "median", "mode", "constant", "drop"
CAP, REMOVE = "cap", "remove"


@dataclass(frozen=True)
class Step:
    """A fitted step: what it does and its parameters per column."""

    kind: str
    params: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "params": self.params}, sort_keys=True, default=str)


def fit_impute(df: DataFrame, columns: list[str], strategy: str, constant=None, limit: int = GROUP_ROWS) -> Step:
    if strategy == DROP:
        return Step("drop_nulls", {c: {} for c in columns})
    if strategy == CONSTANT:
        return Step("impute", {c: {"value": constant} for c in columns})
    if strategy == MEAN:
        row = df.agg(*[F.avg(number(c)) for c in columns]).first()
        return Step("impute", {c: {"value": v} for c, v in zip(columns, row)})
    if strategy == MEDIAN:
        found = quantiles(df, columns, [0.5], limit=limit)
        return Step("impute", {c: {"value": v[0]} for c, v in found.items()})
    if strategy == MODE:
        found = {r["column"]: r["mode"] for r in modes(df, columns).collect()}  # one row per column
        return Step("impute", {c: {"value": found.get(c)} for c in columns})
    raise ValueError(f"unknown imputation strategy {strategy!r}")


def fit_iqr(df: DataFrame, columns: list[str], action: str = CAP, t: float = 1.5, limit: int = GROUP_ROWS) -> Step:
    found = quantiles(df, columns, [0.25, 0.75], limit=limit)
    bounds = {c: (q1 - t * (q3 - q1), q3 + t * (q3 - q1)) for c, (q1, q3) in found.items() if q1 is not None}
    return Step(action, {c: {"low": low, "high": high} for c, (low, high) in bounds.items()})


def fit_zscore(df: DataFrame, columns: list[str], action: str = CAP, t: float = 3.0) -> Step:
    row = df.agg(*[a for c in columns for a in (F.avg(number(c)), F.stddev(number(c)))]).first()
    pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return Step(action, {c: {"low": m - t * s, "high": m + t * s} for c, (m, s) in pairs.items() if s})


def fit_scale(df: DataFrame, columns: list[str], method: str = "standard", limit: int = GROUP_ROWS) -> Step:
    """Centre and width per column; a column without spread is left alone."""
    if method == "robust":
        found = quantiles(df, columns, [0.25, 0.5, 0.75], limit=limit)
        pairs = {c: (q[1], q[2] - q[0]) for c, q in found.items() if q[0] is not None}
    else:
        forms = {"standard": (F.avg, F.stddev), "minmax": (F.min, lambda x: F.max(x) - F.min(x))}
        centre, width = forms[method]
        row = df.agg(*[a for c in columns for a in (centre(number(c)), width(number(c)))]).first()
        pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return Step("scale", {c: {"centre": m, "width": w} for c, (m, w) in pairs.items() if w})


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    """Apply fitted parameters in one projection or filter."""
    p = step.params
    if step.kind == "drop_nulls":
        return df.dropna(subset=list(p))
    if step.kind == "impute":
        made = {
            c: F.coalesce(F.col(c), F.lit(v["value"]).cast(df.schema[c].dataType))
            for c, v in p.items()
            if v["value"] is not None
        }
    elif step.kind == CAP:
        made = {
            c: F.when(number(c).isNotNull(), F.greatest(F.lit(v["low"]), F.least(F.lit(v["high"]), number(c))))
            for c, v in p.items()
        }
    elif step.kind == REMOVE:
        for c, v in p.items():
            df = df.filter(number(c).between(F.lit(v["low"]), F.lit(v["high"])))
        return df
    elif step.kind == "scale":
        made = {f"{c}_scaled": (number(c) - F.lit(v["centre"])) / F.lit(v["width"]) for c, v in p.items()}
    else:
        raise ValueError(f"unknown step {step.kind!r}")
    return df.withColumns(made)


def frequent_values(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """(column, value): values holding at least threshold of all rows; at most 1/threshold per column."""
    rows = df.count()
    return value_counts(df, columns).filter(F.col("n") >= threshold * rows).select("column", "value")


def apply_rare(df: DataFrame, frequent: DataFrame, columns: list[str], replacement: str = "RARE") -> DataFrame:
    """Replace values missing from the frequent table; nulls stay. Values are looked up, whatever their number."""
    known = written(frequent.filter(F.col("value").isNotNull()).select("column", "value"))
    out = df
    for c in columns:
        table = known.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.lit(True).alias("__known"))
        found = lookup(out.withColumn("__value", F.col(c).cast("string")), table, ["__value"], stored=True)
        kept = F.when(F.col("__value").isNull() | F.col("__known"), F.col("__value")).otherwise(replacement)
        out = found.select(*[kept.alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
    return out


def group_rare(df: DataFrame, columns: list[str], threshold: float = 0.01, replacement: str = "RARE") -> DataFrame:
    return apply_rare(df, frequent_values(df, columns, threshold), columns, replacement)


@dataclass(frozen=True)
class PrepOptions:
    impute_numeric: str = MEDIAN
    impute_categorical: str = MODE
    outliers: str | None = "iqr"
    outlier_action: str = CAP
    outlier_t: float = 1.5
    rare_threshold: float | None = 0.01
    scale: str | None = "standard"


@dataclass(frozen=True)
class Prepared:
    """All fitted steps; applying them to new rows uses only these values."""

    steps: tuple[Step, ...]
    frequent: DataFrame | None
    categories: tuple[str, ...]
    rare_at: int

    def apply(self, df: DataFrame) -> DataFrame:
        for i, step in enumerate(self.steps):
            if i == self.rare_at and self.frequent is not None:
                df = apply_rare(df, self.frequent, list(self.categories))
            df = apply_step(df, step)
        if self.rare_at >= len(self.steps) and self.frequent is not None:
            df = apply_rare(df, self.frequent, list(self.categories))
        return df

    def parameters(self, df: DataFrame) -> DataFrame:
        """(step, column, parameter, value) of every fitted number or text."""
        rows = [
            (i, s.kind, c, k, None if v is None else str(v))
            for i, s in enumerate(self.steps)
            for c, p in s.params.items()
            for k, v in p.items()
        ]
        return df.sparkSession.createDataFrame(rows, "step int, kind string, column string, parameter string, value string")


def fit_prepare(df: DataFrame, numbers: list[str], categories: list[str], options: PrepOptions = PrepOptions()) -> Prepared:
    """Impute numbers, impute categories, treat outliers, group rare categories, scale: each fitted on the step before."""
    steps, now = [], df

    def take(step: Step):
        nonlocal now
        steps.append(step)
        now = apply_step(now, step)

    if numbers:
        take(fit_impute(now, numbers, options.impute_numeric))
    if categories:
        take(fit_impute(now, categories, options.impute_categorical))
    if numbers and options.outliers:
        fit = fit_iqr if options.outliers == "iqr" else fit_zscore
        take(fit(now, numbers, options.outlier_action, options.outlier_t))
    frequent, rare_at = None, len(steps)
    if categories and options.rare_threshold:
        frequent = written(frequent_values(now, categories, options.rare_threshold))
        now = apply_rare(now, frequent, categories)
    if numbers and options.scale:
        take(fit_scale(now, numbers, options.scale))
    return Prepared(tuple(steps), frequent, tuple(categories), rare_at)


def prepare(df: DataFrame, numbers: list[str], categories: list[str], options: PrepOptions = PrepOptions()) -> DataFrame:
    return fit_prepare(df, numbers, categories, options).apply(df)
