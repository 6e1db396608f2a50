"""Problem statement, column roles and feature descriptions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

CLASSIFICATION = "classification"
REGRESSION = "regression"

CATEGORICAL = "categorical"
NUMERICAL = "numerical"
BOOLEAN = "boolean"
DATETIME = "datetime"


@dataclass(frozen=True)
class Problem:
    """What is predicted: a target column, and for a classification the class of interest."""

    target: str
    kind: str = CLASSIFICATION
    desired: object = None
    date_column: str | None = None


@dataclass(frozen=True)
class FeatureSpec:
    """Describes a generated column, so that nothing has to read meaning out of its name."""

    name: str
    kind: str
    inputs: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> FeatureSpec:
        raw = json.loads(text)
        return FeatureSpec(raw["name"], raw["kind"], tuple(raw["inputs"]))


@dataclass(frozen=True)
class Feature:
    """A feature description together with the expression that computes it."""

    spec: FeatureSpec
    column: Column

    @property
    def named(self) -> Column:
        return self.column.alias(self.spec.name)


def feature(name: str, kind: str, inputs, column: Column) -> Feature:
    return Feature(FeatureSpec(name, kind, tuple(inputs)), column)


def add_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """Append all features in one projection."""
    return df.select("*", *[f.named for f in features])


def role_of(data_type: T.DataType) -> str | None:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, T.NumericType):
        return NUMERICAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return None


def columns_of(df: DataFrame, role: str, exclude=()) -> list[str]:
    """Columns of one role, in schema order."""
    return [f.name for f in df.schema.fields if role_of(f.dataType) == role and f.name not in exclude]
