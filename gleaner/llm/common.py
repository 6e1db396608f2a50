"""Parts shared by the corpus operators: keys of texts, checked joins, and row-wise work in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.plans.tables import written

BROADCAST_BYTES = 48_000_000  # a side measured to be smaller than this is broadcast, any other is joined by a shuffle
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts share them, so copies and repeated ids need no care."""
    return F.unhex(F.md5(text))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Pure ASCII takes the fast built-in way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sized(df: DataFrame, row_bytes: Column | int) -> tuple[DataFrame, int]:
    """df written to the shared folder, and the bytes its rows take together."""
    stored = written(df)
    cost = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return stored, int(stored.agg(F.coalesce(F.sum(cost.cast("bigint")), F.lit(0))).first()[0])


def attach(df: DataFrame, stored: DataFrame, size: int, on: list[str], how: str = "left") -> DataFrame:
    """Join rows with a written table of one row per key.

    A table measured below BROADCAST_BYTES is broadcast, so df stays where it is; a larger one is joined by
    sorting, where adaptive execution splits the partitions of keys that hold many rows of df.
    """
    return df.join(F.broadcast(stored) if size <= BROADCAST_BYTES else stored, on, how)


def give_back() -> None:
    """Return memory that a task has freed to the system: Python workers that wait for another task keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, make: Callable[[], Callable[[list], Iterable]], schema: str) -> DataFrame:
    """Run a function over the Arrow batches of every partition.

    make() is called once per task and returns a function from the columns of a batch, as lists, to the
    columns of the output, as lists; so tables and caches are made once per task.
    """
    shape = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, f.dataType) for f in shape.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(t) for _, t in fields]
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                out = work(*[c.to_pylist() for c in piece.columns])
                if out is not None:
                    made = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(made, [n for n, _ in fields])
        work = batch = piece = out = made = None
        give_back()

    return df.mapInArrow(run, shape)


def append(df: DataFrame, inputs: list[str], make: Callable[[], Callable[[list], Iterable]], schema: str) -> DataFrame:
    """df with new columns made from some of its own, as in in_batches; all others pass through untouched."""
    new = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, f.dataType) for f in new.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                out = work(*[piece.column(c).to_pylist() for c in inputs])
                made = [pa.array(v, to_arrow_type(t)) for v, (_, t) in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], [*piece.schema.names, *(n for n, _ in fields)])
        work = batch = piece = out = made = None
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))
