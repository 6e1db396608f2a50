"""Reading, writing, naming, sampling, sizing and conforming tables."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.plans.tables import with_facts, written


def read_csv(spark: SparkSession, path, header: bool = True, sep: str = ",", schema=None, infer: bool = True) -> DataFrame:
    """Read CSV; give a schema for large data, since inference costs a scan of its own."""
    reader = spark.read.option("header", header).option("sep", sep)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Replace dots and spaces in column names by underscores; fails when two names become equal."""
    names = [c.replace(".", "_").replace(" ", "_") for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after sanitizing: {twice}")
    return df.toDF(*names)


def settled(df: DataFrame) -> DataFrame:
    """df itself where every run cuts it into the same partitions, as a scan does; else df written once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df) if "Exchange" in plan or "Adaptive" in plan else df


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """Exactly the first rows of df in partition order, or all if fewer; every partition keeps its own share.

    A first job counts rows per partition without reading columns. No row moves, so there is no task that all kept
    rows pass through, and a partition stops reading at its share. What is behind a shuffle is written first, since
    its partitions may be cut anew by each run.
    """
    df = settled(df)
    return _shares(df, rows, rows_per_partition(df))


def _shares(df: DataFrame, rows: int, held: dict[int, int]) -> DataFrame:
    share, left = {}, rows
    for part in sorted(held):
        share[part] = min(left, held[part])
        left -= share[part]

    def run(batches):
        left = share.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not left:
                return
            yield batch.slice(0, left)
            left -= min(left, batch.num_rows)

    return df.mapInArrow(run, df.schema)


def rows_per_partition(df: DataFrame) -> dict[int, int]:
    """Number of rows by partition; empty partitions are absent."""

    def run(batches):
        n = sum(b.num_rows for b in batches)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n])], ["part", "n"])

    counted = df.select(F.lit(1).alias("one")).mapInArrow(run, "part int, n bigint")
    return {r["part"]: r["n"] for r in counted.collect()}  # a row per task


def cap_rows(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """The first rows of df, and whether more than that existed."""
    df = settled(df)
    held = rows_per_partition(df)
    return _shares(df, rows, held), sum(held.values()) > rows


def dataset_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row and column counts."""
    names = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = df.sparkSession.createDataFrame(names, "position int, column string, dtype string")
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(names)))
    return with_facts(schema, counted)


# Timestamp formats tried in this order after the automatic one.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "MM-dd-yyyy",
    "yyyy/MM/dd",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
]


def _shape(column: Column) -> Column:
    """The value with every digit as 0: what tells formats apart before anything is parsed."""
    return F.translate(column, "123456789", "000000000")


def timestamp_format(df: DataFrame, column: str, min_parsed: float = 0.9) -> str | None:
    """The first way of parsing that fits at least min_parsed of the non-null values; None is the automatic one.

    All candidates are counted in one scan. A format is tried on values of its own shape only, so a value is parsed
    once besides the automatic way, and twice where day and month may change places.
    """
    value = F.col(f"`{column}`").cast("string")
    shaped = df.select(F.col(f"`{column}`").alias("v"), _shape(value).alias("s"))
    tries = {"auto": F.expr("try_cast(v as timestamp)")}
    for f in TIMESTAMP_FORMATS:
        tries[f] = F.when(F.col("s") == re.sub("[a-zA-Z]", "0", f), F.try_to_timestamp(F.col("v"), F.lit(f)))
    row = shaped.agg(F.count("v"), *[F.count(e) for e in tries.values()]).first()
    for (name, _), parsed in zip(tries.items(), row[1:]):
        if parsed > 0 and parsed >= min_parsed * row[0]:
            return None if name == "auto" else name
    raise ValueError(f"column {column!r} does not look like timestamps in any known format")


def auto_cast_timestamp(df: DataFrame, column: str, min_parsed: float = 0.9) -> DataFrame:
    """Turn a text column into timestamps; values that do not parse become null."""
    fmt = timestamp_format(df, column, min_parsed)
    parsed = (
        F.expr(f"try_cast(`{column}` as timestamp)") if fmt is None else F.try_to_timestamp(F.col(column), F.lit(fmt))
    )
    return df.withColumn(column, parsed)


def save_table(df: DataFrame, path: str) -> None:
    """Write parquet beside the goal and move it there, so readers never see half a table."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    goal, fresh = fs_path(path), fs_path(f"{path}.new-{uuid.uuid4().hex}")
    df.write.parquet(fresh.toString())
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    old = fs_path(f"{path}.old-{time.time_ns()}")
    had = fs.exists(goal)
    if had and not fs.rename(goal, old):
        raise OSError(f"cannot move the old table {path} aside")
    if not fs.rename(fresh, goal):
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(old, True)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def schema_mismatches(df: DataFrame, schema: T.StructType) -> list[tuple[str, str, str | None]]:
    """(column, expected type, found type or None) for each column that differs from schema."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [
        (f.name, f.dataType.simpleString(), have[f.name].simpleString() if f.name in have else None)
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]


def conform_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """df cast to schema (values that do not fit become null), and its mismatches as a table.

    The report has, per column that differs, the expected and the found type (null: no such column) and how many
    values the cast loses; one scan counts them for all columns.
    """
    have = set(df.columns)
    casts = [
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    found = schema_mismatches(df, schema)
    kinds = {f.name: f.dataType for f in schema.fields}
    lost = [
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kinds[c]).isNull()) if c in have else F.lit(0).cast("bigint")
        for c, _, _ in found
    ]
    counts = df.agg(F.count(F.lit(1)), *lost).first()[1:] if found else ()
    rows = [(*m, n) for m, n in zip(found, counts)]
    report = df.sparkSession.createDataFrame(rows, "column string, expected string, found string, lost bigint")
    return df.select(*casts), report


def bounded_sample(df: DataFrame, max_rows: int, seed: int = 42, sample: bool = True) -> DataFrame:
    """About max_rows random rows of a larger table (never above 1.1 times that), or the first ones.

    Partitions draw by seed and keep their share of what was drawn, so a repeated run gives the same rows.
    """
    df = settled(df)
    held = rows_per_partition(df)
    rows = sum(held.values())
    if rows <= max_rows:
        return df
    return first_rows(df.sample(max_rows / rows, seed), int(max_rows * 1.1)) if sample else _shares(df, max_rows, held)


def exact_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """Exactly that many random rows of df, or all if fewer.

    Every partition gives its part of them by its size (largest remainders first), drawn in one pass over its rows
    without replacement; no row moves. A repeated run gives the same rows.
    """
    df = settled(df)
    held = rows_per_partition(df)
    whole = sum(held.values())
    if whole <= rows:
        return df
    share = {p: rows * n // whole for p, n in held.items()}
    rest = rows - sum(share.values())
    for p in sorted(held, key=lambda p: (-(rows * held[p] % whole), p))[:rest]:
        share[p] += 1

    def run(batches):
        part = TaskContext.get().partitionId()
        rng, wanted, left = np.random.default_rng([seed, part]), share.get(part, 0), held.get(part, 0)
        for batch in batches:
            m = batch.num_rows
            if wanted and m:
                hits = int(rng.hypergeometric(wanted, left - wanted, m))
                yield batch.take(pa.array(np.sort(rng.choice(m, hits, replace=False))))
                wanted, left = wanted - hits, left - m

    return df.mapInArrow(run, df.schema)


@dataclass(frozen=True)
class TableSize:
    rows: int
    mean_row_bytes: float
    total_bytes: float
    fits: bool
    suggested_rows: int


# Fixed widths in bytes of values whose size does not depend on the value.
WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def table_size(df: DataFrame, limit_bytes: float = 2 * 1024**3) -> TableSize:
    """Number of rows, their mean width over the whole table in one scan, and how many rows would fit."""
    width = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        fixed = WIDTHS.get(kind, 16 if kind.startswith("decimal") else None)
        width = width + (F.lit(fixed) if fixed else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(width).alias("mean")).first()
    rows, mean = facts["rows"], facts["mean"] or 0.0
    total = mean * rows
    fits = total <= limit_bytes
    return TableSize(rows, float(mean), float(total), fits, rows if fits or not mean else int(limit_bytes / mean))


def split(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([train, 1 - train], seed)
    return a, b


def split_by_key(df: DataFrame, keys: list[str], train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A split that depends only on key values: the same rows whatever the partitioning, and no row in both."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(10_000))
    return df.filter(slot < int(train * 10_000)), df.filter(slot >= int(train * 10_000))
