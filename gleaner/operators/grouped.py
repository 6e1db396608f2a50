"""Python functions per group, with no task holding more than a bounded number of rows.

Rows come sorted by group, and a task converts a batch of many groups at once: for small groups the conversion of each
would cost more than the function itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleaner.plans.ordered import GROUP_ROWS, split_hot
from gleaner.plans.tables import written


def _begins(column: pa.ChunkedArray) -> np.ndarray:
    """For each value but the first, whether it is another one than the value before it; null equals null."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        unlike = pc.and_(unlike, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return pc.or_(unlike, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy()


def _whole_groups(batches: Iterator[pa.RecordBatch], ids: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, out of sorted batches, and where each group begins. Only a group that goes on is held."""
    held: list[pa.Table] = []

    def found(parts: list[pa.Table]):
        whole = pa.concat_tables(parts)
        new = np.zeros(len(whole) - 1, bool)
        for c in ids:
            new |= _begins(whole.column(c))
        return whole, np.flatnonzero(np.append(True, new))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = held[-1].slice(len(held[-1]) - 1) if held else table.slice(0, 0)
        _, starts = found([last, table])
        starts = starts[1:] - 1 if held else starts[1:]
        if not len(starts):
            held.append(table)
            continue
        ended = [t for t in (*held, table.slice(0, starts[-1])) if len(t)]
        if ended:
            yield found(ended)
        held = [table.slice(starts[-1])]
    if held:
        yield found(held)


def _in_pandas(table: pa.Table, zone: str) -> pd.DataFrame:
    """As Spark gives tables to pandas functions: times with a zone become those of the session's clock."""
    made = table.to_pandas()
    for name in made.columns:
        if isinstance(made[name].dtype, pd.DatetimeTZDtype):
            made[name] = made[name].dt.tz_convert(zone).dt.tz_localize(None)
    return made


def _map_groups(df: DataFrame, ids: list[str], made: Callable[[list[pd.DataFrame]], list[pd.DataFrame]], schema: str, many: bool = False) -> DataFrame:
    """made turns a list of groups into tables of rows; with many, a list of tables of many whole groups."""
    zone, shape = df.sparkSession.conf.get("spark.sql.session.timeZone"), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for table, starts in _whole_groups(batches, ids):
            ends = [*starts[1:].tolist(), len(table)]
            # a null among whole numbers makes them floats: then each group is converted on its own, as its types are its own
            mixed = any(c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)) for c in table.columns)
            if mixed:
                groups = [_in_pandas(table.slice(a, b - a), zone) for a, b in zip(starts.tolist(), ends)]
            else:
                whole = _in_pandas(table, zone)
                groups = [whole] if many else [whole.iloc[a:b].reset_index(drop=True) for a, b in zip(starts.tolist(), ends)]
            done = [pa.Table.from_pandas(g, schema=shape, preserve_index=False) for g in made(groups)]
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    # a fixed number of parts: chosen by bytes, small rows would all come to one task, however much Python has to do
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *ids).sortWithinPartitions(*ids).mapInArrow(run, schema)


def combine_per_group(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: str,
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    limit: int = GROUP_ROWS,
    many: bool = False,
) -> DataFrame:
    """Run partial on slices of at most about limit rows of each group, then finish on the slices' results.

    partial returns a few rows per slice (with the keys); finish sees them all for one group. No Python call gets
    a whole group that is large. With many, both get slices of many groups in one table and tell them apart by the keys.
    """
    each = lambda f: lambda groups: [f(g) for g in groups]
    return _combined(df, keys, each(partial), partial_schema, each(finish), schema, limit, many)


def _combined(df, keys, partial, partial_schema, finish, schema, limit, many=False) -> DataFrame:
    """combine_per_group with functions of lists of groups."""
    cold, hot, _ = split_hot(df, keys, limit)
    pieces = []
    if cold is not None:
        pieces.append(cold.withColumn("__slice", F.lit(0).cast("bigint")))
    if hot is not None:
        largest = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        slices = max(2, -(-largest // max(1, limit // 2)))
        # numbered rows, so that rows which are equal are spread as well
        numbered = written(hot.withColumn("__row", F.monotonically_increasing_id()))
        pieces.append(numbered.withColumn("__slice", F.pmod(F.xxhash64("__row"), F.lit(slices))).drop("__row"))
    sliced = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    without = lambda groups: partial([g.drop(columns="__slice") for g in groups])
    # with many, slices of a group that end in one batch share a table and count as one
    parts = _map_groups(sliced, [*keys, "__slice"], without, partial_schema, many)
    return _map_groups(parts, keys, finish, schema, many)


def measure_per_group(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], dict[str, float]],
    finish: Callable[[pd.DataFrame], dict[str, float]],
    parts: list[str],
    names: list[str],
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """One row per group with the numbers `names`: partial gives the numbers `parts` of a slice of the group's rows,
    finish makes the result from a table of the slices' parts."""
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = lambda columns: ", ".join([*kinds, *[f"`{c}` double" for c in columns]])

    def rows(groups: list[pd.DataFrame], found: list[dict[str, float]], columns: list[str]) -> list[pd.DataFrame]:
        made = {k: pd.Series([g[k].iloc[0] for g in groups], dtype=object) for k in keys}  # a null leaves other keys as they are
        return [pd.DataFrame({**made, **{c: [f.get(c) for f in found] for c in columns}})]

    return _combined(
        df,
        keys,
        lambda groups: rows(groups, [partial(g) for g in groups], parts),
        schema(parts),
        lambda groups: rows(groups, [finish(g[parts]) for g in groups], names),
        schema(names),
        limit,
    )
