"""Ordered computation (lags, frames, running totals, ranks) when one group may be huge.

A window function sorts each partition-by group inside one task. Groups of up to
GROUP_ROWS rows take that direct way. A larger group, or a whole table without a
partition key, is cut into range slices that many tasks work on, and the slices are
stitched together with carried totals or with copies of the few rows a frame looks back on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.tables import null_safe_join, written

GROUP_ROWS = 2_000_000
BROADCAST_KEYS = 1_000_000
MAX_SLICES = 20_000  # a shuffle into more partitions than this has too many blocks; slices grow instead


def split_hot(df: DataFrame, keys: list[str], limit: int, sizes: DataFrame | None = None):
    """Split df into rows of small groups and rows of groups above limit, with the hot row count.

    Returns (cold, hot, hot_rows); one of the frames is None where it would be empty for sure.
    sizes, a table of the keys and __rows, saves the scan that counts rows per group.
    """
    if not keys:
        rows = df.count()
        return (df, None, 0) if rows <= limit else (None, df, rows)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = written(sizes.filter(F.col("__rows") > limit))
    hot_rows = hot.agg(F.sum("__rows")).first()[0]
    if not hot_rows:
        return df, None, 0
    hot_keys = hot.drop("__rows")
    if hot.count() <= BROADCAST_KEYS:  # keys with more than limit rows each; beyond that, none holds a large share of rows
        hot_keys = F.broadcast(hot_keys)
    return null_safe_join(df, hot_keys, keys, "left_anti"), null_safe_join(df, hot_keys, keys, "left_semi"), hot_rows


def _order_columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def order_tie(df: DataFrame) -> Column:
    """Last order key: rows that tie in the caller's order come in one order in every way of computing."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*plain)


def _in_slices(df: DataFrame, keys: list[str], order: list[Column], rows: int, limit: int):
    """Range-partition by (keys, order) into about rows/limit slices of whole order ranges."""
    parts = min(MAX_SLICES, max(2, -(-rows // max(1, limit // 2))))
    # numbered rows, so that rows which are equal fall into different slices too
    tied = written(df.withColumn("__tie", order_tie(df)).withColumn("__row", F.monotonically_increasing_id()))
    full_order = [*order, F.col("__tie"), F.col("__row")]
    sliced = tied.repartitionByRange(parts, *keys, *full_order).withColumn("__slice", F.spark_partition_id())
    return written(sliced), full_order


def running_totals(
    df: DataFrame, keys, order, totals: dict[str, Column], limit: int = GROUP_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Append, per group and in the given order, the sum of each expression up to and with the row.

    df is read twice (once to look for hot groups) unless sizes are given, so store what is costly to compute.

    Rows with equal order values come in the order of a hash of the row; rows that are equal are interchangeable. A lit(1) total is the row position.
    """
    keys, order = list(keys), _order_columns(order)
    cold, hot, rows = split_hot(df, keys, limit, sizes)
    parts = []
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy(*order, order_tie(cold)).rowsBetween(Window.unboundedPreceding, 0)
        parts.append(cold.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in totals.items()]))
    if hot is not None:
        parts.append(_running_in_slices(hot, keys, order, totals, rows, limit))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _running_in_slices(df, keys, order, totals, rows, limit):
    sliced, full_order = _in_slices(df, keys, order, rows, limit)
    per_slice = sliced.groupBy(*keys, "__slice").agg(*[F.sum(e).alias(f"__t_{n}") for n, e in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(
        per_slice.select(
            *keys, "__slice", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in totals]
        )
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*full_order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(sliced, carried, [*keys, "__slice"], "inner")
    return joined.select(
        *df.columns, *[(F.coalesce(F.sum(e).over(inside), F.lit(0)) + F.col(f"__c_{n}")).alias(n) for n, e in totals.items()]
    )


def look_back(
    df: DataFrame,
    keys,
    order,
    columns: Callable[[Window], list[Column]],
    rows_back: int,
    rows_ahead: int = 0,
    limit: int = GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Append window columns whose frames reach at most rows_back before and rows_ahead after the row.

    Hot groups are numbered, cut into blocks, and each block also gets copies of the
    neighbouring rows its frames can reach; the copies are dropped after the window ran.
    """
    keys, order = list(keys), _order_columns(order)
    cold, hot, rows = split_hot(df, keys, limit, sizes)
    parts = []
    if cold is not None:
        parts.append(cold.select("*", *columns(Window.partitionBy(*keys).orderBy(*order, order_tie(cold)))))
    if hot is not None:
        block = max(limit // 2, rows_back, rows_ahead, 1)
        placed = _running_in_slices(hot, keys, order, {"__seq": F.lit(1).cast("bigint")}, rows, limit)
        home = F.floor((F.col("__seq") - 1) / block)
        offset = (F.col("__seq") - 1) % block
        reach = F.array(
            home,
            F.when(offset >= block - rows_back, home + 1),
            F.when(offset < rows_ahead, home - 1),
        )
        copies = placed.select("*", home.alias("__home"), F.explode(F.array_compact(reach)).alias("__block"))
        w = Window.partitionBy(*keys, "__block").orderBy("__seq")
        done = copies.select("*", *columns(w)).filter(F.col("__home") == F.col("__block"))
        parts.append(done.drop("__seq", "__home", "__block"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
