"""Joining every row with the one row its key has in a table of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.ordered import GROUP_ROWS, split_hot
from gleaner.plans.tables import null_safe_join, written

BROADCAST_CELLS = 4_000_000  # rows x columns a broadcast table may have
SALTS = 64  # shares of a hot key where even the hot keys are too many to broadcast


def _joined(df: DataFrame, table: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    if null_safe:
        return null_safe_join(df, table, keys)
    return df.join(table, keys, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in table.columns if c not in keys]
    )


def lookup(
    df: DataFrame, table: DataFrame, keys: list[str], null_safe: bool = False, limit: int = GROUP_ROWS, stored: bool = False
) -> DataFrame:
    """Left join with a table that has one row per key; unless stored, it is written first, so its size is known.

    A table of checked size is broadcast. With a larger one, rows whose key is hot meet only the hot keys' rows
    of the table, by broadcast if those are few enough and else by a join on key and salt; all others are joined
    by sorting, where no key is large any more.
    """
    table = table if stored else written(table)
    if table.count() * len(table.columns) <= BROADCAST_CELLS:
        return _joined(df, F.broadcast(table), keys, null_safe)
    cold, hot, _ = split_hot(df, keys, limit)
    if hot is None:
        return _joined(cold, table, keys, null_safe)
    hot_table = written(null_safe_join(table, hot.select(*keys).distinct(), keys, "left_semi"))
    if hot_table.count() * len(hot_table.columns) <= BROADCAST_CELLS:
        found = _joined(hot, F.broadcast(hot_table), keys, null_safe)
    else:
        salted = hot.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
        copies = hot_table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        found = _joined(salted, copies, [*keys, "__salt"], null_safe).drop("__salt")
    return _joined(cold, table, keys, null_safe).unionByName(found)
