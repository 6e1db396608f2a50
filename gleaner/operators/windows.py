"""Lag, rolling, difference, running and per-entity features over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rowwise import number
from gleaner.functions.sums import grid_units, split_on_grid
from gleaner.functions.times import micros
from gleaner.plans import lookup as lookups
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS, look_back, running_totals
from gleaner.plans.quantiles import group_quantiles, ranks_of_all
from gleaner.plans.tables import null_safe_join, written
from gleaner.types import DATETIME, role_of

# Rolling statistics and the Spark function each one means.
ROLLING = {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "sum": F.sum}


def lag_features(df: DataFrame, columns, order, partition=(), lags=(1, 2, 3, 7), limit=GROUP_ROWS) -> DataFrame:
    """{column}_lag_{k}: the value k rows earlier."""
    made = lambda w: [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in columns for k in lags]
    return look_back(df, partition, order, made, max(lags), limit=limit)


def rolling_features(
    df: DataFrame, columns, order, partition=(), windows=(3, 7, 14), funcs=("mean", "std", "min", "max"), limit=GROUP_ROWS
) -> DataFrame:
    """{column}_rolling_{func}_{w} over the w rows before the current one, which is left out."""

    def made(w):
        return [
            ROLLING[f](c).over(w.rowsBetween(-size, -1)).alias(f"{c}_rolling_{f}_{size}")
            for size in windows
            for c in columns
            for f in funcs
        ]

    return look_back(df, partition, order, made, max(windows), limit=limit)


def diff_features(df: DataFrame, columns, order, partition=(), periods=(1,), limit=GROUP_ROWS) -> DataFrame:
    """{column}_diff_{p}: the value minus the one p rows earlier."""
    made = lambda w: [
        (number(c) - F.lag(number(c), p).over(w)).alias(f"{c}_diff_{p}") for c in columns for p in periods
    ]
    return look_back(df, partition, order, made, max(periods), limit=limit)


def pct_change_features(df: DataFrame, columns, order, partition=(), periods=(1,), limit=GROUP_ROWS) -> DataFrame:
    """{column}_pct_change_{p}: relative change against p rows earlier; 0 when that is 0 or null."""

    def change(c, p, w) -> Column:
        before = F.lag(number(c), p).over(w)
        return F.when(before != 0, (number(c) - before) / F.abs(before)).otherwise(F.lit(0.0))

    made = lambda w: [change(c, p, w).alias(f"{c}_pct_change_{p}") for c in columns for p in periods]
    return look_back(df, partition, order, made, max(periods), limit=limit)


def entity_profile(df: DataFrame, entity: str, order, columns, limit: int = GROUP_ROWS, trend: bool = True) -> DataFrame:
    """One row per entity and {column}__{stat}: mean, std, min, max, sum, count, range, first, last, median, variance, trend.

    trend is the least-squares slope against seconds of the first order column. Every statistic
    but the median combines on the map side, so a hot entity costs no more than others.
    """
    order = [order] if isinstance(order, str) else list(order)
    when = F.struct(*order)
    seconds = seconds_of(df, order[0])
    aggs = []
    for c in columns:
        x = number(c)
        aggs += [
            F.avg(x).alias(f"{c}__mean"),
            F.stddev(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            F.sum(x).alias(f"{c}__sum"),
            F.count(x).alias(f"{c}__count"),
            (F.max(x) - F.min(x)).alias(f"{c}__range"),
            F.min_by(x, when).alias(f"{c}__first"),
            F.max_by(x, when).alias(f"{c}__last"),
            F.variance(x).alias(f"{c}__variance"),
        ]
        if trend:
            aggs.append(F.regr_slope(x, seconds).alias(f"{c}__trend"))
    # rows per entity come with the statistics, so hot entities are known without another scan
    stats = written(df.groupBy(entity).agg(F.count(F.lit(1)).alias("__rows"), *aggs))
    sizes, names = stats.select(entity, "__rows"), {c: [f"{c}__median"] for c in columns}
    medians = group_quantiles(df, [entity], list(columns), [0.5], names, limit, sizes)
    return null_safe_join(stats.drop("__rows"), medians, [entity], "left")


def seconds_of(df: DataFrame, column: str) -> Column:
    """A numeric position in time for dates and timestamps, the number itself otherwise."""
    if role_of(df.schema[column].dataType) == DATETIME:
        return micros(df, column) / 1e6
    return F.col(column).cast("double")


def entity_features(df: DataFrame, entity: str, order, columns, limit: int = GROUP_ROWS) -> DataFrame:
    """Every row with the profile of its entity."""
    return lookup(df, entity_profile(df, entity, order, columns, limit), [entity], null_safe=True, limit=limit)


def cumulative_features(df: DataFrame, columns, order, partition=(), limit: int = GROUP_ROWS) -> DataFrame:
    """{column}_cum_sum and {column}_cum_mean up to and with the row; null where the value is null.

    Sums are as good as rounded once, however many rows they run over: errors of single additions do not pile up.
    """
    totals, grids = {}, grid_units(df, [number(c) for c in columns])
    for c, unit in zip(columns, grids):
        on_grid, rest = split_on_grid(F.coalesce(number(c), F.lit(0.0)), unit)
        totals[f"__s_{c}"], totals[f"__r_{c}"] = on_grid, rest
        totals[f"__n_{c}"] = F.col(c).isNotNull().cast("bigint")
    placed = running_totals(df, partition, order, totals, limit)
    made = []
    for c in columns:
        known, total = F.col(c).isNotNull(), F.col(f"__s_{c}") + F.col(f"__r_{c}")
        made.append(F.when(known, total).alias(f"{c}_cum_sum"))
        made.append(F.when(known, total / F.col(f"__n_{c}")).alias(f"{c}_cum_mean"))
    return placed.select(*df.columns, *made)


def percentile_features(df: DataFrame, columns, limit: int = GROUP_ROWS) -> DataFrame:
    """{column}_percentile: average rank among the non-null values, divided by their number.

    Columns of one type are ranked together, so the jobs do not grow with the columns. Ranks of columns with few
    distinct values, as counted, are broadcast together in one plan; others are looked up one by one.
    """
    kinds: dict = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType, []).append(c)
    out, room = df, lookups.BROADCAST_CELLS
    for group in kinds.values():
        ranks = written(ranks_of_all(df, group, limit))
        totals = {r["feature"]: (r["total"], r["values"]) for r in _rank_totals(ranks)}
        for c in group:
            total, values = totals.get(c, (1, 0))
            share = F.col("avg_rank") / F.lit(float(total))
            table = ranks.filter(F.col("feature") == c).select(F.col("value").alias(c), share.alias(f"{c}_percentile"))
            if 2 * values <= room:
                room -= 2 * values
                out = out.join(F.broadcast(table), [c], "left").select(*[F.col(f"`{x}`") for x in out.columns], f"`{c}_percentile`")
            else:
                out = lookup(out, table, [c], limit=limit, stored=True)
    return out


def _rank_totals(ranks: DataFrame) -> list:
    """A row per column: rows and distinct values."""
    return ranks.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values")).collect()
