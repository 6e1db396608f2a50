"""Features of each entity's time series.

The minimal set is one grouped aggregate plus exact medians. The efficient set looks at
neighbouring values, so rows are ordered per entity first; an entity too large for one
task is ordered and cut by the helpers in plans.ordered. Columns are stacked into
(entity, feature, time, value) rows, so all of them share the same shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.grouped import measure_per_group
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS, look_back, running_totals
from gleaner.plans.quantiles import LINEAR, group_quantiles, quantiles
from gleaner.plans.tables import null_safe_join, written

MINIMAL = ("sum_values", "median", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum")
QUANTILES = (0.1, 0.25, 0.75, 0.9)
SIGMAS = (1, 2, 3)
LAGS = (1, 2, 3)
SUPPORTS = (1, 3, 5)


def _minimal_aggregates(x: Column) -> dict[str, Column]:
    return {
        "sum_values": F.sum(x),
        "mean": F.avg(x),
        "length": F.count(x),
        "standard_deviation": F.stddev_pop(x),
        "variance": F.var_pop(x),
        "root_mean_square": F.sqrt(F.avg(x * x)),
        "maximum": F.max(x),
        "absolute_maximum": F.max(F.abs(x)),
        "minimum": F.min(x),
    }


def _stacked(df: DataFrame, entity: str, time: str | list[str], values: list[str]) -> DataFrame:
    """(entity, t1.., feature, x) without null values."""
    order = [time] if isinstance(time, str) else list(time)
    wide = df.select(
        F.col(entity).alias("__id"),
        *[F.col(o).alias(f"__t{i}") for i, o in enumerate(order)],
        *[F.col(v).cast("double").alias(v) for v in values],
    )
    ids = ["__id", *[f"__t{i}" for i in range(len(order))]]
    return wide.unpivot(ids, values, "feature", "x").filter(F.col("x").isNotNull())


def _chosen(name: str, include, exclude) -> bool:
    return (include is None or name in include) and name not in exclude


def _widened(long: DataFrame, entity: str, values: list[str], stats: list[str]) -> DataFrame:
    """One row per entity with {value}__{stat} from rows of (__id, feature, stats)."""
    cells = [F.max(F.when(F.col("feature") == v, F.col(f"`{s}`"))).alias(f"{v}__{s}") for v in values for s in stats]
    return long.groupBy("__id").agg(*cells).withColumnRenamed("__id", entity)


def ts_features(
    df: DataFrame,
    entity: str,
    time: str | list[str],
    values: list[str],
    mode: str = "minimal",
    include: set[str] | None = None,
    exclude: set[str] = frozenset(),
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """One row per entity with {value}__{feature}; mode minimal or efficient, narrowed by include and exclude."""
    if mode == "minimal":
        return _minimal(df, entity, values, include, exclude, limit)
    if mode == "efficient":
        return _efficient(df, entity, time, values, include, exclude, limit)
    raise ValueError(f"unknown mode {mode!r}")


def _minimal(df, entity, values, include, exclude, limit):
    aggs = [
        a.alias(f"{v}__{n}")
        for v in values
        for n, a in _minimal_aggregates(F.col(v).cast("double")).items()
        if _chosen(n, include, exclude)
    ]
    out = df.groupBy(entity).agg(*aggs) if aggs else df.select(entity).distinct()
    if not _chosen("median", include, exclude):
        return out
    return null_safe_join(out, group_quantiles(df, [entity], values, [0.5], {v: [f"{v}__median"] for v in values}, limit), [entity])


def _efficient(df, entity, time, values, include, exclude, limit):
    long = _stacked(df, entity, time, values)
    order = [c for c in long.columns if c.startswith("__t")]
    keys = ["__id", "feature"]
    x = F.col("x")
    base_aggs = _minimal_aggregates(x) | {
        "abs_energy": F.sum(x * x),
        "skewness": F.skewness(x),
        "kurtosis": F.kurtosis(x),
    }
    base = written(long.groupBy(*keys).agg(*[a.alias(n) for n, a in base_aggs.items()]))

    steps = max(*LAGS, *SUPPORTS)
    known = base.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("mean", "standard_deviation", "maximum", "minimum", "length")])
    facts = lookup(long, known, keys, null_safe=True, limit=limit, stored=True)
    above, below = x > F.col("__mean"), x < F.col("__mean")
    one = F.lit(1).cast("bigint")
    totals = {"__pos": one, "__above": above.cast("bigint"), "__below": below.cast("bigint")}
    sizes = base.select(*keys, F.col("length").alias("__rows"))
    placed = running_totals(facts, keys, order, totals, limit, sizes)

    def neighbours(w) -> list[Column]:
        made = [F.lag("x", k).over(w).alias(f"__b{k}") for k in range(1, steps + 1)]
        return made + [F.lead("x", k).over(w).alias(f"__f{k}") for k in range(1, max(SUPPORTS) + 1)]

    # the position orders rows totally, so both passes see the same order
    seen = written(look_back(placed, keys, ["__pos"], neighbours, steps, max(SUPPORTS), limit, sizes))
    n, mean, std = F.col("__length"), F.col("__mean"), F.col("__standard_deviation")
    step = x - F.col("__b1")
    when = lambda cond, value=one: F.when(cond, value)
    place = F.col("__pos") / n

    def peak(s: int) -> Column:
        sides = [(x > F.col(f"__b{k}")) & (x > F.col(f"__f{k}")) for k in range(1, s + 1)]
        return F.count(when(reduce(lambda a, b: a & b, sides)))

    at_max, at_min = x == F.col("__maximum"), x == F.col("__minimum")
    position = (F.col("__pos") - 1).cast("double")
    pairs = F.min(n)
    # again, now in the order of time: so last digits do not follow the order of files
    aggs = base_aggs | {
        "mean_abs_change": F.avg(F.abs(step)),
        "mean_change": F.when(pairs > 1, F.sum(step) / (pairs - 1)),
        "absolute_sum_of_changes": F.coalesce(F.sum(F.abs(step)), F.lit(0.0)),
        "cid_ce": F.sqrt(F.coalesce(F.sum(step * step), F.lit(0.0))),
        "count_above_mean": F.count(when(above)),
        "count_below_mean": F.count(when(below)),
        "first_location_of_maximum": F.min(when(at_max, (F.col("__pos") - 1) / n)),
        "last_location_of_maximum": F.max(when(at_max, place)),
        "first_location_of_minimum": F.min(when(at_min, (F.col("__pos") - 1) / n)),
        "last_location_of_minimum": F.max(when(at_min, place)),
        "linear_trend_slope": F.regr_slope(x, position),
        "linear_trend_intercept": F.avg(x) - F.regr_slope(x, position) * F.avg(position),
        "linear_trend_rvalue": F.corr(x, position),
    }
    for s in SIGMAS:
        aggs[f"ratio_beyond_{s}_sigma"] = F.count(when(F.abs(x - mean) > s * std)) / pairs
    for k in LAGS:
        products = F.sum((x - mean) * (F.col(f"__b{k}") - mean))
        aggs[f"autocorrelation_lag_{k}"] = F.when(
            (pairs > k) & (F.min(std) > 0), products / ((pairs - k) * F.min(std) * F.min(std))
        )
    for s in SUPPORTS:
        aggs[f"number_peaks_{s}"] = peak(s)
    ordered = seen.groupBy(*keys).agg(*[a.alias(n_) for n_, a in aggs.items()])

    # rows of one unbroken strike share position minus running count
    strikes = []
    for name, flag, count in (("above", above, "__above"), ("below", below, "__below")):
        runs = seen.filter(flag).groupBy(*keys, (F.col("__pos") - F.col(count)).alias("__run")).agg(F.count(F.lit(1)).alias("n"))
        strikes.append(runs.groupBy(*keys).agg(F.max("n").alias(f"longest_strike_{name}_mean")))
    repeats = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg((F.max("n") > 1).cast("int").alias("has_duplicate"))

    joined = ordered
    for part in (*strikes, repeats):
        joined = null_safe_join(joined, part, keys)
    joined = joined.withColumns(
        {f"longest_strike_{s}_mean": F.coalesce(F.col(f"longest_strike_{s}_mean"), F.lit(0)) for s in ("above", "below")}
    )
    stats = [c for c in joined.columns if c not in keys and _chosen(c, include, exclude)]
    wide = _widened(joined, entity, values, stats)
    cuts = {f"quantile_{round(100 * q)}": q for q in QUANTILES} | {"median": 0.5}
    cuts = {n_: q for n_, q in cuts.items() if _chosen(n_, include, exclude)}
    if cuts:
        names = {v: [f"{v}__{n_}" for n_ in cuts] for v in values}
        wide = null_safe_join(wide, group_quantiles(df, [entity], values, list(cuts.values()), names, limit), [entity])
    return wide


def ts_features_with(
    df: DataFrame,
    entity: str,
    partial: Callable[[pd.DataFrame], dict[str, float]],
    finish: Callable[[pd.DataFrame], dict[str, float]],
    parts: list[str],
    names: list[str],
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """One row per entity with the numbers `names` that Python functions compute.

    partial gets at most about limit rows of the entity and gives the numbers `parts`; finish makes the features
    from a table of all slices' parts. What needs the order of time can keep first and last times among its parts.
    """
    return measure_per_group(df, [entity], partial, finish, parts, names, limit)


def impute_features(df: DataFrame, columns: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """NaN and null become the column's median of finite values, infinities its largest or smallest one; 0 if there is none."""
    x = lambda c: F.col(f"`{c}`").cast("double")
    infinite = lambda c: x(c).isin(float("inf"), float("-inf"))
    finite = df.select(*[F.when(~(F.isnan(x(c)) | infinite(c)), x(c)).alias(c) for c in columns])
    found = quantiles(finite, columns, [0.0, 0.5, 1.0], LINEAR, limit)
    made = {}
    for c in columns:
        low, mid, high = [v if v is not None else 0.0 for v in found[c]]
        made[c] = (
            F.when(x(c).isNull() | F.isnan(x(c)), F.lit(mid))
            .when(x(c) == float("inf"), F.lit(high))
            .when(x(c) == float("-inf"), F.lit(low))
            .otherwise(x(c))
        )
    return df.withColumns(made)


def select_relevant(df: DataFrame, columns: list[str], target: str, classification: bool = True, fdr: float = 0.05) -> list[str]:
    """Columns whose F test against the target passes the Benjamini-Hochberg procedure at rate fdr."""
    assembled = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    selector = UnivariateFeatureSelector(
        featuresCol="__v", labelCol=target, outputCol="__s", selectionMode="fdr"
    ).setFeatureType("continuous").setLabelType("categorical" if classification else "continuous")
    kept = selector.setSelectionThreshold(fdr).fit(assembled).selectedFeatures
    return [columns[i] for i in sorted(kept)]
