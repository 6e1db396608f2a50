"""Exact quantiles without sending a column, or a hot group, through one task.

A percentile aggregate merges one buffer per input partition in a single reducer, and an
exact one keeps every value there. That is fine for GROUP_ROWS rows. Beyond that, two
scans find the same answer: a sample proposes cut points, the first scan counts rows
between cut points, and the second keeps only the few value ranges that hold a wanted
rank. A poor sample makes those ranges wider, never the answer wrong.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS, running_totals, split_hot
from gleaner.plans.tables import null_safe_join, written

SAMPLE_ROWS = 500_000
CUT_MARGIN = 0.0025  # several standard errors of a sample quantile
COLUMNS_PER_METHOD = 8
DISCRETE = "discrete"
LINEAR = "linear"


def long_values(df: DataFrame, columns: list[str], keep=()) -> DataFrame:
    """Rows of (keep..., feature, x) with the columns as doubles and nulls dropped."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), columns, "feature", "x").filter(F.col("x").isNotNull())


def _ranks(n: int, p: float, kind: str) -> tuple[int, int, float]:
    """1-based ranks (low, high) around the quantile and the weight of the high one."""
    if kind == DISCRETE:
        r = max(1, math.ceil(p * n - 1e-9))
        return r, r, 0.0
    at = (n - 1) * p
    low = math.floor(at)
    return low + 1, min(n, math.ceil(at) + 1), at - low


def _wanted_ranks(totals: dict[str, int], probs: list[float], kind: str) -> dict[str, list[int]]:
    return {c: sorted({r for p in probs for r in _ranks(n, p, kind)[:2]}) for c, n in totals.items()}


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], kind: str = DISCRETE, limit: int = GROUP_ROWS
) -> dict[str, list[float | None]]:
    """Exact quantiles of each column; DISCRETE picks a value, LINEAR interpolates between two."""
    if not columns:
        return {}
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = wide.count()  # parquet footers answer this without reading data
    if rows <= limit:
        known = wide.agg(*[F.count(c) for c in columns]).first()
        totals = {c: n for c, n in zip(columns, known) if n}
        at = _values_directly(wide, _wanted_ranks(totals, probs, kind), totals)
    else:
        totals, at = _values_in_buckets(wide, columns, probs, kind, rows, limit)
    out = {}
    for c in columns:
        places = [_ranks(totals[c], p, kind) for p in probs] if c in totals else []
        out[c] = [at[c][low] if w == 0 else at[c][low] + (at[c][high] - at[c][low]) * w for low, high, w in places]
        out[c] = out[c] or [None] * len(probs)
    return out


def _values_directly(wide: DataFrame, ranks: dict[str, list[int]], totals: dict[str, int]) -> dict[str, dict[int, float]]:
    """{column: {rank: value}} in one aggregate.

    The sketch is exact once rows / accuracy is below a half; the accuracy here leaves a wide margin.
    """
    if not ranks:
        return {}
    share = lambda c: F.array(*[F.lit((r - 0.5) / totals[c]) for r in ranks[c]])
    row = wide.agg(*[F.percentile_approx(c, share(c), max(8 * totals[c], 10_000)).alias(c) for c in ranks]).first()
    return {c: dict(zip(ranks[c], row[c])) for c in ranks}


def _proposed_cuts(wide: DataFrame, columns: list[str], probs: list[float], rows: int) -> dict[str, list[float]]:
    """Cut points a little below and above each quantile of a sample."""
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-CUT_MARGIN, CUT_MARGIN)})
    asked = F.array(*[F.lit(p) for p in edges])
    sample = wide.sample(min(1.0, SAMPLE_ROWS / rows), seed=7)
    row = sample.agg(*[F.percentile_approx(c, asked, 10_000).alias(c) for c in columns]).first()
    return {c: sorted({v for v in row[c] or [] if not math.isnan(v)}) for c in columns}


def _bucket(c: str, cuts: list[float]) -> Column:
    """Number of cuts at or below the value."""
    case = F.when(F.col(c).isNull(), None)
    for i, cut in enumerate(cuts):
        case = case.when(F.col(c) < F.lit(cut), i)
    return case.otherwise(len(cuts)).cast("int")


def _inside(c: str, cuts: list[float], bucket: int) -> Column:
    """Whether a value lies in one bucket."""
    tests = [F.col(c) >= F.lit(cuts[bucket - 1])] if bucket else []
    tests += [F.col(c) < F.lit(cuts[bucket])] if bucket < len(cuts) else []
    return reduce(and_, tests, F.lit(True))


def _bucket_sizes(wide: DataFrame, columns: list[str], cuts: dict[str, list[float]]) -> dict[str, dict[int, int]]:
    """Rows per column and bucket.

    Column and bucket share one integer, the cheapest key to group by. A few columns go into
    one generated method, since a long one is not compiled; each group reads only its columns.
    """
    stride = max((len(v) for v in cuts.values()), default=0) + 1
    parts = []
    for at in range(0, len(columns), COLUMNS_PER_METHOD):
        some = list(enumerate(columns))[at : at + COLUMNS_PER_METHOD]
        numbered = wide.select(*[(_bucket(c, cuts[c]) + i * stride).alias(c) for i, c in some])
        long = numbered.unpivot([], [c for _, c in some], "feature", "place").filter(F.col("place").isNotNull())
        parts.append(long.groupBy("place").count())
    sizes: dict[str, dict[int, int]] = {}
    for r in reduce(DataFrame.unionByName, parts).collect():  # one row per column and bucket
        sizes.setdefault(columns[r["place"] // stride], {})[r["place"] % stride] = r["count"]
    return sizes


def _values_in_buckets(
    wide: DataFrame, columns: list[str], probs: list[float], kind: str, rows: int, limit: int
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Row counts and {column: {rank: value}}: count rows between cut points, then rank only ranges with a wanted rank."""
    spark = wide.sparkSession
    cuts = _proposed_cuts(wide, columns, probs, rows)
    sizes = _bucket_sizes(wide, columns, cuts)
    totals = {c: sum(parts.values()) for c, parts in sizes.items()}
    ranks = _wanted_ranks(totals, probs, kind)
    marks, kept = [], {}
    for c, parts in sizes.items():
        before = skipped = 0
        for b, n in sorted(parts.items()):
            hits = [r for r in ranks[c] if before < r <= before + n]
            if hits:
                kept.setdefault(c, []).append(_inside(c, cuts[c], b))
                marks += [(c, r, r - skipped) for r in hits]  # rank among the kept values
            else:
                skipped += n
            before += n
    if not marks:
        return totals, {}
    near = wide.select(*[F.when(reduce(or_, tests), F.col(c)).alias(c) for c, tests in kept.items()])
    long = near.unpivot([], list(kept), "feature", "x").filter(F.col("x").isNotNull())
    values = written(long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(values, ["feature"], ["x"], {"upto": F.col("n")}, limit)
    # at most two marks per column and probability, so they can be broadcast
    wanted = spark.createDataFrame(marks, "feature string, rank bigint, kept_rank bigint")
    found = (
        placed.join(F.broadcast(wanted), "feature")
        .filter((F.col("kept_rank") <= F.col("upto")) & (F.col("kept_rank") > F.col("upto") - F.col("n")))
        .select("feature", "rank", "x")
        .collect()
    )
    at: dict[str, dict[int, float]] = {c: {} for c in totals}
    for r in found:
        at[r["feature"]][r["rank"]] = r["x"]
    return totals, at


def group_quantiles(
    df: DataFrame, keys, columns: list[str], probs: list[float], names: dict[str, list[str]], limit: int = GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group: one row per group, a column per (column, probability).

    Small groups use the percentile aggregate. Groups above limit rows are ranked by value counts. sizes, a table of
    the keys and __rows, saves the scan that counts rows per group.
    """
    keys = list(keys)
    cold, hot, _ = split_hot(df.select(*keys, *columns), keys, limit, sizes)
    parts = []
    if cold is not None:
        asked = F.array(*[F.lit(float(p)) for p in probs])
        per = cold.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), asked).alias(f"__q{i}") for i, c in enumerate(columns)])
        parts.append(
            per.select(*keys, *[F.col(f"__q{i}")[j].alias(names[c][j]) for i, c in enumerate(columns) for j in range(len(probs))])
        )
    if hot is not None:
        parts.append(_hot_group_quantiles(hot, keys, columns, probs, names, limit))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _hot_group_quantiles(hot, keys, columns, probs, names, limit):
    counts = written(long_values(hot, columns, keys).groupBy(*keys, "feature", "x").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(counts, [*keys, "feature"], ["x"], {"upto": F.col("n")}, limit)
    total = counts.groupBy(*keys, "feature").agg(F.sum("n").alias("total"))
    ranked = lookup(placed, total, [*keys, "feature"], null_safe=True, limit=limit)

    def value_at(rank):
        inside = (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("n"))
        return lambda c: F.max(F.when(inside & (F.col("feature") == c), F.col("x")))

    aggs = []
    for j, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high, w = F.floor(at) + 1, F.ceil(at) + 1, at - F.floor(at)
        for c in columns:
            share = F.max(F.when(F.col("feature") == c, w))
            a, b = value_at(low)(c), value_at(high)(c)
            aggs.append((a + (b - a) * share).alias(names[c][j]))
    per = ranked.groupBy(*keys).agg(*aggs)
    # a group whose values are all null has no counts but still needs its row
    return null_safe_join(hot.select(*keys).distinct(), per, keys, "left")


def value_ranks(df: DataFrame, column: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Per distinct non-null value: its count n and average rank, ranks running over the whole column."""
    return ranks_of_all(df, [column], limit).select("value", "n", "avg_rank")


def ranks_of_all(df: DataFrame, columns: list[str], limit: int = GROUP_ROWS) -> DataFrame:
    """(feature, value, n, avg_rank) of every distinct non-null value of all columns, which share one type.

    One ranking serves all columns: values are counted, and counts run along each column, whose values may be many.
    """
    wide = df.select(*[F.col(f"`{c}`").alias(c) for c in columns])
    long = wide.unpivot([], columns, "feature", "value").filter(F.col("value").isNotNull())
    counts = written(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(counts, ["feature"], ["value"], {"upto": F.col("n")}, limit)
    return placed.select("feature", "value", "n", (F.col("upto") - (F.col("n") - 1) / 2).cast(T.DoubleType()).alias("avg_rank"))
