"""Aggregates of what was known at a cutoff time: rows up to the cutoff, optionally only the latest stretch.

With one cutoff per entity this is an equi-join and a time filter. With several, joining
would repeat every row for every later cutoff, so each row is instead counted once, in the
interval between neighbouring cutoffs, and intervals are accumulated over the cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.times import micros, micros_in
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS, look_back, running_totals
from gleaner.plans.tables import written

# Aggregate names, their display names, and the Spark function each one means.
PRIMITIVES = {
    "mean": ("MEAN", F.avg),
    "sum": ("SUM", F.sum),
    "min": ("MIN", F.min),
    "max": ("MAX", F.max),
    "std": ("STD", F.stddev),
    "num_unique": ("NUM_UNIQUE", F.countDistinct),
}

Wanted = list[tuple[str, str, str]]  # (output name, primitive or 'count', column)


def _aggregate(primitive: str, column: str) -> Column:
    if primitive == "count":
        return F.count(F.lit(1))
    return PRIMITIVES[primitive][1](F.col(f"`{column}`"))


def asof_aggregate(
    rows: DataFrame,
    key: str,
    time: str,
    cutoffs: DataFrame,
    entity: str,
    cutoff: str,
    wanted: Wanted,
    window: str | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """One row per distinct (entity, cutoff): aggregates of rows with time <= cutoff and, given a window, > cutoff - window."""
    marks = written(cutoffs.select(F.col(entity).alias("__e"), F.col(cutoff).alias("__c"), micros(cutoffs, cutoff).alias("__ct")).distinct())
    slim = rows.select(F.col(key).alias("__e"), micros(rows, time).alias("__t"), *[F.col(f"`{c}`") for c in dict.fromkeys(c for _, p, c in wanted if p != "count")])
    per_entity = marks.groupBy("__e").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if per_entity <= 1:
        near = (F.col("__t") <= F.col("__ct")) if window is None else (
            (F.col("__t") <= F.col("__ct")) & (F.col("__t") > F.col("__ct") - micros_in(window))
        )
        seen = lookup(slim, marks, ["__e"], limit=limit, stored=True).filter(near).groupBy("__e", "__c").agg(
            *[_aggregate(p, c).alias(n) for n, p, c in wanted]
        )
    else:
        seen = _accumulated(slim, marks, wanted, window, limit)
    counts = [n for n, p, _ in wanted if p in ("count", "num_unique")]
    # types follow from the columns alone, not from how many cutoffs an entity has
    kinds = {f.name: f.dataType for f in slim.agg(*[_aggregate(p, c).alias(n) for n, p, c in wanted]).schema.fields}
    out = marks.join(seen, ["__e", "__c"], "left")
    return out.select(
        F.col("__e").alias(entity),
        F.col("__c").alias(cutoff),
        *[
            (F.coalesce(F.col(f"`{n}`"), F.lit(0)) if n in counts else F.col(f"`{n}`")).cast(kinds[n]).alias(n)
            for n, _, _ in wanted
        ],
    )


def _intervals(slim: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """Rows with the time of the first end at or after them; rows after the last end are left out.

    The number of ends not before a row is a running total over rows and ends from late to early.
    """
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in slim.schema.fields if f.name not in ("__e", "__t")]
    marked = ends.select("__e", F.col("__t"), *blank, F.lit(1).cast("bigint").alias("__end"))
    both = slim.withColumn("__end", F.lit(0).cast("bigint")).unionByName(marked)
    placed = running_totals(both, ["__e"], [F.desc("__t"), F.desc("__end")], {"__no": F.col("__end")}, limit)
    placed = written(placed)
    times = placed.filter("__end = 1").select("__e", "__no", F.col("__t").alias("__until"))
    return lookup(placed.filter("__end = 0 and __no > 0"), times, ["__e", "__no"], limit=limit)


def _accumulated(slim: DataFrame, marks: DataFrame, wanted: Wanted, window: str | None, limit: int) -> DataFrame:
    span = None if window is None else micros_in(window)
    ends = marks.select("__e", F.col("__ct").alias("__t"))
    if span is not None:
        ends = ends.unionByName(marks.select("__e", (F.col("__ct") - span).alias("__t"))).distinct()
    near = slim.join(marks.select("__e").distinct(), "__e", "left_semi")
    parts = _intervals(near, ends, limit)
    columns = sorted({c for _, p, c in wanted if p not in ("count", "num_unique")})
    # deviations from the overall mean keep sums of squares accurate
    row = slim.agg(F.count(F.lit(1)), *[F.avg(f"`{c}`") for c in columns]).first()
    centre = dict(zip(columns, row[1:]))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        dev = x - F.lit(centre[c] or 0.0)
        aggs += [F.count(x).alias(f"__n{i}"), F.sum(dev).alias(f"__s{i}"), F.sum(dev * dev).alias(f"__q{i}")]
        own = F.col(f"`{c}`")
        aggs += [F.min(own).alias(f"__lo{i}"), F.max(own).alias(f"__hi{i}"), F.sum(own).alias(f"__t{i}")]
    per = parts.groupBy("__e", "__until").agg(*aggs)
    # one row per end: an entity has as many as it has cutoffs (twice that with a window)
    timeline = ends.withColumnRenamed("__t", "__until").join(per, ["__e", "__until"], "left")
    w = Window.partitionBy("__e").orderBy("__until")
    w = w.rangeBetween(Window.unboundedPreceding, 0) if span is None else w.rangeBetween(-span + 1, 0)
    made = []
    for name, primitive, c in wanted:
        if primitive == "num_unique":
            continue
        if primitive == "count":
            made.append(F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias(name))
            continue
        i = columns.index(c)
        whole = isinstance(slim.schema[c].dataType, (T.IntegralType, T.DecimalType))
        n, s, q = F.sum(f"__n{i}").over(w), F.sum(f"__s{i}").over(w), F.sum(f"__q{i}").over(w)
        mid = F.lit(centre[c] or 0.0)
        made.append(
            {
                "sum": F.sum(f"__t{i}").over(w) if whole else F.when(n > 0, s + n * mid),
                "mean": F.when(n > 0, s / n + mid),
                "min": F.min(f"__lo{i}").over(w),
                "max": F.max(f"__hi{i}").over(w),
                "std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))),
            }[primitive].alias(name)
        )
    out = marks.join(timeline.select("__e", F.col("__until").alias("__ct"), *made), ["__e", "__ct"], "left").drop("__ct")
    for name, primitive, c in wanted:
        if primitive == "num_unique":
            out = out.join(_unique_values(near, marks, name, c, span, limit), ["__e", "__c"], "left")
    return out


def _unique_values(slim: DataFrame, marks: DataFrame, name: str, column: str, span: int | None, limit: int) -> DataFrame:
    """Distinct values seen at each cutoff: a value counts from each occurrence until it occurs again or goes out of the window."""
    seen = slim.filter(F.col(f"`{column}`").isNotNull()).select("__e", "__t", F.col(f"`{column}`").alias("__v")).distinct()
    seen = written(seen)
    following = look_back(
        seen, ["__e", "__v"], ["__t"], lambda w: [F.lead("__t").over(w).alias("__next")], 0, 1, limit
    )
    gone = F.col("__next") if span is None else F.least(F.col("__next"), F.col("__t") + span)
    step = lambda t, d: F.struct(t.alias("__t"), F.lit(d).cast("bigint").alias("__d"))
    change = following.select("__e", F.inline(F.array(step(F.col("__t"), 1), step(gone, -1))))
    change = written(change.filter(F.col("__t").isNotNull()))
    ends = marks.select("__e", F.col("__ct").alias("__t"))
    per = _intervals(change, ends, limit).groupBy("__e", "__until").agg(F.sum("__d").alias("__d"))
    timeline = ends.withColumnRenamed("__t", "__until").join(per, ["__e", "__until"], "left")
    w = Window.partitionBy("__e").orderBy("__until").rowsBetween(Window.unboundedPreceding, 0)
    counted = timeline.select("__e", F.col("__until").alias("__ct"), F.coalesce(F.sum("__d").over(w), F.lit(0)).alias(name))
    return marks.join(counted, ["__e", "__ct"]).drop("__ct")
