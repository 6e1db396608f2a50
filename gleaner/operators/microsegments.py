"""Microsegments: combinations of conditions that lift the target more than each one alone.

Spark evaluates every condition once in generated code, packs the answers of a row into a few integers and
writes them. Each task turns its rows into one bitmap per condition, so a combination is an AND of bitmaps and a
bit count: about a byte of work per eight rows and condition. A task emits one row per combination, whatever its
input. Combinations grow level by level in written tables: adding a condition never adds rows, so only those whose
every part has enough support are counted. Nothing else limits them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.lift import segment_metrics
from gleaner.functions.predicates import Condition
from gleaner.functions.text import fixed
from gleaner.operators.insights import Goal, conditions_of
from gleaner.plans.tables import written

WORD = 62  # conditions packed into one integer
COMBINATIONS_PER_JOB = 100_000  # counted at once; a level with more takes several jobs
DEEPEST = 5


def next_level(frequent: DataFrame, features: list[str]) -> DataFrame:
    """(combo) one longer than those of frequent (combo), over distinct features, whose every part is among these.

    Two combinations that differ in the last member only are joined on what they share; a group of these has at most a
    row per condition. The parts that drop one of the shared members are then looked up among the frequent ones.
    """
    depth = F.size("combo")
    parts = frequent.select(F.slice("combo", F.lit(1), depth - 1).alias("start"), F.element_at("combo", -1).alias("last"))
    ends = parts.select(F.col("start").alias("same"), F.col("last").alias("next"))
    number = {f: i for i, f in enumerate(dict.fromkeys(features))}
    of = F.array(*[F.lit(number[f]) for f in features])
    differ = F.element_at(of, F.col("last") + 1) != F.element_at(of, F.col("next") + 1)
    grown = parts.join(ends, (F.col("start") == F.col("same")) & (F.col("last") < F.col("next")) & differ)
    grown = grown.select(F.concat("start", F.array("last", "next")).alias("combo"))
    shared = F.sequence(F.lit(1), depth - 2)
    without = F.transform(shared, lambda i: F.concat(F.slice("combo", F.lit(1), i - 1), F.slice("combo", i + 1, depth - i)))
    dropped = grown.filter(depth > 2).select("combo", F.explode(without).alias("part"))
    known = dropped.join(frequent.select(F.col("combo").alias("part")), "part")
    whole = known.groupBy("combo").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") == depth - 2).select("combo")
    return grown.filter(depth == 2).unionByName(whole)


def _packed(conditions: list[Condition]) -> list[Column]:
    words = [conditions[i : i + WORD] for i in range(0, len(conditions), WORD)]
    bit = lambda c, i: F.when(c.predicate(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return [
        reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i) for i, c in enumerate(word)]).alias(f"__w{k}")
        for k, word in enumerate(words)
    ]


def _bitmap_counter(n_conditions: int, combos: list[tuple[int, ...]]):
    """Task function: per-partition row and positive counts of every combination."""
    depths = sorted({len(c) for c in combos})
    members = {d: np.array([c for c in combos if len(c) == d], dtype=np.int32) for d in depths}
    places = {d: np.array([i for i, c in enumerate(combos) if len(c) == d]) for d in depths}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(len(combos), np.int64), np.zeros(len(combos), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)]
            hit = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) != 0
            maps = np.stack(
                [np.packbits((words[i // WORD] >> np.int64(i % WORD)) & 1 == 1) for i in range(n_conditions)]
            )
            positive = np.packbits(hit)
            for d in depths:
                for at in range(0, len(members[d]), 512):
                    rows = members[d][at : at + 512]
                    both = maps[rows[:, 0]]
                    for j in range(1, d):
                        both = both & maps[rows[:, j]]
                    where = places[d][at : at + 512]
                    n[where] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                    pos[where] += np.bitwise_count(both & positive).sum(axis=1, dtype=np.int64)
        seen = np.nonzero(n)[0]
        told = pa.array([combos[i] for i in seen.tolist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([told, pa.array(n[seen]), pa.array(pos[seen])], names=["combo", "n", "pos"])

    return count


def _counts(packed: DataFrame, n_conditions: int, combos: list[tuple[int, ...]]) -> DataFrame:
    partial = packed.mapInArrow(_bitmap_counter(n_conditions, combos), "combo array<int>, n bigint, pos bigint")
    return partial.groupBy("combo").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def combination_counts(
    df: DataFrame, conditions: list[Condition], combos: list[tuple[int, ...]], positive: Column
) -> DataFrame:
    """(combo, n, pos): rows and positive rows satisfying all conditions of each combination; those without rows are absent."""
    return _counts(df.select(*_packed(conditions), positive.cast("int").alias("__pos")), len(conditions), combos)


def counted_levels(
    df: DataFrame, conditions: list[tuple[Condition, float]], goal: Goal, max_depth: int, min_support: float
) -> Iterator[tuple[int, DataFrame]]:
    """(depth, combinations (combo, n, pos) with enough support) from depth 2 on; each depth is counted when asked for.

    A combination is the positions of its conditions. Levels are written tables; a task gets the combinations of a
    job, about COMBINATIONS_PER_JOB, and no more of a level is ever in one place.
    """
    plain, least = [c for c, _ in conditions], max(1, min_support * goal.total)
    if not plain:
        return
    packed = written(df.select(*_packed(plain), goal.positive.cast("int").alias("__pos")))

    def supported(combos: DataFrame) -> DataFrame:
        stored = written(combos)
        jobs = max(1, -(-stored.count() // COMBINATIONS_PER_JOB))
        parts = []
        for k in range(jobs):
            part = stored.filter(F.pmod(F.xxhash64("combo"), F.lit(jobs)) == k) if jobs > 1 else stored
            members = sorted(tuple(r["combo"]) for r in part.toLocalIterator())
            parts.append(written(_counts(packed, len(plain), members).filter(F.col("n") >= least)))
        return reduce(DataFrame.unionByName, parts)

    found = supported(df.sparkSession.range(len(plain)).select(F.array(F.col("id").cast("int")).alias("combo")))
    for depth in range(2, max(2, min(max_depth, DEEPEST)) + 1):
        found = supported(next_level(found.select("combo"), [c.feature for c in plain]))
        yield depth, found


def microsegments_of(counted: DataFrame, conditions: list[tuple[Condition, float]], goal: Goal) -> DataFrame:
    """Of counted combinations, those that beat their best single condition by the margin of their depth."""
    shape = "struct<feature:string,op:string,number:double,text:string>"
    told = F.array(*[F.struct(*[F.lit(v) for v in (c.feature, c.op, c.number, c.text)]).cast(shape) for c, _ in conditions])
    lifts = F.array(*[F.lit(float(lift)) for _, lift in conditions])
    depth = F.size("combo")
    measured = counted.select(
        "combo",
        depth.alias("depth"),
        F.transform("combo", lambda j: F.element_at(told, j + 1)).alias("conditions"),
        F.array_max(F.transform("combo", lambda j: F.element_at(lifts, j + 1))).alias("best_single_lift"),
        *segment_metrics(F.col("n"), F.col("pos"), goal.total, goal.positives),
    )
    margin = 1.1 + (F.col("depth") - 2) * 0.05
    return measured.filter(F.col("lift") > F.col("best_single_lift") * margin)


def microsegments(
    df: DataFrame,
    insights: DataFrame,
    goal: Goal,
    max_depth: int = 3,
    top_n: int | None = None,
    max_segments: int | None = None,
    min_support: float = 0.01,
) -> DataFrame:
    """Combinations of 2 to max_depth (itself 2 to 5) of the conditions, the top_n strongest and the best max_segments if given."""
    conditions = conditions_of(insights, top_n)
    levels = [microsegments_of(level, conditions, goal) for _, level in counted_levels(df, conditions, goal, max_depth, min_support)]
    if not levels:
        nothing = df.sparkSession.createDataFrame([], "combo array<int>, n bigint, pos bigint")
        levels = [microsegments_of(nothing, [(Condition("", "null"), 0.0)], goal)]
    found = reduce(DataFrame.unionByName, levels).orderBy(F.desc("lift"), "depth", "combo")
    return found if max_segments is None else found.limit(max_segments)


def segment_name() -> Column:
    """Readable form of a microsegment's conditions."""
    one = lambda c: (
        F.when(c["op"] == "=", F.concat(c["feature"], F.lit(" = '"), c["text"], F.lit("'")))
        .when(c["op"] == "null", F.concat(c["feature"], F.lit(" IS NULL")))
        .otherwise(F.concat_ws(" ", c["feature"], c["op"], fixed(c["number"], 3)))
    )
    return F.array_join(F.transform("conditions", one), " AND ")
