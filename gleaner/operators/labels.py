"""Prediction engineering: cutoff times per entity, and labels from the window after each.

Windows start at regular steps, so an event's windows follow from arithmetic on its time.
Events are grouped by (entity, window number) instead of being range-joined with cutoffs,
and a busy entity's events combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.labelers import Labeler, churn, event_count, total_spend, will_purchase
from gleaner.functions.times import micros, micros_in, shifted
from gleaner.operators.grouped import measure_per_group
from gleaner.plans.lookup import lookup
from gleaner.plans.ordered import GROUP_ROWS
from gleaner.plans.tables import with_facts, written


@dataclass(frozen=True)
class LabelWindow:
    """Cutoffs from an entity's first event plus minimum_data to its last event, one per step (default: the window).

    A label covers [cutoff + gap, cutoff + gap + window).
    """

    entity: str
    time: str
    window: str = "30 days"
    step: str | None = None
    gap: str = "0 days"
    minimum_data: str = "7 days"
    num_examples: int = -1

    @property
    def step_micros(self) -> int:
        return micros_in(self.step or self.window)


def _spans(events: DataFrame, w: LabelWindow) -> DataFrame:
    """(entity, first time, number of cutoffs), entities without a cutoff left out."""
    known = events.filter(F.col(w.entity).isNotNull() & F.col(w.time).isNotNull())
    per = known.groupBy(w.entity).agg(
        F.min(w.time).alias("__first"),
        F.min(micros(events, w.time)).alias("__start"),
        F.max(micros(events, w.time)).alias("__end"),
    )
    room = F.col("__end") - F.col("__start") - micros_in(w.minimum_data)
    count = F.when(room >= 0, F.floor(room / w.step_micros) + 1).otherwise(0)
    if w.num_examples >= 0:
        count = F.least(count, F.lit(w.num_examples))
    return per.withColumn("__count", count).filter(F.col("__count") > 0).select(w.entity, "__first", "__start", "__count")


def _cutoffs(spans: DataFrame, w: LabelWindow) -> DataFrame:
    numbered = spans.select(
        w.entity, "__first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__count") - 1)).alias("__k")
    )
    moved = shifted(F.col("__first"), F.lit(micros_in(w.minimum_data)).cast("bigint") + F.col("__k") * w.step_micros)
    return numbered.select(w.entity, "__k", moved.alias("cutoff_time"))


def cutoff_times(events: DataFrame, w: LabelWindow) -> DataFrame:
    """(entity, cutoff_time)."""
    return _cutoffs(_spans(events, w), w).select(w.entity, "cutoff_time")


def window_events(events: DataFrame, w: LabelWindow, spans: DataFrame | None = None) -> DataFrame:
    """Events with the number __k of each label window they fall in (several when windows overlap)."""
    spans = written(_spans(events, w)) if spans is None else spans
    step, window = w.step_micros, micros_in(w.window)
    at = F.col("__t") - F.col("__start") - micros_in(w.minimum_data) - micros_in(w.gap)
    last = F.least(F.floor(at / step), F.col("__count") - 1)
    first = F.greatest(F.floor((at - window) / step) + 1, F.lit(0))
    joined = lookup(events.withColumn("__t", micros(events, w.time)), spans, [w.entity], stored=True)
    hit = joined.withColumns({"__lo": first, "__hi": last}).filter(F.col("__lo") <= F.col("__hi"))
    return hit.select(*events.columns, F.explode(F.sequence("__lo", "__hi")).alias("__k"))


def make_labels(events: DataFrame, w: LabelWindow, labelers: list[Labeler] = ()) -> DataFrame:
    """(entity, cutoff_time, one column per labeler); windows without events count as empty ones."""
    labelers = list(labelers) or [event_count()]
    spans = written(_spans(events, w))
    per = window_events(events, w, spans).groupBy(w.entity, "__k").agg(
        *[lab.aggregate.alias(f"__a{i}") for i, lab in enumerate(labelers)]
    )
    labelled = _cutoffs(spans, w).join(per, [w.entity, "__k"], "left")
    return labelled.select(
        w.entity, "cutoff_time", *[lab.finish(F.col(f"__a{i}")).alias(lab.name) for i, lab in enumerate(labelers)]
    )


def make_labels_with(
    events: DataFrame,
    w: LabelWindow,
    partial: Callable[[pd.DataFrame], dict[str, float]],
    finish: Callable[[pd.DataFrame], float],
    parts: list[str],
    name: str = "label",
    empty: float | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Labels from Python functions over the rows of each window; empty is the label of a window without events.

    partial gets at most about limit rows of a window and gives the numbers `parts`; finish makes the label from
    a table with the parts of all slices of the window, which is one row unless the window is large.
    """
    spans = written(_spans(events, w))
    inside = window_events(events, w, spans)
    columns = events.columns
    measured = measure_per_group(
        inside, [w.entity, "__k"], lambda pdf: partial(pdf[columns]), lambda rows: {"__label": float(finish(rows))}, parts, ["__label"], limit
    )
    labelled = _cutoffs(spans, w).join(measured, [w.entity, "__k"], "left")
    return labelled.select(w.entity, "cutoff_time", F.coalesce("__label", F.lit(empty).cast("double")).alias(name))


def label_distribution(labels: DataFrame, name: str) -> DataFrame:
    """(label, n, n_labels, n_cutoffs): rows per label, all labels, and distinct cutoff times."""
    counts = labels.groupBy(F.col(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = labels.agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("cutoff_time").alias("n_cutoffs"))
    return with_facts(counts, whole)


def customer_churn(entity: str, time: str, window: str = "30 days") -> tuple[LabelWindow, Labeler]:
    return LabelWindow(entity, time, window), churn()


def next_purchase(entity: str, time: str, window: str = "7 days") -> tuple[LabelWindow, Labeler]:
    return LabelWindow(entity, time, window), will_purchase()


def customer_value(entity: str, time: str, amount: str, window: str = "90 days") -> tuple[LabelWindow, Labeler]:
    return LabelWindow(entity, time, window), total_spend(amount, "ltv")


def event_frequency(entity: str, time: str, window: str = "7 days") -> tuple[LabelWindow, Labeler]:
    return LabelWindow(entity, time, window), event_count()
