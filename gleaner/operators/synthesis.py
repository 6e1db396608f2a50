"""Deep feature synthesis: features of a table from its own columns and from related tables.

A child table is aggregated by its foreign key before it is joined, so a parent with very
many children costs a few partial sums per task. Every feature has a specification from
which the same feature can be computed on other tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.times import micros, micros_in
from gleaner.operators.asof import PRIMITIVES, asof_aggregate
from gleaner.operators.windows import cumulative_features, percentile_features
from gleaner.plans.lookup import lookup
from gleaner.plans.tables import written
from gleaner.types import CATEGORICAL, NUMERICAL, columns_of

AGGREGATIONS = ("mean", "sum", "min", "max", "std", "count", "num_unique")
PAIR_TRANSFORMS = ("add", "subtract", "multiply", "divide")
TRANSFORMS = (*PAIR_TRANSFORMS, "percentile", "cum_sum", "cum_mean")

# Sign of each pair transform in a feature name.
SIGNS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}


CUT = "__cut"  # the cutoff a row was chosen for, in microseconds, where rows are cut


@dataclass(frozen=True)
class Relationship:
    parent: str
    parent_key: str
    child: str
    child_key: str


@dataclass(frozen=True)
class EntitySet:
    """Tables with their unique key, optional time column, and foreign keys."""

    tables: dict[str, DataFrame]
    index: dict[str, str]
    relationships: tuple[Relationship, ...] = ()
    time: dict[str, str] = field(default_factory=dict)

    def keys_of(self, name: str) -> set[str]:
        keys = {self.index[name]} | {self.time.get(name)}
        keys |= {r.child_key for r in self.relationships if r.child == name} | {CUT}
        return keys | {r.parent_key for r in self.relationships if r.parent == name}

    def numbers(self, name: str) -> list[str]:
        return columns_of(self.tables[name], NUMERICAL, self.keys_of(name))

    def texts(self, name: str) -> list[str]:
        return columns_of(self.tables[name], CATEGORICAL, self.keys_of(name))


@dataclass(frozen=True)
class Synthesis:
    """What to generate; as JSON it can be saved and applied to other tables."""

    target: str
    aggregations: tuple[str, ...] = AGGREGATIONS
    transforms: tuple[str, ...] = TRANSFORMS
    max_depth: int = 2
    max_features: int | None = None
    training_window: str | None = None
    names: tuple[str, ...] | None = None  # keep only these features

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Synthesis:
        raw = json.loads(text)
        return Synthesis(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def pair_transforms(columns: list[str], kinds=PAIR_TRANSFORMS) -> dict[str, Column]:
    """'a + b' and so on for all column pairs; dividing by zero gives an infinity, and null for zero by zero."""

    def divided(a: Column, b: Column) -> Column:
        infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
        return F.when(b == 0, infinite).otherwise(a / b)

    forms = {
        "add": lambda a, b: a + b,
        "subtract": lambda a, b: a - b,
        "multiply": lambda a, b: a * b,
        "divide": divided,
    }
    x = lambda c: _quoted(c).cast("double")
    return {
        f"{a} {SIGNS[k]} {b}": forms[k](x(a), x(b)) for k in kinds if k in forms for a, b in combinations(columns, 2)
    }


def _single(df: DataFrame, index: str, columns: list[str] | None, transforms, max_features: int | None):
    """df with the running columns it needs, and the expressions of all features by name."""
    columns = columns_of(df, NUMERICAL, {index}) if columns is None else columns
    pairs = pair_transforms(columns, [t for t in transforms if t in PAIR_TRANSFORMS])
    running = [f"{t.upper()}({c})" for t in ("percentile", "cum_sum", "cum_mean") if t in transforms for c in columns]
    names = [*columns, *pairs, *running][:max_features]
    out = df
    sums = [c for c in columns if f"CUM_SUM({c})" in names or f"CUM_MEAN({c})" in names]
    if sums:
        out = cumulative_features(out, sums, [index])
    ranks = [c for c in columns if f"PERCENTILE({c})" in names]
    if ranks:
        out = percentile_features(out, ranks)
    computed = {f"{t.upper()}({c})": F.col(f"{c}_{t}") for t in ("percentile", "cum_sum", "cum_mean") for c in columns}
    return out, {n: pairs.get(n, computed.get(n, _quoted(n))) for n in names}


def dfs_single(
    df: DataFrame, index: str, columns: list[str] | None = None, transforms=TRANSFORMS, max_features: int | None = None
) -> DataFrame:
    """index, the numeric columns, and their transforms; running ones follow the index order.

    With max_features, that many are kept, in this order, and only those are computed.
    """
    columns = columns_of(df, NUMERICAL, {index}) if columns is None else columns
    out, made = _single(df.select(index, *columns), index, columns, transforms, max_features)
    return out.select(index, *[e.alias(n) for n, e in made.items()])


def quick_dfs(df: DataFrame, index: str, max_features: int | None = None) -> DataFrame:
    """The source table with its single-table features beside each row, without a join."""
    out, made = _single(df, index, None, TRANSFORMS, max_features)
    return out.select(*[_quoted(c) for c in df.columns], *[e.alias(n) for n, e in made.items() if n not in df.columns])


Feature = tuple[str, int]  # a numeric column and its depth: how many steps made it; a table's own columns have 0


def _needed(name: str, plan: Synthesis) -> bool:
    """Whether a plan asks for a feature or, as names tell what they are made of, for one that is made of it."""
    return plan.names is None or any(name in n for n in plan.names)


def stacked_pairs(features: list[Feature], plan: Synthesis, depth: int) -> dict[str, tuple[Callable[[], Column], int]]:
    """Pair transforms of features by name: what makes the expression, and the depth, at most the given one.

    A feature that several others are made of stays one column, computed once.
    """
    kinds = [t for t in plan.transforms if t in PAIR_TRANSFORMS]
    made = {}
    for (a, i), (b, j) in combinations(features, 2):
        if max(i, j) < depth:
            for k in kinds:
                name = f"{a} {SIGNS[k]} {b}"
                if _needed(name, plan):
                    made[name] = (lambda a=a, b=b, k=k, name=name: pair_transforms([a, b], [k])[name]), max(i, j) + 1
    return made


def _child_columns(es: EntitySet, rel: Relationship, plan: Synthesis, depth: int) -> tuple[DataFrame, list[Feature], list[str]]:
    """The child table with features of its own children and pairs of them, its numeric and its text columns."""
    child = es.tables[rel.child]
    numbers, texts = [(c, 0) for c in es.numbers(rel.child)], es.texts(rel.child)
    if depth > 1:
        child, stacked = _with_aggregates(es, rel.child, child, plan, depth - 1)
        numbers = numbers + stacked
        pairs = stacked_pairs(numbers, plan, depth - 1)
        if pairs:
            child = child.select("*", *[make().alias(n) for n, (make, _) in pairs.items()])
            numbers = numbers + [(n, d) for n, (_, d) in pairs.items()]
    return child, numbers, texts


def _wanted(rel: Relationship, numbers: list[Feature], texts, plan: Synthesis) -> list[tuple[str, str, str, int]]:
    """(name, primitive, column, depth) of all aggregates over a child table."""
    out = [(f"COUNT({rel.child})", "count", rel.child_key, 1)] if "count" in plan.aggregations else []
    for p in plan.aggregations:
        if p == "count":
            continue
        for c, d in [(t, 0) for t in texts] if p == "num_unique" else numbers:
            out.append((f"{PRIMITIVES[p][0]}({rel.child}.{c})", p, c, d + 1))
    return [w for w in out if _needed(w[0], plan)]


def _with_stats(df: DataFrame, rel: Relationship, child: DataFrame, wanted: list[tuple[str, str, str, int]]) -> DataFrame:
    """df with aggregates over the rows of one child table."""
    aggs = [(F.count(F.lit(1)) if p == "count" else PRIMITIVES[p][1](_quoted(c))).alias(n) for n, p, c, _ in wanted]
    cut = [F.col(CUT).alias("__fcut")] if CUT in child.columns else []
    stats = child.groupBy(F.col(rel.child_key).alias("__fk"), *cut).agg(*aggs)
    counts = {n for n, p, _, _ in wanted if p in ("count", "num_unique")}
    same = F.col(f"`{rel.parent_key}`") == F.col("__fk")
    joined = df.join(stats, same & (F.col(CUT) == F.col("__fcut")) if cut else same, "left")
    return joined.select(
        *[_quoted(c) for c in df.columns],
        *[F.coalesce(_quoted(n), F.lit(0)).alias(n) if n in counts else _quoted(n) for n, _, _, _ in wanted],
    )


def _with_aggregates(es: EntitySet, name: str, df: DataFrame, plan: Synthesis, depth: int) -> tuple[DataFrame, list[Feature]]:
    """df with aggregates over each child table, and the new columns."""
    made = []
    for rel in es.relationships:
        if rel.parent != name:
            continue
        child, numbers, texts = _child_columns(es, rel, plan, depth)
        wanted = _wanted(rel, numbers, texts, plan)
        if not wanted:
            continue
        before = df.columns
        # distinct counts copy every row per counted column; they are taken of the child's own few columns, apart from all else
        apart = [w for w in wanted if w[1] == "num_unique"]
        for some, rows in (([w for w in wanted if w not in apart], child), (apart, es.tables[rel.child])):
            if some:
                df = _with_stats(df, rel, rows, some)
        df = df.select(*[_quoted(c) for c in before], *[_quoted(n) for n, _, _, _ in wanted])
        made += [(n, d) for n, _, _, d in wanted]
    return df, made


def _tables_below(es: EntitySet, name: str) -> set[str]:
    found, todo = set(), [name]
    while todo:
        at = todo.pop()
        new = {r.child for r in es.relationships if r.parent == at} - found
        found |= new
        todo += new
    return found


def _aggregates_at_cutoffs(es: EntitySet, df: DataFrame, plan: Synthesis, marks: DataFrame) -> tuple[DataFrame, list[Feature]]:
    """df, a row per cutoff of the target, with aggregates over what each child table held by then.

    What lies below a child table without any time there is the same at every cutoff: it is stacked on the child's rows
    once, each row then falls into one interval between cutoffs, and intervals are accumulated. So rows never multiply
    with cutoffs. Only where a table further below has a time of its own do a child row's features differ from cutoff
    to cutoff, and its rows are taken once per cutoff.
    """
    made = []
    for rel in (r for r in es.relationships if r.parent == plan.target):
        one = EntitySet(es.tables, es.index, tuple(r for r in es.relationships if r == rel or r.parent != plan.target), es.time)
        if any(t in es.time for t in _tables_below(es, rel.child)):
            cut = _before_cutoff(one, plan.target, marks, plan.training_window)
            df, new = _with_aggregates(cut, plan.target, df, plan, plan.max_depth)
        elif rel.child not in es.time:
            df, new = _with_aggregates(one, plan.target, df, plan, plan.max_depth)
        else:
            child, numbers, texts = _child_columns(one, rel, plan, plan.max_depth)
            wanted = _wanted(rel, numbers, texts, plan)
            if not wanted:
                continue
            plain = {c: f"x{i}" for i, c in enumerate(dict.fromkeys(c for _, p, c, _ in wanted if p != "count"))}
            keys = dict.fromkeys([rel.child_key, es.time[rel.child]])
            child = written(child.select(*[_quoted(c) for c in keys], *[_quoted(c).alias(x) for c, x in plain.items()]))
            index, triples = es.index[plan.target], [(n, p, plain.get(c, c)) for n, p, c, _ in wanted]
            at = asof_aggregate(child, rel.child_key, es.time[rel.child], marks, index, "cutoff_time", triples, plan.training_window)
            df = df.join(at, [index, "cutoff_time"], "left").select(*[_quoted(c) for c in df.columns], *[_quoted(n) for n, _, _ in triples])
            new = [(n, d) for n, _, _, d in wanted]
        made += new
    return df, made


def _with_direct(es: EntitySet, name: str, df: DataFrame, depth: int) -> tuple[DataFrame, dict[str, int | None]]:
    """df with its parents' columns as 'parent.column', and theirs in turn; their depths, None for a text."""
    made: dict[str, int | None] = {}
    for rel in es.relationships:
        if rel.child != name:
            continue
        parent = es.tables[rel.parent]
        columns: dict[str, int | None] = dict.fromkeys(es.numbers(rel.parent), 0) | dict.fromkeys(es.texts(rel.parent))
        higher: dict[str, int | None] = {}
        if depth > 1:
            parent, higher = _with_direct(es, rel.parent, parent, depth - 1)
        names = [f"{rel.parent}.{c}" for c in [*columns, *higher]]
        renamed = parent.select(
            _quoted(rel.parent_key).alias(rel.child_key), *[_quoted(c).alias(n) for c, n in zip([*columns, *higher], names)]
        )
        df = lookup(df, renamed, [rel.child_key])  # a parent may have very many children
        made |= {n: None if d is None else d + 1 for n, d in zip(names, (columns | higher).values())}
    return df, made


def _before_cutoff(es: EntitySet, target: str, cutoffs: DataFrame, window: str | None) -> EntitySet:
    """Descendant tables with the rows that each cutoff lets through, once per cutoff, marked with it in CUT.

    A child row takes the cutoffs of its parent's rows; where its table has a time, those before it are left out.
    """
    tables = dict(es.tables)
    limits = {target: cutoffs.select(F.col(es.index[target]).alias("__key"), F.col(CUT))}
    todo = [target]
    while todo:
        name = todo.pop(0)
        for rel in es.relationships:
            if rel.parent != name or rel.child in limits:
                continue
            child = tables[rel.child]
            joined = child.join(limits[name].withColumnRenamed("__key", rel.child_key), rel.child_key)
            if rel.child in es.time:
                t = micros(child, es.time[rel.child])
                joined = joined.filter(t <= F.col(CUT))
                if window is not None:
                    joined = joined.filter(t > F.col(CUT) - micros_in(window))
            tables[rel.child] = joined.select(*child.columns, CUT)
            limits[rel.child] = tables[rel.child].select(F.col(es.index[rel.child]).alias("__key"), CUT)
            todo.append(rel.child)
    return EntitySet(tables, es.index, es.relationships, es.time)


def dfs_multi(es: EntitySet, plan: Synthesis, cutoffs: DataFrame | None = None) -> DataFrame:
    """Feature matrix of the target table: its columns, child aggregates up to max_depth, parent columns, transforms.

    Pair transforms apply to aggregates and parent columns too, and to a child's columns before they are aggregated,
    as long as max_depth allows; running transforms apply to own columns, along the index, and the cutoff.
    cutoffs holds (index, cutoff_time), any number for each row: the matrix has a row per cutoff, and all
    descendant tables are cut at it.
    """
    index, base = es.index[plan.target], es.tables[plan.target]
    numbers = es.numbers(plan.target)
    keep, order = [index, *numbers], [index]
    if cutoffs is not None:
        marks = cutoffs.select(index, "cutoff_time", micros(cutoffs, "cutoff_time").alias(CUT)).distinct()
        marks = written(marks.filter(F.col(CUT).isNotNull()))
        base = base.join(marks, index)
        keep, order = [index, "cutoff_time", *numbers], [index, CUT]
    running = {f"{t.upper()}({c})": F.col(f"`{c}_{t}`") for t in ("percentile", "cum_sum", "cum_mean") if t in plan.transforms for c in numbers}
    asked = [n for n in running if plan.names is None or n in plan.names]
    sums = [c for c in numbers if f"CUM_SUM({c})" in asked or f"CUM_MEAN({c})" in asked]
    if sums:
        base = cumulative_features(base, sums, order)
    ranks = [c for c in numbers if f"PERCENTILE({c})" in asked]
    if ranks:
        base = percentile_features(base, ranks)
    if cutoffs is None:
        df, made = _with_aggregates(es, plan.target, base, plan, plan.max_depth)
    else:
        df, made = _aggregates_at_cutoffs(es, base, plan, marks)
    df, direct = _with_direct(es, plan.target, df, plan.max_depth)
    pairs = pair_transforms(numbers, [t for t in plan.transforms if t in PAIR_TRANSFORMS])
    # whatever a pair is made of is a column of df by now
    above = [(c, 0) for c in numbers] + made + [(c, d) for c, d in direct.items() if d is not None]
    stacked = {n: make for n, (make, _) in stacked_pairs(above, plan, plan.max_depth).items() if n not in pairs}
    names = [*keep, *[n for n, _ in made], *direct, *pairs, *running, *stacked]
    fixed = 1 if cutoffs is None else 2
    if plan.names is not None:
        names = [*names[:fixed], *[n for n in names[fixed:] if n in plan.names]]
    elif plan.max_features is not None:
        names = names[: fixed + plan.max_features]
    made_of = lambda n: stacked[n]() if n in stacked else pairs.get(n, running.get(n, _quoted(n)))
    return df.select(*[made_of(n).alias(n) for n in names])


def feature_names(matrix: DataFrame, plan: Synthesis, es: EntitySet) -> Synthesis:
    """The plan narrowed to the features of a matrix (say after selecting some), ready to save."""
    fixed = {es.index[plan.target], "cutoff_time"}
    return Synthesis(**{**plan.__dict__, "names": tuple(c for c in matrix.columns if c not in fixed)})


def reapply_features(saved: str, es: EntitySet, cutoffs: DataFrame | None = None) -> DataFrame:
    """Compute the saved features on other tables."""
    return dfs_multi(es, Synthesis.from_json(saved), cutoffs)
