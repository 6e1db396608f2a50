"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.tables import forget, written

FEW_EDGES = 50_000  # that the driver joins at once; rounds over as few would take their time in plans


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (a, b); keys of any ordered type.

    Every round moves each node to the one of the smallest hash among itself and its neighbours, and goes on with the
    edges between different places, each once. The hash changes with the round, so places and edges shrink by a share
    every round, however long a path, and all rounds together read about as much as the first few. Then places are
    followed back. Each round is written to the shared folder, and its edges deleted after. Edges of a node with very
    many neighbours are split by the adaptive join; minima are taken on the map side first. The last FEW_EDGES are
    joined on the driver.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while (left := edges.count()) or not moves:
        if left <= FEW_EDGES:
            moves.append(written(_at_once(edges)))
            break
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("x"))
        both = edges.select("a", ranked("b").alias("to")).union(edges.select(F.col("b").alias("a"), ranked("a").alias("to")))
        best = both.groupBy("a").agg(F.min("to").alias("to"))
        moved = written(best.select(F.col("a").alias("node"), F.least("to", ranked("a"))["x"].alias("root")))
        one, other = (moved.select(F.col("node").alias(c), F.col("root").alias(f"at_{c}")) for c in ("a", "b"))
        left = edges.join(one, "a").join(other, "b").filter(F.col("at_a") != F.col("at_b"))
        left = written(left.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b")).distinct())
        forget(edges)
        edges = left
        moves.append(moved)
    forget(edges)
    labels = moves[-1]
    for moved in reversed(moves[:-1]):
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("then"))
        labels = moved.join(further, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    labels = written(labels)
    lowest = labels.groupBy("root").agg(F.min("node").alias("low"))
    return written(labels.join(lowest, "root").select("node", F.col("low").alias("root")))


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of a few edges: a node of its component, the same for all of them."""
    rows = edges.toArrow()
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    nodes = list(above)
    kind = rows.schema.field("a").type
    table = pa.table({"node": pa.array(nodes, kind), "root": pa.array([top(x) for x in nodes], kind)})
    return edges.sparkSession.createDataFrame(table, edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
