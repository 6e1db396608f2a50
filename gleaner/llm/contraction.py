"""Totals over all subtrees of a forest by parallel tree contraction, in rounds of joins.

A round rakes all leaves into their parents and compresses chains: of the nodes with one child that is no leaf, those
whose hash is above that child's and the parent's are spliced out, a third of a long chain on average. The tables of
the rounds shrink geometrically, so the work is linear in the nodes and the number of rounds logarithmic, however deep
the tree or wide a node. Re-expansion goes back through the rounds and gives every contracted node its total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans.tables import written


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): for every row of tree (node, parent, *values) the sums over the node and all below it.

    node is unique and never null, of any ordered type; parent is null for a root. values are integers, null counts as
    0. Ties of hashes only delay a splice. An empty table gives no rows; other columns are not looked at. Every round
    is written to the shared folder. A node with very many children is summed on the map side first.
    """
    rounds = [written(_start(tree.select("node", "parent", *values), values))]
    while rounds[-1].filter(F.col("kids") > 0).limit(1).count():
        rounds.append(written(contracted(rounds[-1], values, len(rounds))))
    total = lambda alive: alive.filter(F.col("kids") == 0).select("node", *[F.col(f"acc_{v}").alias(v) for v in values])
    known = total(rounds[-1])
    for before, after in zip(reversed(rounds[:-1]), reversed(rounds[1:])):
        spliced = after.filter(F.col("gone").isNotNull()).join(known, "node")
        back = spliced.select(F.col("gone").alias("node"), *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values])
        known = written(total(before).unionByName(known).unionByName(back))
    return known


def _start(tree: DataFrame, values: list[str]) -> DataFrame:
    """Rows of a round: kids (children still there), acc (sums at the node), edge (sums of nodes spliced out above it)."""
    kids = tree.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    return tree.join(kids, "node", "left").select(
        "node",
        "parent",
        F.coalesce("kids", F.lit(0)).cast("bigint").alias("kids"),
        *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(f"acc_{v}") for v in values],
        *[F.lit(0).cast("bigint").alias(f"edge_{v}") for v in values],
        F.lit(None).cast(tree.schema["node"].dataType).alias("gone"),
        *[F.lit(0).cast("bigint").alias(f"more_{v}") for v in values],
    )


def contracted(alive: DataFrame, values: list[str], turn: int) -> DataFrame:
    """The next round. gone names the parent that a node lost to a splice, more what that parent's total adds to its own."""
    leaf = F.col("kids") == 0
    below = (
        alive.filter(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("up"))
        .agg(
            F.sum((~leaf).cast("bigint")).alias("rest"),
            F.max(F.when(~leaf, F.col("node"))).alias("only"),
            *[F.sum(F.when(leaf, F.col(f"acc_{v}") + F.col(f"edge_{v}")).otherwise(0)).alias(f"got_{v}") for v in values],
        )
    )
    inner = alive.filter(~leaf).join(below, F.col("node") == F.col("up"))
    inner = inner.select(
        "node", "parent", "rest", "only", *[(F.col(f"acc_{v}") + F.col(f"got_{v}")).alias(f"acc_{v}") for v in values],
        *[f"edge_{v}" for v in values],
    )
    coin = lambda name: F.xxhash64(F.lit(turn), F.col(name))
    splice = (F.col("rest") == 1) & F.col("parent").isNotNull() & (coin("node") > coin("only")) & (coin("node") > coin("parent"))
    # a spliced node becomes a message to its child, any other a message to itself
    own = lambda name: F.when(~F.col("splice"), F.col(name))
    gone = lambda name: F.when(F.col("splice"), F.col(name))
    sent = inner.withColumn("splice", F.coalesce(splice, F.lit(False))).select(
        F.when(F.col("splice"), F.col("only")).otherwise(F.col("node")).alias("node"),
        own("parent").alias("parent"),
        own("rest").alias("kids"),
        *[own(f"acc_{v}").alias(f"acc_{v}") for v in values],
        *[own(f"edge_{v}").alias(f"edge_{v}") for v in values],
        gone("node").alias("gone"),
        gone("parent").alias("gone_parent"),
        *[gone(f"acc_{v}").alias(f"gone_acc_{v}") for v in values],
        *[gone(f"edge_{v}").alias(f"gone_edge_{v}") for v in values],
    )
    met = sent.groupBy("node").agg(*[F.max(c).alias(c) for c in sent.columns if c != "node"])
    return met.select(
        "node",
        F.coalesce("gone_parent", "parent").alias("parent"),
        "kids",
        *[f"acc_{v}" for v in values],
        *[
            (F.col(f"edge_{v}") + F.coalesce(F.col(f"gone_acc_{v}") + F.col(f"gone_edge_{v}"), F.lit(0))).alias(f"edge_{v}")
            for v in values
        ],
        "gone",
        *[(F.col(f"edge_{v}") + F.coalesce(F.col(f"gone_acc_{v}"), F.lit(0))).alias(f"more_{v}") for v in values],
    )
