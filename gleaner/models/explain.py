"""What trees learned: importances, effect of each split, and each feature's share in a prediction.

A model's nodes are few (trees x nodes per tree), so they are read on the driver; rows stay
on the cluster. Contributions are path-dependent Shapley values: for one leaf an integral over
the share t of known features, whose integrand is a polynomial, so a few Gauss points give it
exactly and a leaf costs its path's length squared, however deep the tree.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.models.boosting import BoostedTrees
from gleaner.plans.tables import shared_folder


@dataclass
class Node:
    value: float
    cover: float
    gain: float
    feature: int = -1
    threshold: float = 0.0
    categories: tuple[float, ...] | None = None  # values going left, for a categorical split
    left: int = -1
    right: int = -1


@dataclass
class Trees:
    """Nodes of each tree by id; leaf values already carry the tree's weight."""

    nodes: list[dict[int, Node]] = field(default_factory=list)
    margin_scale: float = 1.0  # probability is the logistic of scale x sum, for boosted classifiers
    base: float = 0.0  # added to the trees' sum

    def leaves_under(self, tree: int, node: int) -> list[float]:
        n = self.nodes[tree][node]
        if n.feature < 0:
            return [n.value]
        return self.leaves_under(tree, n.left) + self.leaves_under(tree, n.right)


def read_trees(spark: SparkSession, model: Model) -> Trees:
    """The node table of a fitted tree model: of boosted trees as they are, of others taken from the saved form."""
    if isinstance(model, BoostedTrees):
        return _of_boosted(model)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    single = "treeID" not in rows.columns
    if single:
        rows = rows.select(F.lit(0).alias("treeID"), F.struct(*rows.columns).alias("nodeData"))
    classes = getattr(model, "numClasses", 0)
    weights = [1.0] if single else list(model.treeWeights)
    boosted = type(model).__name__.startswith("GBT")
    if not single and not boosted:  # forests average their trees
        weights = [w / len(weights) for w in weights]
    out = Trees([{} for _ in weights], 2.0 if boosted and classes == 2 else 1.0)
    for r in rows.select("treeID", "nodeData.*").collect():
        value = r["prediction"]
        if classes >= 2 and not boosted:  # share of class 1 in the node
            value = r["impurityStats"][1] / max(1e-300, sum(r["impurityStats"]))
        node = Node(value * weights[r["treeID"]], float(r["rawCount"]), r["gain"])
        if r["leftChild"] >= 0:
            s = r["split"]
            node.feature, node.left, node.right = s["featureIndex"], r["leftChild"], r["rightChild"]
            if s["numCategories"] >= 0:
                node.categories = tuple(s["leftCategoriesOrThreshold"])
            else:
                node.threshold = s["leftCategoriesOrThreshold"][0]
        out.nodes[r["treeID"]][r["id"]] = node
    return out


def _of_boosted(model: BoostedTrees) -> Trees:
    out = Trees([], 1.0, model.base)
    for t in model.trees:
        nodes, reached = {}, [0]
        while reached:
            k = reached.pop()
            f = t["feature"][k]
            nodes[k] = Node(t["value"][k], float(t["rows"][k]), t["gain"][k], f, t["threshold"][k])
            if f >= 0:
                nodes[k].left, nodes[k].right = 2 * k + 1, 2 * k + 2
                reached += [2 * k + 1, 2 * k + 2]
        out.nodes.append(nodes)
    return out


def feature_importances(spark: SparkSession, model: Model, names: list[str]) -> DataFrame:
    """(feature, importance), strongest first."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


SPLIT_SCHEMA = (
    "tree int, node int, feature string, threshold double, left_prob double, right_prob double, prob_impact double, gain double"
)


def split_impact(spark: SparkSession, trees: Trees, names: list[str]) -> DataFrame:
    """One row per split: probabilities from the mean leaf of each side, and how far they are apart."""
    sigmoid = lambda s: 1 / (1 + math.exp(-trees.margin_scale * s))
    rows = []
    for t, nodes in enumerate(trees.nodes):
        for i, n in nodes.items():
            if n.feature < 0:
                continue
            left = sigmoid(float(np.mean(trees.leaves_under(t, n.left))))
            right = sigmoid(float(np.mean(trees.leaves_under(t, n.right))))
            cut = n.threshold if n.categories is None else None
            rows.append((t, i, names[n.feature], cut, left, right, abs(right - left), n.gain))
    return spark.createDataFrame(rows, SPLIT_SCHEMA).orderBy(F.desc("prob_impact"), "tree", "node")


def feature_impact(splits: DataFrame, top: int | None = None) -> DataFrame:
    """Splits summed up per feature, the strongest total impact first; the first top of them if given."""
    four = lambda c: F.round(c, 4)
    found = (
        splits.groupBy("feature")
        .agg(
            four(F.avg("prob_impact")).alias("avg_prob_impact"),
            four(F.max("prob_impact")).alias("max_prob_impact"),
            four(F.sum("prob_impact")).alias("total_prob_impact"),
            F.count(F.lit(1)).alias("num_splits"),
            four(F.avg("gain")).alias("avg_gain"),
            four(F.sum("gain")).alias("total_gain"),
            four(F.min("threshold")).alias("min_threshold"),
            four(F.max("threshold")).alias("max_threshold"),
            four(F.median("threshold")).alias("median_threshold"),  # a model's splits are few
        )
        .orderBy(F.desc("total_prob_impact"), "feature")
    )
    return found if top is None else found.limit(top)


TABLE_FEATURES = 8  # leaves with up to so many features look their rows' patterns up in a table


@dataclass
class Leaf:
    """A leaf's path: per feature the tests on it and the share of training rows that pass them, and the leaf's value."""

    features: list[int]
    tests: list[list[tuple[Node, bool]]]
    shares: list[float]
    value: float


def leaf_contributions(value: float, shares: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Shapley values of a path's features for rows that pass some of them: (rows, features).

    A feature that is known counts as passed or not, an unknown one as its share. With every feature known with
    probability t, the gain of knowing feature i is (passed - share) times the product of the others' expectations;
    the Shapley value is its mean over t in (0, 1). The product is a polynomial of degree features - 1 in t.
    """
    points, weights = np.polynomial.legendre.leggauss((len(shares) + 1) // 2)
    out = np.zeros(passed.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        factors = (1 - t) * shares + t * passed  # above 0, as every side of a split has rows
        out += (value * w) * factors.prod(1, keepdims=True) / factors
    return out * (passed - shares)


def read_leaves(trees: Trees) -> tuple[list[Leaf], float]:
    """All leaves with their paths, and the expected output over training rows."""
    leaves, base = [], trees.base
    for nodes in trees.nodes:
        stack = [(0, {}, {})]
        while stack:
            at, shares, tests = stack.pop()
            n = nodes[at]
            if n.feature < 0:
                order = list(shares)
                base += n.value * math.prod(shares.values())
                if order:
                    leaves.append(Leaf(order, [tests[f] for f in order], [shares[f] for f in order], n.value))
                continue
            for child, goes_left in ((n.left, True), (n.right, False)):
                part = nodes[child].cover / n.cover if n.cover else 0.0
                stack.append(
                    (
                        child,
                        {**shares, n.feature: shares.get(n.feature, 1.0) * part},
                        {**tests, n.feature: [*tests.get(n.feature, []), (n, goes_left)]},
                    )
                )
    return leaves, base


def _goes_left(node: Node, v: np.ndarray) -> np.ndarray:
    return v <= node.threshold if node.categories is None else np.isin(v, node.categories)


def _passed(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """(rows, features of the leaf): whether the row passes all tests on a feature."""
    out = np.ones((len(x), len(leaf.features)), dtype=bool)
    for i, tests in enumerate(leaf.tests):
        for node, goes_left in tests:
            out[:, i] &= _goes_left(node, x[:, node.feature]) == goes_left
    return out


def _contributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    out = np.zeros_like(x, dtype=float)
    for leaf in leaves:
        passed, shares, m = _passed(x, leaf), np.array(leaf.shares), len(leaf.features)
        if m <= TABLE_FEATURES:
            every = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
            out[:, leaf.features] += leaf_contributions(leaf.value, shares, every)[passed @ (1 << np.arange(m))]
        else:
            out[:, leaf.features] += leaf_contributions(leaf.value, shares, passed)
    return out


def _outputs(x: np.ndarray, trees: Trees) -> np.ndarray:
    """The model's raw output for each row."""
    out = np.full(len(x), trees.base)
    for nodes in trees.nodes:
        parts = [(0, np.arange(len(x)))]
        while parts:
            k, rows = parts.pop()
            n = nodes[k]
            if n.feature < 0:
                out[rows] += n.value
                continue
            left = _goes_left(n, x[rows, n.feature])
            parts += [(n.left, rows[left]), (n.right, rows[~left])]
    return out


def permutation_importance(
    df: DataFrame, trees: Trees, names: list[str], label: str = "label", features: str = "features", loss: str = "log_loss"
) -> DataFrame:
    """(feature, importance, base_loss, permuted_loss): how much the mean loss grows when a feature's values are mixed.

    All features in one scan: values are permuted inside batches of rows, which keeps their distribution there; the
    permutation is a shift by half a batch along the order of a hash of the row. loss is log_loss of labels 0 and 1,
    or squared_error. Strongest first; rows without a label are left out.
    """
    slim = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    slim = slim.withColumn("k", F.xxhash64("x", "y"))
    scale = trees.margin_scale

    def losses(x, y):
        raw = _outputs(x, trees)
        if loss == "squared_error":
            return (y - raw) ** 2
        return np.logaddexp(0, np.where(y > 0, -scale * raw, scale * raw))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("k", kind="stable")
            x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
            sums = [losses(x, y).sum()]
            for f in range(x.shape[1]):
                mixed = x.copy()
                mixed[:, f] = np.roll(x[:, f], len(x) // 2)
                sums.append(losses(mixed, y).sum())
            yield pd.DataFrame({"slot": range(-1, x.shape[1]), "total": sums, "n": len(x)})

    per = slim.mapInPandas(run, "slot int, total double, n bigint").groupBy("slot").agg((F.sum("total") / F.sum("n")).alias("mean"))
    rows = {r["slot"]: r["mean"] for r in per.collect()}  # one row per feature
    made = [(n, rows[k] - rows[-1], rows[-1], rows[k]) for k, n in enumerate(names)] if rows else []
    shape = "feature string, importance double, base_loss double, permuted_loss double"
    return df.sparkSession.createDataFrame(made, shape).orderBy(F.desc("importance"), "feature")


def contributions(df: DataFrame, trees: Trees, keep: list[str], features: str = "features") -> DataFrame:
    """keep, base_value, and one contribution per vector slot; base and contributions add up to the model's raw output."""
    leaves, base = read_leaves(trees)
    slim = df.select(*keep, vector_to_array(features).alias("__x"))
    numbers = T.ArrayType(T.DoubleType())
    schema = slim.select(*keep).schema.add("values", numbers).add("contributions", numbers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["__x"].to_numpy())
                done = pdf.drop(columns="__x")
                done["values"] = list(x)
                done["contributions"] = list(_contributions(x, leaves))
                yield done

    return slim.mapInPandas(run, schema).withColumn("base_value", F.lit(base))


def attribution_summary(explained: DataFrame, names: list[str]) -> DataFrame:
    """Per feature over all explained rows: mean absolute, deviation, extremes; strongest first."""
    long = explained.select(F.posexplode("contributions").alias("slot", "c"))
    per = long.groupBy("slot").agg(
        F.avg(F.abs("c")).alias("mean_abs"),
        F.stddev_pop("c").alias("std"),
        F.max(F.abs("c")).alias("max_abs"),
        F.min("c").alias("min"),
        F.max("c").alias("max"),
    )
    table = explained.sparkSession.createDataFrame(list(enumerate(names)), "slot int, feature string")
    return per.join(F.broadcast(table), "slot").drop("slot").orderBy(F.desc("mean_abs"), "feature")  # one row per slot


def explain_rows(explained: DataFrame, names: list[str], keys: list[str], top: int = 5) -> DataFrame:
    """Long form of explained rows: feature, value, contribution, direction, rank within its direction, top flag."""
    explained = explained.withColumn("names", F.array(*[F.lit(n) for n in names]))
    parts = F.arrays_zip("values", "contributions", "names")
    pieces = F.transform(
        parts,
        lambda e: F.struct(
            (-F.abs(e["contributions"])).alias("k"),
            e["names"].alias("feature"),
            e["values"].alias("value"),
            e["contributions"].alias("contribution"),
        ),
    )
    # ranking happens inside each row's own array, which is as long as the feature vector
    side = lambda cond: F.array_sort(F.filter(pieces, cond))
    ups, downs = side(lambda e: e["contribution"] > 0), side(lambda e: e["contribution"] <= 0)
    keyed = explained.select(*keys, "base_value", ups.alias("Positive"), downs.alias("Negative"))
    long = keyed.unpivot([*keys, "base_value"], ["Positive", "Negative"], "direction", "parts")
    return long.select(*keys, "base_value", "direction", F.posexplode("parts").alias("place", "p")).select(
        *keys, "base_value", "direction", "p.feature", "p.value", "p.contribution",
        (F.col("place") + 1).alias("rank"), (F.col("place") < top).alias("in_top"),
    )
