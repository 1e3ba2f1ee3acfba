"""Boosters that stop by patience, and exact Shapley values of their trees.

MLlib stops a booster at the first round that gains little. Here the trees are grown without that, the loss of every round is
read on the held rows, and the ensemble is cut at its best round once ``patience`` rounds brought nothing better. Trees do not
depend on the number asked for, so growing in steps gives the same result as growing all of them first.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.session import checkpoint_dir

PATIENCE = 30
#: Rows of one numpy step over all leaves.
STEP_ROWS = 128


def stopping_round(losses: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(rounds to keep, whether patience ran out): the best round before the first stretch of ``patience`` without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The first ``rounds`` trees of a booster."""
    from pyspark import SparkContext

    gateway, jvm = SparkContext._active_spark_context._gateway, SparkContext._active_spark_context._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    all_trees = model._java_obj.trees()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], model.treeWeights[i]
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid + "_cut", trees, weights))


def rounds_asked(most: int, patience: int = PATIENCE) -> list[int]:
    """Numbers of trees after which the losses are read."""
    asked = [min(most, 2 * patience)]
    while asked[-1] < most:
        asked.append(min(most, 2 * asked[-1]))
    return asked


def grow(train: DataFrame, held: DataFrame, estimator: GBTClassifier, patience: int = PATIENCE) -> tuple[GBTClassificationModel, list[float]]:
    """(model cut at its best round, loss of each grown round on the held rows). Both frames have the assembled features.

    Without held rows, or with one tree asked for, all trees stay.
    """
    most = estimator.getMaxIter()
    if held.isEmpty():
        return estimator.fit(train), []
    for asked in rounds_asked(most, patience):
        model = estimator.copy({estimator.maxIter: asked}).fit(train)
        losses = list(model.evaluateEachIteration(held))
        keep, stopped = stopping_round(losses, patience)
        if stopped or asked == most:
            return (model if keep == model.getNumTrees else truncated(model, keep)), losses


# ---------------------------------------------------------------- Shapley values
@dataclass
class Paths:
    """Leaves with the same number of different features on their way: features, bounds, shares of rows and value of each.

    A row passes a feature where low < value <= high; the share is that of rows going the leaf's way where the feature is unknown.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Shapley values of rows ``x`` for the sum of the leaves' games, added to ``out``.

        A leaf pays its value times the product over its features: passed (0 or 1) where known, the share where not. Coalitions of
        one size enter with one weight, so their sum is a coefficient of a product of (share + passed * t).
        """
        d = self.feature.shape[1]
        passed = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(self.feature.T, self.low.T, self.high.T, strict=True)]
        weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for j in range(d):
            coefficients = [np.ones((len(x), len(self.value)))]
            for g in range(d):
                if g != j:
                    z, o = self.share[:, g], passed[g]
                    grown = [c * z for c in coefficients] + [np.zeros_like(coefficients[0])]
                    for k, c in enumerate(coefficients):
                        grown[k + 1] += c * o
                    coefficients = grown
            total = sum(w * c for w, c in zip(weight, coefficients, strict=True)) * (passed[j] - self.share[:, j]) * self.value
            order = np.argsort(self.feature[:, j], kind="stable")
            names = self.feature[order, j]
            at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            out[:, names[at]] += np.add.reduceat(total[:, order], at, axis=1)


@dataclass
class ShapleyTable:
    """Leaf paths of a booster, a table bounded by trees and depth, and its mean margin over the training rows."""

    base: float
    paths: list[Paths]

    @classmethod
    def of(cls, nodes: Sequence[tuple], weights: Sequence[float]) -> ShapleyTable:
        """``nodes``: (tree, id, prediction, rows, left, right, feature, threshold), with feature -1 at leaves."""
        tree: dict[int, dict[int, tuple]] = defaultdict(dict)
        for t, i, *rest in nodes:
            tree[t][i] = tuple(rest)
        base, leaves = 0.0, defaultdict(list)
        for t, table in tree.items():
            todo = [(0, {})]
            while todo:
                i, way = todo.pop()
                prediction, rows, left, right, feature, threshold = table[i]
                if feature < 0:
                    value = prediction * weights[t]
                    share = 1.0
                    for _, _, s in way.values():
                        share *= s
                    base += value * share
                    if way:
                        leaves[len(way)].append((*zip(*[(f, *b) for f, b in sorted(way.items())], strict=True), value))
                    continue
                low, high, share = way.get(feature, (-np.inf, np.inf, 1.0))
                for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
                    todo.append((child, way | {feature: (*bounds, share * table[child][1] / rows)}))
        return cls(base, [Paths(*(np.array(c) for c in zip(*x, strict=True))) for _, x in sorted(leaves.items())])

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for a in range(0, len(x), STEP_ROWS):
            for p in self.paths:
                p.add(x[a : a + STEP_ROWS], out[a : a + STEP_ROWS])
        return out


def tree_nodes(model: GBTClassificationModel) -> list[tuple]:
    """Nodes of all trees: written by the model's own writer to the shared folder and read as a table, a few thousand rows."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        "treeID", n.id, n.prediction, n.rawCount, n.leftChild, n.rightChild, n.split.featureIndex, F.get(n.split.leftCategoriesOrThreshold, F.lit(0))
    )
    return [tuple(r) for r in table.collect()]


def shapley_table(model: GBTClassificationModel) -> ShapleyTable:
    return ShapleyTable.of(tree_nodes(model), model.treeWeights)


def shapley_values(df: DataFrame, features: Sequence[str], table: ShapleyTable, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of each row with shap: an array of one value for each feature; with the base they add up to the margin."""
    sent = df.sparkSession.sparkContext.broadcast(table)
    kept = df.select(*keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))], 1) if batch.num_rows else np.zeros((0, len(features)))
            found = sent.value.values(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(features), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, "shap"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["shap array<double>"])
    return df.select(*keep, *features).mapInArrow(each, schema)


def shapley_importance(values: DataFrame, features: Sequence[str], key: str = "product_id") -> DataFrame:
    """(key, feature, shap): mean absolute Shapley value of every feature over the rows of each key."""
    names = F.array(*map(F.lit, features))
    each = values.select(key, F.posexplode("shap").alias("_at", "_v"))
    means = each.groupBy(key, "_at").agg(F.avg(F.abs("_v")).alias("shap"))
    return means.select(key, F.get(names, F.col("_at")).alias("feature"), "shap")
