"""Early stopping by patience and Shapley values of trees."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tapeflow.operators import boosting as B
from tapeflow.operators import models as M


def test_stopping_round():
    assert B.stopping_round([3, 2, 1, 1, 1, 1], 3) == (3, True)
    assert B.stopping_round([3, 2, 1, 1, 1], 3) == (3, False)
    assert B.stopping_round([3, 4, 5, 2, 5, 5, 5], 3) == (4, True)
    assert B.stopping_round([3, 4, 5, 5, 2], 3) == (1, True)
    assert B.stopping_round([1.0], 3) == (1, False)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=400) > 0).astype(float)
    names = [f"f{i}" for i in range(5)]
    data = [("AB"[i % 2], i, *map(float, r), float(t), i % 4 == 0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, f"product_id string, row_idx long, {', '.join(n + ' double' for n in names)}, target double, is_validation boolean").cache(), names


def test_trees_grow_until_patience_ends(rows):
    df, names = rows
    fitted = M.train_booster(df, names, M.BoosterConfig(trees=24, depth=3, step=0.2, patience=6))
    keep, stopped = B.stopping_round(fitted.losses, 6)
    assert fitted.model.getNumTrees == keep > 1 and (stopped or len(fitted.losses) == 24)
    # the cut ensemble is the one that asks for as many trees
    whole = M.train_booster(df, names, M.BoosterConfig(trees=keep, depth=3, step=0.2, patience=99))
    a, b = (m.score(df).orderBy("row_idx").toPandas()["prob"] for m in (fitted, whole))
    if len(whole.losses) == keep == whole.model.getNumTrees:
        np.testing.assert_allclose(a, b, rtol=1e-12)
    assert len(fitted.importance()) == len(names) and abs(sum(fitted.importance().values()) - 1) < 1e-9
    assert fitted.losses[keep - 1] == min(fitted.losses[: keep + 6])


def value(nodes, weights, x, known):
    """Expected margin where only some features are known, by walking down every tree."""

    def walk(table, i):
        prediction, n, left, right, feature, threshold = table[i]
        if feature < 0:
            return prediction
        if feature in known:
            return walk(table, left if x[feature] <= threshold else right)
        return (table[left][1] * walk(table, left) + table[right][1] * walk(table, right)) / n

    trees = {}
    for t, i, *rest in nodes:
        trees.setdefault(t, {})[i] = rest
    return sum(weights[t] * walk(table, 0) for t, table in trees.items())


def test_shapley_values_equal_all_subsets_and_add_up(spark, rows):
    df, names = rows
    fitted = M.train_booster(df.drop("is_validation"), names, M.BoosterConfig(trees=6, depth=4, step=0.3))
    nodes, weights = B.tree_nodes(fitted.model), fitted.model.treeWeights
    table = B.ShapleyTable.of(nodes, weights)
    got = {r.row_idx: np.array(r.shap) for r in B.shapley_values(df, names, table, ["row_idx"]).collect()}
    ready = M.VectorAssembler(inputCols=names, outputCol="features").transform(df)
    margin = {r.row_idx: r.rawPrediction[1] for r in fitted.model.transform(ready).select("row_idx", "rawPrediction").collect()}
    for i, shap in got.items():
        assert abs(shap.sum() + table.base - margin[i]) < 1e-9
    x = {r.row_idx: [r[n] for n in names] for r in df.collect()}
    for i in list(got)[:12]:
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = sum(
                factorial(k) * factorial(4 - k) / factorial(5) * (value(nodes, weights, x[i], {*s, f}) - value(nodes, weights, x[i], set(s)))
                for k in range(5)
                for s in combinations(others, k)
            )
            assert abs(got[i][f] - want) < 1e-9
    means = {(r.product_id, r.feature): r.shap for r in M.shap_importance(fitted, df).collect()}
    assert len(means) == 10
    assert abs(means["A", "f2"] - np.mean([abs(got[i][2]) for i in got if i % 2 == 0])) < 1e-12


def test_a_leaf_alone_has_no_values():
    table = B.ShapleyTable.of([(0, 0, 0.25, 10, -1, -1, -1, None)], [2.0])
    assert table.base == 0.5 and not table.values(np.ones((3, 2))).any()


def test_few_rows_are_grown_in_one_task_with_the_same_trees(spark):
    rng = np.random.default_rng(12)
    n, names = 260, [f"f{i}" for i in range(7)]
    x = np.column_stack([
        rng.normal(size=n), rng.normal(size=n).round(1), rng.integers(0, 3, n), np.where(rng.random(n) < 0.6, 0, rng.normal(size=n)),
        np.zeros(n), rng.normal(size=n) ** 3, rng.normal(size=n) * 1e-3,
    ])
    target = (x[:, 0] + x[:, 2] - x[:, 3] + rng.normal(size=n) > 1).astype(int)
    rows = [(*map(float, v), int(y), float(0.5 ** (i / 90)), i % 5 == 2) for i, (v, y) in enumerate(zip(x, target, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in names) + ", target int, sample_weight double, is_validation boolean").coalesce(1)
    cfg = M.BoosterConfig(trees=40, step=0.2, patience=8)
    spark.sparkContext.setJobGroup("few", "few")
    fitted = M.train_booster(df, names, cfg)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    ready = M.assembled(df, names)
    model, losses = B.grow(ready.where("NOT is_validation"), ready.where("is_validation"), M.booster(cfg, True), cfg.patience)
    assert [t.toDebugString.split("\n", 1)[1] for t in fitted.model.trees] == [t.toDebugString.split("\n", 1)[1] for t in model.trees]
    assert len(fitted.losses) == len(losses) and np.allclose(fitted.losses, losses, rtol=1e-12) and fitted.model.treeWeights == model.treeWeights
    assert np.array_equal(np.pad(fitted.model.featureImportances.toArray(), (0, 7))[:7], np.pad(model.featureImportances.toArray(), (0, 7))[:7])
    a, b = (sorted((r.f0, r.prob) for r in M.Fitted(m, names).score(df).collect()) for m in (fitted.model, model))
    assert a == b
    assert jobs < 20
