"""The model queries fit every feature with the operators' defaults."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401  (loads the catalog)
from tapeflow.functions.names import ALL_FEATURES
from tapeflow.operators import models as M
from tapeflow.operators import selection as N
from tapeflow.plans.catalog import models as Q


class Seen(Exception):
    """What a query asked of its operator."""


def test_fits_read_all_features_with_full_boosters(spark, monkeypatch):
    def seen(df, features, cfg=None, **kw):
        raise Seen(list(features), cfg, kw)

    table = spark.range(1).selectExpr("'A' AS product_id", "id AS row_idx")
    monkeypatch.setattr(Q, "labeled", lambda x: table)
    monkeypatch.setattr(Q, "split", lambda df: df.selectExpr("*", "true AS is_validation"))
    monkeypatch.setattr(M, "train_booster", seen)
    monkeypatch.setattr(M, "walk_forward", seen)
    queries = (Q.train_booster, Q.gain_importance, Q.blend_probabilities, Q.permutation_importance, Q.feature_contribution, Q.walk_forward_validate)
    for query in queries:
        with pytest.raises(Seen) as found:
            query(None)
        features, cfg, kw = found.value.args
        assert features == list(ALL_FEATURES)
        boost = kw.get("boost", cfg)
        assert boost == M.BoosterConfig() and boost.trees == 300
    assert (cfg.splits, cfg.permutations, cfg.max_features) == (5, 5, 25)


def test_correlations_of_as_many_features_as_the_catalog_has(spark):
    names = [f"f{i}" for i in range(len(ALL_FEATURES))]
    df = pd.DataFrame(np.random.default_rng(2).normal(size=(60, len(names))), columns=names)
    df["f113"] = 1.0
    got = N.correlations(spark.createDataFrame(df), names).toPandas()
    assert len(got) == len(names) * (len(names) - 1) // 2
    want = df.corr().abs()
    assert got[got["feature_b"] == "f113"]["abs_corr"].isna().all()
    some = got[got["feature_b"] != "f113"].iloc[::37]
    np.testing.assert_allclose(some["abs_corr"], [want.loc[a, b] for a, b in zip(some["feature_a"], some["feature_b"])], rtol=1e-9)


def test_correlations_are_pairwise_complete_and_the_drop_is_greedy(spark):
    rng = np.random.default_rng(4)
    df = pd.DataFrame(rng.normal(1e3, 1, size=(500, 6)), columns=list("abcdef"))
    df["b"] = df["a"] + 0.1 * rng.normal(size=500)
    df["c"] = df["b"] + 0.1 * rng.normal(size=500)
    df["e"] = 7.0
    df.loc[rng.random(500) < 0.3, "a"] = np.nan
    df.loc[rng.random(500) < 0.4, "d"] = np.nan
    df.loc[df["a"].notna(), "f"] = 5.5  # constant where a is known
    frame = spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in df)).repartition(3)
    matrix = N.correlations(frame, list(df))
    got = {(r.feature_a, r.feature_b): r.abs_corr for r in matrix.collect()}
    assert len(got) == 15 and got["a", "f"] is None and got["a", "e"] is None
    want = df.corr().abs()
    for (a, b), v in got.items():
        if v is not None:
            assert abs(v - want.loc[a, b]) < 1e-9
    assert N.correlation_filter(matrix, list(df), {"a": 1.0, "b": 2.0, "c": 1.5})[1] == ["a", "c"]
    assert N.correlation_filter(matrix, list(df), {"a": 3.0, "b": 2.0, "c": 1.5})[1] == ["b", "c"]
    assert N.correlation_filter(matrix, list(df), {})[1] == ["a", "b"]
    assert N.correlations(frame.limit(0), list(df)).where("abs_corr IS NOT NULL").count() == 0
