"""Model-fit queries: every product of the given tables, all features, boosters of the operators' default size.

MLlib learners have no SQL counterpart, so these are rows-only checks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import functions as F

from tapeflow.functions.columns import rounded
from tapeflow.functions.names import ALL_FEATURES
from tapeflow.operators import flow_features as G
from tapeflow.operators import hidden_states as H
from tapeflow.operators import labels as L
from tapeflow.operators import models as M
from tapeflow.operators import monitors as D
from tapeflow.plans.catalog.features import merged_flow
from tapeflow.plans.registry import query
from tapeflow.plans.views import CANDLE_SPAN, Inputs
from tapeflow.session import staged

FEATURES = list(ALL_FEATURES)
BOOST = M.BoosterConfig()
#: The operator's folds and shuffles; the first training part is shorter, as products have some 470 rows at sf0.01.
WALK = M.WalkForwardConfig(min_train=150)


def labeled(x: Inputs):
    kept = staged(G.flow_features(x.candle_table(), staged(merged_flow(x)), CANDLE_SPAN))
    return staged(L.label_net_return(kept, 5, 0.20, 0.05, CANDLE_SPAN))


def products(table) -> list[str]:
    return [r.product_id for r in table.select("product_id").distinct().orderBy("product_id").collect()]


def per_product(table, fn):
    """Results of all products; a few are fitted at once, as each fit is a row of small jobs."""
    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(lambda p: fn(table.where(F.col("product_id") == p), p), products(table)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def split(df):
    """Holdout mark and recency weights for the booster."""
    marked = L.holdout_split(df).withColumnRenamed("is_test", "is_validation")
    return L.recency_weight(marked, 500.0)


@query("train_booster")
def train_booster(x: Inputs):
    def run(df, p):
        rows = staged(split(df))
        fitted = M.train_booster(rows, FEATURES, BOOST)
        grown = {"n_grown": F.lit(len(fitted.losses)), "n_trees": F.lit(fitted.model.getNumTrees)}
        return fitted.score(rows).withColumns(grown).select("product_id", "open_time", "target", "prob", "n_grown", "n_trees")

    return rounded(per_product(labeled(x), run))


@query("gain_importance")
def gain_importance(x: Inputs):
    table = split(labeled(x))
    fitted = M.train_booster(table, FEATURES, BOOST)
    share = F.create_map(*[F.lit(v) for kv in fitted.importance().items() for v in kv])
    known = table.agg(*[F.count(f).alias(f) for f in FEATURES]).unpivot([], FEATURES, "feature", "known_rows")
    return rounded(known.withColumn("importance", share[F.col("feature")]))


@query("blend_probabilities")
def blend_probabilities(x: Inputs):
    rows = staged(split(labeled(x)))
    models = [M.train_booster(rows, FEATURES, BOOST), M.train(rows, FEATURES, M.forest(BOOST))]
    return rounded(M.blend(models, rows).select("product_id", "open_time", "prob"))


@query("calibrate")
def calibrate(x: Inputs):
    scored = staged(x.scored())
    return rounded(M.calibrate(scored).transform(scored).select("product_id", "row_idx", "prob", "calibrated"))


@query("permutation_importance")
def permutation_importance(x: Inputs):
    rows = staged(split(labeled(x)))
    fitted = M.train_booster(rows, FEATURES, BOOST)
    return rounded(M.permutation_importance(fitted, rows.where("is_validation")))


@query("shap_importance")
def shap_importance(x: Inputs):
    rows = staged(split(labeled(x)))
    return rounded(M.shap_importance(M.train_booster(rows, FEATURES, BOOST), rows.where("is_validation")))


@query("feature_contribution")
def feature_contribution(x: Inputs):
    rows = staged(split(labeled(x)))
    return rounded(M.feature_contribution(M.train_booster(rows, FEATURES, BOOST), rows))


@query("walk_forward_validate")
def walk_forward_validate(x: Inputs):
    table = staged(split(labeled(x)).drop("is_validation"))
    return rounded(per_product(table, lambda df, p: M.walk_forward(df, FEATURES, WALK, boost=BOOST).folds))


@query("regime_mixture")
def regime_mixture(x: Inputs):
    table = labeled(x)
    states = per_product(table, lambda df, p: M.regime_states(df))
    return D.label_states(states.withColumn("state", F.col("state").cast("bigint")))


@query("hidden_regimes")
def hidden_regimes(x: Inputs):
    """Fitted hidden states of every product and their names, on the rows before the holdout."""
    rows = L.holdout_split(labeled(x)).where("NOT is_test")
    states = H.hidden_regimes(rows, list(D.REGIME_FEATURES), CANDLE_SPAN)
    return D.label_states(staged(states))
