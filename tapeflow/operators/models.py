"""Model fits with MLlib: boosters, blending, calibration, walk-forward, regimes.

Fits run one asset at a time over a stored labeled table, as parameters and row
sets differ per asset; each fit itself is distributed. Scores, ranks and
metrics of all assets are DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach
from tapeflow.operators import evaluation as V
from tapeflow.operators import labels as L
from tapeflow.operators import monitors as D
from tapeflow.operators import selection as P
from tapeflow.operators.boosting import PATIENCE, grow, rounds_asked, shapley_importance, shapley_table, shapley_values, stopping_round
from tapeflow.operators.task_boosting import grow_in_task
from tapeflow.session import staged

EPS = 1e-6


@dataclass(frozen=True)
class BoosterConfig:
    """Booster settings; the default is the full-size model."""

    trees: int = 300
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    seed: int = 42
    patience: int = PATIENCE


@dataclass(frozen=True)
class WalkForwardConfig:
    splits: int = 5
    gap: int = 15
    min_train: int = 1_000
    test_share: float = 0.15
    permutations: int = 5
    max_features: int = 25


def zero_filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Models see 0.0 for a missing feature."""
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0)) for f in features})


def booster(cfg: BoosterConfig, weighted: bool = False) -> GBTClassifier:
    gbt = GBTClassifier(
        featuresCol="features", labelCol="target", maxDepth=cfg.depth, stepSize=cfg.step, maxIter=cfg.trees,
        subsamplingRate=cfg.subsample, seed=cfg.seed,
    )
    if weighted:
        gbt = gbt.setWeightCol("sample_weight")
    return gbt


def forest(cfg: BoosterConfig) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="target", numTrees=max(10, cfg.trees // 10), maxDepth=cfg.depth + 2, seed=cfg.seed
    )


@dataclass
class Fitted:
    """A fitted classifier with the features it reads."""

    model: Model
    features: list[str]
    #: loss on the held rows after each grown round, of boosters stopped by patience
    losses: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        ready = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(
            zero_filled(df, self.features)
        )
        scored = self.model.transform(ready).withColumn(out, vector_to_array("probability")[1])
        return scored.drop("features", "rawPrediction", "probability", "prediction")

    def importance(self) -> dict[str, float]:
        """Gain importance, normalized; uniform when the model has none."""
        values = getattr(self.model, "featureImportances", None)
        shares = values.toArray() if values is not None else []
        if len(shares):  # a cut ensemble knows only the features up to the last one it splits on
            shares = np.pad(shares, (0, len(self.features) - len(shares)))
        if len(shares) == 0 or shares.sum() <= 0:
            return dict.fromkeys(self.features, 1.0 / len(self.features))
        return dict(zip(self.features, (float(s) for s in shares / shares.sum()), strict=True))


#: Rows of one task of a fit. Every level of every tree is a job, so few rows are better held in few tasks.
TASK_ROWS = 20_000


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vectors, written once and read as partitions of ``TASK_ROWS``: a fit reads them for every level of every tree."""
    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(zero_filled(df, features))
    kept = staged(ready.select("features", *[c for c in ("target", "sample_weight", "is_validation") if c in df.columns]))
    return kept.coalesce(max(1, -(-kept.count() // TASK_ROWS)))


def train(df: DataFrame, features: Sequence[str], estimator: Estimator) -> Fitted:
    return Fitted(estimator.fit(assembled(df, features)), list(features))


def train_booster(df: DataFrame, features: Sequence[str], cfg: BoosterConfig = BoosterConfig()) -> Fitted:
    """Boosted trees; ``sample_weight`` is used when present. With ``is_validation`` those rows are held back, and the ensemble is
    cut at the round of least loss on them, once ``cfg.patience`` rounds brought no better one. Few rows are grown in one task, with
    the same trees."""
    estimator = booster(cfg, "sample_weight" in df.columns)
    if "is_validation" not in df.columns:
        return train(df, features, estimator)
    ready = assembled(df, features)
    stop = partial(stopping_round, patience=cfg.patience)
    few = grow_in_task(ready, len(features), estimator, rounds_asked(cfg.trees, cfg.patience), stop)
    model, losses = few or grow(ready.where("NOT is_validation"), ready.where("is_validation"), estimator, cfg.patience)
    return Fitted(model, list(features), losses)


def blend(models: Sequence[Fitted], df: DataFrame, out: str = "prob") -> DataFrame:
    """Mean probability of the given models."""
    for i, m in enumerate(models):
        df = m.score(df, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return df.withColumn(out, mean).drop(*[f"_p{i}" for i in range(len(models))])


# ---------------------------------------------------------------- calibration
def _inside(c):
    return F.least(F.greatest(c, F.lit(EPS)), F.lit(1.0 - EPS))


def _log_odds(df: DataFrame, prob: str) -> DataFrame:
    p = _inside(F.col(prob))
    return df.withColumns({"_cp": p, "_logit": F.ln(p / (1.0 - p))})


#: Stages and result column of each method. Platt's penalty is a unit-strength one on the summed loss.
CALIBRATORS: dict[str, Callable[[int], tuple[list, Callable]]] = {
    "identity": lambda n: ([], lambda: F.col("_cp")),
    "isotonic": lambda n: ([IsotonicRegression(featuresCol="_cp", labelCol="_y", predictionCol="_fit")], lambda: F.col("_fit")),
    "platt": lambda n: (
        [
            VectorAssembler(inputCols=["_logit"], outputCol="_lv"),
            LogisticRegression(featuresCol="_lv", labelCol="_y", probabilityCol="_fit", maxIter=500, regParam=1.0 / n, standardization=False),
        ],
        lambda: vector_to_array("_fit")[1],
    ),
}


@dataclass
class Calibrator:
    method: str
    model: Model
    value: Callable

    def transform(self, df: DataFrame, prob: str = "prob", out: str = "calibrated") -> DataFrame:
        scored = self.model.transform(_log_odds(df, prob))
        return scored.select(*df.columns, _inside(self.value()).alias(out))


def calibrate(scored: DataFrame, method: str = "isotonic") -> Calibrator:
    """Fit the named method to ``prob`` and ``target``; without two classes nothing can be fitted and probabilities stay.

    The method is the caller's choice, whatever the size; ``calibrator_table`` compares them.
    """
    facts = scored.agg(F.count("target").alias("n"), F.count_distinct("target").alias("classes")).first()
    method = method if facts.classes > 1 else "identity"
    stages, value = CALIBRATORS[method](max(1, facts.n))
    ready = _log_odds(scored, "prob").withColumn("_y", F.col("target").cast("double"))
    return Calibrator(method, Pipeline(stages=stages).fit(ready), value)


def calibrator_table(train: DataFrame, held: DataFrame) -> DataFrame:
    """(method, log_loss, spread) on rows held back: what each method gains, and whether it flattens the probabilities."""
    parts = [calibrate(train, m).transform(held).select(F.lit(m).alias("method"), "target", "calibrated") for m in CALIBRATORS]
    p = F.col("calibrated")
    loss = -F.when(F.col("target") > 0, F.ln(p)).otherwise(F.ln(1.0 - p))
    return reduce(DataFrame.unionByName, parts).groupBy("method").agg(F.avg(loss).alias("log_loss"), F.stddev_pop(p).alias("spread"))


# ---------------------------------------------------------------- importance
def permutation_importance(
    fitted: Fitted, val: DataFrame, key: str = "product_id", repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Mean AUC drop per feature when it is shuffled: all trials in one frame, one grouped AUC."""
    table = staged(val.select(key, "row_idx", "target", *fitted.features))
    base = V.auc(fitted.score(table), [key]).withColumnRenamed("auc", "base_auc")
    parts = P.permuted_trials(table, fitted.features, key, repeats, seed)
    drops = V.auc(fitted.score(parts), [key, "feature", "repeat"]).join(base, key)
    return drops.groupBy(key, "feature").agg(F.avg(F.col("base_auc") - F.col("auc")).alias("permutation"))


def shap_importance(fitted: Fitted, val: DataFrame, key: str = "product_id") -> DataFrame:
    """Mean absolute Shapley value of each feature, of the margin and over all rows, by key."""
    rows = zero_filled(val, fitted.features)
    return shapley_importance(shapley_values(rows, fitted.features, shapley_table(fitted.model), [key]), fitted.features, key)


def feature_contribution(fitted: Fitted, df: DataFrame, key: str = "product_id", top: int = 6) -> DataFrame:
    """Mean probability change per feature against its mean, top both ways."""
    means = df.groupBy(key).agg(*[F.avg(f).alias(f"_m_{f}") for f in fitted.features])
    base = attach(fitted.score(zero_filled(df, fitted.features), "_p"), means, [key])
    each = base.withColumn("feature", F.explode(F.array(*map(F.lit, fitted.features))))
    parts = each.withColumns({f: F.when(F.col("feature") == f, F.col(f"_m_{f}")).otherwise(F.col(f)) for f in fitted.features})
    moved = fitted.score(parts, "_q").groupBy(key, "feature").agg(F.avg(F.col("_p") - F.col("_q")).alias("contribution"))
    from pyspark.sql import Window

    w = Window.partitionBy(key)  # one row per feature
    ranked = moved.withColumns(
        {
            "_up": F.row_number().over(w.orderBy(F.col("contribution").desc(), "feature")),
            "_down": F.row_number().over(w.orderBy("contribution", "feature")),
        }
    )
    return ranked.where((F.col("_up") <= top) | (F.col("_down") <= top)).drop("_up", "_down")


# ---------------------------------------------------------------- walk-forward
@dataclass
class WalkForwardResult:
    folds: DataFrame
    stable: list[str]
    auc_test: float
    model: Fitted
    importance: DataFrame


def selected(rows: DataFrame, val: DataFrame, features: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], Fitted], cfg: WalkForwardConfig) -> dict[str, float]:
    """Features a first fit finds useful, with their gain: uncorrelated ones, ranked by gain and permutation."""
    first = fit(rows, features)
    gain = first.importance()
    kept, _ = P.correlation_filter(P.correlations(rows, features), features, gain)
    gains = rows.sparkSession.createDataFrame([(c, gain.get(c, 0.0)) for c in kept], "feature string, importance double")
    scores = permutation_importance(first, val, repeats=cfg.permutations).join(F.broadcast(gains), "feature")
    ranked = P.weak_feature_filter(scores.select("product_id", "feature", "importance", "permutation"), cfg.max_features)
    return {r.feature: gain.get(r.feature, 0.0) for r in ranked.orderBy("rank").collect()}  # cfg.max_features at most


def walk_forward(
    labeled: DataFrame, features: Sequence[str], cfg: WalkForwardConfig = WalkForwardConfig(),
    model_factory: Callable[[], Estimator] | None = None, boost: BoosterConfig = BoosterConfig(),
) -> WalkForwardResult:
    """Validate one product: select and fit inside each fold, score all folds together, then fit once on the stable features.

    ``labeled`` has product_id, row_idx, target and the features; ``sample_weight`` is used where present, and the booster stops
    early on a fifth of its training rows, taken by hash.
    """
    table = staged(labeled)
    spark = table.sparkSession
    ends = table.groupBy("product_id").agg((F.max("row_idx") + 1).alias("rows")).first()
    held_from = ends["rows"] - max(1, int(ends["rows"] * cfg.test_share))
    lengths = spark.createDataFrame([(ends["product_id"], held_from)], "product_id string, n_rows bigint")
    tagged = L.rows_to_folds(table, L.walk_forward_folds(lengths, cfg.min_train, cfg.gap, cfg.splits))
    stop = F.pmod(F.xxhash64("row_idx", "fold_id"), F.lit(5)) == 0
    tagged = staged(tagged.withColumn("is_validation", stop & (F.col("part") == "train")))
    usable = [r.fold_id for r in L.usable_folds(tagged).select("fold_id").distinct().orderBy("fold_id").collect()]  # cfg.splits at most
    if not usable:
        raise ValueError("no fold has both classes in training and validation")

    def fit(rows: DataFrame, names: Sequence[str]) -> Fitted:
        return train(rows, names, model_factory()) if model_factory else train_booster(rows, names, boost)

    scored, chosen = [], []
    for fold in usable:
        part = tagged.where(F.col("fold_id") == fold)
        rows, val = part.where("part = 'train'"), part.where("part = 'val'")
        gains = selected(rows, val, features, fit, cfg)
        scored.append(fit(rows, list(gains)).score(val).select("product_id", "fold_id", "row_idx", "target", "prob").withColumn("n_features", F.lit(len(gains)).cast("long")))
        chosen += [(ends["product_id"], fold, name, gain) for name, gain in gains.items()]
    scored = staged(reduce(DataFrame.unionByName, scored))
    keys = ["product_id", "fold_id"]
    folds = V.auc(scored, keys).join(V.log_loss(scored, keys).select(*keys, "log_loss"), keys).join(scored.select(*keys, "n_features").distinct(), keys)
    folds = staged(folds.select(*keys, "auc", "log_loss", "n_features"))
    importance = spark.createDataFrame(chosen, "product_id string, fold_id bigint, feature string, importance double")
    ranked = P.stable_features(importance, folds.select(*keys, "auc"), cfg.max_features)
    stable = [r.feature for r in ranked.orderBy("rank").collect()]  # cfg.max_features at most
    before = table.withColumn("is_validation", F.pmod(F.xxhash64("row_idx"), F.lit(5)) == 0).where(F.col("row_idx") < held_from)
    model = fit(before, stable)
    held = V.auc(model.score(table.where(F.col("row_idx") >= held_from)), ["product_id"]).first()
    return WalkForwardResult(folds, stable, held.auc if held else float("nan"), model, importance)


# ---------------------------------------------------------------- regimes
def regime_states(rows: DataFrame, states: int = 3, seed: int = 42) -> DataFrame:
    """Hidden-state labels by a Gaussian mixture on standardized features (one product)."""
    names = list(D.REGIME_FEATURES)
    ready = rows.dropna(subset=names)
    steps = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_z", withMean=True),
            GaussianMixture(featuresCol="_z", k=states, maxIter=200, seed=seed, predictionCol="state", probabilityCol="_prob"),
        ]
    )
    return steps.fit(ready).transform(ready).drop("_raw", "_z", "_prob")


