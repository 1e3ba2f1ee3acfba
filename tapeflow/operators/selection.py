"""Feature catalog and feature selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach

from tapeflow.functions.names import BOOK_CANCEL, FLOW_DERIVED, FLOW_RAW, OHLCV_CATEGORY

SLOT_ROWS = 65_536
CORRELATION_CUT, MIN_IMPORTANCE_SHARE, STABILITY, MAX_FEATURES = 0.85, 0.005, 0.6, 25


def feature_catalog(spark: SparkSession) -> DataFrame:
    """Known model features: name, category, candidate."""
    rows = [(n, cat, True) for cat, names in OHLCV_CATEGORY.items() for n in names.split()]
    rows += [(n, "order_flow", True) for n in FLOW_RAW + FLOW_DERIVED if n not in BOOK_CANCEL]
    return spark.createDataFrame(rows, "name string, category string, candidate boolean")


def gram(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) of every two features (by number, a < b) over the rows where both are known.

    With m the mask of known values, the sums are products of the tables m, xm and x²m, so a task adds them up as four small
    matrices, and rows are neither copied for each pair nor shuffled. Values are taken from each feature's least one, which leaves
    exact zeros for a constant.
    """
    names = list(features)
    low = df.select([F.min(F.col(f).cast("double")).alias(f) for f in names]).first()
    base = np.array([0.0 if v is None else v for v in low], float)
    pairs = np.triu_indices(len(names), 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, xy = (np.zeros((len(names), len(names))) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) - base
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            n += m.T @ m
            s += x.T @ m
            ss += (x * x).T @ m
            xy += x.T @ x
        i, j = pairs
        cols = [i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], xy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", *GRAM])

    parts = df.select(*[F.col(f).cast("double").alias(f) for f in names]).mapInArrow(each, "a int, b int, " + ", ".join(f"{c} double" for c in GRAM))
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in GRAM])


GRAM = ("n", "sa", "sb", "saa", "sbb", "sab")
#: Share of its sum of squares below which a spread is rounding.
FLAT = 1e-12


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, abs_corr) for every pair, over the rows where both are known; null where one of them is constant."""
    names = F.array(*map(F.lit, features))
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    varied = (n > 0) & (va > FLAT * n * F.col("saa")) & (vb > FLAT * n * F.col("sbb"))
    corr = (n * F.col("sab") - F.col("sa") * F.col("sb")) / (F.sqrt(va) * F.sqrt(vb))
    found = gram(df, features).select("a", "b", F.when(varied, F.least(F.abs(corr), F.lit(1.0))).alias("abs_corr"))
    return found.select(F.get(names, F.col("a")).alias("feature_a"), F.get(names, F.col("b")).alias("feature_b"), "abs_corr")


def correlation_filter(
    matrix: DataFrame, features: Sequence[str], importance: Mapping[str, float], cut: float = CORRELATION_CUT
) -> tuple[list[str], list[str]]:
    """(kept, dropped): one pass over the pairs above the cut, by the later feature and then the earlier one; the less important
    of a pair goes (the earlier one if equal), unless one of them went before.

    Pairs are at most features^2 / 2, and which of them still counts depends on all before it, so they are read in order here.
    """
    place = {f: i for i, f in enumerate(features)}
    strong = matrix.where(F.col("abs_corr") > cut).select("feature_a", "feature_b").collect()
    gone: set[str] = set()
    for _, _, a, b in sorted((place[r.feature_b], place[r.feature_a], r.feature_a, r.feature_b) for r in strong):
        if gone.isdisjoint((a, b)):
            gone.add(b if importance.get(b, 0.0) < importance.get(a, 0.0) else a)
    return [f for f in features if f not in gone], sorted(gone)


def weak_feature_filter(scores: DataFrame, max_features: int = MAX_FEATURES, key: str = "product_id") -> DataFrame:
    """Keep features that matter by importance share or by permutation, at most ``max_features``.

    scores: key, feature, importance, permutation. If nothing is left, the most
    important ones stay.
    """
    w = Window.partitionBy(key)  # at most one row per feature
    total = F.sum("importance").over(w)
    share = F.when(total > 0, F.col("importance") / total).otherwise(F.col("importance"))
    strong = ~((share < MIN_IMPORTANCE_SHARE) & (F.col("permutation") <= 0))
    df = scores.withColumn("_strong", strong).withColumn("_any", F.max("_strong").over(w))
    kept = df.where(F.col("_strong") | ~F.col("_any"))
    rank = F.row_number().over(w.orderBy(F.col("importance").desc(), "feature"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= max_features).drop("_strong", "_any")


def stable_features(selected: DataFrame, folds: DataFrame, max_features: int = MAX_FEATURES, key: str = "product_id") -> DataFrame:
    """Features chosen in at least ceil(0.6 * folds) folds, by mean importance.

    selected: key, fold_id, feature, importance. folds: key, fold_id, auc; used
    for the fallback to the best fold's features.
    """
    n = folds.groupBy(key).agg(
        F.count_distinct("fold_id").alias("_folds"), F.max_by("fold_id", F.struct("auc", (-F.col("fold_id")))).alias("_best")
    )
    counts = selected.groupBy(key, "feature").agg(
        F.count_distinct("fold_id").alias("appearances"), F.avg("importance").alias("mean_importance")
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("_folds") * STABILITY))
    stable = counts.join(n, key).where(F.col("appearances") >= need)
    best = (
        selected.join(n, key).where(F.col("fold_id") == F.col("_best"))
        .join(stable.select(key).distinct(), key, "left_anti")
        .join(counts, [key, "feature"])
    )
    cols = [key, "feature", "appearances", "mean_importance"]
    both = stable.select(cols).unionByName(best.select(cols))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("mean_importance").desc(), "feature"))
    return both.withColumn("rank", rank).where(F.col("rank") <= max_features)


def permuted_trials(df: DataFrame, features: Sequence[str], key: str, repeats: int, seed: int) -> DataFrame:
    """``df`` once per (feature, repeat), with that feature shuffled inside each group.

    Trials are a number that rows are exploded by, so the plan does not grow with them. Rows and donor values are both
    numbered in a random order per random slot, so a large group is shuffled slot by slot instead of in one task.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SLOT_ROWS).alias("_slots"))
    trial = F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1)))
    rows = attach(df, sizes, [key]).withColumn("_trial", trial)
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(F.lit(seed), "_trial", key, "row_idx"), F.col("_slots"))).drop("_slots")
    at = F.expr(f"_trial div {repeats}").cast("int")
    w = Window.partitionBy(key, "_trial", "_slot")
    mine = rows.withColumn("_n", F.row_number().over(w.orderBy("row_idx")))
    donors = rows.select(
        key, "_trial", "_slot", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed + 1), "_trial", "row_idx"), "row_idx")).alias("_n"),
        F.element_at(F.array(*[F.col(f).cast("double") for f in features]), at + 1).alias("_shuffled"),
    )
    moved = {f: F.when(at == i, F.col("_shuffled")).otherwise(F.col(f)) for i, f in enumerate(features)}
    names = F.array(*map(F.lit, features))
    out = mine.join(donors, [key, "_trial", "_slot", "_n"]).withColumns(moved)
    return out.withColumns({"feature": F.element_at(names, at + 1), "repeat": F.col("_trial") % repeats}).drop("_trial", "_slot", "_n", "_shuffled")


def folds_needed(folds: int) -> int:
    return max(1, math.ceil(STABILITY * folds))
