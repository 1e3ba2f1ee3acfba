"""Drift bounds and market regime: learned limits and per-row decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach
from tapeflow.functions.quantiles import exact_percentiles

# Drift and regime gates.
BLOCK_RATIO, MARGIN, MIN_CHECKS = 0.30, 0.10, 8
VOL_MAX, COMPRESSION_MIN, WIDTH_MIN = 0.006, 0.25, 0.004
REGIME_FEATURES = ("realized_vol_5", "bb_width", "range_compression_20", "volume_ratio", "trend_slope_pct")


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (id, feature) with finite values only."""
    long = df.select(*ids, *features).unpivot(list(ids), list(features), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def drift_bounds(df: DataFrame, features: Sequence[str], key: str = "product_id") -> DataFrame:
    """5th, 50th and 95th percentile per product and feature."""
    return exact_percentiles(
        to_long(df, [key], features), [key, "feature"], "value", {"low": 0.05, "median": 0.50, "high": 0.95}
    )


def _outside(value: Column, low: Column, median: Column, high: Column) -> Column:
    scale = F.greatest(F.abs(high - low), F.abs(median) * MARGIN, F.lit(1e-9)) * MARGIN
    return (value < low - scale) | (value > high + scale)


def drift_by_feature(df: DataFrame, features: Sequence[str], bounds: DataFrame, key: str = "product_id") -> DataFrame:
    """Checked values and outliers per product and feature."""
    c = F.col
    joined = to_long(df, [key], features).join(bounds, [key, "feature"])
    return joined.groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(_outside(c("value"), c("low"), c("median"), c("high"))).alias("outliers")
    )


def drift_evaluate(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], bounds: DataFrame, key: str = "product_id"
) -> DataFrame:
    """Share of features outside their bounds per row and the decision.

    ``bounds`` is folded to one map per product first, so a row meets its
    product's bounds once and is judged in place: no row is multiplied or regrouped.
    """
    maps = bounds.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "median", "high")))).alias("_b")
    )
    checks = F.filter(
        F.array(
            *[
                F.struct(F.col(f).cast("double").alias("v"), F.try_element_at("_b", F.lit(f)).alias("b"))
                for f in features
            ]
        ),
        lambda c: c["v"].isNotNull() & c["b"].isNotNull() & ~F.isnan(c["v"]) & (F.abs(c["v"]) != float("inf")),
    )

    def outside(c):
        return _outside(c["v"], c["b"]["low"], c["b"]["median"], c["b"]["high"])

    judged = attach(df, maps, [key], "left").withColumn("_c", checks)
    judged = judged.select(
        *ids,
        F.size("_c").cast("bigint").alias("checked_features"),
        F.size(F.filter("_c", outside)).cast("bigint").alias("outlier_count"),
        F.col("_b").isNull().alias("_off"),
    )
    few = F.col("checked_features") < MIN_CHECKS
    share = F.col("outlier_count") / F.greatest(F.col("checked_features"), F.lit(1))
    return judged.withColumns(
        {
            "outlier_ratio": F.when(few, 0.0).otherwise(share),
            "drift_status": F.when(F.col("_off"), "disabled")
            .when(few, "insufficient_checks").when(share >= BLOCK_RATIO, "out_of_distribution").otherwise("ok"),
            "drift_actionable": few | (share < BLOCK_RATIO),
            "drift_reason": F.when(F.col("_off"), "drift_monitor_disabled")
            .when(few, "drift_monitor_insufficient_checks")
            .when(share >= BLOCK_RATIO, "drift_blocked_out_of_distribution").otherwise("ok"),
        }
    ).drop("_off")


def regime_limits(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Learned limits per product; products without rows use the defaults later."""
    ok = df.where(
        F.col("realized_vol_5").isNotNull() & F.col("bb_width").isNotNull() & F.col("range_compression_20").isNotNull()
    )
    inputs = ["realized_vol_5", "range_compression_20", "bb_width"]
    cuts = exact_percentiles(to_long(ok, [key], inputs), [key, "feature"], "value", {"p95": 0.95, "p15": 0.15})

    def pick(feature: str, point: str):
        return F.max(F.when(F.col("feature") == feature, F.col(point)))

    return cuts.groupBy(key).agg(
        pick("realized_vol_5", "p95").alias("vol_limit"),
        pick("range_compression_20", "p15").alias("compression_limit"),
        pick("bb_width", "p15").alias("width_limit"),
    )


def regime_evaluate(df: DataFrame, limits: DataFrame, key: str = "product_id") -> DataFrame:
    """Regime of each row by the limits; missing inputs are unknown and allowed."""
    joined = attach(df, limits, [key], "left")
    vol, comp, width = F.col("realized_vol_5"), F.col("range_compression_20"), F.col("bb_width")
    vol_max = F.coalesce("vol_limit", F.lit(VOL_MAX))
    tight = (comp <= F.coalesce("compression_limit", F.lit(COMPRESSION_MIN))) & (
        width <= F.coalesce("width_limit", F.lit(WIDTH_MIN))
    )
    unknown = vol.isNull() | comp.isNull() | width.isNull()
    regime = (
        F.when(unknown, "unknown").when(vol >= vol_max, "extreme_volatility").when(tight, "compressed").otherwise("normal")
    )
    return joined.withColumn("regime", regime).withColumns(
        {
            "regime_actionable": F.col("regime").isin("unknown", "normal"),
            "regime_reason": F.when(F.col("regime") == "unknown", "regime_insufficient_features")
            .when(F.col("regime") == "extreme_volatility", "regime_blocked_extreme_volatility")
            .when(F.col("regime") == "compressed", "regime_blocked_compression").otherwise("ok"),
        }
    ).drop("vol_limit", "compression_limit", "width_limit")


def label_states(states: DataFrame, key: str = "product_id") -> DataFrame:
    """Names for hidden states: highest mean volatility is extreme; among the rest
    the lowest rank sum of width and compression is compressed."""
    means = states.groupBy(key, "state").agg(
        F.avg("realized_vol_5").alias("vol"), F.avg("bb_width").alias("width"), F.avg("range_compression_20").alias("comp")
    )
    w = Window.partitionBy(key)  # a handful of states per key
    means = means.withColumn("_v", F.row_number().over(w.orderBy(F.col("vol").desc(), "state")))
    rest = means.where(F.col("_v") > 1)
    ranks = rest.withColumns(
        {
            "_r": F.row_number().over(w.orderBy("width", "state")) + F.row_number().over(w.orderBy("comp", "state")),
        }
    )
    ranks = ranks.withColumn("_first", F.row_number().over(w.orderBy("_r", "state")))
    named = ranks.select(key, "state", F.when(F.col("_first") == 1, "compressed").otherwise("normal").alias("label"))
    extreme = means.where(F.col("_v") == 1).select(key, "state", F.lit("extreme_volatility").alias("label"))
    return extreme.unionByName(named).withColumn("actionable", F.col("label") == "normal")
