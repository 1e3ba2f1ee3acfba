"""Model registry as tables: promotion, activation, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import yes

# Promotion floors.
MIN_AUC, MIN_SHARPE, MAX_DRAWDOWN, MIN_SUPPORT, MIN_GAIN = 0.53, 0.1, 0.20, 30, 0.005
SELECTIVE = {"threshold": 0.62, "auc": 0.55, "sharpe": 2.0, "precision": 0.65, "drawdown": 0.10, "support": 20}


def promotion_floor() -> Column:
    """Standard floor, or the selective one for few but clean entries."""
    c = F.col
    standard = (
        (c("auc_val") >= MIN_AUC) & (c("sharpe") >= MIN_SHARPE) & (c("max_drawdown") <= MAX_DRAWDOWN)
        & c("entry_ready") & (c("buy_support") >= MIN_SUPPORT)
    )
    s = SELECTIVE
    selective = (
        (c("buy_threshold") >= s["threshold"]) & (c("auc_val") >= s["auc"]) & (c("sharpe") >= s["sharpe"])
        & (c("precision_buy") >= s["precision"]) & (c("max_drawdown") <= s["drawdown"]) & (c("buy_support") >= s["support"])
    )
    return yes(standard) | yes(selective)


def active_records(records: DataFrame) -> DataFrame:
    """Last promoted record per asset."""
    rest = [c for c in records.columns if c != "registry_key"]
    return (
        records.where(F.col("promoted")).groupBy("registry_key")
        .agg(F.max_by(F.struct(*rest), "model_seq").alias("_a")).select("registry_key", "_a.*")
    )


def promotion_decision(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Promote when the floor holds and the active model, if any, is beaten."""
    now = active.select(
        "registry_key", F.col("auc_val").alias("active_auc"), F.col("sharpe").alias("active_sharpe")
    )
    joined = candidates.join(now, "registry_key", "left")
    beats = (
        (F.col("auc_val") - F.col("active_auc") >= MIN_GAIN)
        & (F.col("sharpe") >= F.greatest(F.lit(MIN_SHARPE), F.col("active_sharpe")))
        & (F.col("max_drawdown") <= MAX_DRAWDOWN)
    )
    return joined.withColumn("promote", promotion_floor() & (F.col("active_auc").isNull() | yes(beats)))


def resolved_models(assets: DataFrame, records: DataFrame, allowed_bases: DataFrame) -> DataFrame:
    """One row per asset: active model, else its latest record, else no model, with the reason."""
    rest = [c for c in records.columns if c != "registry_key"]
    picked = records.groupBy("registry_key").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("promoted"), F.col("model_seq"))).alias("_m")
    )
    base = F.upper(F.split_part("registry_key", F.lit("_"), F.lit(1)))
    allowed = allowed_bases.select(F.upper("base").alias("base")).distinct().withColumn("_ok", F.lit(True))
    joined = assets.select("registry_key").distinct().join(picked, "registry_key", "left").withColumn("base", base)
    joined = joined.join(allowed, "base", "left")
    reason = (
        F.when(F.col("_m").isNull(), "no_model")
        .when(~F.col("_m.promoted"), "no_promoted_model")
        .when(F.col("_ok").isNull(), "base_not_enabled")
        .otherwise("ok")
    )
    return joined.select(
        "registry_key", "base", F.col("_m.model_seq").alias("model_seq"), F.col("_m.auc_val").alias("auc_val"),
        reason.alias("reason"), (reason == "ok").alias("actionable"),
    )


def resolve_for_products(products: DataFrame, models: DataFrame) -> DataFrame:
    """Product to model: exact key, else the base's model, else a no_model row.

    ``models`` has one row per asset, so both sides of the lookups are small
    next to the products; the base lookup keeps the last key per base.
    """
    key = F.replace(F.lower(F.trim("product_id")), F.lit("-"), F.lit("_"))
    exact = models.select(F.col("registry_key").alias("_key"), F.struct("registry_key", "model_seq", "reason", "actionable").alias("_exact"))
    by_base = models.groupBy(F.col("base").alias("_base")).agg(
        F.max_by(F.struct("registry_key", "model_seq", "reason", "actionable"), "registry_key").alias("_by_base")
    )
    base = F.upper(F.split_part(F.trim("product_id"), F.lit("-"), F.lit(1)))
    joined = (
        products.withColumns({"_key": key, "_base": base}).join(exact, "_key", "left").join(by_base, "_base", "left")
    )
    found = F.coalesce("_exact", "_by_base")
    return joined.withColumn("_m", found).select(
        *products.columns,
        F.coalesce("_m.registry_key", F.lower("_base")).alias("registry_key"),
        F.col("_m.model_seq").alias("model_seq"),
        F.coalesce("_m.reason", F.lit("no_model")).alias("reason"),
        F.coalesce("_m.actionable", F.lit(False)).alias("actionable"),
    )


def assets_without_model(observed: DataFrame, records: DataFrame) -> DataFrame:
    """Observed bases without any registry entry get a fresh key."""
    known = records.select(F.upper(F.split_part("registry_key", F.lit("_"), F.lit(1))).alias("base")).distinct()
    new = observed.select(F.upper(F.trim("base")).alias("base")).where(F.col("base") != "").distinct()
    return new.join(known, "base", "left_anti").select(
        F.concat(F.lower("base"), F.lit("_usd")).alias("registry_key"), "base", F.lit("new_asset").alias("reason")
    )


def retrains_since(records: DataFrame, since: Column, at: str) -> DataFrame:
    """Per asset: trained and promoted counts, last AUC and last time since T."""
    return records.where(F.col(at) >= since).groupBy("registry_key").agg(
        F.count(F.lit(1)).alias("trained"),
        F.count_if("promoted").alias("promoted"),
        F.round(F.max_by("auc_val", at), 4).alias("last_auc"),
        F.max(at).alias("last_trained_at"),
    )


def universe_manifest(bases: DataFrame, records: DataFrame) -> DataFrame:
    """Per base the record that would be active: promoted, else the latest candidate."""
    found = records.groupBy("registry_key").agg(
        F.max_by(F.struct("model_seq", "auc_val", "promoted"), F.struct("promoted", "model_seq")).alias("_m"),
        F.count(F.lit(1)).alias("model_count"),
    ).withColumn("base", F.upper(F.split_part("registry_key", F.lit("_"), F.lit(1))))
    return bases.join(found, "base", "left").select(
        "base", "registry_key", F.col("_m.model_seq").alias("model_seq"),
        F.when(F.col("_m.promoted"), "promoted").when(F.col("_m").isNotNull(), "candidate_latest").otherwise("missing").alias("source"),
        F.round("_m.auc_val", 6).alias("auc_val"), F.coalesce("model_count", F.lit(0)).alias("model_count"),
    )


def require_complete(manifest: DataFrame) -> DataFrame:
    """Raise if a base has no model at all."""
    missing = [r.base for r in manifest.where(F.col("source") == "missing").select("base").limit(20).collect()]
    if missing:
        raise ValueError(f"bases without models: {missing}")
    return manifest


def union_sources(registry: DataFrame, observed: DataFrame) -> DataFrame:
    """Registry bases, then observed bases that are not in the registry."""
    known = registry.select("base").distinct()
    new = observed.select("base").distinct().join(known, "base", "left_anti")
    return known.withColumn("source", F.lit("registry")).unionByName(new.withColumn("source", F.lit("new_asset")))


def without_excluded(universe: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return universe.select(key).distinct().join(excluded.select(key).distinct(), key, "left_anti")


def set_difference(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Both directions of a set comparison; empty when they are equal."""
    a, b = expected.select(key).distinct(), got.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected"))
    )
