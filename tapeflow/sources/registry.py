"""Model registry files: one folder per asset with registry.json and, when a
model is active, active_model_meta.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "auc_val: DOUBLE, sharpe: DOUBLE, precision_buy: DOUBLE, win_rate: DOUBLE, max_drawdown: DOUBLE, "
    "buy_support: INT, exit_support: INT, buy_threshold: DOUBLE, exit_threshold: DOUBLE, entry_ready: BOOLEAN"
)
RECORD_SCHEMA = (
    "model_id STRING, model_path STRING, created_at STRING, train_start STRING, train_end STRING, val_start STRING, "
    f"val_end STRING, metrics STRUCT<{METRICS}>, promoted BOOLEAN, feature_names ARRAY<STRING>, n_features INT"
)
META_SCHEMA = "model_id STRING, model_path STRING, feature_names ARRAY<STRING>, signal_contract STRING, artifact_sha256 STRING"
# Defaults of metrics that older records lack.
DEFAULTS = {
    "auc_val": 0.0, "sharpe": 0.0, "precision_buy": 0.0, "win_rate": 0.0, "max_drawdown": 0.0, "buy_support": 0,
    "exit_support": 0, "buy_threshold": 0.62, "exit_threshold": 0.38, "entry_ready": False,
}


def _key():
    return F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """All model records with their asset key, order in the file and active mark."""
    records = (
        spark.read.schema(RECORD_SCHEMA).option("multiLine", True).json(f"{root}/*/registry.json")
        .select(_key().alias("registry_key"), "*")
    )
    flat = records.select(
        "registry_key", "model_id", "model_path", "created_at", "promoted", "feature_names", "n_features",
        *[F.coalesce(f"metrics.{name}", F.lit(value)).alias(name) for name, value in DEFAULTS.items()],
    ).withColumn("model_seq", F.col("created_at"))
    return flat.withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def read_active(spark: SparkSession, root: str) -> DataFrame:
    """Active model per asset with the feature list it was activated with."""
    return (
        spark.read.schema(META_SCHEMA).option("multiLine", True).json(f"{root}/*/active_model_meta.json")
        .select(_key().alias("registry_key"), "*")
    )
