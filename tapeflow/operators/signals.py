"""Probabilities to gated signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signals_from_probabilities(df: DataFrame) -> DataFrame:
    """Decide BUY / EXIT_LONG / HOLD.

    Needs prob_buy, buy_threshold, exit_threshold, model_actionable,
    model_reason, drift_actionable, drift_reason, regime_actionable and
    regime_reason. Rows without a model (null probability) observe only.
    """
    p = F.col("prob_buy")
    known = p.isNotNull()
    free = F.coalesce("drift_actionable", F.lit(True)) & F.coalesce("regime_actionable", F.lit(True))
    raw = F.when(p >= F.col("buy_threshold"), "BUY").when(p <= F.col("exit_threshold"), "EXIT_LONG").otherwise("HOLD")
    model_ok = F.coalesce("model_actionable", F.lit(False))
    reason = (
        F.when(~known, "no_model")
        .when(model_ok & ~F.coalesce("drift_actionable", F.lit(True)), F.col("drift_reason"))
        .when(model_ok & ~F.coalesce("regime_actionable", F.lit(True)), F.col("regime_reason"))
        .otherwise(F.col("model_reason"))
    )
    return df.withColumns(
        {
            "signal": F.when(known & free, raw).otherwise("HOLD"),
            "actionable": known & model_ok & free,
            "reason": reason,
            "prob_buy": F.round(F.coalesce(p, F.lit(0.5)), 6),
        }
    )
