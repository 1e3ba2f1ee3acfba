"""Grouped evaluation metrics, computed without ordering whole groups in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div, ratio
from tapeflow.functions.quantiles import with_stripe
from tapeflow.functions.series import running
from tapeflow.session import staged

DRAWDOWN_BLOCK = 100_000


def auc(scored: DataFrame, keys: Sequence[str], prob: str = "prob", target: str = "target") -> DataFrame:
    """ROC AUC per group with ties at half weight; one class gives 0.5.

    Equal probabilities are folded first; the ranks then come from running
    counts over value ranges of about equal size.
    """
    keys = list(keys)
    folded = scored.groupBy(*keys, F.col(prob).alias("_p")).agg(
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(target) == 1, 0).otherwise(1)).alias("_neg"),
    )
    ranked = running(
        with_stripe(staged(folded), keys, "_p"), keys=keys, order=["_p"], block=F.col("_s"),
        specs={"_below": ("sum", "_neg")}, exclusive=True,
    )
    wins = F.sum(F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2.0))
    sums = ranked.groupBy(*keys).agg(wins.alias("_w"), F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn"))
    pairs = F.col("_np") * F.col("_nn").cast("double")
    return sums.select(*keys, ratio(F.col("_w"), pairs, 0.5).alias("auc"))


def log_loss(scored: DataFrame, keys: Sequence[str], prob: str = "prob", target: str = "target") -> DataFrame:
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1.0 - eps))
    return scored.groupBy(*keys).agg(
        F.avg(F.when(F.col(target) == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))).alias("log_loss")
    )


def sharpe(value: Column) -> Column:
    """mean / population std * sqrt(n); 0 below two values or without spread."""
    n, std = F.count(value), F.stddev_pop(value)
    return F.when((n < 2) | (std == 0), 0.0).otherwise(F.avg(value) / std * F.sqrt(n))


def max_drawdown(
    trades: DataFrame, keys: Sequence[str], value: str, order: str, block: int = DRAWDOWN_BLOCK
) -> DataFrame:
    """Deepest fall of the cumulative sum below its running peak.

    Each block gives its sum, highest and lowest point and its own deepest fall;
    blocks are then chained: a fall may start at the peak of an earlier block.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.select(*keys, order, F.col(value).alias("_x"), int_div(order, block).alias("_blk"))
    df = df.withColumn("_cum", F.sum("_x").over(inside)).withColumn("_peak", F.max("_cum").over(inside))
    blocks = df.groupBy(*keys, "_blk").agg(
        F.sum("_x").alias("_total"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"),
        F.max(F.col("_peak") - F.col("_cum")).alias("_fall"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("_before", F.max(F.col("_start") + F.col("_high")).over(earlier))
    carried = F.col("_before") - F.col("_start") - F.col("_low")
    return blocks.groupBy(*keys).agg(F.max(F.greatest(F.col("_fall"), carried)).alias("max_drawdown"))


def holdout_metrics(scored: DataFrame, keys: Sequence[str], threshold: float | Column, order: str = "row_idx") -> DataFrame:
    """Precision, win rate, Sharpe and drawdown of the rows at or above the buy threshold."""
    keys = list(keys)
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    marked = scored.withColumn("_buy", F.col("prob") >= cut)
    ret = F.when(F.col("_buy"), F.col("target_return"))
    base = marked.groupBy(*keys).agg(
        F.count_if("_buy").alias("buy_support"),
        F.coalesce(F.avg(F.when(F.col("_buy"), F.col("target").cast("double"))), F.lit(0.0)).alias("precision_buy"),
        F.coalesce(F.avg(F.when(ret.isNotNull(), (ret > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        sharpe(ret).alias("sharpe"),
    )
    falls = max_drawdown(marked.where("_buy"), keys, "target_return", order)
    return base.join(falls, keys, "left").fillna(0.0, ["max_drawdown", "sharpe"]).join(auc(scored, keys), keys)


def holdout_stats(holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label and price statistics of a held-out window with ``log_step`` per row."""
    return holdout.groupBy(*keys).agg(
        F.avg("target").alias("target_mean"), F.avg("target_return").alias("return_mean"),
        F.stddev_pop("target_return").alias("return_std"), F.stddev_pop("log_step").alias("volatility"),
    )


def best_strategy(results: DataFrame, by: str = "product_id") -> DataFrame:
    """Best holdout AUC among the strategies with status ok (first name wins a tie)."""
    ok = results.where(F.col("status") == "ok")
    best = ok.groupBy(by).agg(
        F.max(F.struct("holdout_auc", F.struct((-F.col("strategy_no")).alias("no")), "strategy")).alias("_b")
    )
    return results.select(by).distinct().join(best, by, "left").select(
        by, F.col("_b.strategy").alias("best_strategy"), F.col("_b.holdout_auc").alias("best_holdout_auc")
    )
