"""Signal thresholds: candidate grids, selection and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach
from tapeflow.functions.quantiles import exact_percentiles
from tapeflow.operators.evaluation import sharpe

# Grids, quantiles, bounds and gates of the threshold search.
GRID = 7
BUY = {"low": 0.45, "high": 0.85, "quantiles": (0.45, 0.55, 0.65, 0.75, 0.85), "floor": 0.45, "cap": 0.90}
EXIT = {"low": 0.10, "high": 0.45, "quantiles": (0.10, 0.20, 0.30, 0.40), "floor": 0.05, "cap": 0.49}
MIN_SUPPORT, MIN_SHARE, MIN_PRECISION = 30, 0.03, 0.55
DEFAULT_BUY, DEFAULT_EXIT = 0.62, 0.38


def candidates(scored: DataFrame, side: dict, key: str = "product_id") -> DataFrame:
    """Distinct grid and quantile thresholds per group (at most 12 per group)."""
    names = {f"q{i}": q for i, q in enumerate(side["quantiles"])}
    quantiles = exact_percentiles(scored, [key], "prob", names)
    step = (side["high"] - side["low"]) / (GRID - 1)
    grid = [F.lit(side["low"] + i * step) for i in range(GRID)]
    values = F.transform(
        F.array(*grid, *[F.col(n) for n in names]),
        lambda v: F.least(F.greatest(v, F.lit(side["floor"])), F.lit(side["cap"])),
    )
    return quantiles.select(key, F.explode(F.array_distinct(values)).alias("threshold"))


def threshold_stats(scored: DataFrame, cuts: DataFrame, buy: bool, key: str = "product_id") -> DataFrame:
    """Support, mean, Sharpe and precision of every candidate.

    Rows meet at most 12 candidates each as an array, so nothing is shuffled but
    the partial aggregates.
    """
    lists = cuts.groupBy(key).agg(F.collect_list("threshold").alias("_cuts"))
    hits = F.filter("_cuts", lambda t: (F.col("prob") >= t) if buy else (F.col("prob") <= t))
    rows = attach(scored, lists, [key]).select(key, "target", "target_return", F.explode(hits).alias("threshold"))
    return rows.groupBy(key, "threshold").agg(
        F.count(F.lit(1)).alias("support"),
        F.avg("target_return").alias("mean_return"),
        sharpe(F.col("target_return")).alias("sharpe"),
        F.avg((F.col("target") == 1).cast("double")).alias("up_share"),
    )


def optimize_thresholds(scored: DataFrame, key: str = "product_id") -> DataFrame:
    """Buy and exit thresholds per group; the lowest threshold wins a tie."""
    sizes = scored.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    need = F.greatest(F.lit(MIN_SUPPORT), F.floor(F.col("_n") * MIN_SHARE))

    def best(buy: bool, name: str) -> DataFrame:
        side = BUY if buy else EXIT
        stats = threshold_stats(scored, candidates(scored, side, key), buy, key).join(sizes, key)
        ok = F.col("support") >= need
        if buy:
            score = F.col("sharpe") + F.col("up_share") + F.col("mean_return") * 100.0
            ok = ok & (F.col("up_share") >= MIN_PRECISION)
        else:
            score = (1.0 - F.col("up_share")) - F.col("mean_return") * 100.0
        stats = stats.where(ok).withColumn("score", score)
        top = F.struct("score", (-F.col("threshold")).alias("_t"), "threshold", "support", "up_share")
        return stats.groupBy(key).agg(F.max(top).alias(name))

    fallback = scored.groupBy(key).agg(
        F.count_if(F.col("prob") >= DEFAULT_BUY).alias("_fb_support"),
        F.avg(F.when(F.col("prob") >= DEFAULT_BUY, (F.col("target") == 1).cast("double"))).alias("_fb_precision"),
    )
    joined = fallback.join(best(True, "_buy"), key, "left").join(best(False, "_exit"), key, "left")
    ready = F.col("_buy").isNotNull()
    found_buy = F.coalesce("_buy.threshold", F.lit(DEFAULT_BUY))
    found_exit = F.coalesce("_exit.threshold", F.lit(DEFAULT_EXIT))
    exit_cut = F.when(found_exit >= found_buy, F.greatest(F.lit(0.05), found_buy - 0.10)).otherwise(found_exit)
    return joined.select(
        key,
        F.round(found_buy, 6).alias("buy_threshold"),
        F.round(exit_cut, 6).alias("exit_threshold"),
        F.coalesce("_buy.score", F.lit(0.0)).alias("buy_score"),
        F.coalesce("_exit.score", F.lit(0.0)).alias("exit_score"),
        F.when(ready, F.col("_buy.support")).otherwise(F.col("_fb_support")).alias("buy_support"),
        F.coalesce("_exit.support", F.lit(0)).alias("exit_support"),
        F.round(F.when(ready, F.col("_buy.up_share")).otherwise(F.coalesce("_fb_precision", F.lit(0.0))), 6).alias("buy_precision"),
        ready.alias("entry_ready"),
    )


def resolve_thresholds(products: DataFrame, models: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-base override, else the model's, else the default; within [0, 1], sell <= buy."""
    joined = products.join(models.select("base", "buy_threshold", "exit_threshold"), "base", "left").join(
        overrides.select("base", F.col("buy").alias("_ob"), F.col("sell").alias("_os")), "base", "left"
    )

    def unit(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    buy = unit(F.coalesce("_ob", "buy_threshold", F.lit(DEFAULT_BUY)))
    sell = unit(F.coalesce("_os", "exit_threshold", F.lit(DEFAULT_EXIT)))
    return joined.withColumns({"buy_threshold": buy, "exit_threshold": F.least(sell, buy)}).drop("_ob", "_os")
