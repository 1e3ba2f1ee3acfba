"""Session and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.asof import MINUTE_MS
from tapeflow.functions.columns import int_div
from tapeflow.functions.quantiles import exact_percentiles
from tapeflow.functions.series import running

# Decision labels of fills and rejections.
BUY_FILL = "paper_buy_filled"
EXIT_FILLS = ("paper_exit_signal_filled", "paper_exit_rule_filled", "paper_sell_filled")
REJECTED = (
    "blocked_risk", "blocked_no_quote_balance", "blocked_existing_position", "blocked_no_inventory",
    "rejected_exchange", "ignored_base_not_enabled",
)


def recent_counts(df: DataFrame, at: str, span_ms: int, now: DataFrame) -> DataFrame:
    """Rows per product since now - span; ``now`` is one row with now_ms."""
    return (
        df.crossJoin(F.broadcast(now.select("now_ms").limit(1)))  # one row
        .where(F.col(at) >= F.col("now_ms") - span_ms)
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"))
    )


def count_by(df: DataFrame, section: str, key: str, limit: int | None = None) -> DataFrame:
    """(section, item, n) counts of one key, most frequent first."""
    counts = df.groupBy(F.col(key).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    if limit:
        counts = counts.orderBy(F.col("n").desc(), "item").limit(limit)
    return counts.select(F.lit(section).alias("section"), "item", "n")


def signal_summary(signals: DataFrame, top_assets: int = 10, top_reasons: int = 5) -> DataFrame:
    """Totals and counts by signal, asset and blocking reason as (section, item, n, value)."""
    totals = signals.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("actionable").alias("actionable"), F.round(F.avg("prob_buy"), 4).alias("avg")
    )
    head = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("section"), F.lit("").alias("item"), F.col("total").alias("n"), F.col("avg").alias("value")),
                F.struct(F.lit("actionable").alias("section"), F.lit("").alias("item"), F.col("actionable").alias("n"), F.lit(None).cast("double").alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    counts = (
        count_by(signals, "by_signal", "signal")
        .unionByName(count_by(signals, "top_assets", "product_id", top_assets))
        .unionByName(count_by(signals.where(~F.col("actionable")), "reasons", "reason", top_reasons))
    )
    return head.unionByName(counts.withColumn("value", F.lit(None).cast("double")))


def execution_summary(events: DataFrame, top_reasons: int = 10) -> DataFrame:
    decision = F.col("decision")
    totals = events.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(decision == "accepted_dry_run").alias("dry_runs"),
        F.count_if(decision == "sent_live").alias("live_orders"), F.count_if(decision.isin(*REJECTED)).alias("rejected"),
    )
    head = totals.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit("").alias("item"), F.col(n).alias("n")) for n in totals.columns])).alias("r")
    ).select("r.*")
    return head.unionByName(count_by(events, "by_decision", "decision")).unionByName(
        count_by(events.where(F.col("reason") != ""), "reasons", "reason", top_reasons)
    )


def is_fill():
    return F.col("decision").isin(BUY_FILL, *EXIT_FILLS)


def paper_summary(events: DataFrame) -> DataFrame:
    """One row: fills, realized P&L, last account values and mean holding time."""
    exit_ = F.col("decision").isin(*EXIT_FILLS)
    at = F.struct("ts_ms", "event_seq")

    def latest(c):
        return F.max_by(c, F.when(is_fill(), at))

    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("decision") == BUY_FILL).alias("buy_fills"),
        F.count_if(exit_).alias("sell_fills"),
        F.round(F.coalesce(F.sum(F.when(exit_, F.col("realized_pnl"))), F.lit(0.0)), 4).alias("realized_pnl_usd"),
        F.round(latest("equity"), 4).alias("last_equity_usd"),
        F.round(latest("cash"), 4).alias("last_cash_usd"),
        F.round(latest("drawdown_pct") * 100, 4).alias("last_drawdown_pct"),
        F.round(F.avg(F.when(exit_, F.col("holding_ms").cast("double"))) / 60_000, 2).alias("avg_holding_min"),
    )


def pnl_by_product(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Fills, realized and unrealized P&L per product. positions: quantity, entry_price, last_price."""
    exit_ = F.col("decision").isin(*EXIT_FILLS)
    fills = events.groupBy("product_id").agg(
        F.count_if(F.col("decision") == BUY_FILL).alias("buy_fills"),
        F.count_if(exit_).alias("sell_fills"),
        F.coalesce(F.sum(F.when(exit_, F.col("realized_pnl"))), F.lit(0.0)).alias("realized_pnl"),
    )
    gain = (F.coalesce("last_price", "entry_price") - F.col("entry_price")) * F.col("quantity")
    open_ = positions.groupBy("product_id").agg(F.sum(gain).alias("unrealized_pnl"), F.sum("quantity").alias("open_quantity"))
    out = fills.join(open_, "product_id", "full").fillna(0.0, ["realized_pnl", "unrealized_pnl", "open_quantity"]).fillna(0, ["buy_fills", "sell_fills"])
    return out.withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl"))


def best_and_worst(pnl: DataFrame, k: int = 5) -> DataFrame:
    best = pnl.orderBy(F.col("total_pnl").desc(), "product_id").limit(k).withColumn("side", F.lit("top"))
    worst = pnl.orderBy("total_pnl", "product_id").limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def mark_to_market(marks: DataFrame, run: str, at: str, initial_cash: float, block_ms: int = 60 * MINUTE_MS) -> DataFrame:
    """Equity and drawdown over time per run. marks: pnl_change per event, unique
    (at, event_seq); the peak starts at the initial cash."""
    block = int_div(at, block_ms)
    line = running(marks, keys=[run], order=[at, "event_seq"], block=block, specs={"_sum": ("sum", "pnl_change")})
    line = line.withColumn("equity", F.lit(float(initial_cash)) + F.col("_sum"))
    line = running(line, keys=[run], order=[at, "event_seq"], block=block, specs={"_peak": ("max", "equity")})
    peak = F.greatest("_peak", F.lit(float(initial_cash)))
    drawdown = F.when(peak > 0, F.greatest(F.lit(0.0), (peak - F.col("equity")) / peak)).otherwise(0.0)
    return line.withColumn("drawdown_pct", drawdown).drop("_sum", "_peak")


def recent_actionable(signals: DataFrame, n: int) -> DataFrame:
    """Last n actionable signals, or the last n of any kind if there are none."""
    order = (F.col("ts_ms").desc(), F.col("event_id").desc())
    good = signals.where("actionable").orderBy(*order).limit(n)
    other = signals.orderBy(*order).limit(n)
    any_good = good.agg(F.count(F.lit(1)).alias("_k"))
    return good.unionByName(other.join(F.broadcast(any_good), F.col("_k") == 0).drop("_k"))  # one-row side


def bias_summary(signals: DataFrame, min_prob: float = 0.62) -> DataFrame:
    """Signal counts, spread of the probability and bias flags per product."""
    p, low = F.col("prob_buy"), 1.0 - min_prob
    base = signals.groupBy("product_id").agg(
        F.count_if(F.col("signal") == "BUY").alias("buy_count"), F.count_if(F.col("signal") == "HOLD").alias("hold_count"),
        F.count_if(F.col("signal").isin("SELL", "EXIT_LONG")).alias("exit_count"), F.count(F.lit(1)).alias("_n"),
        F.min(p).alias("prob_min"), F.avg(p).alias("prob_mean"), F.max(p).alias("prob_max"),
        F.avg((p < low).cast("double")).alias("bearish_share"),
    )
    quart = exact_percentiles(signals, ["product_id"], "prob_buy", {"prob_p25": 0.25, "prob_median": 0.5, "prob_p75": 0.75})
    return base.join(quart, "product_id").select(
        "product_id", "buy_count", "hold_count", "exit_count",
        *[F.round(c, 6).alias(c) for c in ("prob_min", "prob_p25", "prob_median", "prob_mean", "prob_p75", "prob_max", "bearish_share")],
        F.round(F.col("buy_count") / F.col("_n"), 6).alias("buy_share"), F.round(F.col("exit_count") / F.col("_n"), 6).alias("exit_share"),
        (F.col("prob_p75") > low).alias("likely_threshold_issue"), (F.col("prob_mean") < 0.30).alias("likely_model_bias"),
    )


def prob_alignment(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    other = recomputed.select(*keys, F.col("prob_buy").alias("_p"))
    joined = stored.join(other, keys)
    return joined.groupBy("product_id").agg(F.max(F.abs(F.col("prob_buy") - F.col("_p"))).alias("max_abs_diff"), F.count(F.lit(1)).alias("rows"))


def latest_snapshot(features: DataFrame, names: list[str]) -> DataFrame:
    """Latest feature row per product, rounded."""
    return (
        features.groupBy("product_id").agg(F.max_by(F.struct("open_time", *names[:10]), "open_time").alias("_r"))
        .select("product_id", "_r.open_time", *[F.round(f"_r.{n}", 6).alias(n) for n in names[:10]])
    )


def grouped_counts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Counts by key and by (key, label) in one pass; label is null on the key level."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup(key, label).agg(F.sum("n").alias("n")).where(F.col(key).isNotNull())


def by_rank(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
