"""Trade-flow metrics per product and window, live and historical rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import bucket_start, clip, ratio
from tapeflow.functions.names import TRADE_FLOW
from tapeflow.functions.quantiles import bounded_percentile
from tapeflow.operators.candles import is_buy, with_current_bucket


def trade_flow(trades: DataFrame, window: str, no_sells: float = 10.0, nothing: float = 1.0) -> DataFrame:
    """The 13 trade-flow columns per (product, ``window``).

    ``no_sells`` / ``nothing`` are the buy/sell ratios of windows without sells
    and without volume: 10 and 1 live, 0 and 0 historical. All columns, the median among them, come from one
    aggregate with one shuffle of partial rows; windows without any size are left out.
    """
    keys = ["product_id", window]
    size, buys = F.col("size"), is_buy()
    sums = trades.groupBy(*keys).agg(
        F.sum(F.when(buys, size).otherwise(0.0)).alias("buy_aggressive_volume"),
        F.sum(F.when(buys, 0.0).otherwise(size)).alias("sell_aggressive_volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(buys, 1).otherwise(0)).alias("buy_count"),
        F.avg("size").alias("avg_trade_size"),
        F.max("size").alias("max_trade_size"),
        F.sum(F.col("price") * size).alias("_notional"),
        bounded_percentile("size", 0.5).alias("median_trade_size"),
    )
    bought, sold = F.col("buy_aggressive_volume"), F.col("sell_aggressive_volume")
    total, delta = F.col("total_traded_volume"), F.col("volume_delta")
    return (
        sums.where(F.col("median_trade_size").isNotNull())
        .withColumns(
            {
                "total_traded_volume": bought + sold,
                "sell_count": F.col("trade_count") - F.col("buy_count"),
                "volume_delta": bought - sold,
            }
        )
        .withColumns(
            {
                "delta_ratio": ratio(delta, total, 0.0),
                "buy_sell_ratio": clip(
                    F.when(sold > 0, bought / sold).when(bought > 0, no_sells).otherwise(nothing), 0, 10
                ),
                "trade_vwap": ratio(F.col("_notional"), total, 0.0),
            }
        )
        .select(*keys, *TRADE_FLOW)
    )


def live_flow(trades: DataFrame, length_ms: int, with_last: bool = False) -> DataFrame:
    """Live windows: a trade counts in the candle that was open before it arrived,
    so the first trade of a new bucket closes the old one and late trades count
    in the current one. The still-open last window is left out."""
    seen = with_current_bucket(trades, length_ms)
    keyed = seen.withColumn("open_time", F.coalesce("current", "bucket"))
    flow = trade_flow(keyed, "open_time")
    if with_last:
        return flow
    last = keyed.groupBy("product_id").agg(F.max("bucket").alias("_last"))
    return flow.join(last, "product_id").where(F.col("open_time") < F.col("_last")).drop("_last")


def historical_flow(trades: DataFrame, length_ms: int, klines: DataFrame | None = None) -> DataFrame:
    """Event-time windows; windows without a candle are dropped when candles are given."""
    keyed = trades.withColumn("open_time", bucket_start("ts_ms", length_ms))
    flow = trade_flow(keyed, "open_time", no_sells=0.0, nothing=0.0)
    if klines is not None:
        flow = flow.join(klines.select("product_id", "open_time"), ["product_id", "open_time"], "left_semi")
    return flow


def maker_side(is_buyer_maker: str | Column) -> Column:
    """Aggressor side from the maker flag: a buyer-maker trade was sold into."""
    col = F.col(is_buyer_maker) if isinstance(is_buyer_maker, str) else is_buyer_maker
    return F.when(F.coalesce(F.lower(col.cast("string")) == "true", F.lit(False)), "SELL").otherwise("BUY")
