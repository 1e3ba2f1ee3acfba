"""Book-shaped columns estimated from candles with taker volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import clip, over_nonzero
from tapeflow.functions.names import BOOK_CANCEL, BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD, FLOW_RAW, TRADE_FLOW
from tapeflow.functions.series import Series, number_rows
from tapeflow.operators.ohlcv import MINUTE_SPAN

SERIES = Series(back=64)
NUMERIC = (
    "open high low close volume quote_volume trade_count taker_buy_base_vol taker_buy_quote_vol"
).split()
PROXY = [c for c in BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS if c not in BOOK_CANCEL]


def prepare(klines: DataFrame) -> DataFrame:
    """Numbers or zero, time in ms, taker sell side and side VWAPs."""
    df = klines.withColumns(
        {c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) for c in NUMERIC}
    ).withColumn("open_time", (F.col("open_time_us") / 1000).cast("bigint"))
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "sell_base": F.greatest(F.col("volume") - F.col("taker_buy_base_vol"), zero),
            "sell_quote": F.greatest(F.col("quote_volume") - F.col("taker_buy_quote_vol"), zero),
            "buy_base": F.greatest(F.col("taker_buy_base_vol"), zero),
            "buy_quote": F.greatest(F.col("taker_buy_quote_vol"), zero),
        }
    )
    return df.withColumns(
        {
            "buy_vwap": over_nonzero(F.col("buy_quote"), F.col("buy_base"), F.col("close")),
            "sell_vwap": over_nonzero(F.col("sell_quote"), F.col("sell_base"), F.col("close")),
        }
    )


def _spread(df: DataFrame) -> DataFrame:
    buy, sell, volume = F.col("buy_base"), F.col("sell_base"), F.col("volume")
    trades = F.greatest(F.col("trade_count"), F.lit(1.0))
    df = df.withColumns(
        {
            "mid_price": (F.col("high") + F.col("low")) / 2.0,
            "spread": F.greatest(F.col("buy_vwap") - F.col("sell_vwap"), F.lit(0.0)),
            "best_bid_size": sell / trades,
            "best_ask_size": buy / trades,
            "top_of_book_imbalance": over_nonzero(sell - buy, volume, 0.0),
        }
    )
    df = df.withColumns(
        {
            "relative_spread": over_nonzero(F.col("spread"), F.col("mid_price"), 0.0),
            "microprice": over_nonzero(
                sell * F.col("buy_vwap") + buy * F.col("sell_vwap"), volume, F.col("mid_price")
            ),
        }
    )
    return df.withColumn("microprice_shift", F.col("microprice") - F.col("mid_price"))


def _depth(df: DataFrame, s: Series) -> DataFrame:
    def total(value, n):
        return F.sum(value).over(s.rows(n))

    sides = {"bid": F.col("sell_base"), "ask": F.col("buy_base")}
    df = df.withColumns(
        {f"{side}_depth_top{n}": total(v, n) for side, v in sides.items() for n in (5, 10, 20)}
        | {
            "cumul_depth_1bp": total(F.col("volume"), 3) * 0.05,
            "cumul_depth_5bp": total(F.col("volume"), 5) * 0.20,
            "cumul_depth_10bp": total(F.col("volume"), 10) * 0.40,
        }
    )
    bid, ask = F.col("bid_depth_top10"), F.col("ask_depth_top10")
    return df.withColumns(
        {
            "depth_imbalance_top10": over_nonzero(bid - ask, bid + ask, 0.0),
            "depth_slope_bid": clip(over_nonzero(F.col("bid_depth_top5"), F.col("bid_depth_top20"), 0.0), 0, 2),
            "depth_slope_ask": clip(over_nonzero(F.col("ask_depth_top5"), F.col("ask_depth_top20"), 0.0), 0, 2),
        }
    )


def _dynamics(df: DataFrame, s: Series) -> DataFrame:
    buy, sell, volume, spread = (F.col(c) for c in ("buy_base", "sell_base", "volume", "spread"))
    move = F.col("close") - F.col("open")
    impact = F.greatest(spread * volume, F.lit(1e-12))
    direction = clip(F.coalesce(over_nonzero(move, spread), F.lit(0.0)), -1, 1)
    prev = {c: F.coalesce(s.lag(F.col(c)), F.col(c)) for c in ("volume", "buy_base", "sell_base")}
    df = df.withColumns({f"_prev_{c}": v for c, v in prev.items()})

    def refill(side):
        return clip(over_nonzero(side, F.col("_prev_volume"), 0.0), 0, 2)

    def cancel(name):
        before = F.col(f"_prev_{name}")
        return over_nonzero(F.greatest(before - F.col(name), F.lit(0.0)), before, 0.0)

    df = df.withColumns(
        {
            "ask_consumption_rate": clip(over_nonzero(buy, F.col("ask_depth_top10"), 0.0), 0, 1),
            "bid_consumption_rate": clip(over_nonzero(sell, F.col("bid_depth_top10"), 0.0), 0, 1),
            "price_move_per_unit_flow": over_nonzero(move, volume, 0.0),
            "seller_absorption_estimate": clip(1.0 - F.abs(move) / impact, 0, 1),
            "flow_to_price_divergence": clip(over_nonzero(buy - sell, volume, 0.0) - direction, -2, 2),
            "refill_rate_ask": refill(buy),
            "refill_rate_bid": refill(sell),
            "cancel_rate_ask": cancel("buy_base"),
            "cancel_rate_bid": cancel("sell_base"),
        }
    )
    return df.withColumns(
        {
            "net_consumption": F.col("ask_consumption_rate") - F.col("bid_consumption_rate"),
            "buyer_absorption_estimate": F.col("seller_absorption_estimate"),
            "absorption_score": F.col("seller_absorption_estimate"),
        }
    )


def kline_proxy(klines: DataFrame, span: int = MINUTE_SPAN) -> DataFrame:
    """(product, open_time) + all 51 raw flow columns; the ones candles cannot tell are 0."""
    s = SERIES
    numbered = number_rows(prepare(klines), s.keys, "open_time", span)
    df = s.close(_dynamics(_depth(_spread(s.open(numbered)), s), s))
    finite = {
        c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in PROXY
    }
    rest = {c: F.lit(0.0) for c in TRADE_FLOW + BOOK_CANCEL}
    return df.withColumns(finite | rest).select("product_id", "open_time", *FLOW_RAW)


def merge_proxy_and_trades(proxy: DataFrame, trades: DataFrame) -> DataFrame:
    """Full join of proxy rows and real trade rows; real trade columns win."""
    real = trades.select("product_id", "open_time", *[F.col(c).cast("double").alias(f"_{c}") for c in TRADE_FLOW])
    joined = proxy.join(real, ["product_id", "open_time"], "full")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in TRADE_FLOW}).select(proxy.columns)
