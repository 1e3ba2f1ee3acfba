"""Feature queries: candle features, trade flow, kline proxy, flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapeflow.plans.sql_features  # noqa: F401  (registers the SQL views)
from tapeflow.functions.columns import rounded
from tapeflow.functions.names import (
    BOOK_CANCEL, BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD, CANDLE, FLOW_DERIVED, FLOW_RAW, OHLCV_FEATURES, TRADE_FLOW,
)
from tapeflow.operators import flow_features as G
from tapeflow.operators import kline_proxy as K
from tapeflow.operators import ohlcv as H
from tapeflow.operators import trade_flow as T
from tapeflow.plans.registry import query, r6
from tapeflow.session import staged
from tapeflow.plans.views import CANDLE_SPAN, HOUR, Inputs

KEY = ["product_id", "open_time"]

# ---------------------------------------------------------------- candle features
OHLCV_GROUPS = {
    "f_returns": "ret_1 ret_5 ret_15 ret_30 ret_60 signed_return_1_volume",
    "f_rsi": "rsi_14",
    "f_rsi_divergence": "rsi_divergence",
    "f_macd": "macd_hist macd_cross_up macd_cross_down",
    "f_atr": "atr_pct",
    "f_bollinger": "bb_pct bb_width",
    "f_realized_vol": "realized_vol_5 realized_vol_20",
    "f_ema_distance": "price_vs_ema_fast price_vs_ema_slow price_vs_ema_trend ema_fast_above_slow ema_full_alignment",
    "f_vwap_distance": "vwap_20_distance",
    "f_range_position": "position_in_range_20 range_compression_20",
    "f_slope": "trend_slope_pct volume_trend",
    "f_volume": "volume_ratio volume_spike",
    "f_trade_intensity": "trade_intensity_20",
    "f_candle_shape": "hl_ratio close_position_in_candle body_to_range_ratio",
    "f_calendar": "hour_sin hour_cos day_of_week_sin day_of_week_cos",
}


def _ohlcv_group(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT product_id, open_time, {r6(*cols)} FROM ohlcv", ("ohlcv",))
    def run(x: Inputs):
        return rounded(H.ohlcv_features(x.candle_table(), CANDLE_SPAN, drop_incomplete=False, columns=cols).select(*KEY, *cols))


for _name, _cols in OHLCV_GROUPS.items():
    _ohlcv_group(_name, _cols.split())

NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in OHLCV_FEATURES)


@query(
    "features_ohlcv",
    f"SELECT product_id, open_time, {r6('close', *OHLCV_FEATURES)} FROM ohlcv WHERE {NOT_NULL}",
    ("ohlcv",),
)
def features_ohlcv(x: Inputs):
    return rounded(H.ohlcv_features(x.candle_table(), CANDLE_SPAN).select(*KEY, "close", *OHLCV_FEATURES))


@query(
    "dropna_features",
    f"SELECT product_id, count(*) AS rows_kept, min(open_time) AS first_open FROM ohlcv WHERE {NOT_NULL} GROUP BY product_id",
    ("ohlcv",),
)
def dropna_features(x: Inputs):
    kept = H.complete_rows(H.ohlcv_features(x.candle_table(), CANDLE_SPAN, drop_incomplete=False))
    return kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("rows_kept"), F.min("open_time").alias("first_open"))


# ---------------------------------------------------------------- trade flow
FLOAT_FLOW = [c for c in TRADE_FLOW if c not in ("trade_count", "buy_count", "sell_count")]
FLOW_SQL = f"product_id, open_time, trade_count, buy_count, sell_count, {r6(*FLOAT_FLOW)}"


@query("trade_flow_metrics", f"SELECT {FLOW_SQL} FROM live_flow", ("live_flow",))
def trade_flow_metrics(x: Inputs):
    return rounded(T.live_flow(x.trades(), HOUR, with_last=True))


@query(
    "trade_flow_arrival_windows",
    f"""SELECT {FLOW_SQL} FROM live_flow JOIN (SELECT product_id, max(bucket) AS b FROM arrived GROUP BY product_id)
        USING (product_id) WHERE open_time < b""",
    ("live_flow",),
)
def trade_flow_arrival_windows(x: Inputs):
    return rounded(T.live_flow(x.trades(), HOUR))


@query("trade_flow_event_minutes", f"SELECT {FLOW_SQL} FROM minute_flow", ("minute_flow",))
def trade_flow_event_minutes(x: Inputs):
    maker = F.when(F.col("side") == "BUY", "false").otherwise("True")
    trades = x.trades().withColumn("side", T.maker_side(maker))
    klines = x.klines().withColumn("open_time", (F.col("open_time_us") / 1000).cast("bigint"))
    return rounded(T.historical_flow(trades, HOUR, klines))


@query(
    "minutes_in_klines",
    f"""SELECT {FLOW_SQL} FROM minute_flow SEMI JOIN (SELECT product_id, open_time FROM candles
          WHERE trade_count > 2) USING (product_id, open_time)""",
    ("minute_flow", "candles"),
)
def minutes_in_klines(x: Inputs):
    return rounded(T.historical_flow(x.trades(), HOUR, x.candles().where(F.col("trade_count") > 2)))


# ---------------------------------------------------------------- kline proxy
@query(
    "kline_prep",
    f"""SELECT product_id, open_time, {r6('sell_base', 'sell_quote', 'buy_base', 'buy_quote', 'buy_vwap', 'sell_vwap')} FROM kl""",
    ("kl",),
)
def kline_prep(x: Inputs):
    return rounded(
        K.prepare(x.klines()).select(*KEY, "sell_base", "sell_quote", "buy_base", "buy_quote", "buy_vwap", "sell_vwap")
    )


PROXY_GROUPS = {
    "kline_spread_proxy": BOOK_SPREAD,
    "kline_depth_proxy": BOOK_DEPTH,
    "kline_dynamics_proxy": [c for c in BOOK_DYNAMICS if c not in BOOK_CANCEL and not c.startswith(("refill", "cancel"))],
    "kline_refill_cancel_proxy": ["refill_rate_ask", "refill_rate_bid", "cancel_rate_ask", "cancel_rate_bid"],
}


def _proxy_group(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT product_id, open_time, {r6(*cols)} FROM proxy", ("proxy",))
    def run(x: Inputs):
        return rounded(K.kline_proxy(staged(x.klines()), CANDLE_SPAN).select(*KEY, *cols))


for _name, _cols in PROXY_GROUPS.items():
    _proxy_group(_name, _cols)

ZEROED = ", ".join(f"0e0 AS {c}" for c in TRADE_FLOW + BOOK_CANCEL)
PROXIED = [c for c in FLOW_RAW if c not in TRADE_FLOW + BOOK_CANCEL]


@query("kline_proxy_fill", f"SELECT product_id, open_time, {ZEROED}, {r6(*PROXIED)} FROM proxy", ("proxy",))
def kline_proxy_fill(x: Inputs):
    return rounded(K.kline_proxy(staged(x.klines()), CANDLE_SPAN))


@query("kline_flow_proxy", f"SELECT product_id, open_time, {r6(*PROXIED)} FROM proxy", ("proxy",))
def kline_flow_proxy(x: Inputs):
    return rounded(K.kline_proxy(staged(x.klines()), CANDLE_SPAN).select(*KEY, *PROXIED))


def merged_flow(x: Inputs):
    return K.merge_proxy_and_trades(K.kline_proxy(staged(x.klines()), CANDLE_SPAN), T.historical_flow(x.trades(), HOUR))


def some_flow(x: Inputs):
    """Flow with hours missing, for the two queries about joining it."""
    return merged_flow(x).where((F.col("open_time") / HOUR).cast("bigint") % 9 != 0)


@query("merge_proxy_and_real_flow", f"SELECT product_id, open_time, {r6(*FLOW_RAW)} FROM flow_raw", ("flow_raw",))
def merge_proxy_and_real_flow(x: Inputs):
    return rounded(merged_flow(x))


# ---------------------------------------------------------------- joins with flow
MERGED = [c for c in FLOW_RAW if c != "trade_count"]


@query(
    "candles_with_order_flow",
    f"""SELECT c.product_id, c.open_time, c.close_time, c.trade_count, {r6('c.open', 'c.high', 'c.low', 'c.close', 'c.volume')}, {r6(*[f'r.{k}' for k in MERGED])}
        FROM candles c LEFT JOIN flow_some r USING (product_id, open_time) ORDER BY 1, 2""",
    ("candles", "flow_some"),
)
def candles_with_order_flow(x: Inputs):
    from tapeflow.sources.store import candles_with_flow

    return rounded(candles_with_flow(x.candles(), some_flow(x)).orderBy(*KEY))


@query("merge_order_flow_neutral", f"SELECT product_id, open_time, {r6(*MERGED)} FROM merged_some", ("merged_some",))
def merge_order_flow_neutral(x: Inputs):
    return rounded(G.merge_order_flow(x.candles(), some_flow(x)).select(*KEY, *MERGED))


# ---------------------------------------------------------------- flow features
FLOW_GROUPS = {
    "of_cvd": "cvd_5 cvd_15 delta_acceleration",
    "of_trade_ratios": "volume_delta_normalized trade_size_skew buy_pressure_pct",
    "of_efficiency": "flow_efficiency net_flow_efficiency",
    "of_price_reaction": "ret_3m break_of_local_high break_of_local_low distance_to_recent_high distance_to_recent_low",
    "of_mtf_trend": "trend_5m trend_15m trend_1h",
    "of_mtf_vwap": "vwap_distance_15m vwap_distance_1h",
    "of_vol_state": "vol_state_1h",
    "of_trend_regime": "trend_regime",
    "of_volatility_regime": "volatility_regime",
    "of_spread_regime": "spread_regime",
    "of_activity_regime": "activity_regime",
    "of_liquidity_regime": "liquidity_regime",
    "of_operational": "current_spread_cost fee_impact execution_quality_estimate",
}


def _flow_group(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT product_id, open_time, {r6(*cols)} FROM flow_features", ("flow_features",))
    def run(x: Inputs):
        wide = G.flow_features(x.candle_table(), staged(merged_flow(x)), CANDLE_SPAN, drop_incomplete=False, columns=cols)
        return rounded(wide.select(*KEY, *cols))


for _name, _cols in FLOW_GROUPS.items():
    _flow_group(_name, _cols.split())

EVERYTHING = OHLCV_FEATURES + MERGED + FLOW_DERIVED


@query(
    "features_order_flow",
    f"SELECT product_id, open_time, trade_count, {r6(*EVERYTHING)} FROM flow_features WHERE {NOT_NULL}",
    ("flow_features",),
)
def features_order_flow(x: Inputs):
    wide = G.flow_features(x.candle_table(), staged(merged_flow(x)), CANDLE_SPAN)
    return rounded(wide.select(*KEY, "trade_count", *EVERYTHING))
