"""Column groups of the feature tables."""

# Column names that stored tables and models refer to.
OHLCV_FEATURES = (
    "ret_1 ret_5 ret_15 ret_30 ret_60 signed_return_1_volume rsi_14 rsi_divergence macd_hist macd_cross_up "
    "macd_cross_down atr_pct bb_pct bb_width realized_vol_5 realized_vol_20 price_vs_ema_fast price_vs_ema_slow "
    "price_vs_ema_trend ema_fast_above_slow ema_full_alignment vwap_20_distance position_in_range_20 "
    "range_compression_20 trend_slope_pct volume_ratio volume_spike volume_trend trade_intensity_20 hl_ratio "
    "close_position_in_candle body_to_range_ratio hour_sin hour_cos day_of_week_sin day_of_week_cos"
).split()
TRADE_FLOW = (
    "buy_aggressive_volume sell_aggressive_volume total_traded_volume trade_count buy_count sell_count "
    "avg_trade_size median_trade_size max_trade_size volume_delta delta_ratio buy_sell_ratio trade_vwap"
).split()
BOOK_SPREAD = (
    "spread relative_spread mid_price best_bid_size best_ask_size top_of_book_imbalance microprice microprice_shift"
).split()
BOOK_DEPTH = (
    "bid_depth_top5 bid_depth_top10 bid_depth_top20 ask_depth_top5 ask_depth_top10 ask_depth_top20 "
    "depth_imbalance_top10 depth_slope_bid depth_slope_ask cumul_depth_1bp cumul_depth_5bp cumul_depth_10bp"
).split()
BOOK_CANCEL = (
    "cancelled_bid_vol cancelled_ask_vol bid_cancel_ratio ask_cancel_ratio phantom_bid_vol cancel_asymmetry"
).split()
BOOK_DYNAMICS = (
    "ask_consumption_rate bid_consumption_rate net_consumption price_move_per_unit_flow "
    "seller_absorption_estimate buyer_absorption_estimate absorption_score flow_to_price_divergence "
    "refill_rate_ask refill_rate_bid cancel_rate_ask cancel_rate_bid"
).split() + BOOK_CANCEL
FLOW_RAW = TRADE_FLOW + BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS
FLOW_DERIVED = (
    "cvd_5 cvd_15 delta_acceleration volume_delta_normalized trade_size_skew buy_pressure_pct flow_efficiency "
    "net_flow_efficiency ret_3m break_of_local_high break_of_local_low distance_to_recent_high "
    "distance_to_recent_low trend_5m trend_15m trend_1h vwap_distance_15m vwap_distance_1h vol_state_1h "
    "trend_regime volatility_regime spread_regime activity_regime liquidity_regime current_spread_cost fee_impact "
    "execution_quality_estimate"
).split()
ALL_FEATURES = OHLCV_FEATURES + FLOW_RAW + FLOW_DERIVED
# Categories of the OHLCV features in the catalog; everything else is order flow.
OHLCV_CATEGORY = {
    "returns": "ret_1 ret_5 ret_15 ret_30 ret_60 signed_return_1_volume",
    "momentum": "rsi_14 rsi_divergence macd_hist macd_cross_up macd_cross_down",
    "volatility": "atr_pct bb_pct bb_width realized_vol_5 realized_vol_20",
    "trend": "price_vs_ema_fast price_vs_ema_slow price_vs_ema_trend ema_fast_above_slow ema_full_alignment trend_slope_pct",
    "structure": "vwap_20_distance position_in_range_20 range_compression_20",
    "volume": "volume_ratio volume_spike volume_trend trade_intensity_20",
    "microstructure": "hl_ratio close_position_in_candle body_to_range_ratio",
    "temporal": "hour_sin hour_cos day_of_week_sin day_of_week_cos",
}
CANDLE = "product_id open_time close_time open high low close volume trade_count".split()
