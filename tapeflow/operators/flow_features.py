"""Order-flow features on merged candle + flow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import clip, flag, ratio, yes
from tapeflow.functions.names import BOOK_CANCEL, CANDLE, FLOW_DERIVED, FLOW_RAW, OHLCV_FEATURES
from tapeflow.functions.prefix_rank import above_running_quantile
from tapeflow.functions.series import Ema, Series, number_rows
from tapeflow.operators.ohlcv import MINUTE_SPAN, SERIES, add_ohlcv, complete_rows

FEE_SHARE = 0.0005
# Flow columns that stay null when unknown.
KEEP_NULL = {"spread", "relative_spread", *BOOK_CANCEL}
NEUTRAL = {"buy_sell_ratio": 1.0}
NULLABLE_DERIVED = {
    "spread_regime", "liquidity_regime", "current_spread_cost", "fee_impact", "execution_quality_estimate",
}
NEED_SPREAD_REGIME = {"spread_regime", "execution_quality_estimate"}


def merge_order_flow(candles: DataFrame, flow: DataFrame) -> DataFrame:
    """Left join flow rows and fill gaps with neutral values; the candle's trade count wins."""
    raw = [c for c in FLOW_RAW if c in flow.columns and c not in candles.columns]
    joined = candles.join(flow.select("product_id", "open_time", *raw), ["product_id", "open_time"], "left")
    fills = {}
    for name in raw:
        value = F.col(name).cast("double")
        if name == "microprice":
            value = F.coalesce(value, F.col("close"))
        elif name not in KEEP_NULL:
            value = F.coalesce(value, F.lit(NEUTRAL.get(name, 0.0)))
        fills[name] = value
    return joined.withColumns(fills)


def _trade_derived(df: DataFrame, s: Series) -> DataFrame:
    delta, share = F.col("volume_delta"), F.col("delta_ratio")
    total, move = F.col("total_traded_volume"), F.col("close") - F.col("open")
    return df.withColumns(
        {
            "cvd_5": s.roll(F.sum, delta, 5),
            "cvd_15": s.roll(F.sum, delta, 15),
            "delta_acceleration": F.coalesce(share - s.lag(share, 3), F.lit(0.0)),
            "volume_delta_normalized": ratio(delta, total, 0.0),
            "trade_size_skew": ratio(F.col("avg_trade_size"), F.col("median_trade_size"), 1.0),
            "buy_pressure_pct": ratio(F.col("buy_count"), F.col("trade_count").cast("double"), 0.5),
            "flow_efficiency": ratio(move, total, 0.0),
            "net_flow_efficiency": F.when(F.abs(delta) > 1e-10, move / F.abs(delta)).otherwise(0.0),
        }
    )


def _price_reaction(df: DataFrame, s: Series) -> DataFrame:
    close = F.col("close")
    df = df.withColumns(
        {
            "ret_3m": close / s.lag(close, 3) - 1,
            "_top": s.roll(F.max, F.col("high"), 20),
            "_floor": s.roll(F.min, F.col("low"), 20),
        }
    )
    top, floor = F.col("_top"), F.col("_floor")
    return df.withColumns(
        {
            "break_of_local_high": ratio(close - top, top, 0.0),
            "break_of_local_low": ratio(floor - close, floor, 0.0),
            "distance_to_recent_high": ratio(top - close, close),
            "distance_to_recent_low": F.when(floor.isNotNull(), ratio(close - floor, close)),
        }
    )


def _longer_frames(df: DataFrame, s: Series) -> DataFrame:
    close, volume = F.col("close"), F.col("volume")
    df = s.ema(
        df,
        {"_ema5": Ema.span(close, 5), "_ema15": Ema.span(close, 15), "_ema60": Ema.span(close, 60)},
    )
    df = df.withColumns(
        {
            f"_vwap{n}": ratio(s.roll(F.sum, close * volume, n), s.roll(F.sum, volume, n)) for n in (15, 60)
        }
        | {"_vol_mean": s.roll(F.avg, F.col("realized_vol_5"), 60, 10)}
    )
    vol_ratio = F.coalesce(ratio(F.col("realized_vol_5"), F.col("_vol_mean")), F.when(~yes(F.col("_vol_mean") > 0), 1.0))
    return df.withColumns(
        {
            "trend_5m": ratio(close - F.col("_ema5"), F.col("_ema5")),
            "trend_15m": ratio(close - F.col("_ema15"), F.col("_ema15")),
            "trend_1h": ratio(close - F.col("_ema60"), F.col("_ema60")),
            "vwap_distance_15m": ratio(close - F.col("_vwap15"), F.col("_vwap15")),
            "vwap_distance_1h": ratio(close - F.col("_vwap60"), F.col("_vwap60")),
            "vol_state_1h": F.when(yes(vol_ratio < 0.7), 0.0).when(yes(vol_ratio > 1.4), 2.0).otherwise(1.0),
        }
    )


def _three_way(value: Column, low: Column, high: Column) -> Column:
    return F.when(yes(value < low), 0.0).when(yes(value > high), 2.0).otherwise(1.0)


def _median(s: Series, value: Column, n: int, need: int) -> Column:
    return s.roll(lambda v: F.percentile(v, 0.5), value, n, need)


def _regimes(df: DataFrame, s: Series) -> DataFrame:
    vol, count = F.col("realized_vol_5"), F.col("trade_count").cast("double")
    depth = F.col("bid_depth_top10") + F.col("ask_depth_top10")
    df = df.withColumns(
        {
            "_vol_med": _median(s, vol, 100, 10),
            "_count_med": _median(s, count, 60, 5),
            "_depth_med": _median(s, depth, 60, 5),
        }
    )
    middle = F.col("_depth_med")
    return df.withColumns(
        {
            "trend_regime": F.when(F.col("ema_full_alignment") > 0.5, 1.0)
            .when(yes(F.col("trend_slope_pct") < -1e-4), -1.0)
            .otherwise(0.0),
            "volatility_regime": _three_way(vol, F.col("_vol_med") * 0.7, F.col("_vol_med") * 1.5),
            "activity_regime": _three_way(count, F.col("_count_med") * 0.5, F.col("_count_med") * 1.8),
            "liquidity_regime": F.when(yes(depth > middle * 1.3), 0.0)
            .when(yes(depth < middle * 0.6), 2.0)
            .otherwise(1.0),
        }
    )


def _costs(df: DataFrame) -> DataFrame:
    df = df.withColumns({"current_spread_cost": F.col("relative_spread") / 2.0, "fee_impact": F.lit(FEE_SHARE)})
    quality = (
        1.0
        - F.col("current_spread_cost") / (FEE_SHARE + 1e-9) * 0.4
        - F.col("spread_regime") * 0.3
        - F.col("liquidity_regime") / 2.0 * 0.3
    )
    return df.withColumn("execution_quality_estimate", clip(quality, 0, 1))


# Groups of derived columns, the candle features they read and their builder.
GROUPS = (
    (
        "cvd_5 cvd_15 delta_acceleration volume_delta_normalized trade_size_skew buy_pressure_pct flow_efficiency "
        "net_flow_efficiency",
        "",
        _trade_derived,
    ),
    (
        "ret_3m break_of_local_high break_of_local_low distance_to_recent_high distance_to_recent_low",
        "",
        _price_reaction,
    ),
    ("trend_5m trend_15m trend_1h vwap_distance_15m vwap_distance_1h vol_state_1h", "realized_vol_5", _longer_frames),
    (
        "trend_regime volatility_regime activity_regime liquidity_regime execution_quality_estimate",
        "realized_vol_5 ema_full_alignment trend_slope_pct",
        _regimes,
    ),
)
COSTS = {"current_spread_cost", "fee_impact", "execution_quality_estimate"}


def add_flow(df: DataFrame, s: Series, columns: set[str]) -> DataFrame:
    """Flow features on an opened series that has the candle features and ``spread_regime``."""
    for names, _, build in GROUPS:
        if columns & set(names.split()):
            df = build(df, s)
    if columns & COSTS:
        df = _costs(df if "liquidity_regime" in df.columns else df.withColumn("liquidity_regime", F.lit(None).cast("double")))
    fills = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns if c not in NULLABLE_DERIVED}
    return df.withColumns(fills)


def flow_features(
    candles: DataFrame, flow: DataFrame, span: int = MINUTE_SPAN, drop_incomplete: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Candles + flow rows in, every model feature out (or just ``columns`` of the derived ones)."""
    s = SERIES
    # Flow has at most one row per candle, so positions can be given before the join.
    numbered = merge_order_flow(number_rows(candles, s.keys, "open_time", span), flow)
    derived = [c for c in FLOW_DERIVED if columns is None or c in columns]
    if NEED_SPREAD_REGIME & set(derived):
        numbered = above_running_quantile(
            numbered, list(s.keys), s.row, "relative_spread", 0.75, min_rows=10, fallback=0.001, out="spread_regime"
        )
    elif COSTS & set(derived):
        numbered = numbered.withColumn("spread_regime", F.lit(None).cast("double"))
    base = None
    if columns is not None:
        base = {c for names, reads, _ in GROUPS if set(derived) & set(names.split()) for c in reads.split()}
        base |= set(OHLCV_FEATURES) & set(columns)
    opened = add_ohlcv(s.open(numbered), s, base)
    done = s.close(add_flow(opened, s, set(derived)))
    rest = [c for c in FLOW_RAW + derived if c not in CANDLE]
    candle_features = [c for c in OHLCV_FEATURES if base is None or c in base]
    out = done.select(*candles.columns, *candle_features, *rest)
    return complete_rows(out) if drop_incomplete else out
