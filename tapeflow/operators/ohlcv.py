"""Candle features: one numbered series in, one column per feature out.

Every group of columns takes the frame and its ``Series`` so all windows share
one shuffle and one sort. Unused groups are pruned by the optimizer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import clip, flag, over_nonzero, ratio, yes
from tapeflow.functions.names import OHLCV_FEATURES
from tapeflow.functions.series import BLOCK, PART_ROWS, Ema, Series, number_rows

# Two parts for the exponential means plus the longest chain of row windows.
LOOK_BACK = 2 * PART_ROWS + 256
SERIES = Series(back=LOOK_BACK)
MINUTE_SPAN = 60_000 * 32_768
HOURS_MS = 3_600_000


def returns(df: DataFrame, s: Series, lags: dict[str, int]) -> DataFrame:
    close = F.col("close")
    return df.withColumns({name: close / s.lag(close, n) - 1 for name, n in lags.items()})


def _moves(df: DataFrame, s: Series) -> DataFrame:
    """Per-row inputs of the means: gains, losses, true range, log return."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    prev = s.lag(close)
    step = close - prev
    before = F.coalesce(prev, close)
    return df.withColumns(
        {
            "_gain": F.when(step > 0, step).otherwise(0.0),
            "_loss": F.when(step < 0, -step).otherwise(0.0),
            "_range": F.greatest(high - low, F.abs(high - before), F.abs(low - before)),
            "_log": F.ln(close) - F.ln(prev),
        }
    )


def _means(df: DataFrame, s: Series) -> DataFrame:
    close = F.col("close")
    wilder = 1.0 / 14
    df = s.ema(
        df,
        {
            "_ema9": Ema.span(close, 9),
            "_ema12": Ema.span(close, 12),
            "_ema21": Ema.span(close, 21),
            "_ema26": Ema.span(close, 26),
            "_ema50": Ema.span(close, 50),
            "_avg_gain": Ema(F.col("_gain"), wilder, 14),
            "_avg_loss": Ema(F.col("_loss"), wilder, 14),
            "_atr": Ema(F.col("_range"), wilder, 14),
        },
    )
    # The line is null until the slow mean is shown, so its own mean starts there.
    df = df.withColumn("_macd", F.col("_ema12") - F.col("_ema26"))
    return s.ema(df, {"_macd_mean": Ema.span(F.col("_macd"), 9, first_row=25)})


def _momentum(df: DataFrame, s: Series) -> DataFrame:
    strength = F.col("_avg_gain") / F.col("_avg_loss")
    df = df.withColumn(
        "rsi_14", F.when(F.col("_avg_loss") > 0, 100.0 - 100.0 / (1.0 + strength)).otherwise(50.0)
    )
    close, rsi, row = F.col("close"), F.col("rsi_14"), F.col(s.row)
    five = s.prior(5)
    macd, mean = F.col("_macd"), F.col("_macd_mean")
    was, was_mean = s.lag(macd), s.lag(mean)
    return df.withColumns(
        {
            "rsi_divergence": F.when(row < 5, 0.0)
            .when((close < F.min(close).over(five)) & (rsi > F.min(rsi).over(five)), 1.0)
            .when((close > F.max(close).over(five)) & (rsi < F.max(rsi).over(five)), -1.0)
            .otherwise(0.0),
            "macd_hist": macd - mean,
            "macd_cross_up": flag((macd > mean) & (was <= was_mean)),
            "macd_cross_down": flag((macd < mean) & (was >= was_mean)),
        }
    )


def _volatility(df: DataFrame, s: Series) -> DataFrame:
    close, log = F.col("close"), F.col("_log")
    df = df.withColumns(
        {
            "_mid": s.roll(F.avg, close, 20),
            "_sd": s.roll(F.stddev_samp, close, 20),
            "realized_vol_5": s.roll(F.stddev_samp, log, 5),
            "realized_vol_20": s.roll(F.stddev_samp, log, 20),
            "atr_pct": ratio(F.col("_atr"), close),
        }
    )
    lower, band = F.col("_mid") - 2.0 * F.col("_sd"), 4.0 * F.col("_sd")
    return df.withColumns(
        {
            "bb_pct": clip(ratio(close - lower, band), 0, 1),
            "bb_width": over_nonzero(band, F.col("_mid")),
        }
    )


def _trend(df: DataFrame, s: Series) -> DataFrame:
    close = F.col("close")
    fast, slow, trend = F.col("_ema9"), F.col("_ema21"), F.col("_ema50")
    return df.withColumns(
        {
            "price_vs_ema_fast": over_nonzero(close, fast) - 1.0,
            "price_vs_ema_slow": over_nonzero(close, slow) - 1.0,
            "price_vs_ema_trend": over_nonzero(close, trend) - 1.0,
            "ema_fast_above_slow": flag(fast > slow),
            "ema_full_alignment": flag((fast > slow) & (slow > trend)),
            "trend_slope_pct": slope_share(s, close, 20),
        }
    )


def slope_share(s: Series, value: Column, n: int) -> Column:
    """Least-squares slope over n rows as a share of their mean; mean 0 gives 0."""
    frame = s.rows(n)
    # Positions relative to the block keep the sums of squares small.
    position = (F.col(s.row) - F.col(BLOCK) * s.block_rows).cast("double")
    slope = F.regr_slope(value, position).over(frame)
    mean = F.avg(value).over(frame)
    full = F.count(value).over(frame) >= n
    return F.when(full, F.when(mean != 0, slope / mean).otherwise(0.0))


def _structure(df: DataFrame, s: Series) -> DataFrame:
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    count = F.col("trade_count").cast("double")
    stand_in = F.when(close > 0, F.abs(close - F.col("open")) / close * 10_000.0).otherwise(1.0)
    df = df.withColumns(
        {
            "_sum_cv": s.roll(F.sum, close * volume, 20),
            "_sum_v": s.roll(F.sum, volume, 20),
            "_high_20": s.roll(F.max, high, 20),
            "_low_20": s.roll(F.min, low, 20),
            "_avg_range": s.roll(F.avg, high - low, 20),
            "_avg_v": s.roll(F.avg, volume, 20),
            "_sum_n": s.roll(
                F.sum, F.greatest(F.when(yes(count > 0), count).otherwise(stand_in), F.lit(1.0)), 20
            ),
            "volume_trend": slope_share(s, volume, 10),
        }
    )
    vwap = ratio(F.col("_sum_cv"), F.col("_sum_v"))
    span = F.col("_high_20") - F.col("_low_20")
    return df.withColumns(
        {
            "signed_return_1_volume": F.col("ret_1") * F.log1p(volume),
            "vwap_20_distance": ratio(close - vwap, vwap),
            "position_in_range_20": clip(ratio(close - F.col("_low_20"), span), 0, 1),
            "range_compression_20": ratio(high - low, F.col("_avg_range")),
            "volume_ratio": ratio(volume, F.col("_avg_v")),
            "trade_intensity_20": ratio(F.col("_sum_n"), F.col("_sum_v")),
        }
    ).withColumn("volume_spike", flag(F.col("volume_ratio") > 2.0))


def shape_and_calendar(df: DataFrame) -> DataFrame:
    """Columns of a single row: candle shape and UTC clock (Monday = 0)."""
    close, high, low, open_ = (F.col(c) for c in ("close", "high", "low", "open"))
    span = high - low
    hour = F.pmod(F.floor(F.col("open_time") / HOURS_MS), F.lit(24)) / 24.0 * (2 * math.pi)
    day = F.pmod(F.floor(F.col("open_time") / (24 * HOURS_MS)) + 3, F.lit(7)) / 7.0 * (2 * math.pi)
    return df.withColumns(
        {
            "hl_ratio": ratio(span, close),
            "close_position_in_candle": clip(ratio(close - low, span), 0, 1),
            "body_to_range_ratio": ratio(F.abs(close - open_), span),
            "hour_sin": F.sin(hour),
            "hour_cos": F.cos(hour),
            "day_of_week_sin": F.sin(day),
            "day_of_week_cos": F.cos(day),
        }
    )


MOMENTUM = set("rsi_14 rsi_divergence macd_hist macd_cross_up macd_cross_down".split())
VOLATILITY = set("atr_pct bb_pct bb_width realized_vol_5 realized_vol_20".split())
TREND = {c for c in OHLCV_FEATURES if "ema" in c} | {"trend_slope_pct"}
LAGS = {"ret_1": 1, "ret_5": 5, "ret_15": 15, "ret_30": 30, "ret_60": 60}


def add_ohlcv(df: DataFrame, s: Series, columns: set[str] | None = None) -> DataFrame:
    """Candle features on an opened series; helper columns start with '_'.

    With ``columns`` only the groups holding them are built, which keeps the
    plan of a narrow request small.
    """
    want = set(OHLCV_FEATURES) if columns is None else set(columns)
    df = _moves(df, s)
    if want & (MOMENTUM | TREND | {"atr_pct"}):
        df = _means(df, s)
    if want & MOMENTUM:
        df = _momentum(df, s)
    if want & VOLATILITY:
        df = _volatility(df, s) if "_atr" in df.columns else _volatility(df.withColumn("_atr", F.lit(None).cast("double")), s)
    if want & TREND:
        df = _trend(df, s)
    df = returns(df, s, LAGS)
    df = _structure(df, s)
    return shape_and_calendar(df)


def ohlcv_features(
    candles: DataFrame, span: int = MINUTE_SPAN, drop_incomplete: bool = True, columns: list[str] | None = None
) -> DataFrame:
    """Candle columns + the candle features. Rows with a null feature go unless kept on request."""
    s = SERIES
    numbered = number_rows(candles, s.keys, "open_time", span)
    names = [c for c in OHLCV_FEATURES if columns is None or c in columns]
    built = add_ohlcv(s.open(numbered), s, None if columns is None else set(columns))
    done = s.close(built).select(*candles.columns, *names)
    return complete_rows(done) if drop_incomplete else done


def complete_rows(features: DataFrame) -> DataFrame:
    """Drop rows where a candle feature is null; flow columns may stay null."""
    return features.dropna(subset=list(OHLCV_FEATURES))
