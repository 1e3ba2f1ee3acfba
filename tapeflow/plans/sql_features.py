"""Check SQL of the feature views."""

from __future__ import annotations

from tapeflow.plans.views import SQL_VIEWS

W = "(PARTITION BY product_id ORDER BY open_time)"


def rows(n: int) -> str:
    return f"(PARTITION BY product_id ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, x: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {need or n} THEN {fn}({x}) OVER {rows(n)} END"


def ema(lst: str, alpha: float, ready: int) -> str:
    a = repr(float(alpha))
    return (
        f"CASE WHEN row_idx >= {ready} THEN list_reduce({lst}, lambda s, v: s * (1e0 - {a}::DOUBLE) + v * {a}::DOUBLE) END"
    )


def span(lst: str, n: int, first: int = 0) -> str:
    return ema(lst, 2 / (n + 1), first + n - 1)


def med(x: str, n: int, need: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {need} THEN quantile_cont({x}, 0.5) OVER {rows(n)} END"


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE) END"


def pos(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END"


def flag(cond: str) -> str:
    return f"CASE WHEN coalesce({cond}, false) THEN 1e0 ELSE 0e0 END"


def slope(x: str, n: int) -> str:
    return (
        f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN CASE WHEN avg({x}) OVER {rows(n)} <> 0 "
        f"THEN regr_slope({x}, row_idx::DOUBLE) OVER {rows(n)} / avg({x}) OVER {rows(n)} ELSE 0e0 END END"
    )


def ohlcv_views(source: str, p: str) -> None:
    """Register views <p>a .. <p> computing all candle features of ``source``."""
    v = SQL_VIEWS
    v[f"{p}a"] = (
        f"""SELECT *, close - lag(close) OVER {W} AS step, coalesce(lag(close) OVER {W}, close) AS before,
              ln(close) - ln(lag(close) OVER {W}) AS lg FROM {source}""",
        (source,),
    )
    v[f"{p}b"] = (
        f"""SELECT *, list(close) OVER {W} AS lc,
              list(CASE WHEN step > 0 THEN step ELSE 0e0 END) OVER {W} AS lgain,
              list(CASE WHEN step < 0 THEN -step ELSE 0e0 END) OVER {W} AS lloss,
              list(greatest(high - low, abs(high - before), abs(low - before))) OVER {W} AS lrange FROM {p}a""",
        (f"{p}a",),
    )
    emas = {f"e{n}": span("lc", n) for n in (5, 9, 12, 15, 21, 26, 50, 60)}
    emas |= {"again": ema("lgain", 1 / 14, 13), "aloss": ema("lloss", 1 / 14, 13), "atr": ema("lrange", 1 / 14, 13)}
    v[f"{p}c"] = (
        f"""SELECT * EXCLUDE (lc, lgain, lloss, lrange), {', '.join(f'{e} AS {n}' for n, e in emas.items())} FROM {p}b""",
        (f"{p}b",),
    )
    v[f"{p}d"] = (
        f"""SELECT *, e12 - e26 AS macd, list(e12 - e26) FILTER (WHERE e26 IS NOT NULL) OVER {W} AS lmacd,
              CASE WHEN aloss > 0 THEN 100e0 - 100e0 / (1e0 + again / aloss) ELSE 50e0 END AS rsi_14 FROM {p}c""",
        (f"{p}c",),
    )
    v[f"{p}e"] = (f"SELECT * EXCLUDE (lmacd), {span('lmacd', 9, 25)} AS macd_mean FROM {p}d", (f"{p}d",))
    five = "(PARTITION BY product_id ORDER BY open_time ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    count = "CASE WHEN trade_count > 0 THEN trade_count::DOUBLE WHEN close > 0 THEN abs(close - open) / close * 10000e0 ELSE 1e0 END"
    f = {f"ret_{n}": f"close / lag(close, {n}) OVER {W} - 1" for n in (1, 5, 15, 30, 60)}
    f |= {
        "rsi_divergence": f"""CASE WHEN row_idx < 5 THEN 0e0
             WHEN close < min(close) OVER {five} AND rsi_14 > min(rsi_14) OVER {five} THEN 1e0
             WHEN close > max(close) OVER {five} AND rsi_14 < max(rsi_14) OVER {five} THEN -1e0 ELSE 0e0 END""",
        "macd_hist": "macd - macd_mean",
        "macd_cross_up": flag(f"macd > macd_mean AND lag(macd) OVER {W} <= lag(macd_mean) OVER {W}"),
        "macd_cross_down": flag(f"macd < macd_mean AND lag(macd) OVER {W} >= lag(macd_mean) OVER {W}"),
        "atr_pct": pos("atr", "close"),
        "mid20": full("avg", "close", 20),
        "sd20": full("stddev_samp", "close", 20),
        "realized_vol_5": full("stddev_samp", "lg", 5),
        "realized_vol_20": full("stddev_samp", "lg", 20),
        "price_vs_ema_fast": "close / e9 - 1",
        "price_vs_ema_slow": "close / e21 - 1",
        "price_vs_ema_trend": "close / e50 - 1",
        "ema_fast_above_slow": flag("e9 > e21"),
        "ema_full_alignment": flag("e9 > e21 AND e21 > e50"),
        "trend_slope_pct": slope("close", 20),
        "sum_cv": full("sum", "close * volume", 20),
        "sum_v": full("sum", "volume", 20),
        "hi20": full("max", "high", 20),
        "lo20": full("min", "low", 20),
        "avg_range": full("avg", "high - low", 20),
        "avg_v": full("avg", "volume", 20),
        "sum_n": full("sum", f"greatest({count}, 1e0)", 20),
        "volume_trend": slope("volume", 10),
    }
    v[f"{p}f"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in f.items())} FROM {p}e", (f"{p}e",))
    hour, day = "((open_time // 3600000) % 24) / 24e0 * 2e0 * pi()", "((open_time // 86400000 + 3) % 7) / 7e0 * 2e0 * pi()"
    g = {
        "bb_pct": clip(pos("close - (mid20 - 2e0 * sd20)", "4e0 * sd20"), 0, 1),
        "bb_width": "4e0 * sd20 / nullif(mid20, 0)",
        "signed_return_1_volume": "ret_1 * ln(1e0 + volume)",
        "vwap_20_distance": pos(f"close - {pos('sum_cv', 'sum_v')}", pos("sum_cv", "sum_v")),
        "position_in_range_20": clip(pos("close - lo20", "hi20 - lo20"), 0, 1),
        "range_compression_20": pos("high - low", "avg_range"),
        "volume_ratio": pos("volume", "avg_v"),
        "volume_spike": flag(f"({pos('volume', 'avg_v')}) > 2"),
        "trade_intensity_20": pos("sum_n", "sum_v"),
        "hl_ratio": pos("high - low", "close"),
        "close_position_in_candle": clip(pos("close - low", "high - low"), 0, 1),
        "body_to_range_ratio": pos("abs(close - open)", "high - low"),
        "hour_sin": f"sin({hour})",
        "hour_cos": f"cos({hour})",
        "day_of_week_sin": f"sin({day})",
        "day_of_week_cos": f"cos({day})",
    }
    v[p] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in g.items())} FROM {p}f", (f"{p}f",))


ohlcv_views("numbered", "ohlcv")

# ---- trade flow
def _flow_sql(window: str, no_sells: str, nothing: str) -> str:
    return f"""
    SELECT *, CASE WHEN total_traded_volume > 0 THEN volume_delta / total_traded_volume ELSE 0e0 END AS delta_ratio,
      least(CASE WHEN sell_aggressive_volume > 0 THEN buy_aggressive_volume / sell_aggressive_volume
        WHEN buy_aggressive_volume > 0 THEN {no_sells} ELSE {nothing} END, 10e0) AS buy_sell_ratio,
      notional / total_traded_volume AS trade_vwap
    FROM (SELECT product_id, {window} AS open_time,
        coalesce(sum(size) FILTER (side = 'BUY'), 0e0) AS buy_aggressive_volume,
        coalesce(sum(size) FILTER (side <> 'BUY'), 0e0) AS sell_aggressive_volume,
        sum(size) AS total_traded_volume, count(*) AS trade_count,
        count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side <> 'BUY') AS sell_count,
        avg(size) AS avg_trade_size, quantile_cont(size, 0.5) AS median_trade_size, max(size) AS max_trade_size,
        coalesce(sum(size) FILTER (side = 'BUY'), 0e0) - coalesce(sum(size) FILTER (side <> 'BUY'), 0e0) AS volume_delta,
        sum(price * size) AS notional
      FROM arrived GROUP BY ALL)
    """


SQL_VIEWS["live_flow"] = (_flow_sql("coalesce(current, bucket)", "10e0", "1e0"), ("arrived",))
SQL_VIEWS["minute_flow"] = (_flow_sql("bucket", "0e0", "0e0"), ("arrived",))

# ---- kline proxy
SQL_VIEWS["kl"] = (
    """SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY open_time) - 1 AS row_idx,
         coalesce(buy_quote / nullif(buy_base, 0), close) AS buy_vwap,
         coalesce(sell_quote / nullif(sell_base, 0), close) AS sell_vwap
       FROM (SELECT *, open_time_us // 1000 AS open_time, greatest(volume - taker_buy_base_vol, 0e0) AS sell_base,
           greatest(quote_volume - taker_buy_quote_vol, 0e0) AS sell_quote, greatest(taker_buy_base_vol, 0e0) AS buy_base,
           greatest(taker_buy_quote_vol, 0e0) AS buy_quote FROM klines)""",
    ("klines",),
)
_k1 = {
    "mid_price": "(high + low) / 2e0",
    "spread": "greatest(buy_vwap - sell_vwap, 0e0)",
    "relative_spread": "coalesce(greatest(buy_vwap - sell_vwap, 0e0) / nullif((high + low) / 2e0, 0), 0e0)",
    "best_bid_size": "sell_base / greatest(trade_count, 1)",
    "best_ask_size": "buy_base / greatest(trade_count, 1)",
    "top_of_book_imbalance": "coalesce((sell_base - buy_base) / nullif(volume, 0), 0e0)",
    "microprice": "coalesce((sell_base * buy_vwap + buy_base * sell_vwap) / nullif(volume, 0), (high + low) / 2e0)",
} | {f"{s}_depth_top{n}": f"sum({c}) OVER {rows(n)}" for s, c in (("bid", "sell_base"), ("ask", "buy_base")) for n in (5, 10, 20)} | {
    "cumul_depth_1bp": f"sum(volume) OVER {rows(3)} * 0.05e0",
    "cumul_depth_5bp": f"sum(volume) OVER {rows(5)} * 0.20e0",
    "cumul_depth_10bp": f"sum(volume) OVER {rows(10)} * 0.40e0",
    "prev_v": f"coalesce(lag(volume) OVER {W}, volume)",
    "prev_b": f"coalesce(lag(buy_base) OVER {W}, buy_base)",
    "prev_s": f"coalesce(lag(sell_base) OVER {W}, sell_base)",
}
SQL_VIEWS["kl1"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _k1.items())} FROM kl", ("kl",))


def _z(num: str, den: str) -> str:
    return f"coalesce(({num}) / nullif({den}, 0), 0e0)"


_k2 = {
    "microprice_shift": "microprice - mid_price",
    "depth_imbalance_top10": _z("bid_depth_top10 - ask_depth_top10", "bid_depth_top10 + ask_depth_top10"),
    "depth_slope_bid": f"least({_z('bid_depth_top5', 'bid_depth_top20')}, 2e0)",
    "depth_slope_ask": f"least({_z('ask_depth_top5', 'ask_depth_top20')}, 2e0)",
    "ask_consumption_rate": f"least({_z('buy_base', 'ask_depth_top10')}, 1e0)",
    "bid_consumption_rate": f"least({_z('sell_base', 'bid_depth_top10')}, 1e0)",
    "net_consumption": f"least({_z('buy_base', 'ask_depth_top10')}, 1e0) - least({_z('sell_base', 'bid_depth_top10')}, 1e0)",
    "price_move_per_unit_flow": _z("close - open", "volume"),
    "seller_absorption_estimate": clip("1e0 - abs(close - open) / greatest(spread * volume, 1e-12)", 0, 1),
    "buyer_absorption_estimate": clip("1e0 - abs(close - open) / greatest(spread * volume, 1e-12)", 0, 1),
    "absorption_score": clip("1e0 - abs(close - open) / greatest(spread * volume, 1e-12)", 0, 1),
    "flow_to_price_divergence": clip(
        f"{_z('buy_base - sell_base', 'volume')} - {clip(_z('close - open', 'spread'), -1, 1)}", -2, 2
    ),
    "refill_rate_ask": f"least({_z('buy_base', 'prev_v')}, 2e0)",
    "refill_rate_bid": f"least({_z('sell_base', 'prev_v')}, 2e0)",
    "cancel_rate_ask": _z("greatest(prev_b - buy_base, 0e0)", "prev_b"),
    "cancel_rate_bid": _z("greatest(prev_s - sell_base, 0e0)", "prev_s"),
}
SQL_VIEWS["proxy"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _k2.items())} FROM kl1", ("kl1",))

# ---- merged flow (proxy rows + real trade columns) and flow features
from tapeflow.functions.names import BOOK_CANCEL, BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD, TRADE_FLOW  # noqa: E402

_PROXY_SQL = ", ".join(f"coalesce(p.{c}, 0e0) AS {c}" if c not in BOOK_CANCEL else f"0e0 AS {c}" for c in BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS)
SQL_VIEWS["flow_raw"] = (
    f"""SELECT coalesce(p.product_id, m.product_id) AS product_id, coalesce(p.open_time, m.open_time) AS open_time,
          {', '.join(f'coalesce(m.{c}, 0)::DOUBLE AS {c}' for c in TRADE_FLOW)}, {_PROXY_SQL}
        FROM proxy p FULL JOIN minute_flow m ON p.product_id = m.product_id AND p.open_time = m.open_time""",
    ("proxy", "minute_flow"),
)
_MERGED = [c for c in TRADE_FLOW + BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS if c != "trade_count"]


def _fill(c: str) -> str:
    if c in ("spread", "relative_spread", *BOOK_CANCEL):
        return f"r.{c}"
    return f"coalesce(r.{c}, {'c.close' if c == 'microprice' else '1e0' if c == 'buy_sell_ratio' else '0e0'}) AS {c}"


def _merged_sql(right: str) -> str:
    return f"SELECT c.*, {', '.join(_fill(c) for c in _MERGED)} FROM numbered c LEFT JOIN {right} r USING (product_id, open_time)"


SQL_VIEWS["flow_some"] = ("SELECT * FROM flow_raw WHERE (open_time // 3600000) % 9 <> 0", ("flow_raw",))
SQL_VIEWS["merged_some"] = (_merged_sql("flow_some"), ("numbered", "flow_some"))
SQL_VIEWS["merged"] = (_merged_sql("flow_raw"), ("numbered", "flow_raw"))
ohlcv_views("merged", "mo")
_f1 = {
    "cvd_5": f"coalesce({full('sum', 'volume_delta', 5)}, 0e0)",
    "cvd_15": f"coalesce({full('sum', 'volume_delta', 15)}, 0e0)",
    "delta_acceleration": f"coalesce(delta_ratio - lag(delta_ratio, 3) OVER {W}, 0e0)",
    "volume_delta_normalized": f"coalesce({pos('volume_delta', 'total_traded_volume')}, 0e0)",
    "trade_size_skew": f"coalesce({pos('avg_trade_size', 'median_trade_size')}, 1e0)",
    "buy_pressure_pct": f"coalesce({pos('buy_count', 'trade_count')}, 0.5e0)",
    "flow_efficiency": f"coalesce({pos('close - open', 'total_traded_volume')}, 0e0)",
    "net_flow_efficiency": "CASE WHEN abs(volume_delta) > 1e-10 THEN (close - open) / abs(volume_delta) ELSE 0e0 END",
    "ret_3m": f"coalesce(close / lag(close, 3) OVER {W} - 1, 0e0)",
    "break_of_local_high": "coalesce((close - hi20) / hi20, 0e0)",
    "break_of_local_low": "coalesce((lo20 - close) / lo20, 0e0)",
    "distance_to_recent_high": "coalesce((hi20 - close) / close, 0e0)",
    "distance_to_recent_low": "coalesce((close - lo20) / close, 0e0)",
    "trend_5m": "coalesce((close - e5) / e5, 0e0)",
    "trend_15m": "coalesce((close - e15) / e15, 0e0)",
    "trend_1h": "coalesce((close - e60) / e60, 0e0)",
    "vw15": f"{full('sum', 'close * volume', 15)} / nullif({full('sum', 'volume', 15)}, 0)",
    "vw60": f"{full('sum', 'close * volume', 60)} / nullif({full('sum', 'volume', 60)}, 0)",
    "vol_mean": full("avg", "realized_vol_5", 60, 10),
    "vol_med": med("realized_vol_5", 100, 10),
    "count_med": med("trade_count::DOUBLE", 60, 5),
    "depth_med": med("(bid_depth_top10 + ask_depth_top10)", 60, 5),
    "spread_cut": f"""coalesce(CASE WHEN count(relative_spread) OVER {W} >= 10
        THEN quantile_cont(relative_spread, 0.75) OVER {W} END, 0.001e0)""",
}
SQL_VIEWS["ff1"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _f1.items())} FROM mo", ("mo",))


def _three(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN coalesce({x} < {lo}, false) THEN 0e0 WHEN coalesce({x} > {hi}, false) THEN 2e0 ELSE 1e0 END"


_f2 = {
    "vwap_distance_15m": "coalesce((close - vw15) / vw15, 0e0)",
    "vwap_distance_1h": "coalesce((close - vw60) / vw60, 0e0)",
    "vol_state_1h": _three(
        "(CASE WHEN vol_mean > 0 THEN realized_vol_5 / vol_mean ELSE 1e0 END)", "0.7e0", "1.4e0"
    ),
    "trend_regime": "CASE WHEN ema_full_alignment > 0.5 THEN 1e0 WHEN coalesce(trend_slope_pct < -1e-4, false) THEN -1e0 ELSE 0e0 END",
    "volatility_regime": _three("realized_vol_5", "vol_med * 0.7e0", "vol_med * 1.5e0"),
    "spread_regime": flag("relative_spread > spread_cut"),
    "activity_regime": _three("trade_count", "count_med * 0.5e0", "count_med * 1.8e0"),
    "liquidity_regime": """CASE WHEN coalesce(bid_depth_top10 + ask_depth_top10 > depth_med * 1.3e0, false) THEN 0e0
        WHEN coalesce(bid_depth_top10 + ask_depth_top10 < depth_med * 0.6e0, false) THEN 2e0 ELSE 1e0 END""",
    "current_spread_cost": "relative_spread / 2e0",
    "fee_impact": "0.0005e0",
}
SQL_VIEWS["ff2"] = (f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in _f2.items())} FROM ff1", ("ff1",))
SQL_VIEWS["flow_features"] = (
    "SELECT *, "
    + clip("1e0 - current_spread_cost / (0.0005e0 + 1e-9) * 0.4e0 - spread_regime * 0.3e0 - liquidity_regime / 2e0 * 0.3e0", 0, 1)
    + " AS execution_quality_estimate FROM ff2",
    ("ff2",),
)
