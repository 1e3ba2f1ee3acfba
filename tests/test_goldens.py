"""Small inputs with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import candles as C
from tapeflow.operators import labels as L
from tapeflow.operators import ledger as P
from tapeflow.operators import model_tables as R
from tapeflow.operators import monitors as D
from tapeflow.operators import risk as K
from tapeflow.operators import screen as S
from tapeflow.operators import selection as N
from tapeflow.operators import thresholds as Q
from tapeflow.operators.flow_features import merge_order_flow
from tapeflow.operators.ohlcv import ohlcv_features
from tapeflow.sources import candles as I
from tapeflow.sources import feed as M
from tapeflow.sources import store as H


def trades(spark, rows):
    df = pd.DataFrame(rows, columns=["product_id", "price", "size", "ts_ms"])
    return spark.createDataFrame(df.assign(arrival_seq=range(len(df)), side="BUY", trade_id="t"))


def test_late_trade_is_ignored(spark):
    df = trades(spark, [("A-USD", 10.0, 1.0, 60_000), ("A-USD", 11.0, 1.0, 120_000), ("A-USD", 99.0, 5.0, 61_000)])
    rows = C.build_candles(df).orderBy("open_time").collect()
    assert [(r.open_time, r.high, r.volume) for r in rows] == [(60_000, 10.0, 1.0), (120_000, 11.0, 1.0)]


def test_force_close_uses_the_later_time(spark):
    row = C.force_close(C.build_candles(trades(spark, [("A-USD", 10.0, 1.0, 120_500)])), 130_000).first()
    assert (row.open_time, row.close_time, row.is_closed) == (120_000, 130_000, True)


def test_purged_split(spark):
    end, start = L.purged_bounds(F.lit(1_000).cast("bigint"), 15)
    assert tuple(spark.range(1).select(end, start).first()) == (835, 850)


def test_threshold_fallback_keeps_real_support(spark):
    # 20 rows: 8 at 0.8 with rising prices, the rest low; support 30 cannot be met.
    rows = [("A", 0.8, 1, 0.01)] * 8 + [("A", 0.2, 0, -0.01)] * 12
    out = Q.optimize_thresholds(spark.createDataFrame(rows, "product_id string, prob double, target int, target_return double")).first()
    assert (out.buy_threshold, out.buy_support, out.buy_precision, out.entry_ready) == (0.62, 8, 1.0, False)


def test_drift_blocks_with_five_of_eight_outliers(spark):
    names = [f"f{i}" for i in range(1, 9)]
    ramp = spark.createDataFrame(pd.DataFrame({n: np.linspace(0, 1, 100) for n in names}).assign(product_id="A", row_idx=range(100)))
    bounds = D.drift_bounds(ramp, names)
    probe = spark.createDataFrame([("A", 0, *([5.0] * 5 + [0.5] * 3))], "product_id string, row_idx int, " + ", ".join(f"{n} double" for n in names))
    row = D.drift_evaluate(probe, ["product_id", "row_idx"], names, bounds).first()
    assert (row.outlier_count, row.drift_actionable, row.drift_reason) == (5, False, "drift_blocked_out_of_distribution")


def test_extreme_regime_blocks(spark):
    ramp = spark.createDataFrame(
        pd.DataFrame({"product_id": "A", "realized_vol_5": np.linspace(0.001, 0.01, 120), "bb_width": np.linspace(0.01, 0.1, 120), "range_compression_20": np.linspace(0.5, 1.5, 120)})
    )
    probe = spark.createDataFrame([("A", 0.05, 0.05, 1.0)], "product_id string, realized_vol_5 double, bb_width double, range_compression_20 double")
    row = D.regime_evaluate(probe, D.regime_limits(ramp)).first()
    assert (row.regime, row.regime_actionable) == ("extreme_volatility", False)


def test_sequence_gap_of_two(spark):
    rows = [("c", 1, 199, False), ("c", 2, 200, False), ("c", 3, 203, False), ("c", 4, 150, False), ("c", 5, 10, True), ("c", 6, 11, False)]
    gaps = M.sequence_gaps(spark.createDataFrame(rows, "connection_key string, arrival_seq long, sequence_num long, is_snapshot boolean"), 2)
    assert [(g.last_sequence, g.sequence_num, g.gap_size) for g in gaps.collect()] == [(200, 203, 2)]


def candle(spark, times, product="A-USD"):
    return spark.createDataFrame(
        [(product, t, t + 59_999, 1.0, 1.0, 1.0, 1.0, 1.0, 1) for t in times],
        "product_id string, open_time long, close_time long, open double, high double, low double, close double, volume double, trade_count long",
    )


def test_reconcile_adds_only_newer_closed_candles(spark):
    out = C.reconcile(candle(spark, [120_000, 180_000]), candle(spark, [120_000, 180_000, 240_000, 300_000]), 300_500)
    assert [r.open_time for r in out.where("reconciled").collect()] == [240_000]


def test_upsert_keeps_latest_close(spark):
    old = candle(spark, [60_000]).withColumn("close", F.lit(10.5))
    new = candle(spark, [60_000, 120_000]).withColumn("close", F.lit(11.2))
    rows = {r.open_time: (r.close, r.base_asset) for r in H.upsert(old, new).collect()}
    assert rows == {60_000: (11.2, "A"), 120_000: (11.2, "A")}


def ledger(spark, closes, signals, **cfg):
    candles = spark.createDataFrame(
        [("r", p, t, t, c) for p, t, c in closes], "run string, product_id string, open_time long, close_time long, close double"
    )
    asks = spark.createDataFrame(
        [("r", p, t, i, s, 0.9, ok, "m") for i, (p, t, s, ok) in enumerate(signals)],
        "run string, product_id string, ts_ms long, event_seq long, signal string, prob_buy double, actionable boolean, model_id string",
    )
    fills, state = P.position_ledger(P.ledger_events(candles, asks), P.LedgerConfig(**cfg), slice_ms=60_000, max_rows=3)
    return fills.orderBy("ts_ms", "event_seq").collect(), state


def test_round_trip_profit(spark):
    fills, _ = ledger(
        spark, [("A-USD", 1_000, 100.0), ("A-USD", 200_000, 110.0)], [("A-USD", 2_000, "BUY", True), ("A-USD", 210_000, "EXIT_LONG", True)],
        notional=100.0, fee_pct=0.0, take_profit_pct=50.0,
    )
    assert [f.decision for f in fills] == ["paper_buy_filled", "paper_exit_signal_filled"]
    assert fills[1].realized_pnl == pytest.approx(10.0)


def test_slippage_per_base(spark):
    fills, _ = ledger(spark, [("A-USD", 1_000, 10.0)], [("A-USD", 2_000, "BUY", True)], slippage_by_base={"A": 2.0})
    assert fills[0].fill_price == pytest.approx(10.2)


def test_exit_rules_and_blocks(spark):
    fills, state = ledger(
        spark,
        [("A-USD", 1_000, 100.0), ("A-USD", 300_000, 98.0), ("B-USD", 1_000, 10.0), ("B-USD", 3_700_000, 10.0)],
        [("A-USD", 2_000, "BUY", True), ("A-USD", 3_000, "BUY", True), ("A-USD", 4_000, "BUY", False), ("B-USD", 2_000, "BUY", True), ("C-USD", 5, "BUY", True)],
    )
    got = {(f.product_id, f.decision, f.reason) for f in fills}
    assert got == {
        ("A-USD", "paper_buy_filled", ""), ("A-USD", "blocked_existing_position", ""), ("A-USD", "ignored_non_actionable", ""),
        ("A-USD", "paper_exit_rule_filled", "stop_loss_hit"), ("B-USD", "paper_buy_filled", ""), ("B-USD", "paper_exit_rule_filled", "max_hold_hit"),
        ("C-USD", "blocked_no_market_price", ""),
    }
    assert state.where("open").count() == 0


def test_caution_profile(spark):
    cfg = K.RiskConfig(min_prob=0.63)
    exits = spark.createDataFrame(
        [("A", 1_000_000, "signal_exit_long", -0.2, 5.0, 1), ("A", 1_100_000, "max_hold_hit", -0.2, 5.0, 2)],
        "product_id string, ts_ms long, reason string, pnl_pct double, holding_minutes double, event_id long",
    )
    ask = spark.createDataFrame([("A", 1_200_000, 7), ("A", 9_200_000, 8)], "product_id string, ts_ms long, event_id long")
    rows = {r.event_id: r for r in K.chop_at(ask, exits, cfg).collect()}
    assert rows[7].chop_min_prob == pytest.approx(0.66) and rows[7].chop_notional_scale == 0.6 and not rows[7].chop_blocked
    assert rows[8].adverse_count == 0 and rows[8].chop_min_prob == 0.63


def test_two_stops_block_for_45_minutes(spark):
    exits = spark.createDataFrame(
        [("A", 0, "stop_loss_hit", -1.0, 90.0, 1), ("A", 60_000, "stop_loss_hit", -1.0, 90.0, 2)],
        "product_id string, ts_ms long, reason string, pnl_pct double, holding_minutes double, event_id long",
    )
    ask = spark.createDataFrame([("A", 120_000, 7), ("A", 60_000 + 2_700_000, 8)], "product_id string, ts_ms long, event_id long")
    rows = {r.event_id: r.chop_blocked for r in K.chop_at(ask, exits).collect()}
    assert rows == {7: True, 8: False}


def test_scaled_sizing_reason(spark):
    df = spark.createDataFrame([(0.99, 0.5, 10_000.0, 10_000.0)], "prob_buy double, buy_threshold double, capital_total double, capital_available double")
    sized = K.kelly_size(df)
    assert sized.first().notional_usd == 50.0
    row = K.scale_size(sized, F.lit(0.6), "chop_caution").first()
    assert (row.notional_usd, row.sizing_reason) == (30.0, "kelly_fractional_dynamic|chop_caution_0.60")


def test_screen_tiers(spark):
    cols = "base_asset string, product_id string, status string, quote_volume_24h double, listing_age_days int, spread_pct double, candle_coverage_pct double, daily_realized_vol_pct double"
    df = spark.createDataFrame(
        [("A", "A-USD", "online", 9e6, 400, 0.0005, 1.0, 1.0), ("B", "B-USD", "online", 1e5, 10, 0.01, 0.2, 1.0)], cols
    )
    out = {r.product_id: r for r in S.screen(df.drop("candle_coverage_pct", "daily_realized_vol_pct"), df, df.select("product_id", "candle_coverage_pct", "daily_realized_vol_pct")).collect()}
    assert out["A-USD"].tier == "train_now" and out["A-USD"].reasons == ["ok"]
    assert out["B-USD"].tier == "skip" and out["B-USD"].reasons == ["low_quote_volume_24h", "wide_spread", "recent_listing", "low_candle_coverage"]


def test_correlation_filter_drops_the_less_important(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + rng.normal(0, 0.01, 400)}))
    assert N.correlation_filter(N.correlations(df, ["a", "b", "c"]), ["a", "b", "c"], {"a": 0.1, "b": 0.5, "c": 0.4}) == (["b", "c"], ["a"])


def test_incomplete_manifest_raises(spark):
    rec = spark.createDataFrame([("a1_usd", 1, 0.6, True)], "registry_key string, model_seq long, auc_val double, promoted boolean")
    bases = spark.createDataFrame([("A1",), ("A2",)], "base string")
    with pytest.raises(ValueError, match="A2"):
        R.require_complete(R.universe_manifest(bases, rec))


def test_bad_inputs_raise(spark):
    with pytest.raises(ValueError):
        L.label_net_return(candle(spark, [0]), 5, 0.0, 0.05)
    with pytest.raises(ValueError):
        I.read_candles_file(spark, "x.txt")
    with pytest.raises(ValueError):
        I.normalize_candles(spark.createDataFrame([(1, 1.0)], "open_time long, open double"), "A-USD")


def test_feed_snapshot_and_top_level_trades(spark):
    body = [
        ('{"channel":"market_trades","sequence_num":7,"trades":[{"product_id":"A-USD","price":"1","size":"2","side":"BUY","time":"2024-01-01T00:00:00Z"}]}',),
        ("not json",),
        ('{"channel":"l2_data","sequence_num":8,"events":[{"type":"snapshot","product_id":"A-USD","updates":[{"side":"bid","price_level":"9","new_quantity":"1"},{"side":"offer","price_level":null,"new_quantity":"1"}]}]}',),
    ]
    msgs = M.parse_messages(spark.createDataFrame(body, "value string"))
    assert [(r.trade_id, r.ts_ms) for r in M.feed_trades(msgs).collect()] == [("7:0", 1_704_067_200_000)]
    assert [(r.side, r.price, r.is_snapshot) for r in M.feed_book_updates(msgs).collect()] == [("bid", 9.0, True)]


def test_neutral_fill(spark):
    flow = spark.createDataFrame([("A-USD", 60_000, 3.0)], "product_id string, open_time long, buy_sell_ratio double")
    flow = flow.withColumns({"microprice": F.lit(None).cast("double"), "spread": F.lit(None).cast("double"), "volume_delta": F.lit(2.0)})
    rows = {r.open_time: r for r in merge_order_flow(candle(spark, [60_000, 120_000]), flow).collect()}
    assert rows[60_000].buy_sell_ratio == 3.0 and rows[120_000].buy_sell_ratio == 1.0
    assert rows[120_000].microprice == 1.0 and rows[120_000].spread is None and rows[120_000].volume_delta == 0.0


def test_features_have_no_nulls_and_bounds(spark):
    rng = np.random.default_rng(2)
    n = 220
    close = 100 + rng.normal(0, 0.3, n).cumsum()
    df = pd.DataFrame(
        {"product_id": "A-USD", "open_time": 1_700_000_000_000 + np.arange(n) * 60_000, "close_time": 0, "open": close + 0.05, "high": close + 0.4, "low": close - 0.4, "close": close, "volume": rng.uniform(1, 9, n), "trade_count": 5}
    )
    out = ohlcv_features(spark.createDataFrame(df)).toPandas()
    assert len(out) == n - 60 and not out.isna().any().any()
    assert out["bb_pct"].between(0, 1).all() and out["rsi_14"].between(0, 100).all()
    ret = pd.Series(np.log(close)).diff().rolling(20).std().iloc[-1]
    assert out.sort_values("open_time")["realized_vol_20"].iloc[-1] == pytest.approx(ret)
