"""Streaming jobs agree with their batch operators."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tapeflow.operators import book as B
from tapeflow.operators import ledger as L
from tapeflow.streaming import base as S
from tapeflow.streaming import jobs as J
from tapeflow.streaming import orderflow as O

Q = entry.queries()


def rows(df):
    out = df.toPandas()
    return out[sorted(out.columns)].sort_values(sorted(out.columns)).reset_index(drop=True)


def test_buffered_features_match_the_stream(spark):
    sf = "/root/testdata/sf0.01"
    batch, stream = rows(Q["features_buffered"](spark, sf)), rows(Q["stream_features"](spark, sf))
    assert len(batch) > 1_000
    pd.testing.assert_frame_equal(batch, stream[batch.columns])


def test_buffered_ema_restarts_in_the_buffer(spark):
    sf = "/root/testdata/sf0.01"
    candles = Q["candles_batch"](spark, sf).toPandas().sort_values(["product_id", "open_time"])
    got = Q["features_buffered"](spark, sf).toPandas()
    for product in ("VIEW-USD", "CLICK-USD"):
        c = candles[candles["product_id"] == product].reset_index(drop=True)
        mine = got[got["product_id"] == product].sort_values("open_time").tail(5)
        for r in mine.itertuples():
            end = int(c.index[c["open_time"] == r.open_time][0])
            part = c["close"].iloc[max(0, end - 99) : end + 1]
            want = part.iloc[-1] / part.ewm(span=50, adjust=False, min_periods=50).mean().iloc[-1] - 1
            assert r.price_vs_ema_trend == pytest.approx(want, abs=2e-6)


def test_positions_match_the_ledger(spark, sf):
    batch = Q["position_ledger"](spark, sf).where("run = 'a'")
    pd.testing.assert_frame_equal(rows(batch), rows(Q["stream_positions"](spark, sf)), check_dtype=False)


def test_positions_of_a_large_trigger_are_walked_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "HELD_ROWS", 5_000, raising=False)
    monkeypatch.setattr(J, "FILL_ROWS", 500, raising=False)
    rng = np.random.default_rng(6)
    n = 120_000
    kind = rng.choice([0, 1], n, p=[0.95, 0.05])
    table = pd.DataFrame({
        "run": "a", "product_id": "A-USD", "ts_ms": rng.integers(0, n // 2, n) * 20_000, "kind": kind, "event_seq": rng.integers(0, 3, n),
        "close": np.where(kind == 0, 100 + rng.normal(0, 2, n).round(3), np.nan), "prob_buy": np.where(kind == 1, 0.5, np.nan),
    })
    table["signal"] = np.where(kind == 1, rng.choice(["BUY", "EXIT_LONG", "HOLD"], n, p=[0.4, 0.2, 0.4]), None)
    table["actionable"] = np.where(kind == 1, True, None)
    table["model_id"] = np.where(kind == 1, "m1", None)
    table = table[L.EVENT_COLUMNS]
    cfg, now = L.LedgerConfig(), dict(L.FLAT)
    want = L.walk(("a", "A-USD"), table, now, cfg)
    saved = []
    processor = J.PositionProcessor(cfg)
    processor.state = SimpleNamespace(exists=lambda: False, get=lambda: None, update=saved.append)
    tracemalloc.start()
    got = [f.drop(columns=["run", "product_id"]) for f in processor.handleInputRows(("a", "A-USD"), (table[i : i + 1_000] for i in range(0, n, 1_000)), None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), want.drop(columns=["run", "product_id"]), check_dtype=False)
    assert len(saved) == 1 and saved[0][0] == now["last_close"] and saved[0][1] == now["open"]
    assert peak < 12_000_000


def test_order_flow_with_book_and_snapshots(spark):
    rng = np.random.default_rng(4)
    events, snap = [], 0
    for i in range(900):
        t = i * 1_000
        if i % 3 == 0:
            events.append(("A-USD", "trade", i, t, "BUY" if rng.random() < 0.5 else "SELL", round(100 + rng.normal(), 2), float(rng.integers(1, 9)), False, 0))
        elif i % 200 == 1:
            snap = i
            events += [("A-USD", "book", i, t, s, 100.0 + d * k, 5.0 + k, True, snap) for s, d in (("bid", -0.01), ("ask", 0.01)) for k in range(1, 4)]
        else:
            side = "bid" if rng.random() < 0.5 else "ask"
            price = 100 + (-1 if side == "bid" else 1) * 0.01 * int(rng.integers(1, 30))
            events.append(("A-USD", "book", i, t, side, round(price, 2), float(rng.integers(0, 9)), False, snap))
    df = pd.DataFrame(events, columns="product_id kind arrival_seq ts_ms side price size is_snapshot snapshot_id".split())
    df["arrival_seq"] = range(len(df))
    frame = spark.createDataFrame(df)
    folder = S.new_folder(spark, "flow")
    frame.write.parquet(folder)
    stream = S.file_stream(spark, folder, frame.schema, "*.parquet")
    got = S.drain(O.stream_order_flow(stream, 60_000)).orderBy("open_time").toPandas()

    # Batch: an update belongs to the window that closes next.
    trades = df[df["kind"] == "trade"].copy()
    bucket = trades["ts_ms"] // 60_000 * 60_000
    closes = trades["arrival_seq"][bucket != bucket.shift(1)].to_numpy()[1:]
    opens = np.sort(bucket.unique())
    trades["window_ms"] = bucket.shift(1).fillna(bucket.iloc[0]).astype("int64")
    book = df[df["kind"] == "book"].copy()
    pos = np.searchsorted(closes, book["arrival_seq"])
    book = book[pos < len(closes)].assign(window_ms=opens[pos[pos < len(closes)]])
    trades = trades[trades["window_ms"] < opens[-1]]
    own = df[df["kind"] == "trade"].assign(b=bucket).groupby("b")["price"].agg(["first", "last"])
    win = trades.groupby("window_ms").apply(
        lambda g: pd.Series({"buy_volume": g["size"][g["side"] == "BUY"].sum(), "sell_volume": g["size"][g["side"] == "SELL"].sum()}), include_groups=False
    ).reset_index()
    win["price_change"] = [(own["last"][w] - own["first"][w]) / own["first"][w] for w in win["window_ms"]]
    win["product_id"] = "A-USD"
    updates = spark.createDataFrame(book).withColumnRenamed("arrival_seq", "seq")
    want = B.book_metrics(updates, spark.createDataFrame(win)).orderBy("window_ms").toPandas()
    assert list(want["window_ms"]) == list(got["open_time"])
    for c in want.columns.drop(["product_id", "window_ms"]):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_sync_can_repeat_a_batch(spark, tmp_path):
    from tapeflow.functions.names import CANDLE
    from tapeflow.streaming.jobs import sync_table

    rows_ = [("a-usd", 60_000, 119_999, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows_, "product_id string, open_time long, close_time long, open double, high double, low double, close double, volume double, trade_count long")
    handle = sync_table(spark, str(tmp_path / "t"), CANDLE)
    handle(df, 0)
    handle(df, 0)
    handle(df.withColumn("close", F.lit(2.0)), 1)
    got = spark.read.parquet(str(tmp_path / "t")).collect()
    assert [(r.product_id, r.close, r.base_asset) for r in got] == [("A-USD", 2.0, "A")]


def test_gaps_across_batches_and_snapshots():
    from tapeflow.streaming.jobs import gap_rows

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        df = pd.DataFrame({"arrival_seq": range(n), "sequence_num": rng.integers(0, 12, n), "is_snapshot": rng.random(n) < 0.2})
        carried = None if rng.random() < 0.3 else int(rng.integers(1, 10))
        top, want = carried, []
        for i, q, snap in df.itertuples(index=False):
            if q > 0:
                if top is not None and not snap and q > top + 1:
                    want.append((i, top, q, q - top - 1))
                top = q if snap or top is None else max(top, q)
        got, end = gap_rows(df, carried)
        assert [tuple(map(int, r)) for r in got[["arrival_seq", "last_sequence", "sequence_num", "gap_size"]].itertuples(index=False)] == want
        assert end == top


def test_feed_lists_and_missing_ids(spark):
    from tapeflow.sources.feed import feed_trades, parse_messages

    rows = [
        ('{"sequence_num": 7, "timestamp": "2024-01-01T00:00:00Z", "events": [{"trades": [{"price": "1"}, {"price": "2", "trade_id": ""}]}, {"trades": [{"price": "3"}]}]}',),
        ('{"sequence_num": 8, "events": [{"trades": [{"price": "9"}]}], "trades": [{"price": "4", "trade_time": "2024-01-01T00:00:01Z"}]}',),
    ]
    got = feed_trades(parse_messages(spark.createDataFrame(rows, "value string"))).collect()
    assert sorted((r.price, r.trade_id) for r in got) == [("1", "7:0"), ("2", "7:1"), ("3", "7:0"), ("4", "8:0")]
    assert {r.price: r.ts_ms for r in got}["4"] == 1_704_067_201_000


def test_drift_skips_values_that_are_not_finite(spark):
    from tapeflow.operators.monitors import drift_evaluate

    names = [f"f{i}" for i in range(9)]
    bounds = spark.createDataFrame([("A", f, 0.0, 0.5, 1.0) for f in names], "product_id string, feature string, low double, median double, high double")
    rows = spark.createDataFrame([("A", 1, *[float("inf")] * 9), ("A", 2, *[0.5] * 9), ("B", 3, *[0.5] * 9)], ["product_id", "id", *names])
    got = {r.id: (r.checked_features, r.drift_status) for r in drift_evaluate(rows, ["product_id", "id"], names, bounds).collect()}
    assert got == {1: (0, "insufficient_checks"), 2: (9, "ok"), 3: (0, "disabled")}


def test_symbols_are_trimmed_and_upper_case(spark):
    from tapeflow.functions.text import product_of_symbol

    df = spark.createDataFrame([(" btcusdt ",), ("ETHUSD",), ("xy",)], "s string")
    assert [r[0] for r in df.select(product_of_symbol("s")).collect()] == ["BTC-USD", "ETH-USD", "XY"]


def test_a_load_of_one_day_rewrites_one_day(spark, tmp_path):
    from tapeflow.functions.names import CANDLE
    from tapeflow.sources.store import DAY_MS, upsert_table

    path = tmp_path / "t"
    schema = "product_id string, open_time long, close_time long, open double, high double, low double, close double, volume double, trade_count long"
    day = lambda d, v: [("a-usd", d * DAY_MS + i * 60_000, d * DAY_MS + i * 60_000 + 59_999, v, v, v, v, v, 1) for i in range(5)]
    upsert_table(spark, str(path), spark.createDataFrame([r for d in range(4) for r in day(d, 1.0)], schema), CANDLE)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    upsert_table(spark, str(path), spark.createDataFrame(day(2, 2.0)[:2], schema), CANDLE)
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    assert {f.parent.name for f in set(before.items()) ^ set(after.items()) for f in [f[0]]} == {"open_day=2"}
    got = spark.read.parquet(str(path))
    assert got.count() == 20 and got.where("close = 2").count() == 2
