"""Streaming queries: the same inputs read as a file stream, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.functions.columns import epoch_ms, rounded
from tapeflow.functions.names import BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD, CANDLE, OHLCV_FEATURES
from tapeflow.operators import ledger as L
from tapeflow.plans.catalog.candles import CANDLE_SQL
from tapeflow.plans.catalog.features import FLOW_SQL, NOT_NULL
from tapeflow.plans.catalog.tables import SEQ_SQL, feed
from tapeflow.plans.registry import query, r6, rnd
from tapeflow.plans.views import CANDLE_SPAN, HOUR, Inputs
from tapeflow.session import staged
from tapeflow.sources import feed as M
from tapeflow.sources.store import with_base
from tapeflow.streaming import base as B
from tapeflow.streaming import candles as SC
from tapeflow.streaming import features as SF
from tapeflow.streaming import jobs as SJ
from tapeflow.streaming import orderflow as SO


class StreamInputs(Inputs):
    """The batch views with tables read as streams."""

    def table(self, name: str):
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return B.file_stream(self.spark, self.sf_dir, schema, f"{name}.parquet")


def streamed(x: Inputs) -> StreamInputs:
    return StreamInputs(x.spark, x.sf_dir)


def replay(x: Inputs, df, run, by: str = "open_time", parts: int = 2) -> None:
    """Land a batch frame in order, one part per restart of the job.

    ``run(stream, checkpoint)`` drains what has landed; the next part continues
    from the checkpoint, so state and offsets are carried across restarts.
    """
    folder, checkpoint = B.new_folder(x.spark, "replay"), B.new_folder(x.spark, "replay-cp")
    table = staged(df)
    cuts = table.approxQuantile(by, [i / parts for i in range(1, parts)], 0.01)
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = table
        if low is not None:
            part = part.where(F.col(by) > low)
        if high is not None:
            part = part.where(F.col(by) <= high)
        part.write.mode("append").parquet(folder)
        run(B.file_stream(x.spark, folder, df.schema, "*.parquet", 10_000), checkpoint)


def replay_table(x: Inputs, df, job, by: str = "open_time", parts: int = 2):
    """Replay through ``job(stream)`` into one result table."""
    path = B.new_folder(x.spark, "stream-out")
    out = []
    replay(x, df, lambda stream, cp: out.append(B.drain(job(stream), path, cp)), by, parts)
    return out[-1]


LAST = "JOIN (SELECT product_id AS lp, max(bucket) AS lb FROM arrived GROUP BY 1) ON lp = product_id"


@query("stream_candles", f"SELECT {CANDLE_SQL} FROM candles {LAST} WHERE open_time < lb", ("candles",))
def stream_candles(x: Inputs):
    return rounded(B.drain(SC.stream_candles(streamed(x).trades(), HOUR)))


@query(
    "stream_candles_watermark",
    f"""SELECT product_id, bucket AS open_time, bucket + 3599999 AS close_time, {rnd('arg_min(price, arrival_seq)')} AS open, {rnd('max(price)')} AS high, {rnd('min(price)')} AS low,
          {rnd('arg_max(price, arrival_seq)')} AS close, {rnd('sum(size)')} AS volume, count(*) AS trade_count FROM arrived
        WHERE bucket + 3600000 <= (SELECT max(ts_ms) FROM trades) - 3600000 GROUP BY product_id, bucket""",
    ("arrived",),
)
def stream_candles_watermark(x: Inputs):
    return rounded(B.drain(SC.stream_candles_watermark(streamed(x).trades(), HOUR, "1 hour")))


@query("stream_dedupe", f"SELECT product_id, trade_id, {r6('price', 'size')}, side, ts_ms FROM trades", ("trades",))
def stream_dedupe(x: Inputs):
    t = streamed(x).trades()
    twice = t.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = B.drain(SC.stream_dedupe(twice, "40 days"))
    return rounded(out.select("product_id", "trade_id", "price", "size", "side", "ts_ms"))


NO_BOOK = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS)


@query(
    "stream_order_flow",
    f"SELECT {FLOW_SQL}, {NO_BOOK} FROM live_flow {LAST} WHERE open_time < lb",
    ("live_flow",),
)
def stream_order_flow(x: Inputs):
    """Trade side on the whole event table; the book side is checked in tests."""
    t = streamed(x).trades().select(
        "product_id", F.lit("trade").alias("kind"), "arrival_seq", "ts_ms", "side", "price", "size",
        F.lit(False).alias("is_snapshot"), F.lit(0).cast("bigint").alias("snapshot_id"),
    )
    return rounded(B.drain(SO.stream_order_flow(t, HOUR)))


def _ema(lst: str, alpha: float) -> str:
    a = repr(float(alpha))
    return f"list_reduce({lst}, lambda s, v: s * (1e0 - {a}::DOUBLE) + v * {a}::DOUBLE)"


def _rsi(i: str) -> str:
    gain, loss = _ema(f"lgn[1:{i}]", 1 / 14), _ema(f"ll[1:{i}]", 1 / 14)
    return f"(CASE WHEN {loss} > 0 THEN 100e0 - 100e0 / (1e0 + {gain} / {loss}) ELSE 50e0 END)"


RESTARTED = (
    "rsi_14 rsi_divergence macd_hist macd_cross_up macd_cross_down atr_pct price_vs_ema_fast price_vs_ema_slow "
    "price_vs_ema_trend ema_fast_above_slow ema_full_alignment"
).split()
BUF_SQL = f"""b0 AS (SELECT * EXCLUDE ({', '.join(RESTARTED)}, e9, e21, e50, atr, macd, macd_mean),
    list(close) OVER w AS lc, list(CASE WHEN step > 0 THEN step ELSE 0e0 END) OVER w AS g0, list(CASE WHEN step < 0 THEN -step ELSE 0e0 END) OVER w AS l0,
    list(high - low) OVER w AS r0, list(greatest(high - low, abs(high - before), abs(low - before))) OVER w AS r1 FROM ohlcv
    WINDOW w AS (PARTITION BY product_id ORDER BY open_time ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  b1 AS (SELECT *, list_concat([0e0], g0[2:]) AS lgn, list_concat([0e0], l0[2:]) AS ll, list_concat([r0[1]], r1[2:]) AS lr, len(lc) AS n FROM b0 WHERE row_idx >= 69),
  b2 AS (SELECT *, {_ema('lc', 2 / 10)} AS e9, {_ema('lc', 2 / 22)} AS e21, {_ema('lc', 2 / 51)} AS e50, {_ema('lr', 1 / 14)} AS atr,
    list_transform(range(26, n + 1), lambda i: {_ema('lc[1:i]', 2 / 13)} - {_ema('lc[1:i]', 2 / 27)}) AS lm,
    list_transform(range(n - 5, n + 1), lambda i: {_rsi('i')}) AS lrsi, lc[n - 5:n - 1] AS prev FROM b1),
  b3 AS (SELECT *, lm[-1] AS m1, lm[-2] AS m0, {_ema('lm', 0.2)} AS s1, {_ema('lm[1:len(lm) - 1]', 0.2)} AS s0, lrsi[6] AS rsi_14, list_min(lrsi[1:5]) AS rmin, list_max(lrsi[1:5]) AS rmax FROM b2),
  buffered AS (SELECT *, CASE WHEN close < list_min(prev) AND rsi_14 > rmin THEN 1e0 WHEN close > list_max(prev) AND rsi_14 < rmax THEN -1e0 ELSE 0e0 END AS rsi_divergence,
    m1 - s1 AS macd_hist, (m1 > s1 AND m0 <= s0)::INT::DOUBLE AS macd_cross_up, (m1 < s1 AND m0 >= s0)::INT::DOUBLE AS macd_cross_down, atr / close AS atr_pct,
    close / e9 - 1 AS price_vs_ema_fast, close / e21 - 1 AS price_vs_ema_slow, close / e50 - 1 AS price_vs_ema_trend, (e9 > e21)::INT::DOUBLE AS ema_fast_above_slow,
    (e9 > e21 AND e21 > e50)::INT::DOUBLE AS ema_full_alignment FROM b3)"""
BUF_COLS = f"product_id, open_time, close_time, trade_count, {r6('open', 'high', 'low', 'close', 'volume', *OHLCV_FEATURES)}"
BUFFERED = f"WITH {BUF_SQL} SELECT {BUF_COLS} FROM buffered WHERE {NOT_NULL}"


@query("features_buffered", BUFFERED, ("ohlcv",))
def features_buffered(x: Inputs):
    return rounded(SF.features_buffered(x.candle_table(), CANDLE_SPAN))


@query("stream_features", BUFFERED, ("ohlcv",))
def stream_features(x: Inputs):
    path = B.new_folder(x.spark, "features")
    replay(x, x.candles(), lambda stream, cp: B.drain_batches(SF.stream_buffers(stream), SF.write_features(path), cp))
    return rounded(x.spark.read.parquet(path).drop("batch"))


@query(
    "stream_signals",
    "SELECT product_id, event_id, CASE WHEN prob_buy >= 0.62e0 THEN 'BUY' WHEN prob_buy <= 0.38e0 THEN 'EXIT_LONG' ELSE 'HOLD' END AS signal, true AS actionable, 'ok' AS reason, round(prob_buy, 6) AS prob_buy FROM signals",
    ("signals",),
)
def stream_signals(x: Inputs):
    """Signal rules on a stream; probabilities come from the events, thresholds from the model table."""
    from tapeflow.operators.signals import signals_from_probabilities

    path = B.new_folder(x.spark, "signals")
    rows = streamed(x).signals().select("product_id", "ts_ms", "event_id", "prob_buy")

    def models():
        return x.signals().groupBy("product_id").agg(
            F.lit(0.62).alias("buy_threshold"), F.lit(0.38).alias("exit_threshold"), F.lit(True).alias("model_actionable"), F.lit("ok").alias("model_reason")
        )

    def score(batch, table):
        gates = {c: F.lit(True) for c in ("drift_actionable", "regime_actionable")} | {c: F.lit("ok") for c in ("drift_reason", "regime_reason")}
        return signals_from_probabilities(batch.join(table, "product_id", "left").withColumns(gates)).drop(*gates)

    B.drain_batches(rows, SJ.write_signals(score, models, path))
    return rounded(x.spark.read.parquet(path).drop("batch").select("product_id", "event_id", "signal", "actionable", "reason", "prob_buy"))


@query("stream_positions")
def stream_positions(x: Inputs):
    candles = x.candle_table().withColumn("run", F.lit("a"))
    signals = x.signals().withColumn("run", F.lit("a")).select(
        "run", "product_id", "ts_ms", F.col("event_id").alias("event_seq"), "signal", "prob_buy", "actionable", F.lit("m1").alias("model_id")
    )
    cfg = L.LedgerConfig(slippage_by_base={"CLICK": 0.5})
    return rounded(replay_table(x, L.ledger_events(candles, signals), lambda stream: SJ.stream_positions(stream, cfg), "ts_ms"))


@query(
    "stream_gaps",
    f"WITH {SEQ_SQL} SELECT connection_key, n AS arrival_seq, last_sequence, sequence_num, sequence_num - last_sequence - 1 AS gap_size FROM p WHERE NOT snap AND sequence_num > last_sequence + 1",
    ("trades",),
)
def stream_gaps(x: Inputs):
    msgs = M.parse_messages(feed(x)).select(
        "connection_key", "arrival_seq", F.col("m.sequence_num").alias("sequence_num"),
        F.exists("m.events", lambda e: F.lower(e["type"]) == "snapshot").alias("is_snapshot"),
    )
    return replay_table(x, msgs, SJ.stream_gaps, "arrival_seq")


HEALTH = {"trades": "> 3", "candles": "= 0", "duplicates": "= 1", "gaps": "= 2", "reconcileds": "= 3"}


@query(
    "stream_health",
    f"""SELECT epoch_us(ts) // 3600000000 * 3600000 AS start_ms, {', '.join(f'count(*) FILTER (event_id % 20 {c}) AS {n}' for n, c in HEALTH.items())}, {rnd('avg(user_id)')} AS avg_lag_ms,
          max(user_id)::DOUBLE AS max_lag_ms FROM events GROUP BY 1 HAVING start_ms + 3600000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000""",
)
def stream_health(x: Inputs):
    ev = streamed(x).table("events")
    k = F.col("event_id") % 20
    kind = F.when(k == 0, "candle").when(k == 1, "duplicate").when(k == 2, "gap").when(k == 3, "reconciled").otherwise("trade")
    rows = ev.select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("user_id") * 1.0).alias("lag_ms"))
    return rounded(B.drain(SJ.stream_health(rows, "1 hour")))


@query(
    "stream_chop_state",
    "SELECT product_id, ts_ms, event_id, adverse_count, stop_count, greatest(coalesce(max(block_until) OVER (PARTITION BY product_id ORDER BY ts_ms), 0), 0) AS blocked_until_ms, adverse_count >= 2 AS caution FROM locked",
    ("locked",),
)
def stream_chop_state(x: Inputs):
    return B.drain(SJ.stream_chop_state(streamed(x).exits()))


@query(
    "incremental_sync",
    f"SELECT {CANDLE_SQL}, split_part(product_id, '-', 1) AS base_asset FROM candles",
    ("candles",),
)
def incremental_sync(x: Inputs):
    path = B.new_folder(x.spark, "table")
    replay(x, x.candles(), lambda stream, cp: B.drain_batches(stream, SJ.sync_table(x.spark, path, CANDLE), cp))
    return rounded(with_base(x.spark.read.parquet(path)).select(*CANDLE, "base_asset"))


@query("stream_source_candles", f"SELECT {CANDLE_SQL} FROM candles", ("candles",))
def stream_source_candles(x: Inputs):
    return rounded(replay_table(x, x.candles(), lambda stream: stream))
