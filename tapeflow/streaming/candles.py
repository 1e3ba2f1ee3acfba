"""Streaming candles and dedupe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeflow.operators.candles import trade_hash
from tapeflow.streaming.base import gather

CANDLE_SCHEMA = (
    "product_id string, open_time bigint, close_time bigint, open double, high double, low double, close double, "
    "volume double, trade_count bigint"
)
OPEN_SCHEMA = "open_time bigint, open double, high double, low double, close double, volume double, trade_count bigint"
OPEN_COLUMNS = [c.split()[0] for c in OPEN_SCHEMA.split(", ")]


def fold_trades(rows: pd.DataFrame, open_candle: tuple | None, length_ms: int) -> tuple[pd.DataFrame, tuple]:
    """Trades in arrival order onto the open candle: closed candles and the new open one."""
    bucket = rows["ts_ms"] - rows["ts_ms"] % length_ms
    start = open_candle[0] if open_candle else np.iinfo(np.int64).min
    newest = np.maximum(bucket.cummax().shift(1, fill_value=start), start)
    kept = rows.assign(open_time=bucket)[bucket >= newest]
    grouped = kept.groupby("open_time", sort=True).agg(
        open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"),
        volume=("size", "sum"), trade_count=("size", "size"),
    ).reset_index()
    if open_candle:
        before = pd.DataFrame([open_candle], columns=OPEN_COLUMNS)
        grouped = pd.concat([before, grouped], ignore_index=True).groupby("open_time", sort=True).agg(
            open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"),
            volume=("volume", "sum"), trade_count=("trade_count", "sum"),
        ).reset_index()
    last = tuple(grouped[OPEN_COLUMNS].iloc[-1])
    return grouped.iloc[:-1], last


def _plain(values: tuple) -> tuple:
    return (int(values[0]), *map(float, values[1:6]), int(values[6]))


class CandleProcessor(StatefulProcessor):
    """One open candle per product; it closes when a newer bucket arrives for that product."""

    def __init__(self, length_ms: int) -> None:
        self.length_ms = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candle = handle.getValueState("open_candle", OPEN_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = gather(rows, ["arrival_seq"])
        if batch is None:
            return
        now = tuple(self.candle.get()) if self.candle.exists() else None
        closed, last = fold_trades(batch, now, self.length_ms)
        self.candle.update(_plain(last))
        yield closed.assign(product_id=key[0], close_time=closed["open_time"] + self.length_ms - 1)[
            [c.split()[0] for c in CANDLE_SCHEMA.split(", ")]
        ]

    def close(self) -> None:
        pass


def stream_candles(trades: DataFrame, length_ms: int) -> DataFrame:
    """Exact candles: per-product close, late trades dropped, no empty candles."""
    return trades.groupBy("product_id").transformWithStateInPandas(
        statefulProcessor=CandleProcessor(length_ms), outputStructType=CANDLE_SCHEMA, outputMode="Append", timeMode="None"
    )


def stream_candles_watermark(trades: DataFrame, length_ms: int, delay: str) -> DataFrame:
    """Candles by Spark's own event-time windows; the watermark is shared by all products."""
    at = F.timestamp_millis("ts_ms")
    return (
        trades.withColumn("ts", at).withWatermark("ts", delay)
        .groupBy("product_id", F.window("ts", f"{length_ms} milliseconds").alias("w"))
        .agg(
            F.min_by("price", "arrival_seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "arrival_seq").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            "product_id", F.unix_millis("w.start").alias("open_time"), (F.unix_millis("w.end") - 1).alias("close_time"),
            "open", "high", "low", "close", "volume", "trade_count",
        )
    )


def stream_dedupe(trades: DataFrame, delay: str) -> DataFrame:
    """Drop repeats of a trade that arrive within the delay."""
    return (
        trades.withColumn("ts", F.timestamp_millis("ts_ms")).withColumn("trade_key", trade_hash())
        .withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_key"])
    )
