"""Live features: the last 100 candles per product, recomputed per new candle.

Exponential means restart inside the 100-row buffer, so live values differ from
the full-history ones; ``features_buffered`` gives the same values in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeflow.functions.names import CANDLE, FLOW_DERIVED, FLOW_RAW, OHLCV_FEATURES
from tapeflow.functions.series import Series, number_rows
from tapeflow.operators.flow_features import add_flow
from tapeflow.operators.ohlcv import MINUTE_SPAN, add_ohlcv, complete_rows
from tapeflow.streaming.base import gather

BUFFER, NEEDED = 100, 70
FRAMES = Series(keys=("product_id", "frame"), row="pos")
BUFFER_SCHEMA = (
    "open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, trade_count bigint"
)
BUFFER_COLUMNS = [c.split()[0] for c in BUFFER_SCHEMA.split(", ")]


def latest_of_frames(frames: DataFrame) -> DataFrame:
    """Features of the last row of each (product, frame) buffer. Buffers are at most
    100 rows, so their windows are ordinary ones."""
    s = FRAMES
    flow = [c for c in FLOW_RAW if c in frames.columns and c not in CANDLE]
    df = add_ohlcv(s.open(frames), s)
    names = list(OHLCV_FEATURES)
    if flow:
        upto = s.order.rowsBetween(Window.unboundedPreceding, 0)
        spread = F.col("relative_spread")
        cut = F.coalesce(F.when(F.count(spread).over(upto) >= 10, F.percentile(spread, 0.75).over(upto)), F.lit(0.001))
        df = df.withColumn("spread_regime", F.coalesce((spread > cut).cast("double"), F.lit(0.0)))
        df = add_flow(df, s, set(FLOW_DERIVED))
        names += flow + FLOW_DERIVED
    return complete_rows(df.where(F.col("pos") == F.col("last_pos")).select(*CANDLE, *names))


def features_buffered(candles: DataFrame, span: int = MINUTE_SPAN) -> DataFrame:
    """Batch twin: each candle's features from the 100 candles up to it.

    A candle is sent to every frame it is part of (at most 100), so the groups
    are (product, frame) buffers and never whole products.
    """
    numbered = number_rows(candles, ["product_id"], "open_time", span)
    ends = numbered.groupBy("product_id").agg(F.max("row_idx").alias("_last"))
    row = F.col("row_idx")
    first = F.greatest(row, F.lit(NEEDED - 1))
    last = F.least(row + BUFFER - 1, F.col("_last"))
    frames = numbered.join(ends, "product_id").where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("frame") - (BUFFER - 1), F.lit(0))
    frames = frames.withColumns({"pos": row - start, "last_pos": F.col("frame") - start}).drop("_last", "row_idx")
    return latest_of_frames(frames)


class BufferProcessor(StatefulProcessor):
    """Keeps the last 100 candles; emits the buffer rows for every candle once 70 are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("candles", BUFFER_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = gather(rows, ["open_time"])
        if batch is None:
            return
        kept = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=BUFFER_COLUMNS)
        known = len(kept)
        line = pd.concat([kept, batch[BUFFER_COLUMNS]], ignore_index=True) if known else batch[BUFFER_COLUMNS]
        out = []
        for end in range(known, len(line)):
            frame = line.iloc[max(0, end - BUFFER + 1) : end + 1]
            if len(frame) >= NEEDED:
                out.append(
                    frame.assign(product_id=key[0], frame=line["open_time"].iloc[end], pos=range(len(frame)), last_pos=len(frame) - 1)
                )
        tail = line.tail(BUFFER)
        self.rows.put([(int(r[0]), int(r[1]), *map(float, r[2:7]), int(r[7])) for r in tail.itertuples(index=False)])
        if out:
            yield pd.concat(out)[["product_id", *BUFFER_COLUMNS, "frame", "pos", "last_pos"]]

    def close(self) -> None:
        pass


def stream_buffers(candles: DataFrame) -> DataFrame:
    """Stream of buffer rows; pass each micro-batch to ``latest_of_frames``."""
    return candles.groupBy("product_id").transformWithStateInPandas(
        statefulProcessor=BufferProcessor(),
        outputStructType=f"product_id string, {BUFFER_SCHEMA}, frame bigint, pos bigint, last_pos bigint",
        outputMode="Append", timeMode="None",
    )


def write_features(path: str):
    """foreachBatch handler; a repeated batch overwrites its own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest_of_frames(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle
