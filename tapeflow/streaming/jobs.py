"""Streaming signals, positions, gaps, health, chop state and table sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeflow.operators import ledger as L
from tapeflow.operators.risk import RiskConfig, adverse_exit
from tapeflow.sources.store import upsert_table
from tapeflow.streaming.base import gather, in_order


# ---------------------------------------------------------------- table sync and signals
def sync_table(spark: SparkSession, path: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: upsert new entries. The query's checkpoint remembers
    the last entry; an upsert may safely run twice."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch.sparkSession, path, batch, columns)

    return handle


def write_signals(score: Callable[[DataFrame, DataFrame], DataFrame], models: Callable[[], DataFrame], path: str):
    """foreachBatch handler: the model table is read anew for every batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        score(batch, models()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


# ---------------------------------------------------------------- positions
class PositionProcessor(StatefulProcessor):
    """The ledger's step function with one open position per (run, product); events and fills pass in pieces."""

    def __init__(self, cfg: L.LedgerConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(STATE_FIELDS)
        self.state = handle.getValueState("position", fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE_FIELDS]
        now = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict(L.FLAT)
        ordered = in_order(rows, L.EVENT_ORDER)
        first = next(ordered, None)
        if first is None:
            return
        fills = L.fills_of(key, chain([first], ordered), now, self.cfg)
        while part := list(islice(fills, FILL_ROWS)):
            yield pd.DataFrame(part, columns=L.FILL_COLUMNS).astype({"ts_ms": "int64", "event_seq": "int64", "holding_ms": "Int64"})
        self.state.update(
            (
                float(now["last_close"]), bool(now["open"]), *(float(now[c]) for c in names[2:6]), int(now["opened_at_ms"]),
                str(now["model_id"]), int(now["cooldown_until_ms"]),
            )
        )

    def close(self) -> None:
        pass


#: Fills of one frame that a worker gives back.
FILL_ROWS = 10_000
STATE_FIELDS = L.STATE_SCHEMA.split(", ")[2:]


def stream_positions(events: DataFrame, cfg: L.LedgerConfig) -> DataFrame:
    return events.groupBy("run", "product_id").transformWithStateInPandas(
        statefulProcessor=PositionProcessor(cfg), outputStructType=L.FILL_SCHEMA, outputMode="Append", timeMode="None"
    )


# ---------------------------------------------------------------- gaps
def gap_rows(numbers: pd.DataFrame, carried: int | None) -> tuple[pd.DataFrame, int | None]:
    """Jumps of more than one over the highest number of the current epoch, and the highest number at the end.

    A snapshot opens an epoch; ``carried`` is the highest number so far and counts in the first one.
    """
    numbers = numbers[numbers["sequence_num"] > 0]
    if numbers.empty:
        return numbers.assign(last_sequence=[], gap_size=[]), carried
    epoch = numbers["is_snapshot"].astype(int).cumsum()
    highest = numbers.groupby(epoch)["sequence_num"].cummax()
    if carried is not None:
        highest = highest.where(epoch > 0, highest.clip(lower=carried))
    before = highest.groupby(epoch).shift()
    if carried is not None and not epoch.iloc[0]:
        before.iloc[0] = carried
    jumps = numbers.assign(last_sequence=before, gap_size=numbers["sequence_num"] - before - 1)
    return jumps[jumps["gap_size"] > 0], int(highest.iloc[-1])


class GapProcessor(StatefulProcessor):
    """Carries the highest sequence number of each connection from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence_num bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = gather(rows, ["arrival_seq"])
        if batch is None:
            return
        jumps, highest = gap_rows(batch, self.last.get()[0] if self.last.exists() else None)
        if highest is not None:
            self.last.update((highest,))
        if len(jumps):
            found = jumps[["arrival_seq", "last_sequence", "sequence_num", "gap_size"]].astype("int64")
            yield found.assign(connection_key=key[0])[["connection_key", *found.columns]]

    def close(self) -> None:
        pass


def stream_gaps(messages: DataFrame) -> DataFrame:
    return messages.groupBy("connection_key").transformWithStateInPandas(
        statefulProcessor=GapProcessor(),
        outputStructType="connection_key string, arrival_seq bigint, last_sequence bigint, sequence_num bigint, gap_size bigint",
        outputMode="Append", timeMode="None",
    )


# ---------------------------------------------------------------- health
def stream_health(events: DataFrame, interval: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Counters per interval. events: ts, kind ('trade', 'candle', 'duplicate',
    'gap', 'reconciled'), lag_ms."""
    kinds = ("trade", "candle", "duplicate", "gap", "reconciled")
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", interval).alias("w"))
        .agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds], F.avg("lag_ms").alias("avg_lag_ms"), F.max("lag_ms").alias("max_lag_ms"))
        .select(F.unix_millis("w.start").alias("start_ms"), *[f"{k}s" for k in kinds], "avg_lag_ms", "max_lag_ms")
    )


# ---------------------------------------------------------------- chop state
def chop_counts(exits: pd.DataFrame, earlier: np.ndarray, cfg: RiskConfig, blocked: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Exits and stops of the window that ends with each exit, and the end of its block; and what later exits may still count.

    ``exits`` is ordered by time; ``earlier`` has (time, stop) of exits before it. Both are counted between two sorted places.
    """
    t, stop = exits["ts_ms"].to_numpy("int64"), exits["is_stop"].to_numpy("int64")
    earlier = earlier[np.argsort(earlier[:, 0], kind="stable")]
    own, old = np.searchsorted(t, t - cfg.chop_window_ms), np.searchsorted(earlier[:, 0], t - cfg.chop_window_ms)
    own_sum, old_sum = (np.concatenate([[0], np.cumsum(x)]) for x in (stop, earlier[:, 1]))
    here = np.arange(1, len(t) + 1)
    count = here - own + len(earlier) - old
    stops = own_sum[here] - own_sum[own] + old_sum[-1] - old_sum[old]
    locks = (count >= cfg.lock_exits) | (stops >= cfg.lock_stops)
    until = np.maximum(np.maximum.accumulate(np.where(locks, t + cfg.chop_block_ms, 0)), blocked)
    out = exits[["product_id", "ts_ms", "event_id"]].assign(
        adverse_count=count, stop_count=stops, blocked_until_ms=until, caution=count >= cfg.caution_exits
    )
    every = np.concatenate([earlier, np.stack([t, stop], 1)])
    return out, every[every[:, 0] >= t[-1] - cfg.chop_window_ms]


class ChopProcessor(StatefulProcessor):
    """Carries the exits of the trailing window per product; a timer forgets them."""

    def __init__(self, cfg: RiskConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("exits", "ts_ms bigint, is_stop bigint")
        self.blocked = handle.getValueState("blocked_until", "ts_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = gather(rows, ["ts_ms", "event_id"])
        if batch is None:
            return
        held = list(self.recent.get()) if self.recent.exists() else []
        out, keep = chop_counts(
            batch.assign(product_id=key[0]), np.array(held, "int64").reshape(-1, 2), self.cfg, self.blocked.get()[0] if self.blocked.exists() else 0
        )
        until = int(out["blocked_until_ms"].iloc[-1])
        self.recent.put([(int(a), int(b)) for a, b in keep])
        self.blocked.update((until,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(batch["ts_ms"].iloc[-1]) + self.cfg.chop_window_ms, until) + 1)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.blocked.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_chop_state(exits: DataFrame, cfg: RiskConfig = RiskConfig(), delay: str = "10 minutes") -> DataFrame:
    bad = exits.where(adverse_exit(cfg)).withColumns(
        {"is_stop": (F.lower(F.trim("reason")) == "stop_loss_hit").cast("bigint"), "ts": F.timestamp_millis("ts_ms")}
    )
    return bad.withWatermark("ts", delay).groupBy("product_id").transformWithStateInPandas(
        statefulProcessor=ChopProcessor(cfg),
        outputStructType="product_id string, ts_ms bigint, event_id bigint, adverse_count bigint, stop_count bigint, "
        "blocked_until_ms bigint, caution boolean",
        outputMode="Append", timeMode="EventTime",
    )
