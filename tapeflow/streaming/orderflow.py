"""Streaming order flow: trade window + book per product, one row per closed window.

The processor only keeps state and sums it up; ratios and limits are the same
column expressions as in the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeflow.functions.columns import clip, ratio
from tapeflow.functions.names import BOOK_DEPTH, BOOK_DYNAMICS, BOOK_SPREAD, TRADE_FLOW
from tapeflow.operators.book import dynamics_columns, top_of_book
from tapeflow.streaming.base import gather

DEPTHS = [f"{s}_depth_top{n}" for s in ("bid", "ask") for n in (5, 10, 20)]
CUMUL = [f"cumul_depth_{bp}bp" for bp in (1, 5, 10)]
CHANGES = ["bid_added", "bid_removed", "ask_added", "ask_removed"]
BOOK_RAW = [
    "_best_bid", "_best_ask", "best_bid_size", "best_ask_size", "mid_price", "_wbi_bid", "_wbi_ask",
    "depth_slope_bid", "depth_slope_ask", *DEPTHS, *CUMUL, "_start_bid", "_start_ask", *CHANGES,
]
TRADE_RAW = ["buy_volume", "sell_volume", "avg_trade_size", "median_trade_size", "max_trade_size", "_notional"]
RAW_SCHEMA = (
    "product_id string, open_time bigint, trade_count bigint, buy_count bigint, price_change double, "
    + ", ".join(f"{c} double" for c in TRADE_RAW + BOOK_RAW)
)
RAW_COLUMNS = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
META = "current bigint, open double, close double, " + ", ".join(f"{c} double" for c in [*CHANGES, "start_bid", "start_ask"])


def slope(sizes: np.ndarray) -> float:
    if len(sizes) < 2:
        return 0.0
    x = np.arange(len(sizes)) - (len(sizes) - 1) / 2
    return float((x * (sizes - sizes.mean())).sum() / (x * x).sum())


def book_summary(bids: dict[float, float], asks: dict[float, float]) -> dict[str, float] | None:
    """Sums over the live levels; nothing for an empty book."""
    if not bids and not asks:
        return None
    out: dict[str, float] = {}
    sides = {}
    for name, book, sign in (("bid", bids, -1), ("ask", asks, 1)):
        price = np.array(sorted(book, key=lambda p: sign * p), dtype=float)
        size = np.array([book[p] for p in price], dtype=float)
        sides[name] = price, size
        out[f"_best_{name}"] = float(price[0]) if len(price) else 0.0
        out[f"best_{name}_size"] = float(size[0]) if len(size) else 0.0
        out[f"_wbi_{name}"] = float((size[:10] / np.arange(1, len(size[:10]) + 1)).sum())
        out[f"depth_slope_{name}"] = slope(size[:5])
        out |= {f"{name}_depth_top{n}": float(size[:n].sum()) for n in (5, 10, 20)}
    bid, ask = out["_best_bid"], out["_best_ask"]
    mid = (bid + ask) / 2 if bid > 0 and ask > 0 else 0.0
    out["mid_price"] = mid
    for bp in (1, 5, 10):
        reach = mid * bp / 10_000.0
        near = sides["bid"][1][mid - sides["bid"][0] <= reach].sum() + sides["ask"][1][sides["ask"][0] - mid <= reach].sum()
        out[f"cumul_depth_{bp}bp"] = float(near) if mid > 0 else 0.0
    return out


class OrderFlowProcessor(StatefulProcessor):
    """Book levels, the open trade window and change sums per product.

    Input rows have kind 'trade' (price, size, side, ts_ms) or 'book' (side bid/ask,
    price, size, is_snapshot, snapshot_id), ordered by arrival_seq.
    """

    def __init__(self, length_ms: int) -> None:
        self.length_ms = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.trades = handle.getListState("trades", "price double, size double, buy boolean")
        self.meta = handle.getValueState("meta", META)
        self.snapshot = handle.getValueState("snapshot", "id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = gather(rows, ["arrival_seq"])
        if batch is None:
            return
        books = {"bid": {}, "ask": {}}
        for (side, price), (size,) in self.levels.iterator():
            books[side][price] = size
        loaded = {(s, p) for s in books for p in books[s]}
        window = [tuple(t) for t in self.trades.get()] if self.trades.exists() else []
        meta = dict(zip([c.split()[0] for c in META.split(", ")], self.meta.get() if self.meta.exists() else [None] * 9, strict=True))
        flow = {c: meta[c] or 0.0 for c in CHANGES}
        snapshot = self.snapshot.get()[0] if self.snapshot.exists() else 0
        out = []
        for r in batch.itertuples(index=False):
            if r.kind == "book":
                book = books[r.side]
                if r.is_snapshot:
                    if r.snapshot_id != snapshot:
                        snapshot, books = r.snapshot_id, {"bid": {}, "ask": {}}
                        flow = dict.fromkeys(CHANGES, 0.0)
                    if r.size > 0:
                        books[r.side][r.price] = r.size
                    continue
                old = book.get(r.price, 0.0)
                flow[f"{r.side}_added"] += max(0.0, r.size - old)
                flow[f"{r.side}_removed"] += max(0.0, old - r.size)
                if r.size > 0:
                    book[r.price] = r.size
                else:
                    book.pop(r.price, None)
                continue
            bucket = int(r.ts_ms) - int(r.ts_ms) % self.length_ms
            window.append((float(r.price), float(r.size), str(r.side).upper() in ("BUY", "BID")))
            if meta["current"] is None:
                meta.update(current=bucket, open=r.price, close=r.price)
            elif bucket > meta["current"]:
                out.append(self._row(key[0], meta, window, books, flow))
                if books["bid"] or books["ask"]:
                    meta.update(start_bid=out[-1]["bid_depth_top10"], start_ask=out[-1]["ask_depth_top10"])
                window, flow = [], dict.fromkeys(CHANGES, 0.0)
                meta.update(current=bucket, open=r.price, close=r.price)
            elif bucket == meta["current"]:
                meta["close"] = r.price
        live = {(s, p): v for s in books for p, v in books[s].items()}
        for gone in loaded - live.keys():
            self.levels.removeKey(gone)
        for level, size in live.items():
            self.levels.updateValue(level, (size,))
        self.trades.put(window) if window else self.trades.clear()
        meta.update(flow)
        self.meta.update(tuple(meta.values()))
        self.snapshot.update((snapshot,))
        if out:
            yield pd.DataFrame(out, columns=RAW_COLUMNS)

    @staticmethod
    def _row(product: str, meta: dict, window: list, books: dict, flow: dict) -> dict:
        price, size, buy = (np.array(c) for c in zip(*window, strict=True))
        row = dict(
            product_id=product, open_time=meta["current"], trade_count=len(size), buy_count=int(buy.sum()),
            price_change=(meta["close"] - meta["open"]) / meta["open"] if meta["open"] > 0 else 0.0,
            buy_volume=float(size[buy].sum()), sell_volume=float(size[~buy].sum()), avg_trade_size=float(size.mean()),
            median_trade_size=float(np.median(size)), max_trade_size=float(size.max()), _notional=float((price * size).sum()),
        )
        summary = book_summary(books["bid"], books["ask"])
        if summary is not None:
            start = {f"_start_{s}": summary[f"{s}_depth_top10"] if meta[f"start_{s}"] is None else meta[f"start_{s}"] for s in ("bid", "ask")}
            row |= summary | start | flow
        return row

    def close(self) -> None:
        pass


def flow_columns(raw: DataFrame) -> DataFrame:
    """Raw window sums to the 51 flow columns."""
    bought, sold = F.col("buy_volume"), F.col("sell_volume")
    total, delta = bought + sold, bought - sold
    df = raw.withColumns(
        {
            "buy_aggressive_volume": bought, "sell_aggressive_volume": sold, "total_traded_volume": total,
            "sell_count": F.col("trade_count") - F.col("buy_count"), "volume_delta": delta, "delta_ratio": ratio(delta, total, 0.0),
            "buy_sell_ratio": clip(F.when(sold > 0, bought / sold).when(bought > 0, 10.0).otherwise(1.0), 0, 10),
            "trade_vwap": ratio(F.col("_notional"), total, 0.0),
        }
    )
    df = dynamics_columns(top_of_book(df))
    known = F.col("mid_price").isNotNull()
    book = {c: F.when(known, F.col(c)) for c in BOOK_SPREAD + BOOK_DEPTH + BOOK_DYNAMICS}
    return df.withColumns(book).select("product_id", "open_time", *TRADE_FLOW, *book)


def stream_order_flow(events: DataFrame, length_ms: int) -> DataFrame:
    raw = events.groupBy("product_id").transformWithStateInPandas(
        statefulProcessor=OrderFlowProcessor(length_ms), outputStructType=RAW_SCHEMA, outputMode="Append", timeMode="None"
    )
    return flow_columns(raw)
