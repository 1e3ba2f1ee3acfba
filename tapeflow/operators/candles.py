"""Trades to candles, and plain candle-table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach, bucket_start, int_div
from tapeflow.functions.series import running

MINUTE_MS = 60_000
ARRIVAL_BLOCK = 1_000_000


def valid_trades(raw: DataFrame) -> DataFrame:
    """Cast price, size and time; keep rows where all three are positive numbers."""
    price, size = F.expr("try_cast(price AS DOUBLE)"), F.expr("try_cast(size AS DOUBLE)")
    ts = F.expr("try_cast(ts_ms AS BIGINT)")
    return (
        raw.withColumns({"price": price, "size": size, "ts_ms": ts})
        .where((F.col("price") > 0) & (F.col("size") > 0) & (F.col("ts_ms") > 0))
    )


def is_buy(side: str = "side") -> Column:
    """Aggressor side of a trade."""
    return F.coalesce(F.upper(side).isin("BUY", "BID"), F.lit(False))


def book_side(side: str = "side") -> Column:
    """'bid' or 'ask' for a book update."""
    return F.when(F.upper(side).isin("BID", "BUY", "B"), "bid").otherwise("ask")


def trade_hash() -> Column:
    return F.md5(F.concat_ws("|", "product_id", "trade_id", "price", "size", "ts_ms"))


def dedupe_trades(trades: DataFrame) -> DataFrame:
    """First arrival of each (product, trade id, price, size, time).

    An aggregate, not a window: repeats are folded before the shuffle.
    """
    cols = [c for c in trades.columns]
    return (
        trades.withColumn("_h", trade_hash())
        .groupBy("_h")
        .agg(F.min_by(F.struct(*cols), "arrival_seq").alias("_t"))
        .select("_t.*")
    )


def with_current_bucket(trades: DataFrame, length_ms: int, block: int = ARRIVAL_BLOCK) -> DataFrame:
    """Add ``bucket`` and ``current``: the newest bucket seen by earlier arrivals."""
    marked = trades.withColumn("bucket", bucket_start("ts_ms", length_ms))
    return running(
        marked,
        keys=["product_id"],
        order=["arrival_seq"],
        block=int_div("arrival_seq", block),
        specs={"current": ("max", "bucket")},
        exclusive=True,
    )


def build_candles(trades: DataFrame, length_ms: int = MINUTE_MS) -> DataFrame:
    """OHLCV per product and bucket in arrival order; trades for a bucket that
    was already left are ignored. The last bucket of each product is included."""
    kept = with_current_bucket(trades, length_ms).where(
        F.col("current").isNull() | (F.col("bucket") >= F.col("current"))
    )
    return (
        kept.groupBy("product_id", F.col("bucket").alias("open_time"))
        .agg(
            F.min_by("price", "arrival_seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "arrival_seq").alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        .select(
            "product_id",
            "open_time",
            (F.col("open_time") + length_ms - 1).alias("close_time"),
            "open", "high", "low", "close", "volume", "trade_count",
        )
    )


def force_close(candles: DataFrame, now_ms: int | Column) -> DataFrame:
    """Last open candle of each product, closed at the later of now and its start."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(int(now_ms))
    cols = [c for c in candles.columns if c != "product_id"]
    return (
        candles.groupBy("product_id")
        .agg(F.max_by(F.struct(*cols), "open_time").alias("_c"))
        .select("product_id", "_c.*")
        .withColumn("close_time", F.greatest(now.cast("bigint"), F.col("open_time")))
        .withColumn("is_closed", F.lit(True))
    )


def closed_before(candles: DataFrame, now_ms: int | Column, length_ms: int = MINUTE_MS) -> DataFrame:
    """Drop candles of the current or a later bucket."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(int(now_ms))
    return candles.where(F.col("open_time") < bucket_start(now.cast("bigint"), length_ms))


def monotonic(candles: DataFrame, arrival: str, block: int = ARRIVAL_BLOCK) -> DataFrame:
    """Keep a candle only if it is newer than all earlier arrivals of its product."""
    seen = running(
        candles,
        keys=["product_id"],
        order=[arrival],
        block=int_div(arrival, block),
        specs={"_seen": ("max", "open_time")},
        exclusive=True,
    )
    return seen.where(F.col("_seen").isNull() | (F.col("open_time") > F.col("_seen"))).drop("_seen")


def reconcile(published: DataFrame, backfill: DataFrame, now_ms: int | Column, length_ms: int = MINUTE_MS) -> DataFrame:
    """Published candles plus closed backfill candles newer than the last published one."""
    last = published.groupBy("product_id").agg(F.max("open_time").alias("_last"))
    fresh = (
        attach(closed_before(backfill, now_ms, length_ms), last, ["product_id"], "left")
        .where(F.col("_last").isNull() | (F.col("open_time") > F.col("_last")))
        .drop("_last")
    )
    return published.withColumn("reconciled", F.lit(False)).unionByName(
        fresh.withColumn("reconciled", F.lit(True))
    )


def dedupe_last(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key by ``version`` (an aggregate, so repeats fold map-side)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), version).alias("_r"))
        .select(*keys, "_r.*")
        .select(*df.columns)
    )


def tail_rows(numbered: DataFrame, n: int, keys: list[str] | None = None, row: str = "row_idx") -> DataFrame:
    """Last n rows of each numbered series: compares with the series length, no sort."""
    keys = keys or ["product_id"]
    ends = numbered.groupBy(*keys).agg((F.max(row) + 1).alias("_len"))
    return attach(numbered, ends, keys).where(F.col(row) >= F.col("_len") - n).drop("_len")


def top_k(df: DataFrame, k: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """First k rows in an order, overall or per group. Per group, Spark's
    window-group limit keeps at most k rows per group and task before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")
