"""Exchange feed messages (JSON text) to trades, book updates and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div, yes
from tapeflow.functions.series import running
from tapeflow.functions.text import time_to_ms

TRADE = "STRUCT<trade_id: STRING, product_id: STRING, price: STRING, size: STRING, side: STRING, time: STRING, trade_time: STRING>"
UPDATE = "STRUCT<side: STRING, price_level: STRING, new_quantity: STRING>"
MESSAGE = (
    "channel STRING, sequence_num BIGINT, timestamp STRING, product_id STRING, "
    f"events ARRAY<STRUCT<type: STRING, product_id: STRING, heartbeat_counter: BIGINT, trades: ARRAY<{TRADE}>, "
    f"updates: ARRAY<{UPDATE}>>>, trades ARRAY<{TRADE}>"
)


def parse_messages(raw: DataFrame, text: str = "value") -> DataFrame:
    """Add the parsed message; bad JSON gives null fields and no rows later on.

    The explode of one element keeps the parse one step: else the optimizer copies it into each later filter and field.
    """
    return raw.withColumn("m", F.explode(F.array(F.from_json(text, MESSAGE))))


def feed_trades(messages: DataFrame) -> DataFrame:
    """Trades of a top-level ``trades`` list, or else of each event; a missing id is numbered inside its list."""
    lists = F.when(F.col("m.trades").isNotNull(), F.array("m.trades")).otherwise(F.transform(F.col("m.events"), lambda e: e["trades"]))
    rest = [c for c in messages.columns if c != "m"]
    numbered = F.flatten(F.transform(lists, lambda l: F.transform(F.coalesce(l, F.array().cast(f"ARRAY<{TRADE}>")), lambda t, i: F.struct(i.alias("idx"), t.alias("t")))))
    own = [F.col(f"m.{c}").alias(f"_{c}") for c in ("sequence_num", "product_id", "timestamp")]
    rows = messages.select(*rest, *own, F.explode(numbered).alias("_e")).select(*rest, "_sequence_num", "_product_id", "_timestamp", "_e.*")
    number = F.when(F.col("_sequence_num") != 0, F.concat_ws(":", F.col("_sequence_num").cast("string"), F.col("idx").cast("string")))
    return rows.select(
        *rest,
        F.coalesce("t.product_id", "_product_id").alias("product_id"),
        F.coalesce(F.nullif(F.col("t.trade_id"), F.lit("")), number, F.col("t.trade_id")).alias("trade_id"),
        F.col("t.price").alias("price"),
        F.col("t.size").alias("size"),
        F.col("t.side").alias("side"),
        time_to_ms(F.coalesce(F.nullif("t.time", F.lit("")), F.nullif("t.trade_time", F.lit("")), "_timestamp")).alias("ts_ms"),
    )


def feed_book_updates(messages: DataFrame, channel: str = "l2_data") -> DataFrame:
    """Level rows of snapshots and updates; rows without price or quantity are skipped."""
    rest = [c for c in messages.columns if c != "m"]
    return (
        messages.where(F.lower("m.channel") == channel)
        .select(*rest, F.col("m.sequence_num").alias("sequence_num"), F.explode("m.events").alias("e"))
        .select(
            *rest, "sequence_num", F.col("e.product_id").alias("product_id"),
            (F.lower("e.type") == "snapshot").alias("is_snapshot"), F.explode("e.updates").alias("u"),
        )
        .where(F.col("u.price_level").isNotNull() & F.col("u.new_quantity").isNotNull())
        .select(
            *rest, "sequence_num", "product_id", "is_snapshot", F.col("u.side").alias("side"),
            F.col("u.price_level").cast("double").alias("price"), F.col("u.new_quantity").cast("double").alias("size"),
        )
    )


def message_products(m: str = "m") -> Column:
    """Distinct products of a message in first-seen order, else the message's own."""
    events = F.coalesce(F.col(f"{m}.events"), F.array())
    named = F.flatten(
        F.transform(
            events,
            lambda e: F.concat(
                F.array(e["product_id"]),
                F.coalesce(F.transform(e["trades"], lambda t: t["product_id"]), F.array().cast("array<string>")),
            ),
        )
    )
    found = F.array_distinct(F.filter(named, lambda p: p.isNotNull() & (p != "")))
    own = F.filter(F.array(F.col(f"{m}.product_id")), lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(own)


def sequence_gaps(messages: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Gaps of the per-connection sequence: connection_key, arrival_seq,
    sequence_num, is_snapshot in; rows with last_sequence and gap_size out.

    A snapshot restarts the count: the running maximum is taken per snapshot
    epoch, and numbers that do not advance it are ignored.
    """
    keys = ["connection_key"]
    seen = messages.where(F.col("sequence_num") > 0)
    pos = int_div("arrival_seq", block)
    epochs = running(
        seen, keys=keys, order=["arrival_seq"], block=pos,
        specs={"epoch": ("sum", F.col("is_snapshot").cast("bigint"))},
    )
    last = running(
        epochs, keys=[*keys, "epoch"], order=["arrival_seq"], block=pos,
        specs={"last_sequence": ("max", "sequence_num")}, exclusive=True,
    )
    return last.where(yes(F.col("sequence_num") > F.col("last_sequence") + 1) & ~F.col("is_snapshot")).withColumn(
        "gap_size", F.col("sequence_num") - F.col("last_sequence") - 1
    ).drop("epoch")


def heartbeat_gaps(beats: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Missed heartbeats per connection session: (connection_key, session,
    arrival_seq, counter) in; rows with the previous counter and missed out."""
    last = running(
        beats.where(F.col("counter") > 0), keys=["connection_key", "session"], order=["arrival_seq"],
        block=int_div("arrival_seq", block), specs={"last_counter": ("last", "counter")}, exclusive=True,
    )
    return last.where(yes(F.col("counter") > F.col("last_counter") + 1)).withColumn(
        "missed", F.col("counter") - F.col("last_counter") - 1
    )


def last_heartbeat(m: str = "m") -> Column:
    """Last positive heartbeat counter of a message."""
    counters = F.filter(F.transform(F.col(f"{m}.events"), lambda e: e["heartbeat_counter"]), lambda c: c > 0)
    return F.try_element_at(counters, F.lit(-1))


def split_errors(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid trades, and the others as (error_type, payload JSON)."""
    from tapeflow.operators.candles import valid_trades

    ok = (
        (F.expr("try_cast(price AS DOUBLE)") > 0)
        & (F.expr("try_cast(size AS DOUBLE)") > 0)
        & (F.expr("try_cast(ts_ms AS BIGINT)") > 0)
    )
    bad = trades.where(~yes(ok)).select(
        F.lit("collector.invalid_payload").alias("error_type"), F.to_json(F.struct(*trades.columns)).alias("payload")
    )
    return valid_trades(trades), bad
