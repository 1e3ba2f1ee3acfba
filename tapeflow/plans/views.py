"""Market-data inputs derived from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.columns import epoch_ms
from tapeflow.functions.series import number_rows
from tapeflow.operators.candles import build_candles, with_current_bucket
from tapeflow.session import staged

HOUR = 3_600_000
# Candle blocks of the checks: whole blocks of hourly candles.
CANDLE_SPAN = HOUR * 8_192
FEE = 0.05

# name -> (SQL, views it reads)
SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "trades": (
        """
        SELECT upper(event_type) || '-USD' AS product_id, CAST(event_id AS VARCHAR) AS trade_id,
               value AS price,
               1.0e0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10.0e0 AS size,
               CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
               epoch_us(ts) // 1000 AS ts_ms,
               2 * (event_id + CASE WHEN event_id % 10 = 0 THEN 15 ELSE 0 END)
                 + CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS arrival_seq,
               event_id, user_id
        FROM events
        """,
        (),
    ),
    "arrived": (
        """
        SELECT *, ts_ms // 3600000 * 3600000 AS bucket,
               max(ts_ms // 3600000 * 3600000) OVER (PARTITION BY product_id ORDER BY arrival_seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current
        FROM trades
        """,
        ("trades",),
    ),
    "candles": (
        """
        SELECT product_id, bucket AS open_time, bucket + 3600000 - 1 AS close_time,
               arg_min(price, arrival_seq) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, arrival_seq) AS close, sum(size) AS volume, count(*) AS trade_count
        FROM arrived WHERE current IS NULL OR bucket >= current GROUP BY product_id, bucket
        """,
        ("arrived",),
    ),
    "numbered": (
        "SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY open_time) - 1 AS row_idx FROM candles",
        ("candles",),
    ),
    "exits": (
        """
        SELECT upper(event_type) || '-USD' AS product_id, epoch_us(ts) // 1000 AS ts_ms,
               CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN 'stop_loss_hit'
                 WHEN 1 THEN 'take_profit_hit' WHEN 2 THEN 'max_hold_hit' ELSE 'signal_exit_long' END AS reason,
               (value - 50.0e0) / 50.0e0 AS pnl_pct, CAST(user_id % 40 AS DOUBLE) AS holding_minutes, event_id
        FROM events
        """,
        (),
    ),
    "signals": (
        """
        SELECT upper(event_type) || '-USD' AS product_id, epoch_us(ts) // 1000 AS ts_ms,
               least(value / 100.0e0, 1.0e0) AS prob_buy,
               CASE WHEN value >= 62 THEN 'BUY' WHEN value <= 38 THEN 'EXIT_LONG' ELSE 'HOLD' END AS signal,
               user_id % 7 <> 0 AS actionable,
               CASE WHEN user_id % 7 <> 0 THEN 'ok' WHEN user_id % 14 = 0 THEN 'no_model'
                 ELSE 'base_not_enabled' END AS reason, event_id, user_id
        FROM events
        """,
        (),
    ),
    "scored": (
        """
        SELECT upper(event_type) || '-USD' AS product_id, event_id AS row_idx,
               ((event_id * 7919) % 1000) / 1000.0e0 AS prob, CAST(user_id % 2 AS INT) AS target,
               (value - 50.0e0) / 5000.0e0 AS target_return
        FROM events
        """,
        (),
    ),
    "model_records": (
        """
        SELECT 'a' || CAST(c_custkey % 24 AS VARCHAR) || '_usd' AS registry_key, c_custkey AS model_seq,
               0.45e0 + (c_custkey % 20) / 100.0e0 AS auc_val, c_acctbal / 2500.0e0 AS sharpe,
               (c_custkey % 11) / 10.0e0 AS precision_buy, (c_custkey % 30) / 100.0e0 AS max_drawdown,
               CAST(c_custkey % 60 AS INT) AS buy_support, 0.5e0 + (c_custkey % 30) / 100.0e0 AS buy_threshold,
               c_custkey % 3 <> 0 AS entry_ready, c_custkey % 50 = 0 AS promoted
        FROM customer
        """,
        (),
    ),
    "products": (
        """
        SELECT 'B' || CAST(s_suppkey % 60 AS VARCHAR) || '-' || CASE s_nationkey % 3 WHEN 0 THEN 'USD'
                 WHEN 1 THEN 'USDC' ELSE 'USDT' END AS product_id,
               'SPOT' AS product_type, 'B' || CAST(s_suppkey % 60 AS VARCHAR) AS base_asset,
               CASE s_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'USDC' ELSE 'USDT' END AS quote_asset,
               CASE WHEN s_suppkey % 17 = 0 THEN 'offline' ELSE 'online' END AS status,
               s_suppkey % 13 = 0 AS trading_disabled, s_suppkey % 11 = 0 AS limit_only,
               greatest(s_acctbal, 0.0e0) * 1000.0e0 AS quote_volume_24h,
               (s_suppkey * 7) % 400 AS listing_age_days,
               CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_nationkey + 1) / 5000.0e0 END AS spread_pct, s_suppkey
        FROM supplier
        """,
        (),
    ),
    "l2_updates": (
        """
        SELECT l_returnflag || '-USD' AS product_id, epoch_us(l_shipdate) // 1000 AS window_ms,
               row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                 l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
               CASE WHEN l_suppkey % 2 = 0 THEN 'bid' ELSE 'offer' END AS side,
               CASE WHEN l_suppkey % 2 = 0 THEN 100.0e0 - (l_partkey % 40) / 100.0e0
                    ELSE 100.01e0 + (l_partkey % 40) / 100.0e0 END AS price_level,
               CASE WHEN l_discount = 0 THEN 0.0e0 ELSE l_quantity END AS new_quantity,
               CASE WHEN l_linestatus = 'O' THEN l_quantity / 10.0e0 ELSE 0.0e0 END AS buy_volume,
               CASE WHEN l_linestatus = 'F' THEN l_quantity / 10.0e0 ELSE 0.0e0 END AS sell_volume
        FROM lineitem
        """,
        (),
    ),
    "klines": (
        """
        SELECT product_id, ts_ms // 3600000 * 3600000 * 1000 AS open_time_us,
               arg_min(price, arrival_seq) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, arrival_seq) AS close, sum(size) AS volume,
               sum(price * size) AS quote_volume, count(*) AS trade_count,
               coalesce(sum(size) FILTER (side = 'BUY'), 0e0) AS taker_buy_base_vol,
               coalesce(sum(price * size) FILTER (side = 'BUY'), 0e0) AS taker_buy_quote_vol
        FROM trades GROUP BY product_id, ts_ms // 3600000
        """,
        ("trades",),
    ),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a SELECT with the views it reads, as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in SQL_VIEWS[name][1]:
            add(dep)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][0]})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Inputs:
    """The same views as DataFrames over the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _events(self) -> DataFrame:
        return self.table("events").withColumn("product_id", F.concat(F.upper("event_type"), F.lit("-USD")))

    def trades(self) -> DataFrame:
        tenth = F.col("event_id") % 10 == 0
        return self._events().select(
            "product_id",
            F.col("event_id").cast("string").alias("trade_id"),
            F.col("value").alias("price"),
            (F.lit(1.0) + F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 10.0).alias("size"),
            F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            epoch_ms("ts").alias("ts_ms"),
            (
                2 * (F.col("event_id") + F.when(tenth, 15).otherwise(0)) + F.when(tenth, 0).otherwise(1)
            ).cast("bigint").alias("arrival_seq"),
            "event_id",
            "user_id",
        )

    def arrived(self) -> DataFrame:
        return with_current_bucket(self.trades(), HOUR)

    def candles(self) -> DataFrame:
        return build_candles(self.trades(), HOUR)

    def candle_table(self) -> DataFrame:
        """Candles as a stored table, for plans that read them more than once."""
        return staged(self.candles())

    def numbered(self) -> DataFrame:
        return number_rows(self.candle_table(), ["product_id"], "open_time", CANDLE_SPAN)

    def exits(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 4
        return self._events().select(
            "product_id",
            epoch_ms("ts").alias("ts_ms"),
            F.when(k == 0, "stop_loss_hit").when(k == 1, "take_profit_hit").when(k == 2, "max_hold_hit")
            .otherwise("signal_exit_long").alias("reason"),
            ((F.col("value") - 50.0) / 50.0).alias("pnl_pct"),
            (F.col("user_id") % 40).cast("double").alias("holding_minutes"),
            "event_id",
        )

    def signals(self) -> DataFrame:
        ok = F.col("user_id") % 7 != 0
        return self._events().select(
            "product_id",
            epoch_ms("ts").alias("ts_ms"),
            F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob_buy"),
            F.when(F.col("value") >= 62, "BUY").when(F.col("value") <= 38, "EXIT_LONG").otherwise("HOLD").alias("signal"),
            ok.alias("actionable"),
            F.when(ok, "ok").when(F.col("user_id") % 14 == 0, "no_model").otherwise("base_not_enabled").alias("reason"),
            "event_id",
            "user_id",
        )

    def scored(self) -> DataFrame:
        return self._events().select(
            "product_id",
            F.col("event_id").alias("row_idx"),
            (((F.col("event_id") * 7919) % 1000) / 1000.0).alias("prob"),
            (F.col("user_id") % 2).cast("int").alias("target"),
            ((F.col("value") - 50.0) / 5000.0).alias("target_return"),
        )

    def model_records(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("a"), (k % 24).cast("string"), F.lit("_usd")).alias("registry_key"),
            k.alias("model_seq"),
            (0.45 + (k % 20) / 100.0).alias("auc_val"),
            (F.col("c_acctbal") / 2500.0).alias("sharpe"),
            ((k % 11) / 10.0).alias("precision_buy"),
            ((k % 30) / 100.0).alias("max_drawdown"),
            (k % 60).cast("int").alias("buy_support"),
            (0.5 + (k % 30) / 100.0).alias("buy_threshold"),
            (k % 3 != 0).alias("entry_ready"),
            (k % 50 == 0).alias("promoted"),
        )

    def products(self) -> DataFrame:
        s = F.col("s_suppkey")
        base = F.concat(F.lit("B"), (s % 60).cast("string"))
        q = F.col("s_nationkey") % 3
        quote = F.when(q == 0, "USD").when(q == 1, "USDC").otherwise("USDT")
        return self.table("supplier").select(
            F.concat(base, F.lit("-"), quote).alias("product_id"),
            F.lit("SPOT").alias("product_type"),
            base.alias("base_asset"),
            quote.alias("quote_asset"),
            F.when(s % 17 == 0, "offline").otherwise("online").alias("status"),
            (s % 13 == 0).alias("trading_disabled"),
            (s % 11 == 0).alias("limit_only"),
            (F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 1000.0).alias("quote_volume_24h"),
            ((s * 7) % 400).alias("listing_age_days"),
            F.when(s % 9 == 0, F.lit(None)).otherwise((F.col("s_nationkey") + 1) / 5000.0).cast("double").alias("spread_pct"),
            "s_suppkey",
        )

    def l2_updates(self) -> DataFrame:
        # The table has no arrival number; one is built from its sort columns
        # within each day, then offset by the rows of earlier days.
        from tapeflow.operators.book import number_by_window

        bid = F.col("l_suppkey") % 2 == 0
        cents = (F.col("l_partkey") % 40) / 100.0
        rows = self.table("lineitem").select(
            F.concat(F.col("l_returnflag"), F.lit("-USD")).alias("product_id"),
            epoch_ms("l_shipdate").alias("window_ms"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax",
            ).alias("_sort"),
            F.when(bid, "bid").otherwise("offer").alias("side"),
            F.when(bid, 100.0 - cents).otherwise(100.01 + cents).alias("price_level"),
            F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("new_quantity"),
            F.when(F.col("l_linestatus") == "O", F.col("l_quantity") / 10.0).otherwise(0.0).alias("buy_volume"),
            F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 10.0).otherwise(0.0).alias("sell_volume"),
        )
        return number_by_window(rows, "window_ms", "_sort").drop("_sort")

    def book_updates(self) -> DataFrame:
        """Level updates with the operators' column names, as a stored table."""
        return staged(
            self.l2_updates().withColumnsRenamed({"price_level": "price", "new_quantity": "size"})
        )

    @staticmethod
    def book_windows(updates: DataFrame) -> DataFrame:
        return updates.groupBy("product_id", "window_ms").agg(
            F.sum("buy_volume").alias("buy_volume"),
            F.sum("sell_volume").alias("sell_volume"),
            ((F.count(F.lit(1)) % 7 - 3) / 4000.0).alias("price_change"),
        )

    def klines(self) -> DataFrame:
        buy = F.col("side") == "BUY"
        hour = F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR))
        return (
            self.trades()
            .groupBy("product_id", (hour * 1000).alias("open_time_us"))
            .agg(
                F.min_by("price", "arrival_seq").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "arrival_seq").alias("close"),
                F.sum("size").alias("volume"),
                F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
                F.count(F.lit(1)).alias("trade_count"),
                F.sum(F.when(buy, F.col("size")).otherwise(0.0)).alias("taker_buy_base_vol"),
                F.sum(F.when(buy, F.col("price") * F.col("size")).otherwise(0.0)).alias("taker_buy_quote_vol"),
            )
        )
