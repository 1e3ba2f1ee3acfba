"""Candle files and feeds to the candle schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div
from tapeflow.functions.text import to_epoch_ms
from tapeflow.operators.candles import dedupe_last

# Accepted spellings of candle columns.
ALIASES = {
    "open_time": ("timestamp", "time", "date", "start"),
    "product_id": ("symbol", "product"),
    "volume": ("vol",),
    "trade_count": ("trades", "num_trades", "number_of_trades"),
    "close_time": ("end",),
}
# Header-less daily kline and aggregate-trade file layouts.
KLINE_SCHEMA = (
    "open_time STRING, open STRING, high STRING, low STRING, close STRING, volume STRING, close_time STRING, "
    "quote_volume STRING, trade_count STRING, taker_buy_base_vol STRING, taker_buy_quote_vol STRING, ignore STRING"
)
AGG_TRADE_SCHEMA = (
    "agg_trade_id STRING, price STRING, qty STRING, first_trade_id STRING, last_trade_id STRING, "
    "transact_time STRING, is_buyer_maker STRING, is_best_match STRING"
)


def read_candles_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by suffix."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported candle file: {path}")


def rename_aliases(df: DataFrame) -> DataFrame:
    names = {c.lower().strip(): c for c in df.columns}
    renames = {old: low for low, old in names.items() if old != low}
    df = df.withColumnsRenamed(renames)
    have = set(df.columns)
    for target, others in ALIASES.items():
        found = [o for o in others if o in have]
        if target not in have and found:
            df = df.withColumnRenamed(found[0], target)
    return df


def normalize_candles(raw: DataFrame, product_id: str | None = None, candle_seconds: int = 60) -> DataFrame:
    """Any candle frame to the candle schema: names, numbers, times, defaults, one row per key.

    The later input row wins a repeated key; ``load_seq`` gives the input order
    when present, else rows are taken in file order.
    """
    df = rename_aliases(raw)
    if "product_id" not in df.columns:
        if product_id is None:
            raise ValueError("product_id is missing")
        df = df.withColumn("product_id", F.lit(product_id))
    missing = [c for c in ("open_time", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"missing candle columns: {missing}")
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    if "load_seq" not in df.columns:
        df = df.withColumn("load_seq", F.monotonically_increasing_id())
    if dict(df.dtypes)["open_time"] == "string":
        df = df.withColumn("open_time", F.unix_millis(F.to_timestamp("open_time")))
    else:
        df = to_epoch_ms(df.withColumn("open_time", F.col("open_time").cast("bigint")), "open_time", "open_time")
    length = candle_seconds * 1_000
    close_time = F.col("open_time") + (length - 1)
    if "close_time" in df.columns:
        close_time = F.coalesce(F.col("close_time").cast("bigint"), close_time)
    count = F.coalesce(F.col("trade_count").cast("bigint"), F.lit(0)) if "trade_count" in df.columns else F.lit(0)
    numbers = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")}
    out = df.withColumns(numbers | {"close_time": close_time.cast("bigint"), "trade_count": count.cast("bigint")})
    cols = ["product_id", "open_time", "close_time", "open", "high", "low", "close", "volume", "trade_count"]
    kept = out.select(*cols, "load_seq").dropna(subset=["open_time", *numbers])
    return dedupe_last(kept, ["product_id", "open_time"], "load_seq").select(cols)


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Daily kline CSV: 12 columns without header, times in microseconds."""
    raw = spark.read.schema(KLINE_SCHEMA).option("mode", "DROPMALFORMED").csv(path)
    return klines_to_candles(raw)


def klines_to_candles(raw: DataFrame) -> DataFrame:
    """Typed candles in ms; rows with a bad number are skipped."""
    doubles = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol"]
    df = raw.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in doubles})
    df = df.withColumns({c: F.expr(f"try_cast({c} AS BIGINT)") for c in ("open_time", "close_time", "trade_count")})
    df = df.dropna(subset=["open_time", "open", "high", "low", "close", "volume"])
    return df.withColumns({"open_time": int_div("open_time", 1_000), "close_time": int_div("close_time", 1_000)})


def read_agg_trades(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate-trade CSV: price, size, ms time and aggressor side."""
    from tapeflow.operators.trade_flow import maker_side

    raw = spark.read.schema(AGG_TRADE_SCHEMA).csv(path)
    return raw.select(
        F.col("agg_trade_id").alias("trade_id"),
        F.expr("try_cast(price AS DOUBLE)").alias("price"),
        F.expr("try_cast(qty AS DOUBLE)").alias("size"),
        int_div(F.expr("try_cast(transact_time AS BIGINT)"), 1_000).alias("ts_ms"),
        maker_side("is_buyer_maker").alias("side"),
    ).dropna(subset=["price", "size", "ts_ms"])


def api_candles(raw: DataFrame, length_ms: int) -> DataFrame:
    """Exchange candles (start in seconds) to the candle schema, oldest first."""
    start = F.col("start").cast("bigint") * 1_000
    return raw.select(
        "product_id",
        start.alias("open_time"),
        (start + length_ms - 1).alias("close_time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.lit(0).cast("bigint").alias("trade_count"),
    ).orderBy("product_id", "open_time")


def decode_candle_maps(raw: DataFrame, fields: str = "fields") -> DataFrame:
    """String-map stream entries to typed candles; blank products are skipped."""

    def number(name: str, kind: str):
        return F.expr(f"try_cast({fields}['{name}'] AS {kind})")

    open_time = number("open_time", "BIGINT")
    return (
        raw.select(
            F.upper(F.trim(F.col(fields)["product_id"])).alias("product_id"),
            open_time.alias("open_time"),
            F.coalesce(number("close_time", "BIGINT"), open_time).alias("close_time"),
            *[number(c, "DOUBLE").alias(c) for c in ("open", "high", "low", "close")],
            F.coalesce(number("volume", "DOUBLE"), F.lit(0.0)).alias("volume"),
            F.coalesce(number("trade_count", "DOUBLE").cast("bigint"), F.lit(0)).alias("trade_count"),
        )
        .where(F.col("product_id").isNotNull() & (F.col("product_id") != ""))
    )


def decode_flow_maps(raw: DataFrame, metrics: list[str], fields: str = "fields") -> DataFrame:
    """String-map flow entries to typed metric rows; a missing metric is null."""
    return raw.select(
        F.upper(F.trim(F.col(fields)["product_id"])).alias("product_id"),
        F.expr(f"try_cast({fields}['open_time'] AS BIGINT)").alias("open_time"),
        *[F.expr(f"try_cast({fields}['{m}'] AS DOUBLE)").alias(m) for m in metrics],
    ).where(F.col("product_id").isNotNull() & (F.col("product_id") != ""))


def discover_history_files(spark: SparkSession, directories: list[str], bases: DataFrame) -> DataFrame:
    """First file per base by directory, then suffix, then path; 'missing_file' if none.

    Only paths are listed; file contents are not read.
    """
    found = None
    for rank, directory in enumerate(directories):
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.{csv,parquet,pq}")
            .option("recursiveFileLookup", "false")
            .load(directory)
            .select("path", F.lit(rank).alias("dir_rank"))
        )
        found = files if found is None else found.unionByName(files)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    listed = found.select(
        F.upper(F.regexp_extract(name, "^([A-Za-z0-9]+)", 1)).alias("base"),
        F.struct("dir_rank", F.array_position(F.array(*map(F.lit, ("csv", "parquet", "pq"))), suffix).alias("kind"), "path").alias("at"),
    )
    first = listed.groupBy("base").agg(F.min("at").alias("at"))
    return bases.join(first, "base", "left").select(
        "base", F.col("at.path").alias("path"), F.when(F.col("at").isNull(), "missing_file").otherwise("ok").alias("status")
    )


def write_candles(candles: DataFrame, path: str, last_n: int | None = None, dry_run: bool = False) -> DataFrame:
    """Write candles oldest first, optionally just the last N; returns the load summary."""
    chosen = candles if last_n is None else candles.orderBy(F.col("open_time").desc(), "product_id").limit(last_n)
    if not dry_run:
        chosen.write.mode("append").parquet(path)
    return load_summary(chosen)


def load_summary(candles: DataFrame) -> DataFrame:
    return candles.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("product_id").alias("products"),
        F.min("open_time").alias("min_open_time"),
        F.max("open_time").alias("max_open_time"),
    )
