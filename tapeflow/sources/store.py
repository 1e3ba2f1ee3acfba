"""History tables: upserts, loads, joins and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div, ratio
from tapeflow.functions.names import CANDLE, FLOW_RAW
from tapeflow.functions.text import base_asset
from tapeflow.operators.candles import dedupe_last
from tapeflow.session import staged

KEY = ["product_id", "open_time"]
DAY, DAY_MS = "open_day", 86_400_000
PARTITION = ["base_asset", DAY]


def with_base(df: DataFrame) -> DataFrame:
    """Upper-case product and its base asset, the table's partition column."""
    return df.withColumn("product_id", F.upper(F.trim("product_id"))).withColumn("base_asset", base_asset("product_id"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Existing rows replaced or extended by incoming ones. Columns new to either
    side are null on the other; ``load_seq`` on the incoming side orders repeats."""
    keys = keys or KEY
    new = with_base(incoming)
    if "load_seq" not in new.columns:
        new = new.withColumn("load_seq", F.lit(1))
    old = with_base(existing).withColumn("load_seq", F.lit(-1).cast("bigint"))
    both = old.unionByName(new.withColumn("load_seq", F.col("load_seq").cast("bigint")), allowMissingColumns=True)
    return dedupe_last(both, keys, "load_seq").drop("load_seq")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether anything was written to a path, in whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(target) and len(store.listStatus(target)) > 0


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, columns: list[str]) -> None:
    """Upsert into a Parquet table partitioned by base asset and day.

    Only the days of the incoming rows are read and rewritten, so a load costs what it brings and not the history.
    """
    rows = with_base(incoming.select(*[c for c in incoming.columns if c in {*columns, *KEY, "load_seq"}]))
    rows = staged(rows.withColumn(DAY, int_div("open_time", DAY_MS).cast("int")))
    if has_files(spark, path):
        touched = rows.select(*PARTITION).distinct()
        merged = upsert(spark.read.option("mergeSchema", True).parquet(path).join(touched, PARTITION, "left_semi"), rows)
    else:
        merged = dedupe_last(rows if "load_seq" in rows.columns else rows.withColumn("load_seq", F.lit(1)), KEY, "load_seq").drop("load_seq")
    (
        staged(merged)  # the write replaces files the plan reads
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION)
        .parquet(path)
    )


def flow_rows(flow: DataFrame) -> DataFrame:
    """Flow rows with all 51 metric columns; a missing metric is null."""
    have = set(flow.columns)
    return flow.select(
        *KEY, *[F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in FLOW_RAW]
    )


def checked_candles(df: DataFrame) -> DataFrame:
    """Bulk-load check: required columns, casts, missing trade counts as 0."""
    missing = [c for c in CANDLE if c not in df.columns and c != "trade_count"]
    if missing:
        raise ValueError(f"missing candle columns: {missing}")
    count = F.expr("try_cast(trade_count AS DOUBLE)").cast("bigint") if "trade_count" in df.columns else F.lit(None)
    return df.select(
        F.upper(F.trim("product_id")).alias("product_id"),
        *[F.col(c).cast("bigint").alias(c) for c in ("open_time", "close_time")],
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.coalesce(count, F.lit(0)).cast("bigint").alias("trade_count"),
    )


def candles_with_flow(candles: DataFrame, flow: DataFrame, bases: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Candles left-joined with their flow rows; the candle's trade count wins."""
    raw = [c for c in FLOW_RAW if c in flow.columns and c not in candles.columns]
    if bases:
        candles = candles.where(base_asset("product_id").isin([b.upper() for b in bases]))
    joined = candles.join(flow.select(*KEY, *raw), KEY, "left")
    return joined.orderBy("open_time").limit(limit) if limit else joined


def load_record(df: DataFrame, by: list[str]) -> DataFrame:
    """Load metadata per source."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("product_id").alias("product_count"),
        F.min("open_time").alias("min_open_time"),
        F.max("open_time").alias("max_open_time"),
    )


def counts_by_base(candles: DataFrame) -> DataFrame:
    return candles.groupBy(base_asset("product_id").alias("base_asset")).agg(F.count(F.lit(1)).alias("rows"))


def distinct_bases(candles: DataFrame) -> DataFrame:
    return candles.select(base_asset("product_id").alias("base_asset")).distinct().orderBy("base_asset")


def underfilled(wanted: DataFrame, candles: DataFrame, need: int) -> DataFrame:
    """Products with fewer than ``need`` stored rows."""
    have = candles.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        wanted.join(have, "product_id", "left")
        .select("product_id", F.coalesce("n", F.lit(0)).alias("rows"))
        .where(F.col("rows") < need)
    )


def frame_summary(candles: DataFrame) -> DataFrame:
    return candles.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("product_id").alias("products"),
        F.min("open_time").alias("min_open_time"),
        F.max("open_time").alias("max_open_time"),
        F.avg(F.when(F.col("volume") <= 0, 1.0).otherwise(0.0)).alias("zero_volume_share"),
    )


def flow_coverage(flow: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Per column group: rows whose first column is set and not zero, in percent."""
    counted = flow.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) != 0).alias(g) for g, c in groups.items()]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(g).alias("column_group"), F.lit(c).alias("sample_col"), F.col(g).alias("non_null_rows")) for g, c in groups.items()])
    )
    return counted.select("total", rows.alias("_r")).select(
        "_r.*", F.round(ratio(F.col("_r.non_null_rows") * 100.0, F.col("total"), 0.0), 1).alias("pct_of_total")
    )


def history_status(candles: DataFrame, now_ms: int | Column, by: Column) -> DataFrame:
    now = now_ms if isinstance(now_ms, Column) else F.lit(int(now_ms))
    return (
        candles.groupBy(by.alias("asset"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("open_time").alias("latest_ms"))
        .withColumn("latest_ago_min", F.round((now - F.col("latest_ms")) / 60_000.0, 1))
    )
