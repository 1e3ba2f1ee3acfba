"""Session exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_session(streams: dict[str, DataFrame], folder: str, by_product: tuple[str, ...] = ("candles",)) -> None:
    """One CSV table per stream; candle tables also one folder per product."""
    for name, df in streams.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        if name in by_product:
            copy = df.withColumn("product", F.col("product_id"))
            copy.write.mode("overwrite").option("header", True).partitionBy("product").csv(f"{folder}/{name}_by_product")


def write_report(results: DataFrame, top: DataFrame, folder: str) -> None:
    """Screen results as JSON lines and the ranked table as CSV."""
    results.write.mode("overwrite").json(f"{folder}/results")
    top.write.mode("overwrite").option("header", True).csv(f"{folder}/top")
