"""Queries that write files from the given tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.functions.columns import rounded
from tapeflow.functions.names import CANDLE, TRADE_FLOW
from tapeflow.plans.catalog.candles import CANDLE_SQL
from tapeflow.plans.registry import query, r6, rnd
from tapeflow.plans.views import HOUR, Inputs
from tapeflow.sources import candles as S
from tapeflow.sources import registry as R
from tapeflow.sources import sinks as K
from tapeflow.sources import store as H
from tapeflow.streaming.base import new_folder

SCHEMA = "product_id string, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, trade_count bigint"


@query(
    "read_candles_file",
    f"SELECT {CANDLE_SQL}, 'csv' AS kind FROM candles UNION ALL SELECT {CANDLE_SQL}, 'pq' FROM candles",
    ("candles",),
)
def read_candles_file(x: Inputs):
    table, folder = x.candle_table(), new_folder(x.spark, "files")
    table.write.option("header", True).csv(f"{folder}/BTC.csv")
    table.write.parquet(f"{folder}/BTC.pq")
    csv = S.read_candles_file(x.spark, f"{folder}/BTC.csv", SCHEMA).withColumn("kind", F.lit("csv"))
    return rounded(csv.unionByName(S.read_candles_file(x.spark, f"{folder}/BTC.pq").withColumn("kind", F.lit("pq"))))


@query(
    "read_agg_trades",
    f"SELECT trade_id, {r6('price', 'size')}, ts_ms, side FROM trades WHERE event_id % 17 <> 0",
    ("trades",),
)
def read_agg_trades(x: Inputs):
    t, folder = x.trades(), new_folder(x.spark, "agg")
    text = t.select(
        "trade_id", F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.col("price").cast("string")).alias("price"), F.col("size").cast("string"),
        F.col("trade_id").alias("f"), F.col("trade_id").alias("l"), (F.col("ts_ms") * 1000).cast("string").alias("t"),
        F.when(F.col("side") == "BUY", "False").otherwise("True").alias("m"), F.lit("True").alias("b"),
    )
    text.write.csv(folder)
    return rounded(S.read_agg_trades(x.spark, folder))


@query(
    "discover_history_files",
    """SELECT DISTINCT upper(event_type) AS base, CASE WHEN event_type < 'e' THEN 'ok' WHEN event_type > 's' THEN 'ok' ELSE 'missing_file' END AS status,
         CASE WHEN event_type < 'e' THEN 'first' WHEN event_type > 's' THEN 'second' END AS folder FROM events""",
)
def discover_history_files(x: Inputs):
    """Two folders of per-base files; the first folder wins, csv before parquet."""
    folder = new_folder(x.spark, "history")
    ev = x.table("events").select(F.upper("event_type").alias("base"), F.col("event_type").alias("t"))
    names = ev.distinct().select("base", "t")
    # One file per base: the rows of a base become the text of its file.
    for i, (place, keep) in enumerate((("first", F.col("t") < "e"), ("second", (F.col("t") < "e") | (F.col("t") > "s")))):
        for r in names.where(keep).collect():
            path = f"{folder}/{place}/{r.base}-USD.{('parquet', 'csv')[i]}"
            fs = x.spark._jvm.org.apache.hadoop.fs.Path(path)
            out = fs.getFileSystem(x.spark._jsc.hadoopConfiguration()).create(fs)
            out.write(bytearray(r.t, "utf8"))  # Spark does not list empty files
            out.close()
    found = S.discover_history_files(x.spark, [f"{folder}/first", f"{folder}/second"], names.select("base"))
    return found.select("base", "status", F.element_at(F.split("path", "/"), -2).alias("folder"))


@query(
    "export_session",
    f"SELECT {CANDLE_SQL} FROM candles",
    ("candles",),
)
def export_session(x: Inputs):
    folder = new_folder(x.spark, "session")
    K.export_session({"candles": x.candle_table()}, folder)
    back = x.spark.read.schema(SCHEMA + ", product string").option("header", True).csv(f"{folder}/candles_by_product")
    return rounded(back.drop("product"))


@query(
    "read_registry",
    f"SELECT registry_key, CAST(model_seq AS VARCHAR) AS model_id, {r6('auc_val', 'sharpe')}, buy_support, promoted FROM model_records",
    ("model_records",),
)
def read_registry(x: Inputs):
    """Registry files with one JSON array per asset (a bounded list of models)."""
    root = new_folder(x.spark, "registry")
    rec = x.model_records().withColumn(
        "r",
        F.struct(
            F.col("model_seq").cast("string").alias("model_id"), F.lpad(F.col("model_seq").cast("string"), 12, "0").alias("created_at"),
            F.struct("auc_val", "sharpe", "buy_support").alias("metrics"), "promoted",
        ),
    )
    for r in rec.groupBy("registry_key").agg(F.to_json(F.collect_list("r")).alias("text")).toLocalIterator():
        path = x.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r.registry_key}/registry.json")
        out = path.getFileSystem(x.spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(r.text, "utf8"))
        out.close()
    return rounded(R.read_registry(x.spark, root).select("registry_key", "model_id", "auc_val", "sharpe", "buy_support", "promoted"))


@query(
    "upsert_frame",
    f"""SELECT product_id, open_time, close_time, {r6('open', 'high', 'low', 'close', 'volume')}, CASE WHEN (open_time // 3600000) % 4 = 0 THEN 0 ELSE trade_count END AS trade_count FROM candles""",
    ("candles",),
)
def upsert_frame(x: Inputs):
    path = new_folder(x.spark, "table")
    hour = (F.col("open_time") / HOUR).cast("bigint")
    raw = x.candle_table().withColumns(
        {"product_id": F.lower("product_id"), "trade_count": F.when(hour % 4 == 0, "none").otherwise(F.col("trade_count").cast("string"))}
    )
    H.upsert_table(x.spark, path, H.checked_candles(raw), CANDLE)
    return rounded(x.spark.read.parquet(path).select(*CANDLE))


@query(
    "evolve_order_flow_schema",
    f"""SELECT product_id, open_time, {r6('buy_aggressive_volume', 'volume_delta')}, CASE WHEN (open_time // 3600000) % 7 = 0 THEN {rnd('trade_vwap')} END AS trade_vwap FROM minute_flow""",
    ("minute_flow",),
)
def evolve_order_flow_schema(x: Inputs):
    """A metric that appears later is null in the rows stored before."""
    from tapeflow.operators.trade_flow import historical_flow
    from tapeflow.session import staged

    path = new_folder(x.spark, "flow")
    flow = staged(historical_flow(x.trades(), HOUR))
    key = ["product_id", "open_time"]
    H.upsert_table(x.spark, path, flow.select(*key, "buy_aggressive_volume", "volume_delta"), TRADE_FLOW)
    later = flow.where((F.col("open_time") / HOUR).cast("bigint") % 7 == 0)
    H.upsert_table(x.spark, path, later.select(*key, "buy_aggressive_volume", "volume_delta", "trade_vwap"), TRADE_FLOW)
    return rounded(x.spark.read.option("mergeSchema", True).parquet(path).drop("base_asset").select(*key, "buy_aggressive_volume", "volume_delta", "trade_vwap"))


@query(
    "dataset_limits",
    "SELECT product_id, count(*) AS rows FROM (SELECT product_id FROM candles ORDER BY open_time DESC, product_id LIMIT 500) GROUP BY 1",
    ("candles",),
)
def dataset_limits(x: Inputs):
    """The last-N limit of a candle import, written and counted."""
    path = new_folder(x.spark, "import")
    S.write_candles(x.candle_table(), path, last_n=500)
    return x.spark.read.parquet(path).groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"))
