"""Queries on sources, stores, keys and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapeflow.plans.sql_features  # noqa: F401
from tapeflow.functions import text as X
from tapeflow.functions.columns import epoch_ms, rounded
from tapeflow.functions.names import ALL_FEATURES, BOOK_CANCEL, CANDLE, FLOW_RAW, OHLCV_CATEGORY, TRADE_FLOW
from tapeflow.operators import candles as C
from tapeflow.operators import trade_flow as T
from tapeflow.plans.catalog.candles import CANDLE_SQL
from tapeflow.plans.registry import query, r6, rnd
from tapeflow.plans.views import HOUR, Inputs
from tapeflow.session import staged
from tapeflow.sources import candles as S
from tapeflow.sources import feed as M
from tapeflow.sources import store as H

HOUR_NO = "(open_time // 3600000)"


def hour_no():
    return (F.col("open_time") / HOUR).cast("bigint")


# ---------------------------------------------------------------- candle sources
@query(
    "normalize_candles",
    f"""WITH raw AS (SELECT *, 0 AS seq FROM candles UNION ALL
          SELECT * REPLACE (close * 1.01e0 AS close), 1 FROM candles WHERE {HOUR_NO} % 7 = 0)
        SELECT product_id, open_time, open_time + 3599999 AS close_time, {r6('open', 'high', 'low', 'close', 'volume')},
          CASE WHEN {HOUR_NO} % 4 = 0 THEN 0 ELSE trade_count END AS trade_count
        FROM raw WHERE {HOUR_NO} % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY product_id, open_time ORDER BY seq DESC) = 1""",
    ("candles",),
)
def normalize_candles(x: Inputs):
    first = x.candle_table().withColumn("load_seq", F.lit(0))
    again = first.where(hour_no() % 7 == 0).withColumn("close", F.col("close") * 1.01).withColumn("load_seq", F.lit(1))
    raw = first.unionByName(again).select(
        F.col("product_id").alias("Symbol"),
        (F.col("open_time") * 1000).alias("timestamp"),
        *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low", "close")],
        F.when(hour_no() % 11 == 0, F.lit(None)).otherwise(F.col("volume")).alias("vol"),
        F.when(hour_no() % 4 == 0, F.lit(None)).otherwise(F.col("trade_count")).alias("trades"),
        "load_seq",
    )
    return rounded(S.normalize_candles(raw, candle_seconds=3600))


@query(
    "to_epoch_ms",
    "SELECT event_id, epoch_us(ts) // 1000 AS from_us, epoch_us(ts) // 1000 AS from_ms, epoch_us(ts) // 1000000 * 1000 AS from_s FROM events",
)
def to_epoch_ms(x: Inputs):
    ev = x.table("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ev = ev.withColumns({"ms": F.expr("us div 1000"), "s": F.expr("us div 1000000")})
    for unit in ("us", "ms", "s"):
        ev = X.to_epoch_ms(ev, unit, f"from_{unit}")
    return ev.select("event_id", "from_us", "from_ms", "from_s")


@query(
    "read_klines",
    f"""SELECT product_id, open_time_us // 1000 AS open_time, {r6('open', 'high', 'low', 'close', 'volume', 'quote_volume', 'taker_buy_base_vol', 'taker_buy_quote_vol')}, trade_count
        FROM klines WHERE (open_time_us // 3600000000) % 6 <> 0""",
    ("klines",),
)
def read_klines(x: Inputs):
    bad = (F.col("open_time_us") / 3_600_000_000).cast("bigint") % 6 == 0
    numbers = ("high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_base_vol", "taker_buy_quote_vol")
    raw = x.klines().select(
        "product_id", F.col("open_time_us").cast("string").alias("open_time"),
        F.when(bad, "n/a").otherwise(F.col("open").cast("string")).alias("open"),
        *[F.col(c).cast("string").alias(c) for c in numbers],
        (F.col("open_time_us") + 3_599_999_999).cast("string").alias("close_time"),
    )
    return rounded(S.klines_to_candles(raw).drop("close_time"))


@query("parse_time_to_ms", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 1000 ELSE 0 END AS ms FROM events")
def parse_time_to_ms(x: Inputs):
    ms = epoch_ms("ts")
    k = F.col("event_id") % 4
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(k == 1, ms.cast("string")).when(k == 2, iso).when(k == 3, "soon")
    return x.table("events").select("event_id", X.time_to_ms(text).alias("ms"))


@query(
    "write_candles_stream",
    "SELECT count(*) AS rows, count(DISTINCT product_id) AS products, min(open_time) AS min_open_time, max(open_time) AS max_open_time FROM (SELECT * FROM candles ORDER BY open_time DESC, product_id LIMIT 500)",
    ("candles",),
)
def write_candles_stream(x: Inputs):
    return S.write_candles(x.candles(), "", last_n=500, dry_run=True)


@query(
    "decode_stream_strings",
    f"""SELECT product_id, open_time, CASE WHEN {HOUR_NO} % 3 = 0 THEN open_time ELSE close_time END AS close_time,
          {r6('open', 'high', 'low', 'close')}, {rnd(f"CASE WHEN {HOUR_NO} % 4 = 0 THEN 0e0 ELSE volume END")} AS volume,
          CASE WHEN {HOUR_NO} % 4 = 0 THEN 0 ELSE trade_count END AS trade_count
        FROM candles WHERE {HOUR_NO} % 13 <> 0""",
    ("candles",),
)
def decode_stream_strings(x: Inputs):
    h = hour_no()
    text = {c: F.col(c).cast("string") for c in CANDLE}
    text["product_id"] = F.when(h % 13 == 0, " ").otherwise(F.lower("product_id"))
    text["close_time"] = F.when(h % 3 != 0, F.col("close_time").cast("string"))
    text["volume"] = F.when(h % 4 != 0, F.col("volume").cast("string"))
    text["trade_count"] = F.when(h % 4 != 0, F.col("trade_count").cast("string"))
    entry = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in text.items()])), "map<string,string>")
    return rounded(S.decode_candle_maps(x.candles().select(entry.alias("fields"))))


@query(
    "normalize_api_candles",
    f"SELECT product_id, open_time, open_time + 3599999 AS close_time, {r6('open', 'high', 'low', 'close', 'volume')}, CAST(0 AS BIGINT) AS trade_count FROM candles",
    ("candles",),
)
def normalize_api_candles(x: Inputs):
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
    raw = x.candles().select("product_id", F.expr("open_time div 1000").cast("string").alias("start"), *text)
    return rounded(S.api_candles(raw, HOUR))


# ---------------------------------------------------------------- stores
UPSERT_SQL = f"""WITH v AS (SELECT *, -1 AS seq FROM candles WHERE {HOUR_NO} % 5 <> 0 UNION ALL
      SELECT * REPLACE (close * 1.01e0 AS close), 1 FROM candles WHERE {HOUR_NO} % 7 = 0)
    SELECT {CANDLE_SQL}, split_part(product_id, '-', 1) AS base_asset FROM v
    QUALIFY row_number() OVER (PARTITION BY product_id, open_time ORDER BY seq DESC) = 1"""


@query("upsert_candles", UPSERT_SQL, ("candles",))
def upsert_candles(x: Inputs):
    table = x.candle_table()
    batch = table.where(hour_no() % 7 == 0).withColumns(
        {"close": F.col("close") * 1.01, "product_id": F.lower("product_id")}
    )
    return rounded(H.upsert(table.where(hour_no() % 5 != 0), batch))


@query(
    "upsert_order_flow",
    f"""WITH v AS (SELECT product_id, open_time, {', '.join(TRADE_FLOW)}, -1 AS seq FROM minute_flow UNION ALL
          SELECT product_id, open_time, {', '.join('NULL' if c == 'max_trade_size' else c for c in TRADE_FLOW)}, 1 FROM minute_flow WHERE {HOUR_NO} % 7 = 0)
        SELECT product_id, open_time, {r6(*[c for c in TRADE_FLOW])}, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in FLOW_RAW if c not in TRADE_FLOW)},
          split_part(product_id, '-', 1) AS base_asset FROM v QUALIFY row_number() OVER (PARTITION BY product_id, open_time ORDER BY seq DESC) = 1""",
    ("minute_flow",),
)
def upsert_order_flow(x: Inputs):
    flow = T.historical_flow(x.trades(), HOUR)
    batch = flow.where(hour_no() % 7 == 0).drop("max_trade_size")
    return rounded(H.upsert(H.flow_rows(flow), H.flow_rows(batch)))


@query(
    "record_bootstrap_load",
    "SELECT split_part(product_id, '-', 1) AS source, count(*) AS row_count, count(DISTINCT product_id) AS product_count, min(open_time) AS min_open_time, max(open_time) AS max_open_time FROM candles GROUP BY 1",
    ("candles",),
)
def record_bootstrap_load(x: Inputs):
    return H.load_record(x.candles().withColumn("source", X.base_asset("product_id")), ["source"])


@query("row_count_by_base", "SELECT split_part(product_id, '-', 1) AS base_asset, count(*) AS rows FROM candles GROUP BY 1", ("candles",))
def row_count_by_base(x: Inputs):
    return H.counts_by_base(x.candles())


@query("distinct_bases", "SELECT DISTINCT split_part(product_id, '-', 1) AS base_asset FROM candles ORDER BY 1", ("candles",))
def distinct_bases(x: Inputs):
    return H.distinct_bases(x.candles())


@query(
    "underfilled_assets",
    """WITH w AS (SELECT DISTINCT product_id FROM trades UNION ALL SELECT DISTINCT 'N' || n_nationkey || '-USD' FROM nation),
         h AS (SELECT product_id, count(*) AS n FROM candles GROUP BY 1)
       SELECT product_id, coalesce(n, 0) AS rows FROM w LEFT JOIN h USING (product_id) WHERE coalesce(n, 0) < 345""",
    ("trades", "candles"),
)
def underfilled_assets(x: Inputs):
    extra = x.table("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("-USD")).alias("product_id"))
    wanted = x.trades().select("product_id").distinct().unionByName(extra)
    return H.underfilled(wanted, x.candles(), 345)


@query(
    "frame_summary",
    """SELECT count(*) AS rows, count(DISTINCT product_id) AS products, min(open_time) AS min_open_time, max(open_time) AS max_open_time,
         round(avg(CASE WHEN volume - 3 <= 0 THEN 1e0 ELSE 0e0 END), 6) AS zero_volume_share FROM candles""",
    ("candles",),
)
def frame_summary(x: Inputs):
    return rounded(H.frame_summary(x.candles().withColumn("volume", F.col("volume") - 3)))


GROUPS = {"trade": "buy_aggressive_volume", "spread": "spread", "book_depth": "bid_depth_top5", "book_dynamics": "ask_consumption_rate"}


@query(
    "flow_coverage",
    " UNION ALL ".join(
        f"SELECT '{g}' AS column_group, '{c}' AS sample_col, count(*) FILTER ({c} <> 0) AS non_null_rows, round(count(*) FILTER ({c} <> 0) * 100e0 / count(*), 1) AS pct_of_total FROM flow_raw"
        for g, c in GROUPS.items()
    ),
    ("flow_raw",),
)
def flow_coverage(x: Inputs):
    from tapeflow.plans.catalog.features import merged_flow

    return H.flow_coverage(merged_flow(x), GROUPS)


@query(
    "history_status",
    """SELECT split_part(product_id, '-', 1) AS asset, count(*) AS rows, max(open_time) AS latest_ms,
         round((1706745600000 - max(open_time)) / 60000e0, 1) AS latest_ago_min FROM candles GROUP BY 1""",
    ("candles",),
)
def history_status(x: Inputs):
    return H.history_status(x.candles(), 1_706_745_600_000, X.base_asset("product_id"))


@query(
    "stream_window_counts",
    "SELECT product_id, count(*) AS rows FROM candles WHERE open_time >= (SELECT max(open_time) FROM candles) - 4 * 3600000 GROUP BY 1",
    ("candles",),
)
def stream_window_counts(x: Inputs):
    from tapeflow.operators.reports import recent_counts

    table = x.candle_table()
    return recent_counts(table, "open_time", 4 * HOUR, table.agg(F.max("open_time").alias("now_ms")))


# ---------------------------------------------------------------- keys and text
@query(
    "base_asset",
    "SELECT event_id, upper(split_part(p, '-', 1)) AS base, upper(split_part(replace(trim(p), '/', '-'), '-', 1)) AS loose FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '-usd' WHEN 1 THEN event_type || '/USDT' ELSE event_type END AS p FROM events)",
)
def base_asset(x: Inputs):
    k = F.col("event_id") % 3
    p = F.when(k == 0, F.concat("event_type", F.lit("-usd"))).when(k == 1, F.concat("event_type", F.lit("/USDT"))).otherwise(F.col("event_type"))
    return x.table("events").select("event_id", X.base_asset(p).alias("base"), X.base_asset_loose(p).alias("loose"))


@query(
    "symbol_to_product_id",
    "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN upper(event_type) ELSE upper(event_type) || '-USD' END AS product_id FROM events",
)
def symbol_to_product_id(x: Inputs):
    k = F.col("event_id") % 3
    symbol = F.concat(F.lit(" "), F.lower("event_type"), F.when(k == 0, "USDT").when(k == 1, "USD").otherwise(""))
    return x.table("events").select("event_id", X.product_of_symbol(symbol).alias("product_id"))


CANDIDATES = [c for c in ALL_FEATURES if c not in BOOK_CANCEL]


@query(
    "candidate_features",
    f"SELECT name, known_rows FROM (SELECT {', '.join(f'count({c}) AS {c}' for c in CANDIDATES)} FROM flow_features) UNPIVOT (known_rows FOR name IN (*))",
    ("flow_features",),
)
def candidate_features(x: Inputs):
    """Catalog entries that are candidates, with how many rows know them."""
    from tapeflow.operators.flow_features import flow_features
    from tapeflow.operators.selection import feature_catalog
    from tapeflow.plans.catalog.features import merged_flow
    from tapeflow.plans.views import CANDLE_SPAN

    names = [r.name for r in feature_catalog(x.spark).where("candidate").collect()]  # the catalog is a fixed list
    wide = flow_features(x.candle_table(), staged(merged_flow(x)), CANDLE_SPAN, drop_incomplete=False)
    return wide.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "known_rows")


@query(
    "normalize_product_list",
    """SELECT event_id, item, CAST(min(pos) AS INT) AS pos FROM (SELECT event_id, upper(trim(u)) AS item, pos FROM
         (SELECT event_id, unnest(string_split(' ' || event_type || ',x' || user_id % 4 || ',,' || upper(event_type) || ' ,y', ',')) AS u,
                 generate_subscripts(string_split(' ' || event_type || ',x' || user_id % 4 || ',,' || upper(event_type) || ' ,y', ','), 1) - 1 AS pos FROM events))
       WHERE item <> '' GROUP BY 1, 2""",
)
def normalize_product_list(x: Inputs):
    text = F.concat(
        F.lit(" "), "event_type", F.lit(",x"), (F.col("user_id") % 4).cast("string"), F.lit(",,"), F.upper("event_type"), F.lit(" ,y")
    )
    return X.list_items(x.table("events").withColumn("names", text), "names", ["event_id"])


@query(
    "parse_overrides",
    """SELECT event_id, 'A' AS base, CASE WHEN event_id % 2 = 0 THEN 2.5e0 ELSE user_id::DOUBLE END AS value FROM events
       UNION ALL SELECT event_id, 'B', 0.25e0 FROM events""",
)
def parse_overrides(x: Inputs):
    text = F.concat(
        F.lit("a="), F.col("user_id").cast("string"), F.lit(", b = 0.25 ,c=oops,d,=3"),
        F.when(F.col("event_id") % 2 == 0, ",A=2.5").otherwise(""),
    )
    return X.overrides(x.table("events").withColumn("txt", text), "txt", ["event_id"])


@query(
    "universe_merge",
    """WITH a AS (SELECT event_type AS base, min(event_id) AS pos FROM events WHERE user_id % 2 = 0 AND event_type > 'e' GROUP BY 1),
         b AS (SELECT event_type AS base, min(event_id) AS pos FROM events GROUP BY 1)
       SELECT base, CAST(0 AS INT) AS list, pos FROM a UNION ALL SELECT base, 1, pos FROM b WHERE base NOT IN (SELECT base FROM a)""",
)
def universe_merge(x: Inputs):
    ev = x.table("events").select(F.col("event_type").alias("base"), F.col("event_id").alias("pos"), "user_id")
    return X.first_seen(ev.where((F.col("user_id") % 2 == 0) & (F.col("base") > "e")), ev)


@query(
    "date_range",
    "SELECT event_type, CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events GROUP BY 1",
)
def date_range(x: Inputs):
    ends = x.table("events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return X.day_range(ends, "a", "z").select("event_type", "day")


@query(
    "granularity_ms",
    "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 60000 WHEN 1 THEN 300000 WHEN 2 THEN 21600000 ELSE 60000 END::BIGINT AS ms FROM events",
)
def granularity_ms(x: Inputs):
    k = F.col("user_id") % 4
    name = F.when(k == 0, "one_minute").when(k == 1, "FIVE_MINUTE").when(k == 2, "SIX_HOUR").otherwise("OTHER")
    return x.table("events").select("event_id", X.interval_ms(name).alias("ms"))


@query(
    "to_bool",
    "SELECT event_id, user_id % 4 = 0 AS paper, user_id % 4 <= 1 AS orders FROM events",
)
def to_bool(x: Inputs):
    k = F.col("user_id") % 4
    text = F.when(k == 0, " True").when(k == 1, "Yes ").when(k == 2, "off")
    return x.table("events").select("event_id", X.is_true(text).alias("paper"), X.is_true(text, X.ORDER_TRUE).alias("orders"))


@query(
    "union_sources",
    """WITH reg AS (SELECT DISTINCT upper(split_part(registry_key, '_', 1)) AS base FROM model_records), obs AS (SELECT DISTINCT upper(event_type) AS base FROM events
         UNION SELECT 'A1' UNION SELECT 'A2')
       SELECT base, 'registry' AS source FROM reg UNION ALL SELECT base, 'new_asset' FROM obs WHERE base NOT IN (SELECT base FROM reg)""",
    ("model_records",),
)
def union_sources(x: Inputs):
    from tapeflow.operators.model_tables import union_sources as run

    reg = x.model_records().select(F.upper(F.split_part("registry_key", F.lit("_"), F.lit(1))).alias("base"))
    obs = x.table("events").select(F.upper("event_type").alias("base"))
    return run(reg, obs.unionByName(reg.where(F.col("base").isin("A1", "A2"))))


@query(
    "except_excluded",
    """WITH u AS (SELECT DISTINCT base_asset FROM products), e AS (SELECT DISTINCT base_asset FROM products WHERE status = 'offline')
       SELECT base_asset, 'kept' AS side FROM u WHERE base_asset NOT IN (SELECT base_asset FROM e)""",
    ("products",),
)
def except_excluded(x: Inputs):
    from tapeflow.operators.model_tables import without_excluded

    p = x.products()
    kept = without_excluded(p.select("base_asset"), p.where(F.col("status") == "offline").select("base_asset"), "base_asset")
    return kept.withColumn("side", F.lit("kept"))


@query(
    "set_difference",
    """WITH a AS (SELECT DISTINCT base_asset FROM products WHERE quote_volume_24h > 3000000), b AS (SELECT DISTINCT base_asset FROM products WHERE status = 'offline')
       SELECT base_asset, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT base_asset, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ("products",),
)
def set_difference(x: Inputs):
    from tapeflow.operators.model_tables import set_difference as run

    p = x.products()
    return run(
        p.where(F.col("quote_volume_24h") > 3_000_000).select("base_asset"), p.where(F.col("status") == "offline").select("base_asset"), "base_asset"
    )


# ---------------------------------------------------------------- feed
def feed(x: Inputs):
    """One JSON message per 20 consecutive trades; every 50th sequence number is skipped."""
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    trade = F.struct(
        F.when(F.col("event_id") % 25 != 0, F.col("trade_id")).alias("trade_id"), "product_id",
        F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), "side", iso.alias("time"),
    )
    n = F.expr("event_id div 20")
    groups = x.trades().groupBy(n.alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", trade.alias("t")))), lambda e: e["t"]).alias("trades")
    )
    seq = F.col("n") + 1 + F.expr("n div 49")
    kind = F.when(F.col("n") % 40 == 0, "snapshot").otherwise("update")
    events = F.array(F.struct(kind.alias("type"), (F.col("n") + 1).alias("heartbeat_counter"), F.col("trades")))
    body = F.to_json(F.struct(F.lit("market_trades").alias("channel"), seq.alias("sequence_num"), events.alias("events")))
    return groups.select(F.concat(F.lit("c"), (F.col("n") % 3).cast("string")).alias("connection_key"), F.col("n").alias("arrival_seq"), body.alias("value"))


@query(
    "parse_feed_messages",
    f"""SELECT product_id, CASE WHEN event_id % 25 <> 0 THEN trade_id ELSE
          (event_id // 20 + 1 + event_id // 20 // 49) || ':' || event_id % 20 END AS trade_id, {r6('price', 'size')}, side, ts_ms FROM trades""",
    ("trades",),
)
def parse_feed_messages(x: Inputs):
    rows = M.feed_trades(M.parse_messages(feed(x)))
    return rounded(
        rows.select("product_id", "trade_id", F.col("price").cast("double"), F.col("size").cast("double"), "side", "ts_ms")
    )


@query(
    "parse_level2",
    f"""SELECT product_id, seq, side, {rnd('price_level')} AS price, {rnd('new_quantity')} AS size, seq % 100 = 1 AS is_snapshot FROM l2_updates WHERE seq % 10 <> 3""",
    ("l2_updates",),
)
def parse_level2(x: Inputs):
    update = F.struct("side", F.col("price_level").cast("string").alias("price_level"), F.when(F.col("seq") % 10 != 3, F.col("new_quantity").cast("string")).alias("new_quantity"))
    kind = F.when(F.col("seq") % 100 == 1, "Snapshot").otherwise("update")
    event = F.struct(kind.alias("type"), F.col("product_id"), F.array(update).alias("updates"))
    text = F.to_json(F.struct(F.lit("l2_data").alias("channel"), F.col("seq").alias("sequence_num"), F.array(event).alias("events")))
    rows = M.feed_book_updates(M.parse_messages(x.l2_updates().select("seq", text.alias("value"))).drop("value"))
    return rounded(rows.drop("sequence_num"))


@query(
    "message_product_ids",
    """SELECT event_id // 20 AS arrival_seq, string_agg(product_id, ',' ORDER BY first_id) AS products FROM
         (SELECT event_id // 20 * 20 AS event_id, product_id, min(event_id) AS first_id FROM trades GROUP BY 1, 2) GROUP BY 1""",
    ("trades",),
)
def message_product_ids(x: Inputs):
    msgs = M.parse_messages(feed(x))
    return msgs.select("arrival_seq", F.concat_ws(",", M.message_products()).alias("products"))


SEQ_SQL = """m AS (SELECT DISTINCT event_id // 20 AS n, 'c' || (event_id // 20) % 3 AS connection_key FROM trades),
  q AS (SELECT *, n + 1 + n // 49 AS sequence_num, n % 40 = 0 AS snap, sum((n % 40 = 0)::INT) OVER (PARTITION BY connection_key ORDER BY n) AS epoch FROM m),
  p AS (SELECT *, max(sequence_num) OVER (PARTITION BY connection_key, epoch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sequence FROM q)"""


@query(
    "sequence_gaps",
    f"WITH {SEQ_SQL} SELECT connection_key, n AS arrival_seq, last_sequence, sequence_num, sequence_num - last_sequence - 1 AS gap_size FROM p WHERE NOT snap AND sequence_num > last_sequence + 1",
    ("trades",),
)
def sequence_gaps(x: Inputs):
    msgs = M.parse_messages(feed(x)).select(
        "connection_key", "arrival_seq", F.col("m.sequence_num").alias("sequence_num"),
        F.exists("m.events", lambda e: F.lower(e["type"]) == "snapshot").alias("is_snapshot"),
    )
    return M.sequence_gaps(msgs, 64).select("connection_key", "arrival_seq", "last_sequence", "sequence_num", "gap_size")


@query(
    "heartbeat_gaps",
    """WITH b AS (SELECT DISTINCT event_id // 20 AS n FROM trades), c AS (SELECT n, 'c' || n % 3 AS connection_key, n // 100 AS session, n + 1 AS counter FROM b),
         p AS (SELECT *, lag(counter) OVER (PARTITION BY connection_key, session ORDER BY n) AS last_counter FROM c)
       SELECT connection_key, session, n AS arrival_seq, last_counter, counter, counter - last_counter - 1 AS missed FROM p WHERE counter > last_counter + 1""",
    ("trades",),
)
def heartbeat_gaps(x: Inputs):
    beats = M.parse_messages(feed(x)).select(
        "connection_key", "arrival_seq", F.expr("arrival_seq div 100").alias("session"), M.last_heartbeat().alias("counter")
    )
    return M.heartbeat_gaps(beats, 64)


@query(
    "publish_side_outputs",
    "SELECT 'collector.invalid_payload' AS error_type, count(*) AS rows FROM trades WHERE user_id % 5 = 0",
    ("trades",),
)
def publish_side_outputs(x: Inputs):
    raw = x.trades().select(
        "product_id", "trade_id", F.when(F.col("user_id") % 5 == 0, "?").otherwise(F.col("price").cast("string")).alias("price"), "size", "ts_ms"
    )
    _, bad = M.split_errors(raw)
    return bad.groupBy("error_type").agg(F.count("payload").alias("rows"))
