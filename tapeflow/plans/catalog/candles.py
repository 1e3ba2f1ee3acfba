"""Queries on trades and candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.functions.columns import rounded
from tapeflow.operators import candles as C
from tapeflow.plans.registry import query, r6
from tapeflow.plans.views import HOUR, Inputs

CANDLE_SQL = f"product_id, open_time, close_time, {r6('open', 'high', 'low', 'close', 'volume')}, trade_count"


@query("candles_batch", f"SELECT {CANDLE_SQL} FROM candles", ("candles",))
def candles_batch(x: Inputs):
    return rounded(x.candles())


@query(
    "top_moves",
    f"""WITH r AS (SELECT product_id, open_time, close,
           close / lag(close, 1) OVER (PARTITION BY product_id ORDER BY open_time) - 1 AS ret_1 FROM candles)
        SELECT product_id, open_time, {r6('close', 'ret_1')} FROM r WHERE ret_1 IS NOT NULL
        ORDER BY abs(ret_1) DESC, product_id, open_time LIMIT 10""",
    ("candles",),
)
def top_moves(x: Inputs):
    from tapeflow.functions.series import Series
    from tapeflow.operators.ohlcv import returns

    s = Series(back=1)
    moves = s.close(returns(s.open(x.numbered()), s, {"ret_1": 1})).where(F.col("ret_1").isNotNull())
    top = C.top_k(moves, 10, F.abs("ret_1").desc(), F.col("product_id"), F.col("open_time"))
    return rounded(top.select("product_id", "open_time", "close", "ret_1"))


@query(
    "candles_force_close",
    f"""SELECT product_id, open_time, greatest(open_time, 1706659200000) AS close_time,
          {r6('open', 'high', 'low', 'close', 'volume')}, trade_count, true AS is_closed
        FROM candles QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY open_time DESC) = 1""",
    ("candles",),
)
def candles_force_close(x: Inputs):
    return rounded(C.force_close(x.candles(), 1_706_659_200_000))


@query(
    "filter_closed_buckets",
    f"SELECT {CANDLE_SQL} FROM candles WHERE open_time < (1705320123456 // 3600000) * 3600000",
    ("candles",),
)
def filter_closed_buckets(x: Inputs):
    return rounded(C.closed_before(x.candles(), 1_705_320_123_456, HOUR))


@query(
    "valid_trades",
    f"""SELECT product_id, trade_id, CAST(p AS DOUBLE) AS price, CAST(s AS DOUBLE) AS size, ts_ms FROM (
          SELECT product_id, trade_id, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN '-1'
            ELSE CAST(user_id AS VARCHAR) END AS p, CAST(user_id % 5 AS VARCHAR) AS s, ts_ms FROM trades)
        WHERE try_cast(p AS DOUBLE) > 0 AND try_cast(s AS DOUBLE) > 0 AND ts_ms > 0""",
    ("trades",),
)
def valid_trades(x: Inputs):
    raw = x.trades().select(
        "product_id", "trade_id",
        F.when(F.col("event_id") % 11 == 0, "bad").when(F.col("event_id") % 7 == 0, "-1")
        .otherwise(F.col("user_id").cast("string")).alias("price"),
        (F.col("user_id") % 5).cast("string").alias("size"),
        F.col("ts_ms").cast("string").alias("ts_ms"),
    )
    return C.valid_trades(raw)


@query(
    "is_buy_side",
    """SELECT product_id, trade_id, coalesce(upper(s) IN ('BUY', 'BID'), false) AS is_buy,
         CASE WHEN upper(s) IN ('BID', 'BUY', 'B') THEN 'bid' ELSE 'ask' END AS book_side
       FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'buy' WHEN 1 THEN 'Bid' WHEN 2 THEN 'b' WHEN 3 THEN NULL
         ELSE side END AS s FROM trades)""",
    ("trades",),
)
def is_buy_side(x: Inputs):
    u = F.col("user_id") % 5
    side = F.when(u == 0, "buy").when(u == 1, "Bid").when(u == 2, "b").when(u == 3, F.lit(None)).otherwise(F.col("side"))
    return x.trades().withColumn("side", side).select(
        "product_id", "trade_id", C.is_buy().alias("is_buy"), C.book_side().alias("book_side")
    )


DUPED = """duped AS (SELECT product_id, trade_id, price, size, side, ts_ms, arrival_seq FROM trades
  UNION ALL SELECT product_id, trade_id, price, size, side, ts_ms, arrival_seq + 1000000000 FROM trades WHERE event_id % 3 = 0)"""


@query(
    "dedupe_trades",
    f"""WITH {DUPED} SELECT product_id, trade_id, {r6('price', 'size')}, side, ts_ms, min(arrival_seq) AS arrival_seq
        FROM duped GROUP BY ALL""",
    ("trades",),
)
def dedupe_trades(x: Inputs):
    cols = ["product_id", "trade_id", "price", "size", "side", "ts_ms", "arrival_seq"]
    repeats = x.trades().where(F.col("event_id") % 3 == 0).withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000)
    return rounded(C.dedupe_trades(x.trades().select(cols).unionByName(repeats.select(cols))))


@query(
    "monotonic_candles",
    f"""WITH a AS (SELECT *, open_time // 3600000 + CASE WHEN (open_time // 3600000) % 5 = 0 THEN 3 ELSE 0 END AS k FROM candles),
          b AS (SELECT *, 2 * k + CASE WHEN (open_time // 3600000) % 5 = 0 THEN 1 ELSE 0 END AS arrival FROM a),
          c AS (SELECT *, max(open_time) OVER (PARTITION BY product_id ORDER BY arrival
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
        SELECT {CANDLE_SQL} FROM c WHERE seen IS NULL OR open_time > seen""",
    ("candles",),
)
def monotonic_candles(x: Inputs):
    hour = (F.col("open_time") / HOUR).cast("bigint")
    late = hour % 5 == 0
    arrival = (2 * (hour + F.when(late, 3).otherwise(0)) + F.when(late, 1).otherwise(0)).cast("bigint")
    return rounded(C.monotonic(x.candles().withColumn("arrival", arrival), "arrival", 512).drop("arrival"))


@query(
    "reconcile_candles",
    f"""WITH pub AS (SELECT * FROM candles WHERE (open_time // 3600000) % 5 <> 0 AND open_time < 1705622400000),
          last AS (SELECT product_id, max(open_time) AS m FROM pub GROUP BY product_id)
        SELECT {CANDLE_SQL}, false AS reconciled FROM pub UNION ALL
        SELECT {CANDLE_SQL}, true FROM candles LEFT JOIN last USING (product_id)
        WHERE open_time < 1706486400000 AND (m IS NULL OR open_time > m)""",
    ("candles",),
)
def reconcile_candles(x: Inputs):
    hour = (F.col("open_time") / HOUR).cast("bigint")
    published = x.candles().where((hour % 5 != 0) & (F.col("open_time") < 1_705_622_400_000))
    return rounded(C.reconcile(published, x.candles(), 1_706_486_400_000 + 1_234, HOUR))


@query(
    "dedupe_last",
    f"""WITH v AS (SELECT *, 0 AS load_seq FROM candles UNION ALL
          SELECT * REPLACE (close * 1.01e0 AS close), 1 FROM candles WHERE (open_time // 3600000) % 7 = 0)
        SELECT {CANDLE_SQL} FROM v QUALIFY row_number() OVER (PARTITION BY product_id, open_time ORDER BY load_seq DESC) = 1""",
    ("candles",),
)
def dedupe_last(x: Inputs):
    hour = (F.col("open_time") / HOUR).cast("bigint")
    first = x.candles().withColumn("load_seq", F.lit(0))
    second = (
        x.candles().where(hour % 7 == 0).withColumn("close", F.col("close") * 1.01).withColumn("load_seq", F.lit(1))
    )
    return rounded(C.dedupe_last(first.unionByName(second), ["product_id", "open_time"], "load_seq").drop("load_seq"))


@query(
    "tail_n",
    f"""SELECT {CANDLE_SQL} FROM candles QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY open_time DESC) <= 25""",
    ("candles",),
)
def tail_n(x: Inputs):
    return rounded(C.tail_rows(x.numbered(), 25).drop("row_idx"))


@query("sort_series", f"SELECT {CANDLE_SQL} FROM candles ORDER BY product_id, open_time", ("candles",))
def sort_series(x: Inputs):
    return rounded(x.candles().orderBy("product_id", "open_time"))


@query(
    "top_k",
    f"""SELECT {CANDLE_SQL} FROM candles QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY volume DESC, open_time) <= 5""",
    ("candles",),
)
def top_k(x: Inputs):
    return rounded(C.top_k(x.candles(), 5, F.col("volume").desc(), F.col("open_time"), by=["product_id"]))
