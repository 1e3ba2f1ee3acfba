"""Queries on windows, labels, splits, metrics, selection and thresholds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import tapeflow.plans.sql_features  # noqa: F401
from tapeflow.functions.columns import rounded
from tapeflow.functions.names import ALL_FEATURES
from tapeflow.functions.series import Ema, Series, ema, number_rows, running
from tapeflow.operators import evaluation as V
from tapeflow.operators import flow_features as FF
from tapeflow.operators import labels as L
from tapeflow.operators import monitors as D
from tapeflow.operators import selection as P
from tapeflow.operators import signals as G
from tapeflow.operators import thresholds as Q
from tapeflow.operators.ohlcv import ohlcv_features, slope_share
from tapeflow.plans import sql_features as Z
from tapeflow.plans.catalog.features import NOT_NULL, merged_flow
from tapeflow.plans.registry import query, r6, rnd
from tapeflow.plans.views import CANDLE_SPAN, HOUR, SQL_VIEWS, Inputs
from tapeflow.session import staged

KEY = ["product_id", "open_time"]
W = Z.W


def features(x: Inputs, columns=None):
    return ohlcv_features(x.candle_table(), CANDLE_SPAN, columns=columns)


SQL_VIEWS["kept"] = (
    f"SELECT * EXCLUDE (row_idx), row_number() OVER {W} - 1 AS row_idx FROM ohlcv WHERE {NOT_NULL}", ("ohlcv",),
)

# ---------------------------------------------------------------- window primitives
@query(
    "ema",
    f"""SELECT product_id, open_time, {rnd('ema_12')} AS ema_12, {rnd('wilder')} AS wilder FROM (SELECT *, {Z.span('lc', 12)} AS ema_12,
          {Z.ema('lc', 1 / 14, 13)} AS wilder FROM (SELECT *, list(close) OVER {W} AS lc FROM numbered))""",
    ("numbered",),
)
def ema_query(x: Inputs):
    s = Series(back=2_048)
    df = s.ema(s.open(x.numbered()), {"ema_12": Ema.span(F.col("close"), 12), "wilder": Ema(F.col("close"), 1 / 14, 14)})
    return rounded(s.close(df).select(*KEY, "ema_12", "wilder"))


@query(
    "lag_ema",
    f"""WITH l AS (SELECT product_id, arrival_seq, list(greatest(0, 1704067200000 + arrival_seq * 13000 - ts_ms)::DOUBLE) OVER (PARTITION BY product_id ORDER BY arrival_seq) AS ls FROM trades)
        SELECT product_id, arrival_seq, {rnd('list_reduce(ls, lambda s, v: s * 0.999e0 + v * 0.001e0)')} AS lag_ema_ms FROM l""",
    ("trades",),
)
def lag_ema(x: Inputs):
    """Mean ingest lag with weight 0.001, per product in arrival order (a clock is made from the arrival number)."""
    lag = F.greatest(F.lit(0), F.lit(1_704_067_200_000) + F.col("arrival_seq") * 13_000 - F.col("ts_ms")).cast("double")
    df = x.trades().select("product_id", "arrival_seq", lag.alias("lag_ms"))
    out = ema(staged(df), "lag_ms", keys=["product_id"], order="arrival_seq", span_units=65_536, out="lag_ema_ms", alpha=0.001)
    return rounded(out.select("product_id", "arrival_seq", "lag_ema_ms"))


@query(
    "rolling_agg",
    f"""SELECT product_id, open_time, {', '.join(f"{rnd('(' + Z.full(fn, 'close', 20, k) + ')')} AS {n}" for fn, n, k in (('sum', 'sum_20', 20), ('avg', 'avg_20', 5), ('min', 'min_20', 20), ('max', 'max_20', 1), ('stddev_samp', 'std_20', 20)))} FROM numbered""",
    ("numbered",),
)
def rolling_agg(x: Inputs):
    s = Series(back=32)
    close = F.col("close")
    df = s.open(x.numbered()).withColumns(
        {
            "sum_20": s.roll(F.sum, close, 20), "avg_20": s.roll(F.avg, close, 20, 5), "min_20": s.roll(F.min, close, 20),
            "max_20": s.roll(F.max, close, 20, 1), "std_20": s.roll(F.stddev_samp, close, 20),
        }
    )
    return rounded(s.close(df).select(*KEY, "sum_20", "avg_20", "min_20", "max_20", "std_20"))


@query(
    "rolling_quantile",
    f"""SELECT product_id, open_time, {rnd('(' + Z.med('volume', 60, 10) + ')')} AS median_60,
          CASE WHEN row_idx >= 9 AND volume > quantile_cont(volume, 0.75) OVER {W} THEN 1e0 WHEN row_idx < 9 AND volume > 5 THEN 1e0 ELSE 0e0 END AS above_q75
        FROM numbered""",
    ("numbered",),
)
def rolling_quantile(x: Inputs):
    from tapeflow.functions.prefix_rank import above_running_quantile

    s = Series(back=64)
    numbered = above_running_quantile(
        x.numbered(), ["product_id"], "row_idx", "volume", 0.75, min_rows=10, fallback=5.0, out="above_q75", block_rows=128
    )
    df = s.open(numbered)
    df = df.withColumn("median_60", s.roll(lambda v: F.percentile(v, 0.5), F.col("volume"), 60, 10))
    return rounded(s.close(df).select(*KEY, "median_60", "above_q75"))


@query("rolling_slope", f"SELECT product_id, open_time, {rnd('(' + Z.slope('close', 30) + ')')} AS slope_30 FROM numbered", ("numbered",))
def rolling_slope(x: Inputs):
    s = Series(back=32)
    df = s.open(x.numbered())
    return rounded(s.close(df.withColumn("slope_30", slope_share(s, F.col("close"), 30))).select(*KEY, "slope_30"))


@query(
    "cross_detect",
    f"""SELECT product_id, open_time, {Z.flag(f'close > open AND lag(close) OVER {W} <= lag(open) OVER {W}')} AS cross_up,
          {Z.flag(f'close < open AND lag(close) OVER {W} >= lag(open) OVER {W}')} AS cross_down FROM numbered""",
    ("numbered",),
)
def cross_detect(x: Inputs):
    from tapeflow.functions.columns import flag

    s = Series(back=1)
    a, b = F.col("close"), F.col("open")
    df = s.open(x.numbered()).withColumns(
        {"cross_up": flag((a > b) & (s.lag(a) <= s.lag(b))), "cross_down": flag((a < b) & (s.lag(a) >= s.lag(b)))}
    )
    return s.close(df).select(*KEY, "cross_up", "cross_down")


@query(
    "recency_weight",
    f"SELECT product_id, open_time, {rnd('least(greatest(pow(0.5e0, (count(*) OVER (PARTITION BY product_id) - 1 - row_idx) / 50e0), 1e-3), 1e0)')} AS sample_weight FROM numbered",
    ("numbered",),
)
def recency_weight(x: Inputs):
    return rounded(L.recency_weight(x.numbered(), 50).select(*KEY, "sample_weight"))


BLOCK_W = "CASE WHEN row_idx >= count(*) OVER (PARTITION BY product_id) - 300 THEN 2e0 ELSE 1e0 END"


@query("recent_block_weight", f"SELECT product_id, open_time, {BLOCK_W} AS sample_weight FROM numbered", ("numbered",))
def recent_block_weight(x: Inputs):
    return L.recent_block_weight(x.numbered(), 300).select(*KEY, "sample_weight")


@query(
    "summarize_weights",
    f"SELECT product_id, min(w) AS min_weight, max(w) AS max_weight, {rnd('avg(w)')} AS mean_weight FROM (SELECT product_id, {BLOCK_W} AS w FROM numbered) GROUP BY 1",
    ("numbered",),
)
def summarize_weights(x: Inputs):
    return rounded(L.weight_summary(L.recent_block_weight(x.numbered(), 300)))


DD_SQL = """c AS (SELECT product_id, row_idx, sum(target_return) OVER (PARTITION BY product_id ORDER BY row_idx) AS cum FROM scored WHERE prob >= {cut}),
  d AS (SELECT product_id, max(cum) OVER (PARTITION BY product_id ORDER BY row_idx) - cum AS fall FROM c)"""


@query("max_drawdown", f"WITH {DD_SQL.format(cut=0)} SELECT product_id, {rnd('max(fall)')} AS max_drawdown FROM d GROUP BY 1", ("scored",))
def max_drawdown(x: Inputs):
    return rounded(V.max_drawdown(x.scored(), ["product_id"], "target_return", "row_idx", block=500))


# ---------------------------------------------------------------- labels and splits
H, THR = 15, 0.20


@query(
    "label_net_return",
    f"""SELECT product_id, open_time, row_idx, {rnd('net')} AS target_return, CAST(net > 0.002e0 AS INT) AS target FROM
          (SELECT *, lead(close, {H}) OVER {W} / close - 1e0 - 0.001e0 AS net FROM kept) WHERE net IS NOT NULL""",
    ("kept",),
)
def label_net_return(x: Inputs):
    df = L.label_net_return(staged(features(x)), H, THR, 0.05, CANDLE_SPAN)
    return rounded(df.select(*KEY, "row_idx", "target_return", "target"))


@query(
    "label_triple_barrier",
    f"""WITH b AS (SELECT n.product_id, n.open_time, n.row_idx, n.close, f.row_idx AS j, f.high, f.low, f.close AS fc FROM numbered n JOIN numbered f
            ON f.product_id = n.product_id AND f.row_idx BETWEEN n.row_idx + 1 AND n.row_idx + {H}),
          h AS (SELECT product_id, open_time, row_idx, close, count(*) AS n, arg_max(fc, j) AS endc,
            min(j) FILTER (high >= close * 1.5e0) AS up, min(j) FILTER (low <= close * 0.5e0) AS dn FROM b GROUP BY ALL)
        SELECT product_id, open_time, row_idx, CAST(CASE WHEN up IS NOT NULL AND up <= coalesce(dn, 1000000000) THEN 1 ELSE 0 END AS INT) AS target,
          {rnd('''CASE WHEN up IS NULL AND dn IS NULL THEN endc / close - 1e0 - 0.001e0 WHEN up IS NOT NULL AND up <= coalesce(dn, 1000000000) THEN 0.5e0 - 0.001e0 ELSE -0.5e0 - 0.001e0 END''')} AS target_return
        FROM h WHERE n = {H}""",
    ("numbered",),
)
def label_triple_barrier(x: Inputs):
    df = L.label_triple_barrier(x.candle_table(), H, 50.0, 0.05, None, CANDLE_SPAN)
    return rounded(df.select(*KEY, "row_idx", "target", "target_return"))


@query(
    "class_balance",
    f"""SELECT product_id, sum(CAST(net > 0.002e0 AS INT))::BIGINT AS positives, count(*) AS total, {rnd('avg(CAST(net > 0.002e0 AS INT))')} AS ratio FROM
          (SELECT *, lead(close, {H}) OVER {W} / close - 1e0 - 0.001e0 AS net FROM numbered) WHERE net IS NOT NULL GROUP BY 1""",
    ("numbered",),
)
def class_balance(x: Inputs):
    return rounded(L.class_balance(L.label_net_return(x.candle_table(), H, THR, 0.05, CANDLE_SPAN)))


@query(
    "holdout_split",
    "SELECT product_id, open_time, row_idx, row_idx >= n - greatest(1, CAST(floor(n * 0.15e0) AS BIGINT)) AS is_test FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM numbered)",
    ("numbered",),
)
def holdout_split(x: Inputs):
    return L.holdout_split(x.numbered()).select(*KEY, "row_idx", "is_test")


FOLD_SQL = """lens AS (SELECT product_id, count(*) AS n FROM numbered GROUP BY 1), fz AS (SELECT product_id, n, greatest(1, (n - 215) // 3) AS sz FROM lens WHERE n - 215 > 3),
  folds AS (SELECT product_id, f + 1 AS fold_id, CAST(0 AS BIGINT) AS train_start, 199 + f * sz AS train_end, 199 + f * sz + 16 AS val_start,
    least(199 + f * sz + 16 + sz - 1, n - 1) AS val_end, n FROM fz, (SELECT unnest([0, 1, 2]) AS f)),
  okf AS (SELECT * EXCLUDE (n) FROM folds WHERE val_start < n AND val_end > val_start)"""


def folds(x: Inputs, numbered):
    return L.walk_forward_folds(L.lengths_of(numbered), 200, 15, 3)


@query("walk_forward_folds", f"WITH {FOLD_SQL} SELECT * FROM okf", ("numbered",))
def walk_forward_folds(x: Inputs):
    return folds(x, x.numbered())


ROWS_SQL = f"""{FOLD_SQL}, asg AS (SELECT nn.product_id, open_time, nn.row_idx, fold_id, nn.trade_count % 2 AS target,
    CASE WHEN nn.row_idx BETWEEN train_start AND train_end THEN 'train' ELSE 'val' END AS part FROM numbered nn JOIN okf ON nn.product_id = okf.product_id
    AND (nn.row_idx BETWEEN train_start AND train_end OR nn.row_idx BETWEEN val_start AND val_end))"""


@query("rows_to_folds", f"WITH {ROWS_SQL} SELECT product_id, open_time, row_idx, fold_id, part FROM asg", ("numbered",))
def rows_to_folds(x: Inputs):
    numbered = x.numbered()
    return L.rows_to_folds(numbered, folds(x, numbered)).select(*KEY, "row_idx", "fold_id", "part")


@query(
    "single_class_folds",
    f"""WITH {ROWS_SQL} SELECT product_id, fold_id FROM asg WHERE fold_id <> 2 OR part = 'train' OR target = 1 GROUP BY 1, 2
        HAVING count(DISTINCT target) FILTER (part = 'train') > 1 AND count(DISTINCT target) FILTER (part = 'val') > 1""",
    ("numbered",),
)
def single_class_folds(x: Inputs):
    numbered = x.numbered().withColumn("target", F.col("trade_count") % 2)
    rows = L.rows_to_folds(numbered, folds(x, numbered))
    return L.usable_folds(rows.where((F.col("fold_id") != 2) | (F.col("part") == "train") | (F.col("target") == 1)))


@query(
    "purged_split",
    """SELECT product_id, greatest(1, r - 15) AS train_end, CASE WHEN least(n - 1, r) <= greatest(1, r - 15) THEN least(n - 1, greatest(1, r - 15) + 1) ELSE least(n - 1, r) END AS val_start
       FROM (SELECT product_id, count(*) AS n, greatest(1, CAST(floor(count(*) * 0.85e0) AS BIGINT)) AS r FROM candles GROUP BY 1)""",
    ("candles",),
)
def purged_split(x: Inputs):
    end, start = L.purged_bounds(F.col("n_rows"), 15)
    return L.lengths_of(x.candles()).select("product_id", end.alias("train_end"), start.alias("val_start"))


@query(
    "fixed_holdout_purged",
    "SELECT product_id, open_time, CASE WHEN row_idx >= n - 100 THEN 'holdout' ELSE 'train' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM numbered) WHERE row_idx >= n - 100 OR row_idx < n - 115",
    ("numbered",),
)
def fixed_holdout_purged(x: Inputs):
    return L.fixed_holdout(x.numbered(), 100, 15).select(*KEY, "part")


@query(
    "select_window",
    f"""SELECT product_id, open_time, '6m_recent' AS strategy, 1e0 AS sample_weight FROM numbered QUALIFY row_idx >= count(*) OVER (PARTITION BY product_id) - 300
        UNION ALL SELECT product_id, open_time, '12m_flat', 1e0 FROM numbered UNION ALL SELECT product_id, open_time, '12m_weighted', {BLOCK_W} FROM numbered""",
    ("numbered",),
)
def select_window(x: Inputs):
    numbered, out = staged(x.numbered()), None
    for name in ("6m_recent", "12m_flat", "12m_weighted"):
        part = L.select_window(numbered, name, 300).select(*KEY, F.lit(name).alias("strategy"), "sample_weight")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "min_rows_gate",
    "SELECT product_id, n AS n_rows, CAST(781 AS BIGINT) - 525 AS required_rows, CASE WHEN n >= 256 THEN 'ok' ELSE 'insufficient_data' END AS status FROM (SELECT product_id, count(*) AS n FROM candles GROUP BY 1)",
    ("candles",),
)
def min_rows_gate(x: Inputs):
    return L.min_rows_gate(L.lengths_of(x.candles()), 199, 14, 3)


@query(
    "align_weights",
    f"""WITH w AS (SELECT product_id, open_time, {BLOCK_W} AS sample_weight FROM numbered)
        SELECT product_id, open_time, sample_weight FROM (SELECT product_id, open_time, lead(close, {H}) OVER {W} AS f FROM kept) JOIN w USING (product_id, open_time) WHERE f IS NOT NULL""",
    ("kept", "numbered"),
)
def align_weights(x: Inputs):
    labeled = L.label_net_return(staged(features(x)), H, THR, 0.05, CANDLE_SPAN)
    return L.align_weights(labeled, L.recent_block_weight(x.numbered(), 300)).select(*KEY, "sample_weight")


# ---------------------------------------------------------------- metrics
def auc_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, coalesce((sum(CASE WHEN target = 1 THEN mid END) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2e0)
        / nullif(count(*) FILTER (target = 1) * (count(*) FILTER (target <> 1))::DOUBLE, 0), 0.5e0) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY prob) + (count(*) OVER (PARTITION BY {keys}, prob) - 1) / 2e0 AS mid FROM {source}) GROUP BY {keys}"""


@query("auc", f"SELECT product_id, {rnd('auc')} AS auc FROM ({auc_sql('product_id', 'scored')})", ("scored",))
def auc(x: Inputs):
    return rounded(V.auc(x.scored(), ["product_id"]))


@query(
    "log_loss",
    f"""SELECT product_id, {rnd('avg(CASE WHEN target = 1 THEN -ln(p) ELSE -ln(1e0 - p) END)')} AS log_loss FROM
        (SELECT *, least(greatest(prob, 2.220446049250313e-16), 1e0 - 2.220446049250313e-16) AS p FROM scored) GROUP BY 1""",
    ("scored",),
)
def log_loss(x: Inputs):
    return rounded(V.log_loss(x.scored(), ["product_id"]))


@query(
    "holdout_metrics",
    f"""WITH {DD_SQL.format(cut=0.62)}, m AS (SELECT product_id, max(fall) AS max_drawdown FROM d GROUP BY 1), a AS ({auc_sql('product_id', 'scored')}),
        b AS (SELECT product_id, count(*) AS buy_support, avg(target) AS precision_buy, avg((target_return > 0)::INT) AS win_rate,
          CASE WHEN count(*) < 2 OR stddev_pop(target_return) = 0 THEN 0e0 ELSE avg(target_return) / stddev_pop(target_return) * sqrt(count(*)) END AS sharpe FROM scored WHERE prob >= 0.62 GROUP BY 1)
        SELECT product_id, buy_support, {r6('precision_buy', 'win_rate', 'sharpe', 'max_drawdown', 'auc')} FROM b JOIN m USING (product_id) JOIN a USING (product_id)""",
    ("scored",),
)
def holdout_metrics(x: Inputs):
    return rounded(V.holdout_metrics(x.scored(), ["product_id"], 0.62))


STRAT = "SELECT *, CASE row_idx % 3 WHEN 0 THEN 'recent' WHEN 1 THEN 'flat' ELSE 'weighted' END AS strategy, (row_idx % 3)::INT AS strategy_no FROM scored"


@query(
    "compare_strategies",
    f"""WITH s AS ({STRAT}), a AS ({auc_sql('product_id, strategy', 's')}),
          k AS (SELECT *, CASE strategy WHEN 'recent' THEN 0 WHEN 'flat' THEN 1 ELSE 2 END AS no FROM a WHERE NOT (strategy = 'flat' AND product_id = 'CLICK-USD'))
        SELECT product_id, strategy AS best_strategy, {rnd('auc')} AS best_holdout_auc FROM k QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY auc DESC, no) = 1""",
    ("scored",),
)
def compare_strategies(x: Inputs):
    k = F.col("row_idx") % 3
    rows = x.scored().withColumn("strategy", F.when(k == 0, "recent").when(k == 1, "flat").otherwise("weighted"))
    res = V.auc(rows, ["product_id", "strategy"]).withColumnRenamed("auc", "holdout_auc")
    skip = (F.col("strategy") == "flat") & (F.col("product_id") == "CLICK-USD")
    res = res.withColumns(
        {
            "status": F.when(skip, "insufficient_data").otherwise("ok"),
            "strategy_no": F.when(F.col("strategy") == "recent", 0).when(F.col("strategy") == "flat", 1).otherwise(2),
        }
    )
    return rounded(V.best_strategy(res))


@query(
    "holdout_stats",
    f"""SELECT product_id, {rnd('avg(target)')} AS target_mean, {rnd('avg(tr)')} AS return_mean, {rnd('stddev_pop(tr)')} AS return_std, {rnd('stddev_pop(ls)')} AS volatility FROM
        (SELECT product_id, trade_count % 2 AS target, close / open - 1 AS tr, ln(greatest(close, 1e-9)) - lag(ln(greatest(close, 1e-9))) OVER {W} AS ls FROM numbered) GROUP BY 1""",
    ("numbered",),
)
def holdout_stats(x: Inputs):
    s = Series(back=1)
    safe = F.greatest(F.col("close"), F.lit(1e-9))
    df = s.open(x.numbered()).withColumns(
        {"target": F.col("trade_count") % 2, "target_return": F.col("close") / F.col("open") - 1, "log_step": F.ln(safe) - F.ln(s.lag(safe))}
    )
    return rounded(V.holdout_stats(s.close(df), ["product_id"]))


@query(
    "training_run_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (entry_ready) AS trained, count(*) FILTER (promoted) AS promoted, count(*) FILTER (NOT entry_ready) AS skipped,
          {rnd('count(*) FILTER (NOT entry_ready) / count(*)::DOUBLE')} AS failure_ratio, count(*) FILTER (NOT entry_ready) / count(*)::DOUBLE > 0.30 AS too_many_failures FROM model_records""",
    ("model_records",),
)
def training_run_summary(x: Inputs):
    runs = x.model_records().withColumn("status", F.when(F.col("entry_ready"), "trained").otherwise("error"))
    return rounded(L.training_summary(runs))


# ---------------------------------------------------------------- selection
CORR = "ret_1 ret_5 ret_15 rsi_14 macd_hist atr_pct bb_pct bb_width realized_vol_5 price_vs_ema_fast price_vs_ema_slow volume_ratio hl_ratio hour_sin".split()


@query(
    "correlation_filter",
    " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 6) AS abs_corr FROM kept" for a, b in combinations(CORR, 2)),
    ("kept",),
)
def correlation_matrix(x: Inputs):
    """Pair matrix of the correlation filter."""
    df = P.correlations(staged(features(x)), CORR)
    return df.withColumn("abs_corr", F.round("abs_corr", 6))


PAIR_SQL = ", ".join(f"abs(corr({a}, {b})) AS p{i * len(ALL_FEATURES) + j}" for (i, a), (j, b) in combinations(enumerate(ALL_FEATURES), 2))
NAMES_SQL = "[" + ", ".join(f"'{f}'" for f in ALL_FEATURES) + "]"
SQL_VIEWS["pairs"] = (
    f"""SELECT {NAMES_SQL}[k // {len(ALL_FEATURES)} + 1] AS feature_a, {NAMES_SQL}[k % {len(ALL_FEATURES)} + 1] AS feature_b, k // {len(ALL_FEATURES)} AS i, k % {len(ALL_FEATURES)} AS j,
          CASE WHEN NOT isnan(c) THEN c END AS abs_corr
        FROM (SELECT CAST(substr(name, 2) AS INT) AS k, c FROM (SELECT {PAIR_SQL} FROM flow_features WHERE {NOT_NULL}) UNPIVOT INCLUDE NULLS (c FOR name IN (*)))""",
    ("flow_features",),
)


def _all_pairs(x: Inputs):
    wide = FF.flow_features(x.candle_table(), staged(merged_flow(x)), CANDLE_SPAN)
    return staged(P.correlations(wide, list(ALL_FEATURES)))


@query("correlation_all_features", f"SELECT feature_a, feature_b, {rnd('abs_corr')} AS abs_corr FROM pairs", ("pairs",))
def correlation_all_features(x: Inputs):
    return rounded(_all_pairs(x))


@query(
    "correlation_drop",
    f"""WITH RECURSIVE w AS (SELECT '{ALL_FEATURES[0]}' AS f, 1e0 AS w UNION ALL SELECT feature_b, coalesce(abs_corr, 0) FROM pairs WHERE i = 0),
          strong AS (SELECT row_number() OVER (ORDER BY j, i) AS k, feature_a AS a, feature_b AS b, CASE WHEN y.w < x.w THEN feature_b ELSE feature_a END AS weaker
            FROM pairs JOIN w x ON x.f = feature_a JOIN w y ON y.f = feature_b WHERE abs_corr > 0.85),
          g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone UNION ALL
            SELECT s.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, weaker) END FROM g JOIN strong s ON s.k = g.k + 1)
        SELECT f AS feature, {rnd('w')} AS importance, list_contains((SELECT gone FROM g ORDER BY k DESC LIMIT 1), f) AS dropped FROM w""",
    ("pairs",),
)
def correlation_drop(x: Inputs):
    """Greedy drop over all features; a feature counts as important as it is correlated with the last return."""
    pairs, first = _all_pairs(x), ALL_FEATURES[0]
    weight = {first: 1.0} | {r.feature_b: r.abs_corr or 0.0 for r in pairs.where(F.col("feature_a") == first).collect()}  # one row a feature
    _, gone = P.correlation_filter(pairs, list(ALL_FEATURES), weight)
    rows = [(f, float(weight[f]), f in set(gone)) for f in ALL_FEATURES]
    return rounded(x.spark.createDataFrame(rows, "feature string, importance double, dropped boolean"))


SCORE_SQL = """SELECT registry_key, 'f' || model_seq % 40 AS feature, avg(sharpe) + 4.1 AS importance, avg(auc_val) - 0.55 AS permutation FROM model_records GROUP BY ALL"""


def _scores(x: Inputs):
    feature = F.concat(F.lit("f"), (F.col("model_seq") % 40).cast("string"))
    return x.model_records().groupBy("registry_key", feature.alias("feature")).agg(
        (F.avg("sharpe") + 4.1).alias("importance"), (F.avg("auc_val") - 0.55).alias("permutation")
    )


@query(
    "weak_feature_filter",
    f"""WITH s AS ({SCORE_SQL}), t AS (SELECT *, NOT (importance / sum(importance) OVER (PARTITION BY registry_key) < 0.005 AND permutation <= 0) AS strong FROM s),
          u AS (SELECT *, bool_or(strong) OVER (PARTITION BY registry_key) AS anyone FROM t),
          v AS (SELECT *, row_number() OVER (PARTITION BY registry_key ORDER BY importance DESC, feature) AS rank FROM u WHERE strong OR NOT anyone)
        SELECT registry_key, feature, {r6('importance', 'permutation')}, CAST(rank AS INT) AS rank FROM v WHERE rank <= 4""",
    ("model_records",),
)
def weak_feature_filter(x: Inputs):
    return rounded(P.weak_feature_filter(_scores(x), 4, "registry_key"))


@query(
    "stable_features",
    f"""WITH s AS (SELECT registry_key, model_seq % 5 AS fold_id, 'f' || model_seq % 7 AS feature, sharpe AS importance FROM model_records WHERE model_seq % 3 <> 0),
          n AS (SELECT registry_key, count(DISTINCT model_seq % 5) AS k FROM model_records GROUP BY 1),
          c AS (SELECT registry_key, feature, count(DISTINCT fold_id) AS appearances, avg(importance) AS mean_importance FROM s GROUP BY 1, 2)
        SELECT registry_key, feature, appearances, {rnd('mean_importance')} AS mean_importance, CAST(row_number() OVER (PARTITION BY registry_key ORDER BY mean_importance DESC, feature) AS INT) AS rank
        FROM c JOIN n USING (registry_key) WHERE appearances >= ceil(k * 0.6e0)""",
    ("model_records",),
)
def stable_features(x: Inputs):
    fold = F.col("model_seq") % 5
    rec = x.model_records()
    sel = rec.where(F.col("model_seq") % 3 != 0).select(
        "registry_key", fold.alias("fold_id"), F.concat(F.lit("f"), (F.col("model_seq") % 7).cast("string")).alias("feature"), F.col("sharpe").alias("importance")
    )
    fs = rec.select("registry_key", fold.alias("fold_id"), F.lit(0.5).alias("auc")).distinct()
    return rounded(P.stable_features(sel, fs, key="registry_key"))


# ---------------------------------------------------------------- thresholds
def grid_sql(name: str, lo: float, hi: float, qs, floor: float, cap: float) -> str:
    step = (hi - lo) / 6
    vals = [repr(lo + i * step) + "::DOUBLE" for i in range(7)] + [f"quantile_cont(prob, {q})" for q in qs]
    return f"{name} AS (SELECT DISTINCT product_id, least(greatest(t, {floor}::DOUBLE), {cap}::DOUBLE) AS threshold FROM (SELECT product_id, unnest([{', '.join(vals)}]) AS t FROM scored GROUP BY 1))"


THR_SQL = f"""{grid_sql('bc', 0.45, 0.85, Q.BUY['quantiles'], 0.45, 0.90)}, {grid_sql('ec', 0.10, 0.45, Q.EXIT['quantiles'], 0.05, 0.49)},
  sz AS (SELECT product_id, greatest(30, CAST(floor(count(*) * 0.03e0) AS BIGINT)) AS need FROM scored GROUP BY 1),
  bs AS (SELECT s.product_id, threshold, count(*) AS support, avg(target_return) AS mean_return, CASE WHEN count(*) < 2 OR stddev_pop(target_return) = 0 THEN 0e0 ELSE avg(target_return) / stddev_pop(target_return) * sqrt(count(*)) END AS sharpe, avg((target = 1)::INT) AS up_share
     FROM scored s JOIN bc ON bc.product_id = s.product_id AND s.prob >= threshold GROUP BY 1, 2),
  es AS (SELECT s.product_id, threshold, count(*) AS support, avg(target_return) AS mean_return, avg((target = 1)::INT) AS up_share FROM scored s JOIN ec ON ec.product_id = s.product_id AND s.prob <= threshold GROUP BY 1, 2)"""


@query(
    "threshold_crossjoin",
    f"WITH {THR_SQL} SELECT product_id, {rnd('threshold')} AS threshold, support, {r6('mean_return', 'sharpe', 'up_share')} FROM bs",
    ("scored",),
)
def threshold_crossjoin(x: Inputs):
    scored = x.scored()
    return rounded(Q.threshold_stats(scored, Q.candidates(scored, Q.BUY), True))


@query(
    "optimize_thresholds",
    f"""WITH {THR_SQL}, b AS (SELECT *, sharpe + up_share + mean_return * 100 AS score FROM bs JOIN sz USING (product_id) WHERE support >= need AND up_share >= 0.55),
          b1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, threshold) = 1),
          e1 AS (SELECT *, 1 - up_share - mean_return * 100 AS score FROM es JOIN sz USING (product_id) WHERE support >= need QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY 1 - up_share - mean_return * 100 DESC, threshold) = 1),
          fb AS (SELECT product_id, count(*) FILTER (prob >= 0.62) AS n, avg(target) FILTER (prob >= 0.62) AS p FROM scored GROUP BY 1)
        SELECT fb.product_id, round(coalesce(b1.threshold, 0.62e0), 6) AS buy_threshold,
          round(CASE WHEN coalesce(e1.threshold, 0.38e0) >= coalesce(b1.threshold, 0.62e0) THEN greatest(0.05e0, coalesce(b1.threshold, 0.62e0) - 0.1e0) ELSE coalesce(e1.threshold, 0.38e0) END, 6) AS exit_threshold,
          {rnd('coalesce(b1.score, 0e0)')} AS buy_score, {rnd('coalesce(e1.score, 0e0)')} AS exit_score, coalesce(b1.support, fb.n) AS buy_support, coalesce(e1.support, 0) AS exit_support,
          {rnd('coalesce(b1.up_share, fb.p, 0e0)')} AS buy_precision, b1.threshold IS NOT NULL AS entry_ready
        FROM fb LEFT JOIN b1 USING (product_id) LEFT JOIN e1 USING (product_id)""",
    ("scored",),
)
def optimize_thresholds(x: Inputs):
    return rounded(Q.optimize_thresholds(staged(x.scored())))


@query(
    "resolve_thresholds",
    f"""WITH m AS (SELECT upper(split_part(registry_key, '_', 1)) AS base, avg(buy_threshold) AS b, min(buy_threshold) - 0.2e0 AS e FROM model_records GROUP BY 1)
        SELECT base, {rnd('CASE WHEN n_regionkey = 1 THEN 1e0 WHEN n_regionkey = 2 THEN 0.3e0 ELSE coalesce(b, 0.62e0) END')} AS buy_threshold,
          {rnd('least(CASE WHEN n_regionkey = 1 THEN 0e0 ELSE coalesce(e, 0.38e0) END, CASE WHEN n_regionkey = 1 THEN 1e0 WHEN n_regionkey = 2 THEN 0.3e0 ELSE coalesce(b, 0.62e0) END)')} AS exit_threshold
        FROM (SELECT 'A' || n_nationkey AS base, n_regionkey FROM nation) LEFT JOIN m USING (base)""",
    ("model_records",),
)
def resolve_thresholds(x: Inputs):
    nat = x.table("nation").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("base"), "n_regionkey")
    models = x.model_records().groupBy(F.upper(F.split_part("registry_key", F.lit("_"), F.lit(1))).alias("base")).agg(
        F.avg("buy_threshold").alias("buy_threshold"), (F.min("buy_threshold") - 0.2).alias("exit_threshold")
    )
    r = F.col("n_regionkey")
    over = nat.where(r.isin(1, 2)).select("base", F.when(r == 1, 1.5).otherwise(0.3).alias("buy"), F.when(r == 1, -0.5).alias("sell"))
    return rounded(Q.resolve_thresholds(nat.select("base"), models, over))


# ---------------------------------------------------------------- drift, regime, signals
DRIFT = "ret_1 ret_5 rsi_14 atr_pct bb_pct bb_width realized_vol_5 realized_vol_20 volume_ratio hl_ratio range_compression_20 price_vs_ema_fast".split()
SQL_VIEWS["early"] = (
    "SELECT *, row_idx < n - greatest(1, CAST(floor(n * 0.15e0) AS BIGINT)) AS is_train FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM kept)", ("kept",),
)
BOUND_SQL = f"""long AS (SELECT product_id, open_time, is_train, f AS feature, v AS value FROM (SELECT * FROM (SELECT product_id, open_time, is_train, {', '.join(DRIFT)} FROM early) UNPIVOT (v FOR f IN ({', '.join(DRIFT)})))),
  bounds AS (SELECT product_id, feature, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS high FROM long WHERE is_train GROUP BY 1, 2)"""


def labeled_rows(x: Inputs, columns=None):
    kept = staged(features(x))
    return staged(L.holdout_split(number_rows(kept, ["product_id"], "open_time", CANDLE_SPAN)))


@query("drift_bounds", f"WITH {BOUND_SQL} SELECT product_id, feature, {r6('low', 'median', 'high')} FROM bounds", ("early",))
def drift_bounds(x: Inputs):
    return rounded(D.drift_bounds(labeled_rows(x).where("NOT is_test"), DRIFT))


DRIFT_SQL = f"""{BOUND_SQL}, chk AS (SELECT l.product_id, open_time, value < low - m OR value > high + m AS out FROM (SELECT *, 0.1e0 * greatest(abs(high - low), abs(median) * 0.1e0, 1e-9) AS m FROM bounds) b
     JOIN long l USING (product_id, feature)), dr AS (SELECT product_id, open_time, count(*) AS checked, count(*) FILTER (out) AS outs FROM chk GROUP BY 1, 2)"""


@query(
    "drift_evaluate",
    f"""WITH {DRIFT_SQL} SELECT product_id, open_time, checked AS checked_features, outs AS outlier_count, {rnd('outs / checked::DOUBLE')} AS outlier_ratio,
          CASE WHEN outs / checked::DOUBLE >= 0.3 THEN 'out_of_distribution' ELSE 'ok' END AS drift_status, outs / checked::DOUBLE < 0.3 AS drift_actionable,
          CASE WHEN outs / checked::DOUBLE >= 0.3 THEN 'drift_blocked_out_of_distribution' ELSE 'ok' END AS drift_reason FROM dr""",
    ("early",),
)
def drift_evaluate(x: Inputs):
    rows = labeled_rows(x)
    bounds = D.drift_bounds(rows.where("NOT is_test"), DRIFT)
    return rounded(D.drift_evaluate(rows, KEY, DRIFT, bounds))


@query(
    "drift_bounds_join",
    f"""WITH {BOUND_SQL} SELECT product_id, feature, count(*) AS checked, count(*) FILTER (value < low - m OR value > high + m) AS outliers FROM
          (SELECT *, 0.1e0 * greatest(abs(high - low), abs(median) * 0.1e0, 1e-9) AS m FROM bounds) JOIN long USING (product_id, feature) GROUP BY 1, 2""",
    ("early",),
)
def drift_bounds_join(x: Inputs):
    rows = labeled_rows(x)
    return D.drift_by_feature(rows, DRIFT, D.drift_bounds(rows.where("NOT is_test"), DRIFT))


LIMIT_SQL = "lim AS (SELECT product_id, quantile_cont(realized_vol_5, 0.95) AS vol_limit, quantile_cont(range_compression_20, 0.15) AS compression_limit, quantile_cont(bb_width, 0.15) AS width_limit FROM early WHERE is_train GROUP BY 1)"


@query("regime_heuristic_fit", f"WITH {LIMIT_SQL} SELECT product_id, {r6('vol_limit', 'compression_limit', 'width_limit')} FROM lim", ("early",))
def regime_heuristic_fit(x: Inputs):
    return rounded(D.regime_limits(labeled_rows(x).where("NOT is_test")))


REGIME_SQL = f"""{LIMIT_SQL}, rg AS (SELECT o.product_id, o.open_time, o.row_idx, CASE WHEN realized_vol_5 IS NULL OR range_compression_20 IS NULL OR bb_width IS NULL THEN 'unknown'
    WHEN realized_vol_5 >= vol_limit THEN 'extreme_volatility' WHEN range_compression_20 <= compression_limit AND bb_width <= width_limit THEN 'compressed' ELSE 'normal' END AS regime FROM ohlcv o JOIN lim USING (product_id))"""


@query(
    "regime_evaluate",
    f"""WITH {REGIME_SQL} SELECT product_id, open_time, regime, regime IN ('unknown', 'normal') AS regime_actionable, CASE regime WHEN 'unknown' THEN 'regime_insufficient_features'
          WHEN 'extreme_volatility' THEN 'regime_blocked_extreme_volatility' WHEN 'compressed' THEN 'regime_blocked_compression' ELSE 'ok' END AS regime_reason FROM rg""",
    ("early",),
)
def regime_evaluate(x: Inputs):
    limits = D.regime_limits(labeled_rows(x).where("NOT is_test"))
    rows = ohlcv_features(x.candle_table(), CANDLE_SPAN, drop_incomplete=False, columns=list(D.REGIME_FEATURES))
    return D.regime_evaluate(rows, limits).select(*KEY, "regime", "regime_actionable", "regime_reason")


@query(
    "regime_states",
    """WITH s AS (SELECT product_id, row_idx % 3 AS state, avg(realized_vol_5) AS vol, avg(bb_width) AS width, avg(range_compression_20) AS comp FROM kept GROUP BY 1, 2),
         a AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY vol DESC, state) AS v FROM s),
         b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY width, state) + row_number() OVER (PARTITION BY product_id ORDER BY comp, state) AS r FROM a WHERE v > 1),
         c AS (SELECT product_id, state, row_number() OVER (PARTITION BY product_id ORDER BY r, state) AS f FROM b)
       SELECT product_id, state, 'extreme_volatility' AS label, false AS actionable FROM a WHERE v = 1 UNION ALL
       SELECT product_id, state, CASE WHEN f = 1 THEN 'compressed' ELSE 'normal' END, f <> 1 FROM c""",
    ("kept",),
)
def regime_states(x: Inputs):
    """State naming, on states that are given (a fitted mixture is checked in tests)."""
    rows = labeled_rows(x).withColumn("state", F.col("row_idx") % 3)
    return D.label_states(rows)


SCORE_P = "((open_time // 3600000 * 7919) % 1000) / 1000e0"


@query(
    "score_signals",
    f"""WITH {DRIFT_SQL}, {REGIME_SQL}, j AS (SELECT k.product_id, k.open_time, CASE WHEN k.product_id = 'VIEW-USD' THEN NULL ELSE {SCORE_P} END AS p, k.product_id <> 'CLICK-USD' AS ok,
            outs / checked::DOUBLE < 0.3 AS d, regime IN ('unknown', 'normal') AS g, regime FROM kept k JOIN dr USING (product_id, open_time) JOIN rg USING (product_id, open_time))
        SELECT product_id, open_time, CASE WHEN p IS NULL OR NOT (d AND g) THEN 'HOLD' WHEN p >= 0.62 THEN 'BUY' WHEN p <= 0.38 THEN 'EXIT_LONG' ELSE 'HOLD' END AS signal,
          p IS NOT NULL AND ok AND d AND g AS actionable, CASE WHEN p IS NULL THEN 'no_model' WHEN ok AND NOT d THEN 'drift_blocked_out_of_distribution'
            WHEN ok AND NOT g THEN CASE regime WHEN 'extreme_volatility' THEN 'regime_blocked_extreme_volatility' ELSE 'regime_blocked_compression' END
            WHEN ok THEN 'ok' ELSE 'base_not_enabled' END AS reason, round(coalesce(p, 0.5e0), 6) AS prob_buy FROM j""",
    ("early",),
)
def score_signals(x: Inputs):
    rows = labeled_rows(x)
    train = rows.where("NOT is_test")
    drift = D.drift_evaluate(rows, KEY, DRIFT, D.drift_bounds(train, DRIFT))
    gated = D.regime_evaluate(rows, D.regime_limits(train)).join(drift, KEY)
    p = ((F.expr("open_time div 3600000") * 7919) % 1000) / 1000.0
    gated = gated.withColumns(
        {
            "prob_buy": F.when(F.col("product_id") != "VIEW-USD", p),
            "buy_threshold": F.lit(0.62), "exit_threshold": F.lit(0.38),
            "model_actionable": F.col("product_id") != "CLICK-USD",
            "model_reason": F.when(F.col("product_id") != "CLICK-USD", "ok").otherwise("base_not_enabled"),
        }
    )
    return G.signals_from_probabilities(gated).select(*KEY, "signal", "actionable", "reason", "prob_buy")


@query(
    "no_model_rows",
    f"""SELECT product_id, open_time, 'HOLD' AS signal, false AS actionable, 'no_model' AS reason, 0.5e0 AS prob_buy FROM candles WHERE product_id NOT IN ('CLICK-USD', 'VIEW-USD')""",
    ("candles",),
)
def no_model_rows(x: Inputs):
    from tapeflow.operators.model_tables import resolve_for_products

    models = x.trades().select("product_id").distinct().where(F.col("product_id").isin("CLICK-USD", "VIEW-USD")).select(
        F.lower(F.replace("product_id", F.lit("-"), F.lit("_"))).alias("registry_key"), F.split_part("product_id", F.lit("-"), F.lit(1)).alias("base"),
        F.lit(1).alias("model_seq"), F.lit("ok").alias("reason"), F.lit(True).alias("actionable"),
    )
    rows = resolve_for_products(x.candles(), models).where(F.col("model_seq").isNull()).withColumns(
        {
            "prob_buy": F.lit(None).cast("double"), "buy_threshold": F.lit(0.62), "exit_threshold": F.lit(0.38), "model_actionable": F.col("actionable"),
            "model_reason": F.col("reason"), "drift_actionable": F.lit(True), "drift_reason": F.lit("ok"), "regime_actionable": F.lit(True), "regime_reason": F.lit("ok"),
        }
    )
    return G.signals_from_probabilities(rows).select(*KEY, "signal", "actionable", "reason", "prob_buy")


# ---------------------------------------------------------------- registry tables
from tapeflow.operators import model_tables as R  # noqa: E402

FLOOR_SQL = """((auc_val >= 0.53 AND sharpe >= 0.1 AND max_drawdown <= 0.20 AND entry_ready AND buy_support >= 30) OR
  (buy_threshold >= 0.62 AND auc_val >= 0.55 AND sharpe >= 2.0 AND precision_buy >= 0.65 AND max_drawdown <= 0.10 AND buy_support >= 20))"""
ACT_SQL = "act AS (SELECT * FROM model_records WHERE promoted QUALIFY row_number() OVER (PARTITION BY registry_key ORDER BY model_seq DESC) = 1)"
RES_SQL = """ast AS (SELECT DISTINCT registry_key FROM model_records UNION SELECT 'a' || n_nationkey || '_usd' FROM nation),
  pk AS (SELECT * FROM model_records QUALIFY row_number() OVER (PARTITION BY registry_key ORDER BY promoted DESC, model_seq DESC) = 1),
  res AS (SELECT registry_key, upper(split_part(registry_key, '_', 1)) AS base, model_seq, auc_val, CASE WHEN model_seq IS NULL THEN 'no_model' WHEN NOT promoted THEN 'no_promoted_model'
    WHEN length(registry_key) > 6 THEN 'base_not_enabled' ELSE 'ok' END AS reason FROM ast LEFT JOIN pk USING (registry_key))"""


@query("promotion_floor", f"SELECT registry_key, model_seq, {FLOOR_SQL} AS passes FROM model_records", ("model_records",))
def promotion_floor(x: Inputs):
    return x.model_records().select("registry_key", "model_seq", R.promotion_floor().alias("passes"))


@query(
    "promotion_decision",
    f"""WITH {ACT_SQL} SELECT m.registry_key, m.model_seq, {FLOOR_SQL.replace('auc_val', 'm.auc_val').replace('sharpe', 'm.sharpe').replace('max_drawdown', 'm.max_drawdown').replace('entry_ready', 'm.entry_ready').replace('buy_support', 'm.buy_support').replace('buy_threshold', 'm.buy_threshold').replace('precision_buy', 'm.precision_buy')}
          AND (a.auc_val IS NULL OR (m.auc_val - a.auc_val >= 0.005 AND m.sharpe >= greatest(0.1e0, a.sharpe) AND m.max_drawdown <= 0.2)) AS promote FROM model_records m LEFT JOIN act a ON a.registry_key = m.registry_key""",
    ("model_records",),
)
def promotion_decision(x: Inputs):
    rec = x.model_records()
    return R.promotion_decision(rec, R.active_records(rec)).select("registry_key", "model_seq", "promote")


def _resolved(x: Inputs):
    rec = x.model_records()
    extra = x.table("nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string"), F.lit("_usd")).alias("registry_key"))
    assets = rec.select("registry_key").unionByName(extra)
    allowed = assets.where(F.length("registry_key") <= 6).select(F.split_part("registry_key", F.lit("_"), F.lit(1)).alias("base"))
    return R.resolved_models(assets, rec, allowed)


@query("active_model", f"WITH {RES_SQL} SELECT registry_key, base, model_seq, {rnd('auc_val')} AS auc_val, reason, reason = 'ok' AS actionable FROM res", ("model_records",))
def active_model(x: Inputs):
    return rounded(_resolved(x))


@query("actionable_assets", f"WITH {RES_SQL} SELECT registry_key FROM res WHERE reason = 'ok'", ("model_records",))
def actionable_assets(x: Inputs):
    return _resolved(x).where("actionable").select("registry_key")


@query(
    "retrains_since",
    "SELECT registry_key, count(*) AS trained, count(*) FILTER (promoted) AS promoted, round(arg_max(auc_val, model_seq), 4) AS last_auc, max(model_seq) AS last_trained_at FROM model_records WHERE model_seq >= 700 GROUP BY 1",
    ("model_records",),
)
def retrains_since(x: Inputs):
    return R.retrains_since(x.model_records(), F.lit(700), "model_seq")


@query(
    "universe_manifest",
    """WITH b AS (SELECT 'A' || n_nationkey AS base FROM nation), p AS (SELECT registry_key, arg_max(model_seq, (promoted, model_seq)) AS model_seq, arg_max(auc_val, (promoted, model_seq)) AS auc_val,
         bool_or(promoted) AS promoted, count(*) AS model_count FROM model_records GROUP BY 1)
       SELECT base, registry_key, model_seq, CASE WHEN promoted THEN 'promoted' WHEN model_seq IS NOT NULL THEN 'candidate_latest' ELSE 'missing' END AS source, round(auc_val, 6) AS auc_val, coalesce(model_count, 0) AS model_count
       FROM b LEFT JOIN p ON upper(split_part(registry_key, '_', 1)) = base""",
    ("model_records",),
)
def universe_manifest(x: Inputs):
    bases = x.table("nation").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("base"))
    return R.universe_manifest(bases, x.model_records())


@query(
    "resolve_model",
    f"""WITH {RES_SQL}, pr AS (SELECT DISTINCT 'A' || s_suppkey % 30 AS base, 'A' || s_suppkey % 30 || CASE s_suppkey % 2 WHEN 0 THEN '-USD' ELSE '-EUR' END AS product_id FROM supplier)
        SELECT product_id, coalesce(registry_key, lower(pr.base)) AS registry_key, model_seq, coalesce(reason, 'no_model') AS reason, coalesce(reason = 'ok', false) AS actionable FROM pr LEFT JOIN res USING (base)""",
    ("model_records",),
)
def resolve_model(x: Inputs):
    s = F.col("s_suppkey")
    p = F.concat(F.lit("A"), (s % 30).cast("string"), F.when(s % 2 == 0, "-USD").otherwise("-EUR"))
    return R.resolve_for_products(x.table("supplier").select(p.alias("product_id")).distinct(), _resolved(x))


@query(
    "assets_without_model",
    """SELECT DISTINCT lower(event_type) || '_usd' AS registry_key, upper(event_type) AS base, 'new_asset' AS reason FROM events""",
    ("model_records",),
)
def assets_without_model(x: Inputs):
    obs = x.table("events").select(F.col("event_type").alias("base"))
    known = x.model_records().select(F.split_part("registry_key", F.lit("_"), F.lit(1)).alias("base"))
    return R.assets_without_model(obs.unionByName(known), x.model_records())
