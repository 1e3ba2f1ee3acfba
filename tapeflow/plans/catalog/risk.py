"""Queries on sizing, risk, decisions, reports, as-of joins and the screen."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapeflow.plans.sql_features  # noqa: F401
from tapeflow.functions.asof import asof_last
from tapeflow.functions.columns import epoch_ms, int_div, rounded
from tapeflow.functions.names import OHLCV_FEATURES
from tapeflow.operators import ledger as L
from tapeflow.operators import reports as P
from tapeflow.operators import risk as R
from tapeflow.operators import screen as S
from tapeflow.plans.registry import query, r6, rnd
from tapeflow.plans.views import CANDLE_SPAN, HOUR, SQL_VIEWS, Inputs
from tapeflow.session import staged

MACRO = [1704461400000, 1705066200000, 1706275800000]

# ---------------------------------------------------------------- as-of and range joins
SQL_VIEWS["sig_close"] = (
    "SELECT s.*, c.close AS last_close FROM signals s ASOF LEFT JOIN candles c ON s.product_id = c.product_id AND s.ts_ms >= c.close_time",
    ("signals", "candles"),
)


@query("asof_last_close", f"SELECT product_id, event_id, ts_ms, {rnd('last_close')} AS last_close FROM sig_close", ("sig_close",))
def asof_last_close(x: Inputs):
    out = asof_last(
        x.signals(), x.candle_table(), keys=["product_id"], left_time="ts_ms", right_time="close_time", values=["close"], block_ms=24 * HOUR
    )
    return rounded(out.select("product_id", "event_id", "ts_ms", F.col("close").alias("last_close")))


MACRO_SQL = " OR ".join(f"abs(ts_ms - {m}) <= 1800000" for m in MACRO)


@query("macro_event_window", f"SELECT event_id, product_id, ts_ms FROM signals WHERE {MACRO_SQL}", ("signals",))
def macro_event_window(x: Inputs):
    return x.signals().where(R.in_macro_window("ts_ms", MACRO)).select("event_id", "product_id", "ts_ms")


BAD_SQL = "reason = 'stop_loss_hit' OR (pnl_pct <= -0.1e0 AND reason IN ('signal_exit_long', 'max_hold_hit') AND holding_minutes <= 20)"
SQL_VIEWS["bad_exits"] = (
    f"""SELECT *, count(*) OVER w AS adverse_count, count(*) FILTER (reason = 'stop_loss_hit') OVER w AS stop_count FROM exits WHERE {BAD_SQL}
        WINDOW w AS (PARTITION BY product_id ORDER BY ts_ms RANGE BETWEEN 5400000 PRECEDING AND CURRENT ROW)""",
    ("exits",),
)
SQL_VIEWS["locked"] = (
    "SELECT *, CASE WHEN adverse_count >= 3 OR stop_count >= 2 THEN ts_ms + 2700000 END AS block_until FROM bad_exits", ("bad_exits",),
)
SQL_VIEWS["chop"] = (
    """WITH n AS (SELECT s.event_id, count(b.ts_ms) AS adverse_count, count(b.ts_ms) FILTER (b.reason = 'stop_loss_hit') AS stop_count FROM signals s
         LEFT JOIN bad_exits b ON b.product_id = s.product_id AND b.ts_ms BETWEEN s.ts_ms - 5400000 AND s.ts_ms GROUP BY 1),
       u AS (SELECT product_id, ts_ms, 0 AS side, block_until, NULL::BIGINT AS event_id FROM locked UNION ALL SELECT product_id, ts_ms, 1, NULL, event_id FROM signals),
       r AS (SELECT *, coalesce(max(block_until) OVER (PARTITION BY product_id ORDER BY ts_ms, side ROWS UNBOUNDED PRECEDING), 0) AS blocked_until_ms FROM u)
       SELECT s.*, adverse_count, stop_count, blocked_until_ms, blocked_until_ms > s.ts_ms AS chop_blocked, adverse_count >= 2 AS chop_caution,
         CASE WHEN adverse_count >= 2 THEN 0.65e0 ELSE 0.62e0 END AS chop_min_prob, CASE WHEN adverse_count >= 2 THEN 0.005e0 ELSE 0.01e0 END AS chop_max_risk,
         CASE WHEN adverse_count >= 2 THEN 0.6e0 ELSE 1e0 END AS chop_notional_scale
       FROM signals s JOIN n USING (event_id) JOIN r USING (event_id)""",
    ("signals", "locked"),
)


@query("adverse_exit", f"SELECT event_id, {BAD_SQL} AS adverse FROM exits", ("exits",))
def adverse_exit(x: Inputs):
    return x.exits().select("event_id", R.adverse_exit().alias("adverse"))


@query("chop_state", "SELECT event_id, product_id, ts_ms, adverse_count, stop_count, block_until FROM locked", ("locked",))
def chop_state(x: Inputs):
    return R.chop_exits(x.exits()).select("event_id", "product_id", "ts_ms", "adverse_count", F.col("stop_count"), "block_until")


CHOP_COLS = "adverse_count, stop_count, blocked_until_ms, chop_blocked, chop_caution, chop_min_prob, chop_max_risk, chop_notional_scale"


@query("recent_adverse_exits", f"SELECT event_id, product_id, {CHOP_COLS} FROM chop", ("chop",))
def recent_adverse_exits(x: Inputs):
    return R.chop_at(x.signals(), x.exits()).select("event_id", "product_id", *CHOP_COLS.split(", "))


# ---------------------------------------------------------------- sizing, exits, risk
P_SQL = "least(greatest(prob_buy, 0e0), 0.999999e0)"
SQL_VIEWS["sized"] = (
    f"""WITH a AS (SELECT *, 517e0 + (event_id % 97) * 101e0 AS capital_total, (event_id % 53) * 3e0 - 6e0 AS capital_available, 0.55e0 AS buy_threshold FROM signals),
         b AS (SELECT *, greatest(0e0, ({P_SQL} * 1.5e0 - (1e0 - {P_SQL})) / 1.5e0) AS raw_kelly, greatest(0e0, least(1e0, ({P_SQL} - 0.55e0) / (1e0 - 0.55e0))) AS confidence FROM a),
         c AS (SELECT *, raw_kelly * 0.1e0 * confidence AS applied_kelly FROM b),
         d AS (SELECT *, CASE WHEN capital_available <= 0 THEN 0e0 ELSE least(least(greatest(25e0, capital_total * least(0.005e0, applied_kelly)), 50e0, capital_total * 0.01e0 / 0.01e0), capital_available) END AS notional FROM c)
       SELECT *, CASE WHEN notional > 0 THEN notional * 0.01e0 / capital_total ELSE 0e0 END AS risk, notional > 25.000000001 AS used_dynamic FROM d""",
    ("signals",),
)


def sized(x: Inputs):
    rows = x.signals().withColumns(
        {
            "capital_total": 517.0 + (F.col("event_id") % 97) * 101.0, "capital_available": (F.col("event_id") % 53) * 3.0 - 6.0,
            "buy_threshold": F.lit(0.55),
        }
    )
    return R.kelly_size(rows)


@query(
    "kelly_size",
    """SELECT event_id, round(notional, 6) AS notional_usd, round(risk, 8) AS risk_pct, round(raw_kelly, 8) AS raw_kelly, round(applied_kelly, 8) AS applied_kelly, round(confidence, 8) AS confidence,
         used_dynamic, CASE WHEN used_dynamic THEN 'kelly_fractional_dynamic' ELSE 'pilot_floor_notional' END AS sizing_reason FROM sized""",
    ("sized",),
)
def kelly_size(x: Inputs):
    return sized(x).select("event_id", "notional_usd", "risk_pct", "raw_kelly", "applied_kelly", "confidence", "used_dynamic", "sizing_reason")


@query(
    "scale_size",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(notional, 6) ELSE round(round(notional, 6) * 0.6e0, 6) END AS notional_usd,
         round(CASE WHEN event_id % 2 = 0 THEN risk ELSE round(round(notional, 6) * 0.6e0, 6) * 0.01e0 / capital_total END, 8) AS risk_pct,
         CASE WHEN used_dynamic THEN 'kelly_fractional_dynamic' ELSE 'pilot_floor_notional' END || CASE WHEN event_id % 2 = 0 THEN '' ELSE '|chop_caution_0.60' END AS sizing_reason FROM sized""",
    ("sized",),
)
def scale_size(x: Inputs):
    out = R.scale_size(sized(x), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.6), "chop_caution")
    return out.select("event_id", "notional_usd", "risk_pct", "sizing_reason")


SQL_VIEWS["held"] = (
    """SELECT event_id, product_id, ts_ms, CASE WHEN user_id % 11 = 0 THEN 0e0 ELSE 50e0 END AS entry_price, 49.2e0 + (event_id % 20) / 10e0 AS current_price, ts_ms - (user_id % 90) * 60000 AS opened_at_ms FROM signals""",
    ("signals",),
)
SQL_VIEWS["held_exit"] = (
    """SELECT *, CASE WHEN entry_price > 0 THEN (current_price / entry_price - 1e0) * 100e0 END AS pnl_pct, CASE WHEN entry_price > 0 THEN (ts_ms - opened_at_ms) / 60000e0 END AS holding_minutes FROM held""",
    ("held",),
)
EXIT_SQL = "CASE WHEN pnl_pct IS NULL THEN '' WHEN pnl_pct <= -1 THEN 'stop_loss_hit' WHEN pnl_pct >= 1.5 THEN 'take_profit_hit' WHEN holding_minutes >= 60 THEN 'max_hold_hit' ELSE '' END"


def held(x: Inputs):
    u = F.col("user_id")
    return R.exit_rule(
        x.signals().select(
            "event_id", "product_id", F.col("ts_ms").alias("now_ms"), F.when(u % 11 == 0, 0.0).otherwise(50.0).alias("entry_price"),
            (49.2 + (F.col("event_id") % 20) / 10.0).alias("current_price"), (F.col("ts_ms") - (u % 90) * 60_000).alias("opened_at_ms"),
        )
    )


@query(
    "exit_rule", f"SELECT event_id, {EXIT_SQL} AS exit_reason, {EXIT_SQL} <> '' AS should_exit, {r6('pnl_pct', 'holding_minutes')} FROM held_exit", ("held_exit",),
)
def exit_rule(x: Inputs):
    return rounded(held(x).select("event_id", "exit_reason", "should_exit", "pnl_pct", "holding_minutes"))


SQL_VIEWS["checked"] = (
    f"""SELECT c.*, (event_id % 13) / 1000e0 AS risk_pct, (event_id % 29) / 1000e0 AS drawdown_today, (event_id % 31) / 10000e0 AS spread_pct,
          CASE WHEN signal = 'EXIT_LONG' THEN 'ok' WHEN (event_id % 13) / 1000e0 > 0.01e0 THEN 'risk_per_trade' WHEN (event_id % 29) / 1000e0 >= 0.02e0 THEN 'daily_drawdown'
            WHEN (event_id % 31) / 10000e0 > 0.0025e0 THEN 'spread' WHEN chop_blocked THEN 'chop_blocked' WHEN prob_buy < chop_min_prob THEN 'chop_probability'
            WHEN (event_id % 13) / 1000e0 > chop_max_risk THEN 'chop_risk' WHEN prob_buy < 0.62e0 THEN 'probability' WHEN {MACRO_SQL} THEN 'macro_event' ELSE 'ok' END AS risk_reason FROM chop c""",
    ("chop",),
)


def checked(x: Inputs):
    e = F.col("event_id")
    rows = R.chop_at(x.signals(), x.exits()).withColumns(
        {"risk_pct": (e % 13) / 1000.0, "drawdown_today": (e % 29) / 1000.0, "spread_pct": (e % 31) / 10000.0}
    )
    return R.risk_check(rows, MACRO)


@query("risk_check", "SELECT event_id, risk_reason, risk_reason = 'ok' AS risk_ok FROM checked", ("checked",))
def risk_check(x: Inputs):
    return checked(x).select("event_id", "risk_reason", "risk_ok")


DEC_SQL = """CASE WHEN signal = 'EXIT_LONG' AND NOT h THEN 'ignored_no_position' WHEN signal = 'HOLD' AND NOT h THEN 'ignored_hold' WHEN signal = 'BUY' AND event_id % 9 = 0 THEN 'cooldown_active'
  WHEN signal = 'BUY' AND NOT actionable THEN 'ignored_non_actionable' WHEN signal = 'BUY' AND product_id = 'VIEW-USD' THEN 'ignored_base_not_enabled' WHEN h AND xr <> '' THEN 'accepted_exit'
  WHEN signal = 'HOLD' THEN 'ignored_hold' WHEN signal = 'BUY' AND risk_reason <> 'ok' THEN 'blocked_risk' WHEN signal = 'BUY' AND (h OR event_id % 8 = 0) THEN 'blocked_existing_position'
  WHEN signal = 'BUY' AND event_id % 6 = 1 THEN 'blocked_sizing_zero' WHEN signal = 'BUY' AND event_id % 10 = 3 THEN 'blocked_no_quote_balance' WHEN signal = 'BUY' THEN 'accepted_buy' ELSE 'accepted_exit' END"""
SQL_VIEWS["decided"] = (
    f"SELECT *, {DEC_SQL} AS decision FROM (SELECT *, user_id % 3 = 0 AS h, CASE WHEN user_id % 3 = 0 AND event_id % 5 = 0 THEN 'stop_loss_hit' ELSE '' END AS xr FROM checked)", ("checked",),
)


def decided(x: Inputs):
    e, u = F.col("event_id"), F.col("user_id")
    held_ = u % 3 == 0
    return R.signal_decision(
        checked(x).withColumns(
            {
                "has_position": held_, "in_cooldown": e % 9 == 0, "base_enabled": F.col("product_id") != "VIEW-USD",
                "exit_reason": F.when(held_ & (e % 5 == 0), "stop_loss_hit").otherwise(""), "base_balance": F.when(e % 8 == 0, 1.0).otherwise(0.0),
                "base_min_size": F.lit(0.5), "notional_usd": F.when(e % 6 == 1, 0.0).otherwise(25.0), "quote_balance": F.when(e % 10 == 3, 5.0).otherwise(100.0),
            }
        )
    )


@query(
    "signal_decision",
    """SELECT event_id, decision, CASE WHEN decision = 'ignored_no_position' THEN 'no_managed_position' WHEN decision = 'ignored_non_actionable' THEN reason WHEN decision = 'blocked_risk' THEN risk_reason
         WHEN decision = 'ignored_hold' AND h THEN 'position_open_waiting_exit' WHEN decision = 'accepted_exit' AND xr <> '' THEN xr WHEN decision = 'accepted_exit' THEN 'signal_exit_long' ELSE '' END AS decision_reason FROM decided""",
    ("decided",),
)
def signal_decision(x: Inputs):
    return decided(x).select("event_id", "decision", "decision_reason")


@query(
    "portfolio_state",
    f"""WITH b AS (SELECT c_nationkey AS account, CASE c_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'usdc' WHEN 2 THEN 'USDT' WHEN 3 THEN 'BTC' ELSE 'ETH' END AS currency, c_acctbal AS balance FROM customer),
          p AS (SELECT account, upper(currency) AS currency, sum(balance) AS balance FROM b GROUP BY 1, 2)
        SELECT account, {rnd("greatest(coalesce(sum(balance) FILTER (currency IN ('USD', 'USDC', 'USDT')), 0e0), 25e0)")} AS capital_total, {rnd("coalesce(sum(balance) FILTER (currency = 'USDC'), 0e0)")} AS capital_available,
          count(*) FILTER (currency = 'BTC' AND balance > 0) AS open_positions FROM p GROUP BY 1""",
)
def portfolio_state(x: Inputs):
    k = F.col("c_custkey") % 5
    cur = F.when(k == 0, "USD").when(k == 1, "usdc").when(k == 2, "USDT").when(k == 3, "BTC").otherwise("ETH")
    bal = x.table("customer").select(F.col("c_nationkey").alias("account"), cur.alias("currency"), F.col("c_acctbal").alias("balance"))
    allowed = bal.where(F.col("currency") == "BTC").select(F.col("currency").alias("base")).distinct()
    return rounded(R.portfolio_state(bal, "usdc", allowed, 25.0))


# ---------------------------------------------------------------- ledger and reports
def ledger(x: Inputs):
    runs = F.explode(F.array(F.lit("a"), F.lit("b")))
    candles = x.candle_table().withColumn("run", runs)
    signals = x.signals().withColumn("run", runs).select(
        "run", "product_id", "ts_ms", F.col("event_id").alias("event_seq"), "signal", "prob_buy", "actionable", F.lit("m1").alias("model_id")
    )
    return L.position_ledger(L.ledger_events(candles, signals), L.LedgerConfig(slippage_by_base={"CLICK": 0.5}), slice_ms=24 * HOUR, max_rows=500_000)


@query("position_ledger")
def position_ledger(x: Inputs):
    fills, _ = ledger(x)
    return rounded(fills)


PAPER_SQL = """paper AS (SELECT event_id AS event_seq, ts_ms, product_id, CASE event_id % 4 WHEN 0 THEN 'paper_buy_filled' WHEN 1 THEN 'paper_exit_signal_filled' WHEN 2 THEN 'paper_exit_rule_filled' ELSE 'ignored_hold' END AS decision,
  (prob_buy - 0.5e0) * 3e0 AS realized_pnl, 10000e0 + event_id % 100 AS equity, 9000e0 + event_id % 77 AS cash, (event_id % 10) / 1000e0 AS drawdown_pct, (user_id + 1) * 60000 AS holding_ms FROM signals)"""


def paper(x: Inputs):
    e = F.col("event_id")
    k = e % 4
    return x.signals().select(
        e.alias("event_seq"), "ts_ms", "product_id",
        F.when(k == 0, "paper_buy_filled").when(k == 1, "paper_exit_signal_filled").when(k == 2, "paper_exit_rule_filled").otherwise("ignored_hold").alias("decision"),
        ((F.col("prob_buy") - 0.5) * 3.0).alias("realized_pnl"), (10_000.0 + e % 100).alias("equity"), (9_000.0 + e % 77).alias("cash"),
        ((e % 10) / 1000.0).alias("drawdown_pct"), ((F.col("user_id") + 1) * 60_000).alias("holding_ms"),
    )


@query(
    "paper_summary",
    f"""WITH {PAPER_SQL} SELECT count(*) AS total, count(*) FILTER (decision = 'paper_buy_filled') AS buy_fills, count(*) FILTER (decision LIKE 'paper_exit%') AS sell_fills,
          round(sum(realized_pnl) FILTER (decision LIKE 'paper_exit%'), 4) AS realized_pnl_usd, round(arg_max(equity, (ts_ms, event_seq)) FILTER (decision LIKE 'paper%'), 4) AS last_equity_usd,
          round(arg_max(cash, (ts_ms, event_seq)) FILTER (decision LIKE 'paper%'), 4) AS last_cash_usd, round(arg_max(drawdown_pct, (ts_ms, event_seq)) FILTER (decision LIKE 'paper%') * 100, 4) AS last_drawdown_pct,
          round(avg(holding_ms) FILTER (decision LIKE 'paper_exit%') / 60000, 2) AS avg_holding_min FROM paper""",
    ("signals",),
)
def paper_summary(x: Inputs):
    return P.paper_summary(paper(x))


PNL_SQL = f"""{PAPER_SQL}, f AS (SELECT product_id, count(*) FILTER (decision = 'paper_buy_filled') AS buy_fills, count(*) FILTER (decision LIKE 'paper_exit%') AS sell_fills, sum(realized_pnl) FILTER (decision LIKE 'paper_exit%') AS realized_pnl FROM paper GROUP BY 1),
  o AS (SELECT product_id, (close - open) * volume AS unrealized_pnl, volume AS open_quantity FROM candles QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY open_time DESC) = 1),
  pnl AS (SELECT product_id, buy_fills, sell_fills, realized_pnl, coalesce(unrealized_pnl, 0e0) AS unrealized_pnl, coalesce(open_quantity, 0e0) AS open_quantity, realized_pnl + coalesce(unrealized_pnl, 0e0) AS total_pnl FROM f LEFT JOIN o USING (product_id))"""
PNL_COLS = ("realized_pnl", "unrealized_pnl", "open_quantity", "total_pnl")


def pnl(x: Inputs):
    last = x.candle_table().groupBy("product_id").agg(
        F.max_by(F.struct(F.col("volume").alias("quantity"), F.col("open").alias("entry_price"), F.col("close").alias("last_price")), "open_time").alias("p")
    ).select("product_id", "p.*")
    return P.pnl_by_product(paper(x), last)


@query("pnl_by_product", f"WITH {PNL_SQL} SELECT product_id, buy_fills, sell_fills, {r6(*PNL_COLS)} FROM pnl", ("signals", "candles"))
def pnl_by_product(x: Inputs):
    return rounded(pnl(x))


@query(
    "top_and_worst_products",
    f"WITH {PNL_SQL} (SELECT product_id, 'top' AS side, {rnd('total_pnl')} AS total_pnl FROM pnl ORDER BY pnl.total_pnl DESC, product_id LIMIT 2) UNION ALL (SELECT product_id, 'worst', {rnd('total_pnl')} FROM pnl ORDER BY pnl.total_pnl, product_id LIMIT 2)",
    ("signals", "candles"),
)
def top_and_worst_products(x: Inputs):
    return rounded(P.best_and_worst(pnl(x), 2).select("product_id", "side", "total_pnl"))


@query(
    "mark_to_market",
    f"""WITH m AS (SELECT product_id, event_id, ts_ms, 10000e0 + sum((prob_buy - 0.5e0) * 100e0) OVER (PARTITION BY product_id ORDER BY ts_ms, event_id) AS equity FROM signals)
        SELECT product_id, event_id, {rnd('equity')} AS equity, {rnd('greatest(0e0, (p - equity) / p)')} AS drawdown_pct FROM (SELECT *, greatest(max(equity) OVER (PARTITION BY product_id ORDER BY ts_ms, event_id), 10000e0) AS p FROM m)""",
    ("signals",),
)
def mark_to_market(x: Inputs):
    marks = x.signals().select("product_id", "ts_ms", F.col("event_id").alias("event_seq"), ((F.col("prob_buy") - 0.5) * 100.0).alias("pnl_change"))
    out = P.mark_to_market(marks, "product_id", "ts_ms", 10_000.0, 24 * HOUR)
    return rounded(out.select("product_id", F.col("event_seq").alias("event_id"), "equity", "drawdown_pct"))


@query(
    "signal_summary",
    """SELECT 'total' AS section, '' AS item, count(*) AS n, round(avg(prob_buy), 4) AS value FROM signals UNION ALL SELECT 'actionable', '', count(*) FILTER (actionable), NULL FROM signals
       UNION ALL SELECT 'by_signal', signal, count(*), NULL FROM signals GROUP BY 2 UNION ALL (SELECT 'top_assets', product_id, count(*), NULL FROM signals GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)
       UNION ALL (SELECT 'reasons', reason, count(*), NULL FROM signals WHERE NOT actionable GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""",
    ("signals",),
)
def signal_summary(x: Inputs):
    return P.signal_summary(x.signals(), 3, 5)


EXEC_DEC = "CASE event_id % 6 WHEN 0 THEN 'accepted_dry_run' WHEN 1 THEN 'sent_live' WHEN 2 THEN 'blocked_risk' WHEN 3 THEN 'rejected_exchange' ELSE 'ignored_hold' END"


@query(
    "execution_summary",
    f"""WITH e AS (SELECT *, {EXEC_DEC} AS decision FROM signals) SELECT 'total' AS section, '' AS item, count(*) AS n FROM e UNION ALL SELECT 'dry_runs', '', count(*) FROM e WHERE decision = 'accepted_dry_run'
        UNION ALL SELECT 'live_orders', '', count(*) FROM e WHERE decision = 'sent_live' UNION ALL SELECT 'rejected', '', count(*) FROM e WHERE decision IN ('blocked_risk', 'rejected_exchange')
        UNION ALL SELECT 'by_decision', decision, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'reasons', reason, count(*) FROM e GROUP BY 2""",
    ("signals",),
)
def execution_summary(x: Inputs):
    k = F.col("event_id") % 6
    dec = F.when(k == 0, "accepted_dry_run").when(k == 1, "sent_live").when(k == 2, "blocked_risk").when(k == 3, "rejected_exchange").otherwise("ignored_hold")
    return P.execution_summary(x.signals().withColumn("decision", dec))


@query(
    "recent_actionable_tail",
    f"SELECT event_id, product_id, ts_ms, signal, {rnd('prob_buy')} AS prob_buy FROM signals WHERE actionable ORDER BY ts_ms DESC, event_id DESC LIMIT 20", ("signals",),
)
def recent_actionable_tail(x: Inputs):
    return rounded(P.recent_actionable(x.signals(), 20).select("event_id", "product_id", "ts_ms", "signal", "prob_buy"))


@query(
    "bias_summary",
    """SELECT product_id, count(*) FILTER (signal = 'BUY') AS buy_count, count(*) FILTER (signal = 'HOLD') AS hold_count, count(*) FILTER (signal = 'EXIT_LONG') AS exit_count,
         round(min(prob_buy), 6) AS prob_min, round(quantile_cont(prob_buy, 0.25), 6) AS prob_p25, round(quantile_cont(prob_buy, 0.5), 6) AS prob_median, round(avg(prob_buy), 6) AS prob_mean, round(quantile_cont(prob_buy, 0.75), 6) AS prob_p75,
         round(max(prob_buy), 6) AS prob_max, round(avg((prob_buy < 0.38e0)::INT), 6) AS bearish_share, round(count(*) FILTER (signal = 'BUY') / count(*)::DOUBLE, 6) AS buy_share,
         round(count(*) FILTER (signal = 'EXIT_LONG') / count(*)::DOUBLE, 6) AS exit_share, quantile_cont(prob_buy, 0.75) > 0.38e0 AS likely_threshold_issue, avg(prob_buy) < 0.30e0 AS likely_model_bias FROM signals GROUP BY 1""",
    ("signals",),
)
def bias_summary(x: Inputs):
    return P.bias_summary(x.signals())


@query(
    "prob_alignment",
    f"SELECT product_id, {rnd('max(abs(prob_buy - (prob_buy * 0.99e0 + 0.001e0)))')} AS max_abs_diff, count(*) AS rows FROM signals GROUP BY 1", ("signals",),
)
def prob_alignment(x: Inputs):
    s = x.signals()
    return rounded(P.prob_alignment(s, s.withColumn("prob_buy", F.col("prob_buy") * 0.99 + 0.001), ["product_id", "event_id"]))


SNAP = OHLCV_FEATURES[:10]


@query(
    "latest_feature_snapshot",
    f"SELECT product_id, open_time, {', '.join(f'round({c}, 6) AS {c}' for c in SNAP)} FROM ohlcv QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY open_time DESC) = 1", ("ohlcv",),
)
def latest_feature_snapshot(x: Inputs):
    from tapeflow.operators.ohlcv import ohlcv_features

    return P.latest_snapshot(ohlcv_features(x.candle_table(), CANDLE_SPAN, drop_incomplete=False, columns=SNAP), SNAP)


@query("grouped_counts", "SELECT product_id, signal, count(*)::BIGINT AS n FROM signals GROUP BY GROUPING SETS ((product_id, signal), (product_id))", ("signals",))
def grouped_counts(x: Inputs):
    return P.grouped_counts(x.signals(), "product_id", "signal")


# ---------------------------------------------------------------- screen
RANK_SQL = "CASE quote_asset WHEN 'USD' THEN 1 WHEN 'USDC' THEN 2 ELSE 3 END"
SQL_VIEWS["preferred"] = (
    f"SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY base_asset ORDER BY {RANK_SQL}, quote_volume_24h DESC, s_suppkey) = 1", ("products",),
)
PREF_COLS = "base_asset, product_id, quote_asset, status, trading_disabled, limit_only, listing_age_days, s_suppkey"


def preferred(x: Inputs):
    return S.preferred_products(x.products(), tie="s_suppkey")


@query("preferred_products", f"SELECT {PREF_COLS}, {rnd('quote_volume_24h')} AS quote_volume_24h FROM preferred", ("preferred",))
def preferred_products(x: Inputs):
    return rounded(preferred(x).select(*PREF_COLS.split(", "), "quote_volume_24h"))


@query(
    "quote_volume",
    f"SELECT s_suppkey, {rnd('CASE s_suppkey % 3 WHEN 0 THEN s_acctbal WHEN 1 THEN s_acctbal * 2.5e0 ELSE 0e0 END')} AS quote_volume FROM supplier",
)
def quote_volume(x: Inputs):
    k = F.col("s_suppkey") % 3
    raw = x.table("supplier").select(
        "s_suppkey", F.when(k == 0, F.col("s_acctbal").cast("string")).when(k == 1, " ").alias("approximate_quote_24h_volume"),
        F.when(k == 1, F.col("s_acctbal").cast("string")).alias("price"), F.when(k == 1, "2.5").otherwise("7").alias("volume_24h"),
    )
    return rounded(raw.select("s_suppkey", S.quote_volume().alias("quote_volume")))


@query(
    "listing_age_days",
    "SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 ELSE greatest(0, (1707000000000 - epoch_us(ts) // 1000) // 86400000) END AS age_days FROM events",
)
def listing_age_days(x: Inputs):
    from tapeflow.functions.columns import epoch_ms

    iso = F.date_format(F.timestamp_millis(epoch_ms("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ev = x.table("events").select("event_id", F.when(F.col("event_id") % 4 == 3, "unknown").otherwise(iso).alias("new_at"))
    return ev.select("event_id", S.listing_age_days("new_at", 1_707_000_000_000).alias("age_days"))


#: The screen's clock and how far it looks back.
NOW, LOOKBACK = 1_706_680_800_000, 300 * 3_600_000
COV_SQL = f"""cs AS (SELECT product_id, least(count(DISTINCT open_time) / 300e0, 1e0) AS cov FROM candles WHERE open_time >= {NOW} - {LOOKBACK} GROUP BY 1),
  vs AS (SELECT product_id, CASE WHEN count(r) >= 2 THEN stddev_pop(r) * sqrt(1440e0) * 100e0 ELSE 0e0 END AS vol FROM (SELECT product_id, ln(close) - ln(lag(close) OVER (PARTITION BY product_id ORDER BY open_time)) AS r FROM candles WHERE open_time >= {NOW} - {LOOKBACK}) GROUP BY 1)"""


@query("candle_coverage", f"WITH {COV_SQL} SELECT product_id, {rnd('cov')} AS candle_coverage_pct FROM cs", ("candles",))
def candle_coverage(x: Inputs):
    return rounded(S.candle_coverage(S.within(x.candles(), NOW, LOOKBACK), 300))


@query("daily_realized_vol", f"WITH {COV_SQL} SELECT product_id, {rnd('vol')} AS daily_realized_vol_pct FROM vs", ("candles",))
def daily_realized_vol(x: Inputs):
    return rounded(S.daily_realized_vol(S.within(x.candle_table(), NOW, LOOKBACK)))


#: Length and wanted number of the candles that the screen measures, and its clock.
SUPPLY_MS, SUPPLY_CANDLES, SUPPLY_NOW = 10 * 86_400_000, 210, 1_004_832_000_000
SQL_VIEWS["supply_candles"] = (
    f"""SELECT product_id, epoch_us(l_shipdate) // 1000 // {SUPPLY_MS} * {SUPPLY_MS} AS open_time,
          arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS close
        FROM lineitem JOIN products ON l_suppkey = s_suppkey WHERE l_quantity > 0 GROUP BY ALL""",
    ("products",),
)
SQL_VIEWS["stats"] = (
    f"""WITH c AS (SELECT * FROM supply_candles WHERE open_time >= {SUPPLY_NOW - SUPPLY_CANDLES * SUPPLY_MS}),
          r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY product_id ORDER BY open_time)) AS r FROM c WHERE close > 0)
        SELECT product_id, least(count(DISTINCT open_time) / {SUPPLY_CANDLES}e0, 1e0) AS cov, CASE WHEN count(r) >= 2 THEN stddev_pop(r) * sqrt(1440e0) * 100e0 ELSE 0e0 END AS vol FROM r GROUP BY 1""",
    ("supply_candles",),
)
SQL_VIEWS["screened"] = (
    """WITH m AS (SELECT p.*, least(coalesce(cov, 0e0), 1e0) AS candle_coverage_pct, coalesce(vol, 0e0) AS daily_realized_vol_pct, CASE WHEN quote_volume_24h > 0 THEN ln(1e0 + quote_volume_24h) END AS lq FROM preferred p LEFT JOIN stats USING (product_id)),
         a AS (SELECT *, coalesce(CASE WHEN lq IS NOT NULL THEN (rank() OVER (ORDER BY lq NULLS LAST) - 1 + 0.5e0 * count(lq) OVER (PARTITION BY lq)) / count(lq) OVER () END, 0e0) AS liquidity_score,
           coalesce(CASE WHEN spread_pct IS NOT NULL THEN 1e0 - (rank() OVER (ORDER BY spread_pct NULLS LAST) - 1 + 0.5e0 * count(spread_pct) OVER (PARTITION BY spread_pct)) / count(spread_pct) OVER () END, 0e0) AS microstructure_score,
           least(listing_age_days / 180e0, 1e0) AS maturity_score FROM m),
         b AS (SELECT *, 100e0 * (0.40e0 * liquidity_score + 0.25e0 * microstructure_score + 0.20e0 * candle_coverage_pct + 0.15e0 * maturity_score) AS score,
           concat_ws(',', CASE WHEN status <> 'online' THEN 'status_not_online' END, CASE WHEN trading_disabled THEN 'trading_disabled' END, CASE WHEN limit_only THEN 'trading_flags_restrictive' END,
             CASE WHEN quote_volume_24h < 1000000 THEN 'low_quote_volume_24h' END, CASE WHEN spread_pct IS NULL THEN 'missing_spread' END, CASE WHEN spread_pct > 0.0025e0 THEN 'wide_spread' END,
             CASE WHEN listing_age_days < 45 THEN 'recent_listing' END, CASE WHEN candle_coverage_pct < 0.9e0 THEN 'low_candle_coverage' END) AS rs FROM a)
       SELECT *, rs = '' AS eligible, CASE WHEN rs = '' THEN 'ok' ELSE rs END AS reasons, CASE WHEN rs = '' AND score >= 70 THEN 'train_now' WHEN rs = '' OR (score >= 50 AND quote_volume_24h >= 500000) THEN 'observe' ELSE 'skip' END AS tier FROM b""",
    ("preferred", "stats"),
)


def supply_candles(x: Inputs):
    """Closes of the candles of all line items of a product's suppliers."""
    price, time = F.col("l_extendedprice") / F.col("l_quantity"), epoch_ms("l_shipdate")
    sold = x.table("lineitem").where("l_quantity > 0").join(x.products().select("product_id", "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    last = F.max_by(price, F.struct(time, "l_orderkey", "l_linenumber", price))
    return sold.groupBy("product_id", (int_div(time, SUPPLY_MS) * SUPPLY_MS).alias("open_time")).agg(last.alias("close"))


def screened(x: Inputs):
    pref = staged(preferred(x))
    candles = staged(S.within(supply_candles(x), SUPPLY_NOW, SUPPLY_CANDLES * SUPPLY_MS))
    stats = S.candle_coverage(candles, SUPPLY_CANDLES).join(S.daily_realized_vol(candles), "product_id", "left")
    return S.screen(pref, pref, stats)


@query(
    "screen_scores", f"SELECT product_id, {r6('liquidity_score', 'microstructure_score', 'maturity_score', 'score')}, {rnd('candle_coverage_pct')} AS stability_score FROM screened", ("screened",),
)
def screen_scores(x: Inputs):
    return rounded(screened(x).select("product_id", "liquidity_score", "microstructure_score", "maturity_score", "score", "stability_score"))


@query(
    "products_spreads_candles",
    f"SELECT product_id, base_asset, {r6('quote_volume_24h', 'spread_pct', 'candle_coverage_pct', 'daily_realized_vol_pct')} FROM screened", ("screened",),
)
def products_spreads_candles(x: Inputs):
    return rounded(screened(x).select("product_id", "base_asset", "quote_volume_24h", "spread_pct", "candle_coverage_pct", "daily_realized_vol_pct"))


@query("screen_reasons", "SELECT product_id, reasons, eligible FROM screened", ("screened",))
def screen_reasons(x: Inputs):
    return screened(x).select("product_id", F.concat_ws(",", "reasons").alias("reasons"), "eligible")


@query("screen_tiers", f"SELECT product_id, tier, {rnd('score')} AS score FROM screened", ("screened",))
def screen_tiers(x: Inputs):
    return rounded(screened(x).orderBy(*S.tier_order()).select("product_id", "tier", "score"))


@query(
    "screen_summary",
    "SELECT count(*) AS candidates, count(*) FILTER (tier = 'train_now') AS train_now, count(*) FILTER (tier = 'observe') AS observe, count(*) FILTER (tier = 'skip') AS skip, count(*) FILTER (eligible) AS eligible FROM screened", ("screened",),
)
def screen_summary(x: Inputs):
    return S.screen_summary(screened(x))


@query(
    "write_screen_report",
    f"SELECT tier, product_id, CAST(rank AS INT) AS rank, {rnd('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, quote_volume_24h DESC, product_id) AS rank FROM screened) WHERE rank <= 5", ("screened",),
)
def write_screen_report(x: Inputs):
    top = P.by_rank(screened(x), "tier", S.tier_order(), 5)
    return rounded(top.select("tier", "product_id", "rank", "score"))


@query("percentile_rank", f"SELECT s_suppkey, {rnd('(rank() OVER (ORDER BY s_nationkey) - 1 + 0.5e0 * count(*) OVER (PARTITION BY s_nationkey)) / count(*) OVER ()')} AS pr FROM supplier")
def percentile_rank(x: Inputs):
    return rounded(S.percentile_rank(x.table("supplier"), "s_nationkey", "pr").select("s_suppkey", "pr"))


@query(
    "resolve_products",
    f"SELECT base_asset, arg_min(product_id, ({RANK_SQL}, s_suppkey)) AS product_id FROM products WHERE status = 'online' AND NOT trading_disabled GROUP BY 1", ("products",),
)
def resolve_products(x: Inputs):
    p = x.products()
    return S.resolve_products(p.select("base_asset").distinct(), p, tie="s_suppkey")


@query("unsupported_bases", "SELECT DISTINCT upper(event_type) AS base_asset FROM events")
def unsupported_bases(x: Inputs):
    obs = x.table("events").select(F.upper("event_type").alias("base_asset")).distinct()
    p = x.products()
    return S.unsupported_bases(obs.unionByName(p.select("base_asset").distinct()), p)


@query(
    "spread_from_book",
    f"""WITH t AS (SELECT product_id, max(price_level) FILTER (side = 'bid' AND new_quantity > 0) AS bid, min(price_level) FILTER (side <> 'bid' AND new_quantity > 0) AS ask FROM l2_updates GROUP BY 1)
        SELECT product_id, {r6('bid', 'ask')}, {rnd('(bid + ask) / 2e0')} AS mid, {rnd('(ask - bid) / ((bid + ask) / 2e0)')} AS spread_pct FROM t""",
    ("l2_updates",),
)
def spread_from_book(x: Inputs):
    from tapeflow.operators.candles import book_side

    u = x.book_updates().where(F.col("size") > 0).withColumn("side", book_side())
    return rounded(S.spread_from_book(u))


@query(
    "spread_from_last_trade",
    f"SELECT product_id, {rnd('p * (1 - 0.0005e0)')} AS bid, {rnd('p * (1 + 0.0005e0)')} AS ask, {rnd('p')} AS mid, 0.001e0 AS spread_pct FROM (SELECT product_id, arg_max(price, arrival_seq) AS p FROM trades GROUP BY 1)",
    ("trades",),
)
def spread_from_last_trade(x: Inputs):
    return rounded(S.spread_from_last_trade(x.trades()))
