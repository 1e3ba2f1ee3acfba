"""Sizing, exits, chop guard and risk checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.asof import MINUTE_MS, trailing_sums
from tapeflow.functions.columns import int_div, yes
from tapeflow.functions.series import running


@dataclass(frozen=True)
class SizingConfig:
    enabled: bool = True
    base_notional: float = 25.0
    min_notional: float = 25.0
    max_notional: float = 50.0
    max_capital_fraction: float = 0.005
    kelly_fraction: float = 0.10
    stop_loss_pct: float = 1.0
    take_profit_pct: float = 1.5
    max_risk: float = 0.01

    @property
    def stop(self) -> float:
        return max(0.01, self.stop_loss_pct) / 100.0

    @property
    def reward_risk(self) -> float:
        return max(max(0.01, self.take_profit_pct) / 100.0, self.stop) / self.stop


@dataclass(frozen=True)
class ExitConfig:
    stop_loss_pct: float = 1.0
    take_profit_pct: float = 1.5
    max_hold_minutes: int = 60


@dataclass(frozen=True)
class RiskConfig:
    max_risk: float = 0.01
    max_drawdown: float = 0.02
    max_spread: float = 0.0025
    min_prob: float = 0.62
    macro_half_window_ms: int = 30 * MINUTE_MS
    chop_window_ms: int = 90 * MINUTE_MS
    chop_block_ms: int = 45 * MINUTE_MS
    fast_exit_minutes: float = 20
    adverse_pnl_pct: float = -0.10
    caution_exits: int = 2
    lock_exits: int = 3
    lock_stops: int = 2
    prob_buffer: float = 0.03
    risk_scale: float = 0.5
    notional_scale: float = 0.6


def kelly_size(df: DataFrame, cfg: SizingConfig = SizingConfig()) -> DataFrame:
    """Notional and risk from prob_buy, buy_threshold, capital_total, capital_available."""
    zero = F.lit(0.0)
    total, free = F.greatest("capital_total", zero), F.greatest("capital_available", zero)
    rr = cfg.reward_risk
    p = F.least(F.greatest("prob_buy", zero), F.lit(0.999999))
    threshold = F.least(F.greatest("buy_threshold", zero), F.lit(0.999999))
    raw = F.greatest(zero, (p * rr - (1.0 - p)) / max(rr, 1e-9))
    confidence = F.greatest(zero, F.least(F.lit(1.0), (p - threshold) / F.greatest(F.lit(1e-9), 1.0 - threshold)))
    applied = raw * cfg.kelly_fraction * confidence

    def available(amount: Column) -> Column:
        return F.when(free <= 0, 0.0).otherwise(F.greatest(zero, F.least(amount, free)))

    top = max(cfg.base_notional, cfg.max_notional)
    target = total * F.least(F.lit(cfg.max_capital_fraction), applied)
    wanted = F.greatest(F.lit(cfg.base_notional), F.lit(cfg.min_notional), target)
    by_risk = total * cfg.max_risk / max(cfg.stop, 1e-9)
    final = available(F.least(wanted, F.lit(top), F.when(by_risk > 0, by_risk).otherwise(wanted)))
    if not cfg.enabled:
        final, raw, applied, confidence = available(F.lit(cfg.base_notional)), zero, zero, zero
    dynamic = (final > cfg.base_notional + 1e-9) if cfg.enabled else F.lit(False)
    reason = (
        F.when(dynamic, "kelly_fractional_dynamic").otherwise("pilot_floor_notional")
        if cfg.enabled else F.lit("dynamic_sizing_disabled")
    )
    risk = F.when((total > 0) & (final > 0), final * cfg.stop / total).otherwise(0.0)
    return df.withColumns(
        {
            "notional_usd": F.round(final, 6), "risk_pct": F.round(risk, 8), "raw_kelly": F.round(raw, 8),
            "applied_kelly": F.round(applied, 8), "confidence": F.round(confidence, 8),
            "used_dynamic": dynamic, "sizing_reason": reason,
        }
    )


def scale_size(df: DataFrame, scale: Column, tag: str, cfg: SizingConfig = SizingConfig()) -> DataFrame:
    """Shrink a sizing decision; a scale of 1 leaves it as it is."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scale))
    keep = s >= 0.999999
    notional = F.round(F.col("notional_usd") * s, 6)
    stop = max(0.0, cfg.stop_loss_pct) / 100.0
    risk = F.when((F.col("capital_total") > 0) & (notional > 0), notional * stop / F.col("capital_total")).otherwise(0.0)
    tagged = F.concat("sizing_reason", F.lit(f"|{tag}_"), F.format_string("%.2f", s))
    return df.withColumns(
        {
            "risk_pct": F.when(keep, F.col("risk_pct")).otherwise(F.round(risk, 8)),
            "sizing_reason": F.when(keep, F.col("sizing_reason")).otherwise(tagged),
            "notional_usd": F.when(keep, F.col("notional_usd")).otherwise(notional),
        }
    )


def exit_rule(df: DataFrame, cfg: ExitConfig = ExitConfig()) -> DataFrame:
    """Protective exit of a position: entry_price, opened_at_ms, current_price, now_ms."""
    entry, now = F.col("entry_price"), F.col("current_price")
    valid = (entry > 0) & (now > 0) & (F.col("now_ms") > 0) & (F.col("opened_at_ms") > 0)
    pnl = F.when(valid, (now / entry - 1.0) * 100.0)
    held = F.when(valid, F.greatest(F.lit(0.0), (F.col("now_ms") - F.col("opened_at_ms")) / 60_000.0))
    reason = (
        F.when(~yes(valid), "")
        .when((pnl <= -cfg.stop_loss_pct) & F.lit(cfg.stop_loss_pct > 0), "stop_loss_hit")
        .when((pnl >= cfg.take_profit_pct) & F.lit(cfg.take_profit_pct > 0), "take_profit_hit")
        .when((held >= cfg.max_hold_minutes) & F.lit(cfg.max_hold_minutes > 0), "max_hold_hit")
        .otherwise("")
    )
    return df.withColumns({"exit_reason": reason, "should_exit": reason != "", "pnl_pct": pnl, "holding_minutes": held})


def adverse_exit(cfg: RiskConfig = RiskConfig()) -> Column:
    """Stop losses always; else a losing, quick signal or max-hold exit."""
    reason = F.lower(F.trim("reason"))
    quick = reason.isin("signal_exit_long", "max_hold_hit") & (F.col("holding_minutes") <= cfg.fast_exit_minutes)
    return yes((reason == "stop_loss_hit") | ((F.col("pnl_pct") <= cfg.adverse_pnl_pct) & quick))


def chop_exits(exits: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Adverse exits with trailing counts and, where they lock, until when entries are blocked."""
    bad = exits.where(adverse_exit(cfg)).withColumn("is_stop", (F.lower(F.trim("reason")) == "stop_loss_hit").cast("bigint"))
    counted = trailing_sums(
        bad, keys=["product_id"], at="ts_ms", window_ms=cfg.chop_window_ms,
        sums={"adverse_count": F.lit(1), "stop_count": F.col("is_stop")},
    )
    locks = (F.col("adverse_count") >= cfg.lock_exits) | (F.col("stop_count") >= cfg.lock_stops)
    return counted.withColumn("block_until", F.when(locks, F.col("ts_ms") + cfg.chop_block_ms))


def chop_at(signals: DataFrame, exits: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Chop state at each signal time: trailing exits, block and caution adjustments."""
    locked = chop_exits(exits, cfg).select("product_id", "ts_ms", "is_stop", "block_until", F.lit(1).alias("is_exit"), F.lit(0).alias("_side"))
    mine = [c for c in signals.columns if c not in ("product_id", "ts_ms")]
    asked = signals.select("product_id", "ts_ms", F.struct(*mine).alias("_s"), F.lit(1).alias("_side"))
    line = trailing_sums(
        locked.unionByName(asked, allowMissingColumns=True), keys=["product_id"], at="ts_ms", window_ms=cfg.chop_window_ms,
        sums={"adverse_count": F.col("is_exit"), "stop_count": F.col("is_stop")},
    )
    line = running(
        line, keys=["product_id"], order=["ts_ms", "_side"], block=int_div("ts_ms", 60 * MINUTE_MS),
        specs={"blocked_until_ms": ("max", "block_until")},
    )
    caution = F.col("adverse_count") >= cfg.caution_exits
    return (
        line.where(F.col("_side") == 1)
        .select(
            "product_id", "ts_ms", "_s.*", F.col("adverse_count").cast("bigint"), F.col("stop_count").cast("bigint"),
            F.coalesce("blocked_until_ms", F.lit(0)).cast("bigint").alias("blocked_until_ms"),
        )
        .withColumns(
            {
                "chop_blocked": F.col("blocked_until_ms") > F.col("ts_ms"),
                "chop_caution": caution,
                "chop_min_prob": F.when(caution, min(0.999, cfg.min_prob + cfg.prob_buffer)).otherwise(cfg.min_prob),
                "chop_max_risk": F.when(caution, cfg.max_risk * cfg.risk_scale).otherwise(cfg.max_risk),
                "chop_notional_scale": F.when(caution, cfg.notional_scale).otherwise(1.0),
            }
        )
    )


def in_macro_window(ts_ms: str, events_ms: list[int], half_ms: int = 30 * MINUTE_MS) -> Column:
    """Within half a window of any listed event (a configured list, so a literal array)."""
    events = F.array(*[F.lit(int(e)) for e in events_ms]) if events_ms else F.array().cast("array<bigint>")
    return F.exists(events, lambda e: F.abs(F.col(ts_ms) - e) <= half_ms)


def risk_check(df: DataFrame, macro_events_ms: list[int], cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """First failing rule of an entry; exits always pass.

    Needs signal, risk_pct, prob_buy, spread_pct, drawdown_today, ts_ms and the chop columns.
    """
    c = F.col
    reason = (
        F.when(F.upper("signal").isin("SELL", "EXIT_LONG"), "ok")
        .when(c("risk_pct") > cfg.max_risk, "risk_per_trade")
        .when(c("drawdown_today") >= cfg.max_drawdown, "daily_drawdown")
        .when(c("spread_pct") > cfg.max_spread, "spread")
        .when(c("chop_blocked"), "chop_blocked")
        .when(c("prob_buy") < c("chop_min_prob"), "chop_probability")
        .when(c("risk_pct") > c("chop_max_risk"), "chop_risk")
        .when(c("prob_buy") < cfg.min_prob, "probability")
        .when(in_macro_window("ts_ms", macro_events_ms, cfg.macro_half_window_ms), "macro_event")
        .otherwise("ok")
    )
    return df.withColumn("risk_reason", reason).withColumn("risk_ok", F.col("risk_reason") == "ok")


def signal_decision(df: DataFrame) -> DataFrame:
    """Order decision label of each signal, first rule wins.

    Needs signal, actionable, reason, has_position, in_cooldown, base_enabled,
    exit_reason, risk_ok, risk_reason, notional_usd, base_balance, base_min_size,
    quote_balance.
    """
    c = F.col
    signal = F.when(F.upper("signal") == "SELL", "EXIT_LONG").otherwise(F.upper("signal"))
    held, buy, auto = c("has_position"), signal == "BUY", F.coalesce(c("exit_reason"), F.lit("")) != ""
    decision = (
        F.when((signal == "EXIT_LONG") & ~held, "ignored_no_position")
        .when((signal == "HOLD") & ~held, "ignored_hold")
        .when(buy & c("in_cooldown"), "cooldown_active")
        .when(buy & ~c("actionable"), "ignored_non_actionable")
        .when(buy & ~c("base_enabled"), "ignored_base_not_enabled")
        .when(held & auto, "accepted_exit")
        .when(signal == "HOLD", "ignored_hold")
        .when(buy & ~c("risk_ok"), "blocked_risk")
        .when(buy & (held | (c("base_balance") >= c("base_min_size"))), "blocked_existing_position")
        .when(buy & (c("notional_usd") <= 0), "blocked_sizing_zero")
        .when(buy & (c("quote_balance") < c("notional_usd")), "blocked_no_quote_balance")
        .when(buy, "accepted_buy")
        .otherwise("accepted_exit")
    )
    why = (
        F.when(decision == "ignored_no_position", "no_managed_position")
        .when(decision == "ignored_non_actionable", c("reason"))
        .when(decision == "blocked_risk", c("risk_reason"))
        .when((decision == "ignored_hold") & held, "position_open_waiting_exit")
        .when((decision == "accepted_exit") & auto, c("exit_reason"))
        .when(decision == "accepted_exit", "signal_exit_long")
        .otherwise("")
    )
    return df.withColumns({"decision": decision, "decision_reason": why})


def portfolio_state(balances: DataFrame, quote: str, allowed: DataFrame, min_total: float) -> DataFrame:
    """Total dollars, dollars free in the quote currency and open base positions per account."""
    per = balances.groupBy("account", F.upper("currency").alias("currency")).agg(F.sum("balance").alias("balance"))
    ok = allowed.select(F.upper("base").alias("currency")).distinct().withColumn("_ok", F.lit(True))
    per = per.join(ok, "currency", "left")
    cash = F.col("currency").isin("USD", "USDC", "USDT")
    return per.groupBy("account").agg(
        F.greatest(F.coalesce(F.sum(F.when(cash, F.col("balance"))), F.lit(0.0)), F.lit(float(min_total))).alias("capital_total"),
        F.coalesce(F.sum(F.when(F.col("currency") == quote.upper(), F.col("balance"))), F.lit(0.0)).alias("capital_available"),
        F.count_if(yes(F.col("_ok")) & (F.col("balance") > 0)).alias("open_positions"),
    )
