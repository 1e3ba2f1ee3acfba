"""Operability screen over product, spread and candle tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import over_nonzero, yes
from tapeflow.functions.quantiles import with_stripe
from tapeflow.functions.series import running
from tapeflow.session import staged

# Bases that are not screened (stable and fiat tokens).
EXCLUDED_BASES = ("USDC", "USDT", "PYUSD", "DAI", "USDS", "FDUSD", "EURC", "EUR", "GBP", "USD", "GYEN")
FLAGS = ("trading_disabled", "is_disabled", "cancel_only", "limit_only", "post_only", "view_only", "auction_mode")


@dataclass(frozen=True)
class ScreenConfig:
    quotes: tuple[str, ...] = ("USD", "USDC", "USDT")
    min_volume: float = 1_000_000.0
    max_spread: float = 0.0025
    min_age_days: int = 45
    lookback_minutes: int = 300
    min_coverage: float = 0.90
    measured: int = 80
    excluded: tuple[str, ...] = EXCLUDED_BASES


def quote_rank(quotes: tuple[str, ...], column: str = "quote_asset") -> Column:
    """1-based priority; 0 when the quote is not listed."""
    return F.array_position(F.array(*[F.lit(q) for q in quotes]), F.upper(column))


def quote_volume() -> Column:
    """24 h quote volume: the exchange's own figure, else price times volume."""
    own = F.expr("try_cast(nullif(trim(approximate_quote_24h_volume), '') AS DOUBLE)")
    zero = F.lit(0.0)
    return F.coalesce(own, F.coalesce(F.expr("try_cast(price AS DOUBLE)"), zero) * F.coalesce(F.expr("try_cast(volume_24h AS DOUBLE)"), zero))


def listing_age_days(new_at: str, now_ms: int) -> Column:
    """Whole days since listing; missing or bad text gives 0."""
    listed = F.unix_millis(F.try_to_timestamp(F.col(new_at)))
    return F.greatest(F.lit(0), F.coalesce(F.floor((F.lit(now_ms) - listed) / 86_400_000), F.lit(0))).cast("bigint")


def preferred_products(products: DataFrame, cfg: ScreenConfig = ScreenConfig(), tie: str = "product_id") -> DataFrame:
    """One product per base: best quote priority, then the largest volume."""
    ok = products.where(
        (F.upper("product_type") == "SPOT") & (quote_rank(cfg.quotes) > 0) & ~F.col("base_asset").isin(*cfg.excluded)
        & (F.col("base_asset") != "")
    )
    rest = [c for c in products.columns if c != "base_asset"]
    best = F.struct(quote_rank(cfg.quotes), -F.col("quote_volume_24h"), F.col(tie))
    return ok.groupBy("base_asset").agg(F.min_by(F.struct(*rest), best).alias("_p")).select("base_asset", "_p.*")


def resolve_products(bases: DataFrame, products: DataFrame, cfg: ScreenConfig = ScreenConfig(), tie: str = "product_id") -> DataFrame:
    """First online, enabled product per base by quote priority."""
    usable = products.where((F.lower("status") == "online") & ~F.col("trading_disabled") & (quote_rank(cfg.quotes) > 0))
    first = usable.groupBy("base_asset").agg(F.min_by("product_id", F.struct(quote_rank(cfg.quotes), F.col(tie))).alias("product_id"))
    return bases.join(first, "base_asset")


def unsupported_bases(bases: DataFrame, products: DataFrame) -> DataFrame:
    return bases.join(products.select("base_asset").distinct(), "base_asset", "left_anti")


def within(candles: DataFrame, now_ms: int, lookback_ms: int) -> DataFrame:
    """Candles that opened in the look-back before the given clock."""
    return candles.where(F.col("open_time") >= now_ms - lookback_ms)


def candle_coverage(candles: DataFrame, expected: int) -> DataFrame:
    """Distinct candle times over the expected number, at most 1."""
    return candles.groupBy("product_id").agg(
        F.least(F.count_distinct("open_time") / float(expected), F.lit(1.0)).alias("candle_coverage_pct")
    )


def daily_realized_vol(candles: DataFrame) -> DataFrame:
    """Population deviation of log returns scaled to a day, in percent. Input holds
    a bounded look-back (at most 350 candles per product)."""
    w = Window.partitionBy("product_id").orderBy("open_time")
    steps = candles.where(F.col("close") > 0).withColumn("_r", F.ln("close") - F.ln(F.lag("close").over(w)))
    return steps.groupBy("product_id").agg(
        F.when(F.count("_r") >= 2, F.stddev_pop("_r") * (1440.0**0.5) * 100.0).otherwise(0.0).alias("daily_realized_vol_pct")
    )


def percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """(values below + half of the equal ones) / n against the non-null values.

    Equal values are folded first; counts below a value are then carried over
    value ranges of about equal size.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(F.lit(0).alias("_all"), F.col(value).alias("_v"))
    values = staged(values.agg(F.count(F.lit(1)).alias("_c")))
    total = values.groupBy("_all").agg(F.sum("_c").alias("_n"))
    below = running(
        with_stripe(values, ["_all"], "_v"), keys=["_all"], order=["_v"], block=F.col("_s"),
        specs={"_less": ("sum", "_c")}, exclusive=True,
    ).join(F.broadcast(total), "_all")  # one row
    share = (F.coalesce("_less", F.lit(0)) + 0.5 * F.col("_c")) / F.col("_n")
    ranks = below.select("_v", F.when(F.col("_n") == 1, 1.0).otherwise(share).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def screen(candidates: DataFrame, spreads: DataFrame, candle_stats: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Scores, reasons and tier of every candidate product."""
    df = (
        candidates.drop("spread_pct").join(spreads.select("product_id", "spread_pct"), "product_id", "left")
        .join(candle_stats, "product_id", "left").fillna(0.0, ["candle_coverage_pct", "daily_realized_vol_pct"])
    )
    df = df.withColumn("_liq", F.when(F.col("quote_volume_24h") > 0, F.log1p("quote_volume_24h")))
    df = percentile_rank(percentile_rank(df, "_liq", "liquidity_score"), "spread_pct", "_spread_rank")
    df = df.withColumns(
        {
            "liquidity_score": F.coalesce("liquidity_score", F.lit(0.0)),
            "microstructure_score": F.coalesce(1.0 - F.col("_spread_rank"), F.lit(0.0)),
            "stability_score": F.least(F.greatest("candle_coverage_pct", F.lit(0.0)), F.lit(1.0)),
            "maturity_score": F.least(F.greatest(F.col("listing_age_days") / 180.0, F.lit(0.0)), F.lit(1.0)),
        }
    ).drop("_liq", "_spread_rank")
    score = 100.0 * (
        0.40 * F.col("liquidity_score") + 0.25 * F.col("microstructure_score") + 0.20 * F.col("stability_score") + 0.15 * F.col("maturity_score")
    )
    df = df.withColumn("score", score).withColumn("reasons", reasons(df.columns, cfg))
    df = df.withColumn("eligible", F.size("reasons") == 0)
    return df.withColumns({"tier": tier(), "reasons": F.when(F.col("eligible"), F.array(F.lit("ok"))).otherwise(F.col("reasons"))})


def reasons(have: list[str], cfg: ScreenConfig = ScreenConfig()) -> Column:
    """Failed filters in fixed order."""
    f = {name: yes(F.col(name)) if name in have else F.lit(False) for name in FLAGS}
    rules = (
        (F.lower("status") != "online", "status_not_online"),
        (f["trading_disabled"] | f["is_disabled"], "trading_disabled"),
        (f["cancel_only"] | f["limit_only"] | f["post_only"] | f["view_only"], "trading_flags_restrictive"),
        (f["auction_mode"], "auction_mode"),
        (F.col("quote_volume_24h") < cfg.min_volume, "low_quote_volume_24h"),
        (F.col("spread_pct").isNull(), "missing_spread"),
        (yes(F.col("spread_pct") > cfg.max_spread), "wide_spread"),
        (F.col("listing_age_days") < cfg.min_age_days, "recent_listing"),
        (F.col("candle_coverage_pct") < cfg.min_coverage, "low_candle_coverage"),
    )
    return F.filter(F.array(*[F.when(rule, name) for rule, name in rules]), lambda r: r.isNotNull())


def tier() -> Column:
    strong = (F.col("score") >= 50.0) & (F.col("quote_volume_24h") >= 500_000.0)
    return (
        F.when(F.col("eligible") & (F.col("score") >= 70.0), "train_now").when(F.col("eligible") | strong, "observe").otherwise("skip")
    )


def tier_order() -> list[Column]:
    return [
        F.when(F.col("tier") == "train_now", 0).when(F.col("tier") == "observe", 1).otherwise(2),
        F.col("score").desc(), F.col("quote_volume_24h").desc(), F.col("product_id"),
    ]


def screen_summary(results: DataFrame) -> DataFrame:
    t = F.col("tier")
    return results.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(t == "train_now").alias("train_now"),
        F.count_if(t == "observe").alias("observe"), F.count_if(t == "skip").alias("skip"), F.count_if("eligible").alias("eligible"),
    )


def spread_from_book(levels: DataFrame) -> DataFrame:
    """Best bid/ask per product to mid and spread share; empty or crossed-out books go."""
    price = F.col("price")
    top = levels.groupBy("product_id").agg(
        F.max(F.when(F.col("side") == "bid", price)).alias("bid"), F.min(F.when(F.col("side") == "ask", price)).alias("ask")
    )
    top = top.where((F.col("bid") > 0) & (F.col("ask") > 0)).withColumn("mid", (F.col("bid") + F.col("ask")) / 2.0)
    return top.withColumn("spread_pct", over_nonzero(F.col("ask") - F.col("bid"), F.col("mid"), 0.0))


def spread_from_last_trade(trades: DataFrame) -> DataFrame:
    """No book: 0.05 % around the last trade."""
    last = trades.groupBy("product_id").agg(F.max_by("price", "arrival_seq").alias("mid"))
    return last.where(F.col("mid") > 0).select(
        "product_id", (F.col("mid") * (1 - 0.0005)).alias("bid"), (F.col("mid") * (1 + 0.0005)).alias("ask"), "mid", F.lit(0.001).alias("spread_pct")
    )
