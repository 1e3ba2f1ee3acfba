"""Labels, sample weights and time splits on numbered series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach, int_div
from tapeflow.functions.series import Series, number_rows
from tapeflow.operators.candles import tail_rows
from tapeflow.operators.ohlcv import MINUTE_SPAN


def _check(threshold_pct: float) -> None:
    if threshold_pct <= 0:
        raise ValueError("threshold_pct must be positive")


def label_net_return(
    features: DataFrame, horizon: int, threshold_pct: float, fee_pct: float, span: int = MINUTE_SPAN
) -> DataFrame:
    """target = 1 when the return over ``horizon`` rows after two fees beats the threshold.

    Rows are the ones left after incomplete features were dropped; the last
    ``horizon`` rows of a series have no label and go.
    """
    _check(threshold_pct)
    s = Series(ahead=horizon)
    df = s.open(number_rows(features, s.keys, "open_time", span))
    later = F.lead("close", horizon).over(s.order)
    df = df.withColumn("target_return", later / F.col("close") - 1.0 - 2.0 * fee_pct / 100.0)
    df = df.withColumn("target", (F.col("target_return") > threshold_pct / 100.0).cast("int"))
    return s.close(df.where(F.col("target_return").isNotNull()), keep_row=True)


def label_triple_barrier(
    features: DataFrame, horizon: int, threshold_pct: float, fee_pct: float,
    stop_loss_pct: float | None = None, span: int = MINUTE_SPAN,
) -> DataFrame:
    """First barrier touched within ``horizon`` rows; profit wins a tie in one bar."""
    _check(threshold_pct)
    up, down = threshold_pct / 100.0, (stop_loss_pct or threshold_pct) / 100.0
    fees = 2.0 * fee_pct / 100.0
    s = Series(ahead=horizon)
    df = s.open(number_rows(features, s.keys, "open_time", span))
    bars = F.collect_list(F.struct("high", "low", "close")).over(s.following(horizon))
    take, stop = F.col("close") * (1.0 + up), F.col("close") * (1.0 - down)
    df = df.withColumn("_bars", bars).where(F.size("_bars") == horizon)
    touched = F.filter("_bars", lambda b: (b["high"] >= take) | (b["low"] <= stop))
    df = df.withColumn("_hit", F.get(touched, F.lit(0)))
    profit = F.col("_hit.high") >= take
    end = F.element_at("_bars", horizon)["close"]
    df = df.withColumns(
        {
            "target": F.when(F.col("_hit").isNotNull() & profit, 1).otherwise(0).cast("int"),
            "target_return": F.when(F.col("_hit").isNull(), end / F.col("close") - 1.0 - fees)
            .when(profit, up - fees)
            .otherwise(-down - fees),
        }
    ).drop("_bars", "_hit")
    return s.close(df, keep_row=True)


def class_balance(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("product_id").agg(
        F.sum("target").alias("positives"), F.count(F.lit(1)).alias("total"), F.avg("target").alias("ratio")
    )


def with_length(numbered: DataFrame, row: str = "row_idx") -> DataFrame:
    ends = numbered.groupBy("product_id").agg((F.max(row) + 1).alias("n_rows"))
    return attach(numbered, ends, ["product_id"])


def recency_weight(numbered: DataFrame, half_life: float) -> DataFrame:
    """0.5^(age / half_life) by rows from the end, within [0.001, 1]."""
    df = with_length(numbered)
    age = (F.col("n_rows") - 1 - F.col("row_idx")).cast("double")
    weight = F.least(F.greatest(F.pow(F.lit(0.5), age / float(half_life)), F.lit(1e-3)), F.lit(1.0))
    return df.withColumn("sample_weight", weight).drop("n_rows")


def recent_block_weight(numbered: DataFrame, last_n: int, weight: float = 2.0) -> DataFrame:
    df = with_length(numbered)
    recent = F.col("row_idx") >= F.col("n_rows") - last_n
    return df.withColumn("sample_weight", F.when(recent, float(weight)).otherwise(1.0)).drop("n_rows")


def select_window(numbered: DataFrame, strategy: str, last_n: int, weight: float = 2.0) -> DataFrame:
    """Rows and weights of a history strategy."""
    if strategy == "6m_recent":
        return tail_rows(numbered, last_n).withColumn("sample_weight", F.lit(1.0))
    if strategy == "12m_flat":
        return numbered.withColumn("sample_weight", F.lit(1.0))
    if strategy == "12m_weighted":
        return recent_block_weight(numbered, last_n, weight)
    raise ValueError(f"unknown strategy: {strategy}")


def align_weights(labeled: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach raw-candle weights to the surviving labeled rows; a missing one raises."""
    keys = ["product_id", "open_time"]
    joined = labeled.join(weights.select(*keys, "sample_weight"), keys, "left")
    checked = F.coalesce("sample_weight", F.raise_error(F.lit("labeled row without a sample weight")).cast("double"))
    return joined.withColumn("sample_weight", checked)


def weight_summary(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("product_id").agg(
        F.min("sample_weight").alias("min_weight"), F.max("sample_weight").alias("max_weight"),
        F.avg("sample_weight").alias("mean_weight"),
    )


# ---------------------------------------------------------------- splits
def holdout_split(numbered: DataFrame, share: float = 0.15) -> DataFrame:
    """Mark the last max(1, int(n * share)) rows as the test set."""
    df = with_length(numbered)
    test = F.greatest(F.lit(1), F.floor(F.col("n_rows") * share))
    return df.withColumn("is_test", F.col("row_idx") >= F.col("n_rows") - test).drop("n_rows")


def walk_forward_folds(lengths: DataFrame, min_train: int, gap: int, splits: int) -> DataFrame:
    """Expanding-train folds per product from its row count ``n_rows``.

    Products without room for a fold get no rows.
    """
    room = F.col("n_rows") - min_train - gap
    df = lengths.where(room > splits).withColumn("_size", F.greatest(F.lit(1), int_div(room.cast("bigint"), splits)))
    df = df.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    train_end = F.lit(min_train - 1) + F.col("_f") * F.col("_size")
    val_start = train_end + gap + 1
    val_end = F.least(val_start + F.col("_size") - 1, F.col("n_rows") - 1)
    return (
        df.select(
            "product_id", (F.col("_f") + 1).cast("bigint").alias("fold_id"), F.lit(0).cast("bigint").alias("train_start"),
            train_end.cast("bigint").alias("train_end"), val_start.cast("bigint").alias("val_start"),
            val_end.cast("bigint").alias("val_end"), "n_rows",
        )
        .where((F.col("val_start") < F.col("n_rows")) & (F.col("val_end") > F.col("val_start")))
        .drop("n_rows")
    )


def rows_to_folds(numbered: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row once per fold that trains on or validates with it."""
    train = F.col("row_idx").between(F.col("train_start"), F.col("train_end"))
    val = F.col("row_idx").between(F.col("val_start"), F.col("val_end"))
    joined = attach(numbered, folds, ["product_id"]).where(train | val)
    return joined.withColumn("part", F.when(train, "train").otherwise("val")).drop(
        "train_start", "train_end", "val_start", "val_end"
    )


def usable_folds(assigned: DataFrame) -> DataFrame:
    """Folds whose train and validation parts both have two classes."""
    both = assigned.groupBy("product_id", "fold_id").agg(
        *[
            (F.count_distinct(F.when(F.col("part") == p, F.col("target"))) > 1).alias(f"_{p}")
            for p in ("train", "val")
        ]
    )
    return both.where(F.col("_train") & F.col("_val")).select("product_id", "fold_id")


def purged_bounds(n_rows: Column, gap: int) -> tuple[Column, Column]:
    """(train_end, val_start) of the final split with a purge gap."""
    raw = F.greatest(F.lit(1), F.floor(n_rows * 0.85))
    train_end = F.greatest(F.lit(1), raw - max(0, gap))
    val_start = F.least(n_rows - 1, raw)
    val_start = F.when(val_start <= train_end, F.least(n_rows - 1, train_end + 1)).otherwise(val_start)
    few = n_rows < 2
    return F.when(few, 1).otherwise(train_end).cast("bigint"), F.when(few, 1).otherwise(val_start).cast("bigint")


def fixed_holdout(numbered: DataFrame, holdout: int, horizon: int) -> DataFrame:
    """Last ``holdout`` rows are held out; training stops ``horizon`` rows before them."""
    df = with_length(numbered)
    start = F.col("n_rows") - holdout
    part = F.when(F.col("row_idx") >= start, "holdout").when(F.col("row_idx") < start - horizon, "train")
    return df.withColumn("part", part).where(F.col("part").isNotNull()).drop("n_rows")


def rows_needed(min_train: int, gap: int, splits: int, test_share: float = 0.15) -> int:
    return int((min_train + gap + splits + 1) / (1.0 - test_share)) + 1


def min_rows_gate(lengths: DataFrame, min_train: int, gap: int, splits: int) -> DataFrame:
    need = rows_needed(min_train, gap, splits)
    return lengths.withColumns(
        {
            "required_rows": F.lit(need).cast("bigint"),
            "status": F.when(F.col("n_rows") >= need, "ok").otherwise("insufficient_data"),
        }
    )


def lengths_of(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_rows"))


def training_summary(runs: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Trained, promoted and skipped runs, and the failure flag above 30 %."""
    failed = F.count_if(F.col("status") != "trained") / F.count(F.lit(1))
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "trained").alias("trained"),
        F.count_if(F.col("promoted")).alias("promoted"),
        F.count_if(F.col("status") != "trained").alias("skipped"),
        failed.alias("failure_ratio"),
        (failed > 0.30).alias("too_many_failures"),
    )
