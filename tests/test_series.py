"""Blocked windows give what whole-series pandas gives, across block edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div
from tapeflow.functions.prefix_rank import above_running_quantile, earlier_smaller
from tapeflow.functions.quantiles import exact_percentiles
from tapeflow.functions.series import Ema, Series, ema, number_rows, running

N = 9_000


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    out = []
    for product, n in (("HOT", N), ("COLD", 700)):
        price = 100 + rng.normal(0, 0.5, n).cumsum()
        out.append(
            pd.DataFrame(
                {"product_id": product, "open_time": np.arange(n) * 60_000 * rng.integers(1, 3, n).cumsum() // np.arange(1, n + 1), "close": price}
            )
        )
    df = pd.concat(out)
    df["open_time"] = df.groupby("product_id").cumcount() * 60_000 + (df.groupby("product_id").cumcount() // 500) * 3_600_000
    return df


def collect(df, *cols):
    return df.orderBy("product_id", "open_time").toPandas()[["product_id", "open_time", *cols]]


def test_number_rows_counts_across_blocks(spark, walk):
    got = collect(number_rows(spark.createDataFrame(walk), ["product_id"], "open_time", 60_000 * 1_000), "row_idx")
    want = walk.sort_values(["product_id", "open_time"]).groupby("product_id").cumcount()
    assert (got["row_idx"].to_numpy() == want.to_numpy()).all()


def test_windows_and_ema_match_pandas(spark, walk):
    s = Series(back=2_048 + 64, ahead=10, block_rows=4_096)
    df = s.open(number_rows(spark.createDataFrame(walk), ["product_id"], "open_time", 60_000 * 1_000))
    df = s.ema(df, {"e60": Ema.span(F.col("close"), 60), "e5": Ema.span(F.col("close"), 5), "w": Ema(F.col("close"), 1 / 14, 14)})
    df = df.withColumns(
        {"std": s.roll(F.stddev_samp, F.col("close"), 20), "later": F.lead("close", 10).over(s.order), "lag": s.lag(F.col("close"), 60)}
    )
    got = collect(s.close(df), "e60", "e5", "w", "std", "later", "lag")
    assert len(got) == len(walk)
    for product, part in walk.groupby("product_id"):
        mine = got[got["product_id"] == product]
        c = part["close"].reset_index(drop=True)
        want = {
            "e60": c.ewm(span=60, adjust=False, min_periods=60).mean(), "e5": c.ewm(span=5, adjust=False, min_periods=5).mean(),
            "w": c.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), "std": c.rolling(20).std(), "later": c.shift(-10), "lag": c.shift(60),
        }
        for name, expected in want.items():
            np.testing.assert_allclose(mine[name].to_numpy(float), expected.to_numpy(), rtol=1e-9, atol=1e-9, err_msg=name)


def test_slow_ema_with_leading_nulls(spark, walk):
    df = walk.copy()
    df.loc[df.groupby("product_id").cumcount() < 25, "close"] = np.nan
    frame = spark.createDataFrame(df).withColumn("close", F.nanvl("close", F.lit(None)))
    got = collect(ema(frame, "close", keys=["product_id"], order="open_time", span_units=60_000_000, out="e", alpha=0.001), "e")
    for product, part in df.groupby("product_id"):
        want = part["close"].ewm(alpha=0.001, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got[got["product_id"] == product]["e"].to_numpy(float), want, rtol=1e-9)


def test_running_matches_cumulative(spark, walk):
    frame = spark.createDataFrame(walk).withColumn("some", F.when(F.col("open_time") % 180_000 == 0, F.col("close")))
    out = running(
        frame, keys=["product_id"], order=["open_time"], block=int_div("open_time", 6_000_000),
        specs={"total": ("sum", "close"), "top": ("max", "close"), "last": ("last", "some")},
    )
    got = collect(out, "total", "top", "last")
    for product, part in walk.groupby("product_id"):
        mine = got[got["product_id"] == product]
        np.testing.assert_allclose(mine["total"], part["close"].cumsum())
        np.testing.assert_allclose(mine["top"], part["close"].cummax())
        some = part["close"].where(part["open_time"] % 180_000 == 0).ffill()
        np.testing.assert_allclose(mine["last"].to_numpy(float), some)


def test_exclusive_running_leaves_the_row_out(spark, walk):
    out = running(
        spark.createDataFrame(walk), keys=["product_id"], order=["open_time"], block=int_div("open_time", 6_000_000),
        specs={"before": ("max", "close")}, exclusive=True,
    )
    got = collect(out, "before")
    for product, part in walk.groupby("product_id"):
        np.testing.assert_allclose(got[got["product_id"] == product]["before"].to_numpy(float), part["close"].cummax().shift(1))


def test_earlier_smaller_is_exact():
    x = np.random.default_rng(1).integers(0, 40, 700).astype(float)
    want = [(x[:i] < x[i]).sum() for i in range(len(x))]
    assert (earlier_smaller(x) == want).all()


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_expanding_quantile_flag(spark, block_rows):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"product_id": "A", "row_idx": np.arange(1_500), "v": rng.integers(0, 90, 1_500) / 7.0})
    df.loc[::13, "v"] = np.nan
    frame = spark.createDataFrame(df).withColumn("v", F.nanvl("v", F.lit(None)))
    out = above_running_quantile(frame, ["product_id"], "row_idx", "v", 0.75, min_rows=10, fallback=3.0, out="hit", block_rows=block_rows)
    got = out.orderBy("row_idx").toPandas()["hit"].to_numpy()
    cut = df["v"].expanding(min_periods=10).quantile(0.75).fillna(3.0)
    assert (got == (df["v"] > cut).astype(float).to_numpy()).all()


def test_expanding_quantile_groups_hold_at_most_a_block(spark, monkeypatch):
    """A value that fills most rows, and more values than one round of stripes can part."""
    from tapeflow.functions import prefix_rank as P

    block = 8
    monkeypatch.setattr(P, "_count_rows", bounded(P._count_rows, block))
    monkeypatch.setattr(P, "_count_folded", bounded(P._count_folded, block))
    rng = np.random.default_rng(6)
    v = np.where(np.arange(2_000) % 3 > 0, 0.5, rng.permutation(2_000) / 1_000)
    v = np.concatenate([v, rng.permutation(2_500) / 1_000])
    df = pd.DataFrame({"product_id": "A", "row_idx": np.arange(len(v)), "v": v})
    out = P.above_running_quantile(spark.createDataFrame(df), ["product_id"], "row_idx", "v", 0.75, min_rows=10, fallback=3.0, out="hit", block_rows=block)
    got = out.orderBy("row_idx").toPandas()["hit"].to_numpy()
    cut = df["v"].expanding(min_periods=10).quantile(0.75).fillna(3.0)
    assert (got == (df["v"] > cut).astype(float).to_numpy()).all()


def bounded(count, most):
    def run(pdf):
        assert len(pdf) <= most
        return count(pdf)

    return run


def test_percentiles_of_hot_groups(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"k": np.where(np.arange(6_000) % 6 == 0, "b", "a"), "v": np.round(rng.lognormal(0, 2, 6_000), 3)})
    points = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(spark.createDataFrame(df), ["k"], "v", points).orderBy("k").toPandas()
    for _, row in got.iterrows():
        for name, p in points.items():
            assert row[name] == pytest.approx(df[df["k"] == row["k"]]["v"].quantile(p), rel=1e-12)
    assert len(got) == 2
