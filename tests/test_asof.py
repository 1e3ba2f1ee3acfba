"""Trailing sums against plain Python."""

import random
import time

from pyspark.sql import functions as F

from tapeflow.functions.asof import trailing_sums


def test_trailing_sums_with_ties_gaps_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AB"), rng.randrange(-2_000, 2_000) * 7, rng.choice([None, 0, 1, 3, -2]), i) for i in range(900)] + [("C", 5, None, 900)]
    df = spark.createDataFrame(rows, "product_id string, t long, v int, i long").repartition(4)
    for window, block in ((0, 50), (70, 20), (699, 10_000), (100_000, 1_000)):
        got = trailing_sums(df, keys=["product_id"], at="t", window_ms=window, sums={"n": F.lit(1), "total": F.col("v")}, block_ms=block)
        assert got.columns == ["product_id", "t", "v", "i", "n", "total"]
        found = {r.i: (r.n, r.total) for r in got.collect()}
        for p, t, _, i in rows:
            near = [v or 0 for q, u, v, _ in rows if q == p and t - window <= u <= t]
            assert found[i] == (len(near), sum(near)), (p, t, window)
    assert trailing_sums(df.limit(0), keys=["product_id"], at="t", window_ms=5, sums={"n": F.lit(1)}).count() == 0


def test_a_million_rows_in_one_window(spark):
    df = spark.range(1_000_000).select(F.lit("A").alias("product_id"), F.col("id").alias("t"))
    began = time.time()
    got = trailing_sums(df, keys=["product_id"], at="t", window_ms=2_000_000, sums={"n": F.lit(1)}, block_ms=100_000)
    assert got.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first() == (1_000_000 * 1_000_001 // 2, 1_000_000)
    assert time.time() - began < 60
