"""As-of and trailing-window joins on time, in bounded time blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div
from tapeflow.functions.series import running

MINUTE_MS = 60_000


def asof_last(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], block_ms: int = 60 * MINUTE_MS,
) -> DataFrame:
    """Attach the latest right values at or before the left time, per key.

    Both sides are stacked on one timeline and the last value is carried along
    it, block by block; there is no row-pair join.
    """
    keys, values = list(keys), list(values)
    mine = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*mine).alias("_l"))
    b = right.select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_r"))
    line = a.unionByName(b, allowMissingColumns=True)
    carried = running(
        line, keys=keys, order=["_at", "_side"], block=int_div("_at", block_ms), specs={"_last": ("last", "_r")}
    )
    return carried.where(F.col("_side") == 1).select(*keys, "_l.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def trailing_sums(
    df: DataFrame, *, keys: Sequence[str], at: str, window_ms: int, sums: Mapping[str, Column], block_ms: int | None = None
) -> DataFrame:
    """Sums of whole numbers over [t - window, t] per row, rows of the same time included; a null number adds nothing.

    Every row enters the sum at its time and leaves it a unit after the window, so one running sum over both ends answers all
    rows: the work grows with the rows, however many share a window. Keys are not null.
    """
    keys = list(keys)
    valued = df.select(*keys, F.col(at).alias("_at"), *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"_v_in_{n}") for n, c in sums.items()], F.struct("*").alias("_row"))
    marks = F.array(F.struct(F.lit(0).cast("bigint").alias("later"), F.lit(1).alias("sign")), F.struct(F.lit(window_ms + 1).cast("bigint").alias("later"), F.lit(-1).alias("sign")))
    moving = F.lit(False)
    for n in sums:
        moving = moving | (F.col(f"_v_in_{n}") != 0)
    ends = valued.where(moving).withColumn("_m", F.explode(marks)).select(
        *keys, (F.col("_at") + F.col("_m.later")).alias("_at"), F.lit(0).alias("_side"), *[(F.col(f"_v_in_{n}") * F.col("_m.sign")).alias(f"_v_in_{n}") for n in sums]
    )
    asked = valued.select(*keys, "_at", F.lit(1).alias("_side"), *[F.lit(0).cast("bigint").alias(f"_v_in_{n}") for n in sums], "_row")
    line = ends.unionByName(asked, allowMissingColumns=True)
    block = int_div("_at", block_ms or max(window_ms, 60 * MINUTE_MS))
    done = running(line, keys=keys, order=["_at", "_side"], block=block, specs={n: ("sum", f"_v_in_{n}") for n in sums})
    return done.where(F.col("_side") == 1).select("_row.*", *sums)
