"""Is a value above the running quantile of its series? Exact, in bounded tasks.

With linear interpolation, x > q_p(first n values incl. x) holds exactly when
more than floor(p * (n - 1)) earlier values are smaller than x. So the job is to
count earlier smaller values, which splits by row block and value stripe:

* same block: counted inside the block,
* earlier block, same stripe: counted inside the stripe,
* earlier block, lower stripe: sums of a (block x stripe) histogram.

Blocks hold ``block_rows`` rows. Stripes come from a quantile sketch, and are
only built for series longer than one block. Equal values of a block are one row
with a count there, and a stripe of more rows than a block is cut again; one of a
single value needs no order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach, int_div
from tapeflow.functions.quantiles import STRIPES, with_stripe
from tapeflow.functions.series import BLOCK_ROWS, running
from tapeflow.session import staged


def earlier_smaller(values: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """For each position, how many earlier values are smaller (merge counting), or the sum of their ``counts``."""
    n = len(values)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    counts = np.ones(n, dtype=np.int64) if counts is None else counts
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    big, at, width = int(rank.max()) + 1, np.arange(n), 1
    while width < n:
        pair = at // (2 * width)
        right = (at // width) % 2 == 1
        key = pair * big + rank
        order = np.argsort(key[~right], kind="stable")
        left, total = key[~right][order], np.concatenate([[0], np.cumsum(counts[~right][order])])
        out[right] += total[np.searchsorted(left, key[right])] - total[np.searchsorted(left, pair[right] * big)]
        width *= 2
    return out


def _count_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Earlier smaller values of one block."""
    pdf = pdf.sort_values("_r", kind="mergesort")
    pdf["_less"] = earlier_smaller(pdf["_x"].to_numpy())
    return pdf[[*pdf.columns.drop(["_x", "_less"]), "_less"]]


def _count_folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add the smaller values of earlier blocks of one stripe; values of the same block don't count."""
    pdf = pdf.sort_values(["_b", "_x"], ascending=[True, False], kind="mergesort")
    pdf["_less"] += earlier_smaller(pdf["_x"].to_numpy(), pdf["_c"].to_numpy())
    return pdf.drop(columns="_c")


def above_running_quantile(
    df: DataFrame,
    keys: Sequence[str],
    row: str,
    value: str,
    p: float,
    *,
    min_rows: int,
    fallback: float,
    out: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``out``: 1.0 where value exceeds its expanding quantile (``fallback``
    until ``min_rows`` values), else 0.0; null values give 0.0."""
    keys = list(keys)
    # The narrow slice is read several times below, so it is written once.
    slim = staged(df.select(*keys, F.col(row).alias("_r"), F.col(value).cast("double").alias("_x")))
    rows = slim.where(F.col("_x").isNotNull()).withColumn("_b", int_div("_r", block_rows))
    types = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    less = rows.groupBy(*keys, "_b").applyInPandas(
        _count_rows, f"{types}, _r bigint, _b bigint, _less bigint"
    )
    if rows.where(F.col("_b") > 0).limit(1).count():
        remote = _from_earlier_blocks(rows, keys, types, block_rows)
        less = less.join(remote, [*keys, "_r"], "left").withColumn(
            "_less", F.col("_less") + F.coalesce("_remote", F.lit(0))
        )
    counted = running(
        slim, keys=keys, order=["_r"], block=int_div("_r", block_rows),
        specs={"_n": ("sum", F.col("_x").isNotNull().cast("bigint"))},
    )
    above = F.when(F.col("_n") >= min_rows, F.col("_less") > F.floor(F.lit(p) * (F.col("_n") - 1))).otherwise(
        F.col("_x") > fallback
    )
    marks = counted.join(less.select(*keys, "_r", "_less"), [*keys, "_r"], "left").select(
        *keys, F.col("_r").alias(row),
        F.when(F.col("_x").isNull(), 0.0).otherwise(F.coalesce(above, F.lit(False)).cast("double")).alias(out),
    )
    return df.join(marks, [*keys, row])


def _from_earlier_blocks(rows: DataFrame, keys: list[str], types: str, block_rows: int) -> DataFrame:
    """Earlier-block counts for series longer than one block."""
    long = rows.groupBy(*keys).agg(F.max("_b").alias("_last")).where(F.col("_last") > 0).select(*keys)
    rest = staged(rows.join(long, keys).groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_c")))
    rest, within, parts = rest.withColumn("_less", F.lit(0).cast("bigint")), keys, []
    while rest.limit(1).count():
        # Cuts of the distinct values part any two of them sooner or later.
        stripe = f"_s{len(parts)}"
        values = with_stripe(rest.select(*within, "_x").distinct(), within, "_x", stripe)
        rest = staged(rest.join(values, [*within, "_x"]))
        below = _from_lower_stripes(rest, within, stripe)
        within = [*within, stripe]
        size = rest.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"), (F.min("_x") < F.max("_x")).alias("_mixed"))
        rest = attach(rest.join(below, [*within, "_b"]), size, within).withColumn("_less", F.col("_less") + F.col("_below"))
        rest = staged(rest.drop("_below"))
        done = [*keys, "_b", "_x", "_less"]
        parts.append(rest.where(~F.col("_mixed")).select(*done))
        inside = rest.where(F.col("_mixed") & (F.col("_n") <= block_rows)).groupBy(*within)
        fit = inside.applyInPandas(lambda pdf: _count_folded(pdf[[*done, "_c"]]), f"{types}, _b bigint, _x double, _less bigint")
        parts.append(fit)
        rest = rest.where(F.col("_mixed") & (F.col("_n") > block_rows)).drop("_mixed", "_n")
    counted = reduce(DataFrame.unionByName, parts)
    return rows.join(counted, [*keys, "_b", "_x"]).select(*keys, "_r", F.col("_less").alias("_remote"))


def _from_lower_stripes(folded: DataFrame, within: list[str], stripe: str) -> DataFrame:
    """``_below`` of each (block, stripe): values of earlier blocks in lower stripes."""
    cells = folded.groupBy(*within, "_b").pivot(stripe, list(range(STRIPES))).sum("_c")
    cells = cells.select(
        *within, "_b",
        F.posexplode(F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(STRIPES)])).alias(stripe, "_n"),
    )
    lower = Window.partitionBy(*within, "_b").orderBy(stripe).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*within, stripe).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("_u", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .select(*within, "_b", stripe, F.coalesce(F.sum("_u").over(earlier), F.lit(0)).alias("_below"))
    )
