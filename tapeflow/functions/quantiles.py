"""Exact grouped percentiles that stay safe for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import attach
from tapeflow.session import staged

#: Groups whose cuts (some kB each) are sent to all executors.
CUT_ROWS = 2_000
FINE = 16
STRIPES = FINE * FINE
SKETCH = 2_000
STRIPE_POINTS = [i / STRIPES for i in range(1, STRIPES)]


def add_stripe(df: DataFrame, x: str, out: str = "_s") -> DataFrame:
    """Number of cuts below x, from the joined cut arrays: a coarse pass over 15
    cuts, then a fine one over 16."""
    value, start = F.col(x), F.col("_step") * FINE
    coarse = F.size(F.filter("_coarse", lambda c: c < value))
    fine = F.size(F.filter(F.slice("_cuts", start + 1, FINE), lambda c: c < value))
    return df.withColumn("_step", coarse).withColumn(out, (start + fine).cast("int")).drop("_cuts", "_coarse", "_step")


def with_stripe(df: DataFrame, keys: Sequence[str], value: str, out: str = "_s") -> DataFrame:
    """Cut each group into value ranges of about equal size, so that running
    totals along the value never order a whole group in one task."""
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, STRIPE_POINTS, SKETCH).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % FINE == FINE - 1))
    return add_stripe(attach(df, cuts, keys, most=CUT_ROWS), value, out)


def bounded_percentile(value: str, point: float) -> Column:
    """The same percentile as a plain aggregate, for groups of bounded span, such as a product's trades in one window.

    Equal values are folded on the map side; a group's distinct values are held at once, so groups that grow with the data
    take ``exact_percentiles``.
    """
    return F.percentile(F.when(~F.isnan(value), F.col(value)), point)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated percentiles of ``value``.

    Equal values are counted first (``weight`` holds counts made earlier) and the
    counts are written once, so the input is read once. Each group is cut into
    value stripes by a sketch; stripes are only counted, and just those holding a
    wanted rank are ordered.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = staged(present.groupBy(*keys, F.col(value).alias("_v")).agg(n.alias("_n")))
    return _by_stripe(counted, keys, points)


def _by_stripe(counted: DataFrame, keys: list[str], points: Mapping[str, float]) -> DataFrame:
    striped = with_stripe(counted, keys, "_v")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        striped.groupBy(*keys, "_s")
        .agg(F.sum("_n").alias("_sn"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_sn").over(before), F.lit(0)),
                "_rows": F.sum("_sn").over(Window.partitionBy(*keys)),
            }
        )
    )
    rank = {n: F.lit(float(p)) * (F.col("_rows") - 1) for n, p in points.items()}
    wanted = F.lit(False)
    for r in rank.values():
        for edge in (F.floor(r), F.ceil(r)):
            wanted = wanted | ((edge >= F.col("_before")) & (edge < F.col("_before") + F.col("_sn")))
    by_value = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = attach(striped, totals.where(wanted), [*keys, "_s"]).withColumn(
        "_cum", F.col("_before") + F.sum("_n").over(by_value)
    )
    low = {n: F.min(F.when(F.col("_cum") > F.floor(r), F.col("_v"))) for n, r in rank.items()}
    high = {n: F.min(F.when(F.col("_cum") > F.ceil(r), F.col("_v"))) for n, r in rank.items()}
    share = {n: F.max(r - F.floor(r)) for n, r in rank.items()}
    return inside.groupBy(*keys).agg(*[(low[n] + share[n] * (high[n] - low[n])).alias(n) for n in points])
