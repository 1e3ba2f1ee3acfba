"""Windows over long series without putting a whole series in one task.

A product may own a third of all rows, so ``Window.partitionBy("product_id")``
is not a safe frame. A series is cut into blocks instead:

* ``number_rows`` gives each row its position in its series: a local
  ``row_number`` per block plus the row counts of earlier blocks.
* ``Series`` builds row-count windows. Rows near the end of a block are also
  sent to the next one (``back``) and rows near its start to the previous one
  (``ahead``), so a frame inside a block sees exactly the rows it would see in
  the whole series. Copies are dropped at the end.
* ``Series.ema`` computes exponential means in the same sort.
* ``running`` computes unbounded running aggregates: local frame + the carry
  of the earlier blocks.

Only block summaries (one row per block) are ever ordered per series.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.columns import int_div

BLOCK, PART, OWN = "_blk", "_sub", "_own"
# A block is a whole number of parts. exp(709) is the largest double, so a part
# of 1,024 rows carries weights (1-a)^-1024 for every a up to 0.45.
BLOCK_ROWS, PART_ROWS = 32_768, 1_024
MAX_EXPONENT = 600.0


def number_rows(
    df: DataFrame, keys: Sequence[str], order: str, span: int, row_col: str = "row_idx"
) -> DataFrame:
    """Add the 0-based position of each row within its series.

    ``order`` is a unique BIGINT per series and ``span`` the width of a block in
    its units, so a block holds at most ``span`` rows.
    """
    keys = list(keys)
    cut = df.withColumn(BLOCK, int_div(order, span))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(order))
    return (
        cut.withColumn("_rn", local)
        .join(counts, [*keys, BLOCK])
        .withColumn(row_col, (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
        .drop(BLOCK, "_rn", "_base")
    )


@dataclass(frozen=True)
class Series:
    """Blocked row windows over numbered series.

    ``back``/``ahead`` is the longest look-back/look-ahead of everything
    computed between ``open`` and ``close``, chained frames added up.
    """

    keys: tuple[str, ...] = ("product_id",)
    row: str = "row_idx"
    back: int = 0
    ahead: int = 0
    block_rows: int = BLOCK_ROWS
    part_rows: int = PART_ROWS

    def open(self, numbered: DataFrame) -> DataFrame:
        row, size = F.col(self.row), self.block_rows
        own = int_div(row, size)
        off = F.pmod(row, F.lit(size))
        blocks = [own]
        if self.back:
            blocks.append(F.when(off >= size - self.back, own + 1))
        if self.ahead:
            blocks.append(F.when((off < self.ahead) & (own > 0), own - 1))
        df = numbered
        if len(blocks) > 1:
            df = df.withColumn(BLOCK, F.explode(F.filter(F.array(*blocks), lambda b: b.isNotNull())))
        else:
            df = df.withColumn(BLOCK, own)
        return (
            df.withColumn(OWN, F.col(BLOCK) == own)
            .withColumn(PART, int_div(row, self.part_rows))
            .repartition(*self.keys, BLOCK)
        )

    def close(self, df: DataFrame, keep_row: bool = False) -> DataFrame:
        out = df.where(F.col(OWN)).drop(BLOCK, PART, OWN)
        return out if keep_row else out.drop(self.row)

    # All windows share (keys, block, part, row), so Spark sorts once.
    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(PART, self.row)

    def rows(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-n, -1)

    def following(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(1, n)

    def roll(self, fn, value: Column, n: int, min_rows: int | None = None) -> Column:
        """Rolling aggregate, null until ``min_rows`` (default n) non-null values."""
        need = n if min_rows is None else min_rows
        frame = self.rows(n)
        return F.when(F.count(value).over(frame) >= need, fn(value).over(frame))

    def lag(self, value: Column, n: int = 1) -> Column:
        return F.lag(value, n).over(self.order)

    def ema(self, df: DataFrame, specs: Mapping[str, "Ema"]) -> DataFrame:
        """Add exponential means (seeded with the first value) as columns.

        Within a part, ema = b^k * sum(u_j * b^-j); earlier parts enter through
        the value at their last row, decayed. Two parts back the weight is below
        (1-a)^(2*part_rows), which is why ``back`` must cover two parts.
        """
        off = F.pmod(F.col(self.row), F.lit(self.part_rows)).cast("double")
        last_off = off == self.part_rows - 1
        in_part = (
            Window.partitionBy(*self.keys, BLOCK, PART)
            .orderBy(self.row)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        earlier = self.order.rowsBetween(Window.unboundedPreceding, -1)
        local, one, two = {}, {}, {}
        for name, spec in specs.items():
            decay = F.lit(1.0 - spec.alpha)
            if -math.log(1.0 - spec.alpha) * self.part_rows > MAX_EXPONENT:
                raise ValueError(f"alpha {spec.alpha} needs parts shorter than {self.part_rows} rows")
            start = F.col(self.row) - spec.first_row
            value = F.when(start == 0, spec.value).when(start > 0, spec.value * spec.alpha)
            weighted = F.sum(value * F.pow(decay, -off)).over(in_part)
            local[f"_{name}_0"] = weighted * F.pow(decay, off)
            one[f"_{name}_1"] = F.last(F.when(last_off, F.col(f"_{name}_0")), True).over(earlier)
            two[f"_{name}_2"] = F.last(F.when(last_off, F.col(f"_{name}_1")), True).over(earlier)
        df = df.withColumns(local).withColumns(one).withColumns(two)
        out = {}
        for name, spec in specs.items():
            decay = F.lit(1.0 - spec.alpha)
            carry = F.coalesce(F.col(f"_{name}_1"), F.lit(0.0)) + F.coalesce(
                F.col(f"_{name}_2"), F.lit(0.0)
            ) * F.pow(decay, F.lit(float(self.part_rows)))
            total = F.coalesce(F.col(f"_{name}_0"), F.lit(0.0)) + carry * F.pow(decay, off + 1)
            ready = F.col(self.row) - spec.first_row + 1 >= spec.min_rows
            out[name] = F.when(ready, total)
        return df.withColumns(out).drop(*local, *one, *two)


@dataclass(frozen=True)
class Ema:
    """One exponential mean: value, smoothing factor, rows before it is shown
    and position of the first non-null value. Later nulls do not occur."""

    value: Column
    alpha: float
    min_rows: int = 0
    first_row: int = 0

    @classmethod
    def span(cls, value: Column, span: int, first_row: int = 0) -> "Ema":
        return cls(value, 2.0 / (span + 1.0), span, first_row)


def part_rows_for(alpha: float) -> int:
    """Longest part whose weights fit a double, at most 65,536 rows."""
    return max(1, min(65_536, int(MAX_EXPONENT / -math.log(1.0 - alpha))))


def ema(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str],
    order: str,
    span_units: int,
    out: str,
    alpha: float | None = None,
    span: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Exponential mean of one column per series; seeds on row 0 of the non-null rows."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    size = part_rows_for(a)
    parts = 2 if a * size > 45 else max(2, math.ceil(45 / (a * size)))
    if parts > 2:
        raise ValueError(f"alpha {a} is too small for a two-part carry")
    series = Series(
        tuple(keys), back=2 * size, block_rows=size * max(4, BLOCK_ROWS // size), part_rows=size
    )
    present = number_rows(df.where(F.col(value).isNotNull()), keys, order, span_units)
    need = (span or 0) if min_rows is None else min_rows
    done = series.close(
        series.ema(series.open(present), {out: Ema(F.col(value), a, need)})
    )
    missing = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return done.unionByName(missing)


_COMBINE = {
    "sum": lambda carry, local: F.when(
        carry.isNotNull() | local.isNotNull(),
        F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    ),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}


def running(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    specs: Mapping[str, tuple[str, str | Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running sum / max / min / last non-null value from the series start.

    ``block`` must not decrease along ``order``. ``exclusive`` leaves the
    current row out.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn(BLOCK, block)
    for name, (_, value) in specs.items():
        cut = cut.withColumn(f"_v_{name}", F.col(value) if isinstance(value, str) else value)
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    position = F.struct(*order)
    totals, local, carried, merged = [], {}, [], {}
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    for name, (how, _) in specs.items():
        v = F.col(f"_v_{name}")
        agg = {"sum": F.sum, "max": F.max, "min": F.min}.get(how)
        if how == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_t_{name}"))
            local[f"_l_{name}"] = F.last(v, True).over(inside)
            carried.append(F.last(f"_t_{name}", True).over(before).alias(f"_c_{name}"))
        else:
            totals.append(agg(v).alias(f"_t_{name}"))
            local[f"_l_{name}"] = agg(v).over(inside)
            carried.append(agg(f"_t_{name}").over(before).alias(f"_c_{name}"))
        merged[name] = _COMBINE[how](F.col(f"_c_{name}"), F.col(f"_l_{name}"))
    carry = cut.groupBy(*keys, BLOCK).agg(*totals).select(*keys, BLOCK, *carried)
    out = cut.withColumns(local).join(carry, [*keys, BLOCK]).withColumns(merged)
    helpers = [f"_{p}_{n}" for n in specs for p in ("v", "l", "c")]
    return out.drop(BLOCK, *helpers)
