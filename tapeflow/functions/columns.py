"""Column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.session import staged

NUDGE = 3e-9


def yes(condition: Column) -> Column:
    """Comparison where a null operand means false, as in NaN comparisons."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (greatest/least would skip it)."""
    bounded = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def ratio(num: Column, den: Column, default: float | Column | None = None) -> Column:
    """num/den where den > 0, else the default."""
    out = F.when(den > 0, num / den)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(float(default)))


def over_nonzero(num: Column, den: Column, default: float | Column | None = None) -> Column:
    """num/den where den is not zero, else the default."""
    out = F.when(den != 0, num / den)
    if default is None:
        return out
    return F.coalesce(out, default if isinstance(default, Column) else F.lit(float(default)))


def flag(condition: Column) -> Column:
    """0.0 / 1.0 from a condition, null counting as 0."""
    return yes(condition).cast("double")


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch from a timestamp (with or without zone), floored."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(col.cast("timestamp"))


def bucket_start(ts_ms: str | Column, length_ms: int) -> Column:
    col = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return col - F.pmod(col, F.lit(int(length_ms)))


def int_div(value: str | Column, by: int) -> Column:
    """Floored integer division of a BIGINT."""
    col = F.col(value) if isinstance(value, str) else value
    return ((col - F.pmod(col, F.lit(int(by)))) / F.lit(int(by))).cast("bigint")


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column. The nudge sends exact ties one way, whatever the
    order of a sum was; + 0.0 turns a negative zero into zero."""
    cols = [
        (F.round(F.col(f"`{f.name}`") + NUDGE, digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


#: Rows up to which one side of a join is sent to all executors: some MB of narrow rows.
SMALL_ROWS = 100_000


def attach(facts: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """Join facts with a frame of one narrow row per key without shuffling the facts by a key that may hold a third of them.

    The frame is written and counted first; it is broadcast up to ``most`` rows. Beyond that no key is that hot for its
    number alone, and the join is left to the session's skew handling.
    """
    per_key = staged(per_key)
    few = per_key.limit(most + 1).count() <= most
    return facts.join(F.broadcast(per_key) if few else per_key, keys, how)
