"""Key and text rules: assets, products, lists, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candle lengths by interval name, in ms.
INTERVAL_MS = {
    "ONE_MINUTE": 60_000,
    "FIVE_MINUTE": 300_000,
    "FIFTEEN_MINUTE": 900_000,
    "THIRTY_MINUTE": 1_800_000,
    "ONE_HOUR": 3_600_000,
    "TWO_HOUR": 7_200_000,
    "SIX_HOUR": 21_600_000,
    "ONE_DAY": 86_400_000,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_asset(product: str | Column) -> Column:
    """Upper-case text before the first dash."""
    return F.upper(F.split_part(_col(product), F.lit("-"), F.lit(1)))


def base_asset_loose(product: str | Column) -> Column:
    """Same, for names that may use a slash."""
    return base_asset(F.translate(F.trim(_col(product)), "/", "-"))


def product_of_symbol(symbol: str | Column) -> Column:
    """Joined exchange symbols to dashed products; others unchanged."""
    return F.regexp_replace(F.trim(F.upper(_col(symbol))), "USDT?$", "-USD")


def interval_ms(name: str | Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in INTERVAL_MS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.upper(_col(name))), F.lit(60_000)).cast("bigint")


def is_true(value: str | Column, words: tuple[str, ...] = ("true",)) -> Column:
    """Text flag; null is false."""
    return F.coalesce(F.lower(F.trim(_col(value))).isin(*words), F.lit(False))


ORDER_TRUE = ("1", "true", "yes", "y")


def list_items(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Comma list to one row per distinct item with its first position."""
    return (
        df.select(*keys, F.posexplode(F.split(text, ",")).alias("pos", "item"))
        .withColumn("item", F.upper(F.trim("item")))
        .where(F.col("item") != "")
        .groupBy(*keys, "item")
        .agg(F.min("pos").alias("pos"))
    )


def overrides(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """'BASE=1.5,X=0.2' to (base, value); bad parts are skipped, a later key wins."""
    parts = df.select(*keys, F.posexplode(F.split(text, ",")).alias("pos", "part")).where(F.col("part").contains("="))
    name = F.upper(F.trim(F.substring_index("part", "=", 1)))
    value = F.trim(F.expr("substring(part, instr(part, '=') + 1)"))
    return (
        parts.select(*keys, "pos", name.alias("base"), value.alias("_v"))
        .withColumn("value", F.expr("try_cast(_v AS DOUBLE)"))
        .where((F.col("base") != "") & F.col("value").isNotNull())
        .groupBy(*keys, "base")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def first_seen(*ranked: DataFrame, item: str = "base") -> DataFrame:
    """Ordered union without repeats. Each input has (item, pos); earlier inputs win."""
    out = None
    for i, df in enumerate(ranked):
        part = df.select(item, F.struct(F.lit(i).alias("list"), F.col("pos").cast("bigint").alias("pos")).alias("_at"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.min("_at").alias("_at")).select(item, "_at.list", "_at.pos")


def day_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day of each inclusive range."""
    return df.withColumn("day", F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))))


def time_to_ms(value: str | Column) -> Column:
    """Number or ISO text to ms; null is 0."""
    text = _col(value).cast("string")
    return F.coalesce(
        text.try_cast("bigint"),
        F.unix_millis(F.try_to_timestamp(text)),
        F.lit(0),
    ).cast("bigint")


def epoch_divisor(largest: Column) -> Column:
    """Unit of a time column by its largest value, as (multiply, divide) to ms."""
    return (
        F.when(largest >= 10**17, F.struct(F.lit(1).alias("mul"), F.lit(1_000_000).alias("div")))
        .when(largest >= 10**14, F.struct(F.lit(1).alias("mul"), F.lit(1_000).alias("div")))
        .when(largest >= 10**11, F.struct(F.lit(1).alias("mul"), F.lit(1).alias("div")))
        .otherwise(F.struct(F.lit(1_000).alias("mul"), F.lit(1).alias("div")))
    )


def to_epoch_ms(df: DataFrame, column: str, out: str) -> DataFrame:
    """Numeric epochs of any unit to ms; the unit comes from the column maximum."""
    unit = df.agg(epoch_divisor(F.max(column)).alias("_u"))
    scaled = F.col(column) * F.col("_u.mul")
    return (
        df.crossJoin(F.broadcast(unit))  # one row
        .withColumn(out, ((scaled - F.pmod(scaled, F.col("_u.div"))) / F.col("_u.div")).cast("bigint"))
        .drop("_u")
    )


def text_time_to_ms(column: str | Column) -> Column:
    """Date-time text, read as UTC, to ms; bad text raises as in a strict load."""
    return F.unix_millis(F.to_timestamp(_col(column)))
