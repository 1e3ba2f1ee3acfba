"""Mixing sources to target weights by systematic sampling (operator 7), in DataFrame functions only.

Every document of a source is expected ``target / source size`` times. Documents stand in a fixed order within their source,
by size class and then by a digest, so every size gets its share. The running sum of expected copies plus one random offset
of the source crosses whole numbers; a document is emitted once for each one that it crosses.

A source may hold a third of all rows, so its order is cut into slices of (size class, first digest letters): rows are ranked
inside their slice and slice counts give the rank of its first row. Only counts are ever gathered by source.
Sizes are counted once and written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeflow.session import staged

WORD = r"[^\x20\x09-\x0D]+"
HEX = 16.0**12


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in order; ``share`` of all sizes is dealt; a source gives at most ``most`` times its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(has_source, source, source_size, target) from the size of each source.

    Water filling: sources ordered by limit over weight are full from the front; what the rest gets per weight is the level
    at which all is dealt. One row per source is ordered here, never documents.
    """
    n = len(mix.weights)
    at = F.row_number().over(W.orderBy(F.col("has_source").desc(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (at % n + 1).cast("int")).cast("double")
    rows = sizes.withColumn("place", at).withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * mix.most)
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    total = F.sum("source_size").over(whole) * mix.share
    rows = rows.withColumn("left", total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("full", F.col("left") * F.col("weight") >= F.col("limit") * F.col("open"))
    # the first source that does not fill up gives the level for all after it
    first = F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "place", (F.col("left") / F.col("open")).alias("level")))).over(whole)
    target = F.when(first.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * first["level"]))
    return rows.select("has_source", "source", "source_size", target.alias("target"))


def keyed(rows: DataFrame, mix: Mix) -> DataFrame:
    """Where each row stands: source, size class, slice of the class, digest."""
    return rows.withColumns(
        {
            "mix_has": F.col("mix_source").isNotNull(),
            "mix_source": F.coalesce("mix_source", F.lit("")),
            "mix_digest": F.md5(F.concat(F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.lit(mix.seed)).cast("binary")),
            "mix_class": F.floor(F.sqrt(F.col("mix_size").cast("double"))),
        }
    ).withColumn("mix_slice", F.substring("mix_digest", 1, 3))


def with_copies(rows: DataFrame, sizes: DataFrame, mix: Mix) -> DataFrame:
    """Add source_size, target and copies to rows that have ``mix_id``, ``mix_source`` and ``mix_size``; their other columns stay.

    ``sizes`` has these three columns of the same rows and is read several times. Names starting with ``mix_`` are used for the
    work.
    """
    rows = keyed(rows, mix)
    key = ["mix_has", "mix_source", "mix_class", "mix_slice"]
    slices = keyed(sizes, mix).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("size"))
    classes = slices.groupBy(*key[:3]).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    of_source = classes.groupBy(*key[:2]).agg(F.sum("size").alias("source_size"))
    targets = source_targets(of_source.select(F.col("mix_has").alias("has_source"), F.col("mix_source").alias("source"), "source_size"), mix)
    targets = targets.select(F.col("has_source").alias("mix_has"), F.col("source").alias("mix_source"), "source_size", "target")

    def earlier(keys: list[str], by: str) -> Column:
        w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    classes = classes.select(*key[:3], earlier(key[:2], "mix_class").alias("before")).join(targets, key[:2])
    slices = slices.select(*key, earlier(key[:3], "mix_slice").alias("inside")).join(classes, key[:3])
    slices = slices.select(*key, (F.col("before") + F.col("inside")).alias("mix_before"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    local = F.row_number().over(W.partitionBy(*key).orderBy("mix_digest", "mix_id"))
    rows = rows.withColumn("mix_local", local).join(slices, key)
    rank = F.col("mix_before") + F.col("mix_local")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    tag = F.md5(F.concat(F.lit(mix.seed), F.when(F.col("mix_has"), F.lit("+")).otherwise("-"), F.col("mix_source")).cast("binary"))
    offset = F.conv(F.substring(tag, 1, 12), 16, 10).cast("double") / HEX
    copies = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return rows.withColumn("mix_copies", F.greatest(F.lit(0), F.least(F.lit(mix.most), copies)).cast("long"))


def mix_plan(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source_size, target, copies and taken words of every row.

    A null text has size 0; rows without a source are one source, the last. Empty sources have target 0 and none of their
    documents is taken. Repeated rows count as documents of their own; rows of equal id are alike, so their order is free.
    """
    sizes = staged(docs.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), word_count(F.col(text_col)).alias("mix_size")))
    out = with_copies(sizes, sizes, mix)
    return out.select(
        F.col("mix_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_copies").alias("copies"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns unchanged."""
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"),
        F.col(id_col).alias("mix_id"),
        F.col(source_col).alias("mix_source"),
        word_count(F.col(text_col)).alias("mix_size"),
    )
    sizes = staged(whole.select("mix_id", "mix_source", "mix_size"))
    out = with_copies(whole, sizes, mix).where(F.col("mix_copies") > 0)
    return out.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_no")).select("mix_row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NOT NULL AS has_source, coalesce(source, '') AS source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), sources AS (
  SELECT *, row_number() OVER (ORDER BY has_source DESC, source) - 1 AS place
  FROM (SELECT has_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL)
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(place % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 2e0 AS top FROM sources
), filled AS (
  SELECT *, (SELECT sum(source_size) FROM weighed) * 1.5e0 - coalesce(sum(top) OVER w, 0) AS remain,
    (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS open
  FROM weighed WINDOW w AS (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(remain / open, (top / weight, place)) AS v FROM filled WHERE remain * weight < top * open
), targets AS (
  SELECT f.*, CASE WHEN v IS NULL THEN top ELSE least(top, weight * v) END AS target,
    CAST(('0x' || substr(md5('mix' || CASE WHEN has_source THEN '+' ELSE '-' END || source), 1, 12)) AS BIGINT) / 281474976710656e0 AS shift
  FROM filled f, level
), ranked AS (
  SELECT doc_id, size, source_size, target, shift,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY has_source, source ORDER BY floor(sqrt(size)), md5(doc_id || 'mix'), doc_id) AS r
  FROM sized JOIN targets USING (has_source, source)
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(2, floor(rate * r + shift) - floor(rate * (r - 1) + shift))) AS BIGINT) * size AS taken
FROM ranked
"""
