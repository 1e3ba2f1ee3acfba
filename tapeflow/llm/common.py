"""What the text operators share: narrow inputs, Arrow batches, words, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Whole texts travel in batches, so memory grows with the
#: rows of a batch and not with a partition.
BATCH_ROWS = "1000"
#: Bytes of text that one task should hold where it needs whole blocks.
PART_BYTES = 64 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); a null text is empty. Other columns can't clash with later names."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions, which a session sizes by its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Number of parts of at most about ``part_bytes`` of text, and no fewer than shuffle partitions; reads the texts once."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(width(docs.sparkSession), -(-total // part_bytes))


def block_of(col: Column, blocks: int) -> Column:
    """Documents dealt evenly over blocks; a null id counts as an id of its own."""
    return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words(text: str) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D (what bytes.split cuts at)."""
    return utf8(text).split()


class Ids(dict):
    """Numbers things as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal values starts."""
    first = np.ones(len(sorted_keys), bool)
    if len(sorted_keys):
        first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return first


def spans_to_mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any half-open span."""
    edge = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given spans, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    at = np.cumsum(lengths) - lengths
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


def joined_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``.

    Small groups come together, about ``most`` rows at a time; a group is never cut, so its size
    has to be bounded by who made it.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(runs(keys))[-1])
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
