"""Line dedup by sharded minimal perfect hashes (operator 6).

Documents are dealt into blocks by a hash of their id. A block sends each shard its distinct line hashes with a document count
and its largest document id, so a line in a third of all documents costs one record a block. A shard adds these up and builds a
minimal perfect hash over all its distinct line hashes, which indexes compact arrays of fingerprints, document counts and largest
ids; the hashes of each block probe these arrays. Lines found often enough go back to the block as arrays of the same kind,
and its documents probe them with all their lines at once. Lines themselves are never joined, and texts are shuffled once.
The number of blocks follows the bytes of the texts, which are read once more for it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.llm.common import block_of, parts_for, prepare, runs, utf8

STRIP = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
#: One line of one block or shard: two halves of its hash, documents that hold it, the largest id of these.
ENTRY = np.dtype([("hash", "<u8"), ("print", "<u8"), ("docs", "<u8"), ("last", "<i8")])
DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def mixed_bits(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit keys for each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays by level, keys that meet another go one level down."""

    def __init__(self, keys: np.ndarray, slots_per_key: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # packed bits, set bits before each byte, slots
        before = 0
        while len(keys):
            slots = int(len(keys) * slots_per_key) + 1
            at = (mixed_bits(keys, len(self.levels)) % np.uint64(slots)).astype(np.int64)
            alone = np.bincount(at, minlength=slots) == 1
            bits = np.packbits(alone)
            ones = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self.levels.append((bits, before + ones - np.bitwise_count(bits), slots))
            before += int(ones[-1])
            keys = keys[~alone[at]]
        self.size = before

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for some keys that are not in the set; others get any place."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before, slots) in enumerate(self.levels):
            at = (mixed_bits(keys[todo], level) % np.uint64(slots)).astype(np.int64)
            byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
            found = (bits[byte] >> bit & 1).astype(bool)
            b = byte[found]
            above = np.bitwise_count((bits[b] >> bit[found]).astype(np.uint8)).astype(np.int64) - 1
            out[todo[found]] = before[b] + above
            todo = todo[~found]
        return out


def summed(entries: np.ndarray) -> np.ndarray:
    """One entry for each line hash."""
    entries = entries[np.lexsort((entries["print"], entries["hash"]))]
    first = runs(entries["hash"]) | runs(entries["print"])
    at = np.flatnonzero(first)
    out = entries[at].copy()
    if len(at):
        out["docs"] = np.add.reduceat(entries["docs"], at)
        out["last"] = np.maximum.reduceat(entries["last"], at)
    return out


def line_hash(line: str, min_chars: int) -> bytes | None:
    """Hash of a line's key, none for short keys."""
    line = line.strip(STRIP)
    return xxhash.xxh3_128_digest(utf8(line).lower()) if len(line) >= min_chars else None


def block_entries(ids: list[int], found: list[str], min_chars: int) -> np.ndarray:
    """Entries of the lines of a block's documents."""
    raw, owner = [], []
    for doc, text in zip(ids, found, strict=True):
        keys = {line_hash(x, min_chars) for x in text.split("\n")} - {None}
        raw.extend(keys)
        owner.extend([doc] * len(keys))
    if not raw:
        return np.zeros(0, ENTRY)
    halves = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)
    out = np.zeros(len(raw), ENTRY)
    out["hash"], out["print"], out["docs"], out["last"] = halves[:, 0], halves[:, 1], 1, owner
    # a document that comes as several rows counts once
    order = np.lexsort((out["last"], out["print"], out["hash"]))
    out = out[order]
    return summed(out[runs(out["hash"]) | runs(out["print"]) | runs(out["last"])])


def shard_rows(block: int, entries: np.ndarray, shards: int) -> pa.Table:
    shard = (mixed_bits(entries["hash"], 99) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard, entries = shard[order], entries[order]
    at = np.flatnonzero(runs(shard))
    stop = np.append(at, len(shard))[1:]
    return pa.table(
        {
            "shard": pa.array(shard[at], pa.int32()),
            "block": pa.array(np.full(len(at), block, np.int32)),
            "entries": pa.array([entries[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary()),
        }
    )


def line_keys(entries: np.ndarray) -> np.ndarray:
    """Both halves of a line's hash as one key."""
    return entries["hash"] ^ mixed_bits(entries["print"], 7)


class LineArrays:
    """Arrays over distinct lines, indexed by a minimal perfect hash: fingerprint, number of documents, largest id."""

    def __init__(self, entries: np.ndarray):
        keys, at = np.unique(line_keys(entries), return_index=True)
        self.index = PerfectHash(keys)
        place = self.index.index(keys)
        self.prints, self.docs, self.last = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        self.prints[place] = entries["print"][at]
        self.docs[place] = np.minimum(entries["docs"][at], 2**32 - 1)
        self.last[place] = entries["last"][at]

    def probe(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with each line (0: not in the arrays) and the largest id of these."""
        docs, last = np.zeros(len(lines), np.uint32), np.zeros(len(lines), np.int64)
        if not self.index.size or not len(lines):
            return docs, last
        at = self.index.index(line_keys(lines))
        hit = (at >= 0) & (self.prints[at] == lines["print"])
        docs[hit], last[hit] = self.docs[at[hit]], self.last[at[hit]]
        return docs, last


def shard_answers(table: pa.Table, min_docs: int) -> pa.Table:
    """For each block, its lines of this shard that are in enough documents, with their counts and largest ids."""
    sent = [np.frombuffer(x, ENTRY) for x in table["entries"].to_pylist()]
    arrays = LineArrays(summed(np.concatenate(sent)))
    blocks, answers = [], []
    for block, entries in zip(table["block"].to_pylist(), sent, strict=True):
        docs, last = arrays.probe(entries)
        often = docs >= min_docs
        if often.any():
            found = entries[often].copy()
            found["docs"], found["last"] = docs[often], last[often]
            blocks.append(block)
            answers.append(found.tobytes())
    return pa.table({"block": pa.array(blocks, pa.int32()), "entries": pa.array(answers, pa.binary())})


def dropped_lines(ids: list[int], lines: list[list[str]], arrays: LineArrays, min_chars: int, min_docs: int) -> dict[int, set[int]]:
    """For documents that lose some, the numbers of the lines that they lose; all lines are looked up in the arrays at once."""
    raw, doc, number = [], [], []
    for i, mine in enumerate(lines):
        for k, line in enumerate(mine):
            h = line_hash(line, min_chars)
            if h is not None:
                raw.append(h)
                doc.append(i)
                number.append(k)
    halves = np.frombuffer(b"".join(raw), "<u8").reshape(-1, 2)
    asked = np.zeros(len(raw), ENTRY)
    asked["hash"], asked["print"] = halves[:, 0], halves[:, 1]
    docs, last = arrays.probe(asked)
    doc = np.array(doc, np.int64)
    gone: dict[int, set[int]] = {}
    for at in np.flatnonzero((docs >= min_docs) & (last != np.array(ids, np.int64)[doc])).tolist():
        gone.setdefault(int(doc[at]), set()).add(number[at])
    return gone


def line_dedup(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """Rows of ``docs`` without the lines found in ``min_docs`` documents or more; the largest id keeps them.

    A line's key is the line without white space at its ends and with A-Z in lower case; keys below ``min_chars`` code points
    stay. A null text is one empty line and stays null. Rows of one id are one document; a missing id counts as one document
    before all others. All columns but the text are given back unchanged. With ``digest``: id, lines, dropped lines and SHA-256
    of what stays instead. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = parts_for(docs, text_col)
    blocks, shards = 2 * partitions, partitions
    rest = [c for c in docs.columns if c != text_col and not digest]
    dealt = docs.select(
        block_of(F.col(id_col), blocks).alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        *([F.struct(*[docs[c] for c in rest]).alias("rest")] if rest else []),
    ).repartition(partitions, "block")

    def ids_of(table: pa.Table) -> list[int]:
        return [NO_ID if x is None else x for x in table["id"].to_pylist()]

    def count(table: pa.Table) -> pa.Table:
        found = [x or "" for x in table["text"].to_pylist()]
        return shard_rows(table["block"][0].as_py(), block_entries(ids_of(table), found, min_chars), shards)

    def keep(table: pa.Table, known: pa.Table) -> pa.Table:
        arrays = LineArrays(np.concatenate([np.zeros(0, ENTRY), *(np.frombuffer(x, ENTRY) for x in known["entries"].to_pylist())]))
        found = table["text"].to_pylist()
        lines = [(x or "").split("\n") for x in found]
        gone = dropped_lines(ids_of(table), lines, arrays, min_chars, min_docs)
        total, lost = [len(x) for x in lines], [len(gone.get(i, ())) for i in range(len(lines))]
        kept = [x if i not in gone else "\n".join(line for k, line in enumerate(lines[i]) if k not in gone[i]) for i, x in enumerate(found)]
        if digest:
            sha = [hashlib.sha256(utf8(x or "")).hexdigest() for x in kept]
            return pa.table({"doc_id": table["id"], "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})
        return pa.table(({"rest": table["rest"]} if rest else {}) | {"text": pa.array(kept, pa.string())})

    sent = dealt.select("block", "id", "text").groupBy("block").applyInArrow(count, "shard int, block int, entries binary")
    answers = sent.groupBy("shard").applyInArrow(lambda t: shard_answers(t, min_docs), "block int, entries binary")
    if digest:
        schema = DIGEST
    else:
        schema = T.StructType([*(f for f in dealt.schema if f.name == "rest"), T.StructField("text", T.StringType())])
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, schema)
    if digest:
        return out
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs, digest=True)


SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, last IS NULL OR last = doc_id AS stays FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
