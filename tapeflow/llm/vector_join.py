"""Embedding near-duplicates by exact comparison of packed blocks (operator 5).

Vectors in many dimensions that point anywhere share no cell of any grid that keeps all near pairs, so the pairs of a label are all
compared, cheaply and without copying vectors. Equal vectors are one node; nodes are packed into blocks of one label and size and
written once. Tasks read pairs of files of that table, so nothing is shuffled for a comparison. The first coordinates of the rotated unit
vectors and the length of the others bound the cosine from above by one product of small matrices; pairs that pass are compared whole
in single precision, and those within its rounding of the threshold by their cosine in double precision.

Tasks return one row for each node with links: their number and one link to a root, never pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import BATCH_ROWS, prepare
from tapeflow.llm.components import class_facts, roots
from tapeflow.session import staged

#: Bytes of the vectors of one block at most, and blocks of one file: a reader holds the blocks of a file at once.
BLOCK_BYTES = 1 << 20
FILE_BLOCKS = 16
#: Pairs of blocks of one Arrow batch, prepared blocks kept by a task, and left rows of one product.
BATCH_PAIRS = "4"
KEPT_BLOCKS = 32
TILE = 256
#: Links held before they are folded into roots.
HELD_LINKS = 1 << 20


@dataclass(frozen=True)
class Search:
    """Least cosine; coordinates compared first; members of a block."""

    threshold: float = 0.93
    prefix: int = 24
    members: int = 2048


@lru_cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(v: np.ndarray) -> bool:
    """Can the vector (in double precision) link? Not if empty, zero, or with a number that is null or not finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt(np.dot(v, v))
    return bool(len(v) and np.isfinite(v).all() and np.isfinite(size) and size > 0)


class Block:
    """Nodes of one label and size, ready to be compared."""

    def __init__(self, nodes: bytes, copies: bytes, vectors: bytes, kind: str, search: Search) -> None:
        self.nodes, self.copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
        self.raw = np.frombuffer(vectors, kind).reshape(len(self.nodes), -1)
        v = self.raw.astype(np.float64)
        self.norm = np.linalg.norm(v, axis=1)
        #: the cosine is only rounded as usual where products of norms are far from the limits of a double
        self.plain = (self.norm > 1e-100) & (self.norm < 1e100)
        dim = v.shape[1]
        x = (v / self.norm[:, None]) @ rotation(dim)
        k = min(search.prefix, dim)
        rest = np.sqrt((x[:, k:] ** 2).sum(1))
        self.unit = x.astype(np.float32)
        self.head = np.column_stack([x[:, :k], rest]).astype(np.float32)
        #: twice the most that rounding to single precision moves a product of unit vectors
        self.slack = np.float32((dim + 8) * 2.0**-23)

    def links(self, other: Block, search: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked places (here, there), each pair once, a tile at a time."""
        least, sure = np.float32(search.threshold) - self.slack, np.float32(search.threshold) + self.slack
        for a in range(0, len(self.nodes), TILE):
            # inside a block, only later members
            b = a if other is self else 0
            near = self.head[a : a + TILE] @ other.head[b:].T >= least
            if other is self:
                near = np.triu(near, 1)
            found = np.count_nonzero(near)
            if not found:
                continue
            if found * 32 > near.size:
                cosine = self.unit[a : a + TILE] @ other.unit[b:].T
                i, j = np.nonzero(near & (cosine >= least))
                cosine = cosine[i, j]
                i, j = i + a, j + b
            else:
                i, j = np.nonzero(near)
                i, j = i + a, j + b
                cosine = np.einsum("ij,ij->i", self.unit[i], other.unit[j])
                good = cosine >= least
                i, j, cosine = i[good], j[good], cosine[good]
            good = (cosine >= sure) & self.plain[i] & other.plain[j]
            doubt = np.flatnonzero(~good)
            for s in range(0, len(doubt), 100_000):
                at = doubt[s : s + 100_000]
                u, v = i[at], j[at]
                exact = (self.raw[u].astype(np.float64) * other.raw[v].astype(np.float64)).sum(1) / (self.norm[u] * other.norm[v])
                good[at] = exact >= search.threshold
            if good.any():
                yield i[good], j[good]


class Found:
    """Links and roots of the nodes of all blocks that a task has compared."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.nodes: list[np.ndarray] = []
        self.number: list[np.ndarray] = []
        self.start: list[int] = []
        self.size = 0
        self.root = np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.held_links = 0

    def place(self, key: int, block: Block) -> int:
        if key not in self.at:
            self.at[key] = len(self.nodes)
            self.nodes.append(block.nodes)
            self.number.append(np.zeros(len(block.nodes), np.int64))
            self.start.append(self.size)
            self.root = np.append(self.root, np.arange(self.size, self.size + len(block.nodes)))
            self.size += len(block.nodes)
        return self.at[key]

    def add(self, left: tuple[int, Block], right: tuple[int, Block], search: Search) -> None:
        for i, j in left[1].links(right[1], search):
            p, q = self.place(*left), self.place(*right)
            self.number[p] += np.bincount(i, right[1].copies[j], len(left[1].nodes)).astype(np.int64)
            self.number[q] += np.bincount(j, left[1].copies[i], len(right[1].nodes)).astype(np.int64)
            i, j = self.root[i + self.start[p]], self.root[j + self.start[q]]
            new = i != j
            self.held.append((i[new], j[new]))
            self.held_links += np.count_nonzero(new)
            if self.held_links > HELD_LINKS:
                self.fold()

    def fold(self) -> None:
        if self.held:
            i, j = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.root = roots(i, j, self.size)[self.root]
            self.held, self.held_links = [], 0

    def rows(self) -> pa.RecordBatch:
        self.fold()
        nodes = np.concatenate([np.zeros(0, np.int64), *self.nodes])
        number = np.concatenate([np.zeros(0, np.int64), *self.number])
        at = np.flatnonzero(number)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[at], number[at], nodes[self.root[at]])], names=["node", "links", "root"])


def packed(nodes: DataFrame, kind: str, search: Search) -> DataFrame:
    """Blocks of nodes of one label and size: (key, label, dim, nodes, reps, copies, vectors); the key is its first node."""
    width = np.dtype(kind).itemsize

    def block(label: str, dim: int, rows: list[tuple]) -> pa.RecordBatch:
        node, rep, copies, raw = zip(*rows, strict=True)
        cells = [node[0], label, dim, *(np.array(c, np.int64).tobytes() for c in (node, rep, copies)), b"".join(raw)]
        types = (pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["key", "label", "dim", "nodes", "reps", "copies", "vectors"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for label, dim, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (now != (label, dim) or len(rows) >= min(search.members, max(1, BLOCK_BYTES // (dim * width)))):
                    yield block(*now, rows)
                    rows = []
                now = (label, dim)
                rows.append(row)
        if rows:
            yield block(*now, rows)

    dim = F.expr(f"octet_length(vector) div {width}").cast("int")
    rows = nodes.select("label", dim.alias("dim"), "node", "rep", "copies", "vector").sortWithinPartitions("label", "dim")
    return rows.mapInArrow(each, "key long, label string, dim int, nodes binary, reps binary, copies binary, vectors binary")


def firsts(blocks: DataFrame) -> DataFrame:
    """(node, rep, copies) of all nodes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)) for c in row], names=["node", "rep", "copies"])

    return blocks.select("nodes", "reps", "copies").mapInArrow(each, "node long, rep long, copies long")


def compared(blocks: DataFrame, kind: str, search: Search) -> DataFrame:
    """(node, links, root) for every node and task in which it has links.

    Files are read against files (a product of two tables has no shuffle); of the two orders of a pair of blocks one is taken,
    by a bit of both keys, so that work is even.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, Block] = OrderedDict()

        def ready(key: int, batch: pa.RecordBatch, side: str, row: int) -> tuple[int, Block]:
            if key not in kept:
                kept[key] = Block(*(batch[f"{side}_{c}"][row].as_py() for c in ("nodes", "copies", "vectors")), kind, search)
            kept.move_to_end(key)
            if len(kept) > KEPT_BLOCKS:
                kept.popitem(last=False)
            return key, kept[key]

        found = Found()
        for batch in batches:
            for row, (a, b) in enumerate(zip(batch["l_key"].to_pylist(), batch["r_key"].to_pylist(), strict=True)):
                found.add(ready(a, batch, "l", row), ready(b, batch, "r", row), search)
        yield found.rows()

    sides = [blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", "label", "dim", "nodes", "copies", "vectors")]) for s in "lr"]
    left, right = F.col("l_key"), F.col("r_key")
    once = (left == right) | ((left < right) == (left.bitwiseXOR(right).bitwiseAND(1) == 0)) & (left != right)
    same = (F.col("l_label") == F.col("r_label")) & (F.col("l_dim") == F.col("r_dim"))
    pairs = sides[0].join(sides[1].hint("shuffle_replicate_nl"), same & once)
    return pairs.drop("l_label", "r_label", "l_dim", "r_dim").mapInArrow(each, "node long, links long, root long")


def near_vectors(table: DataFrame, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link where labels are equal and not null and the cosine reaches the threshold. A vector that is null, empty, zero or holds
    a null or a number that is not finite links with nothing, as does one without a label or an id; it is its own component and is
    kept. Vectors of different sizes do not link. Rows of one id are linked as rows; their component is the least id reached.
    """
    spark = table.sparkSession
    prepare(spark)
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, array = ("f4", "array<float>") if single else ("f8", "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(array).alias("vector"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raws = [], []
            for vec_id, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                node = raw = None
                if vec_id is not None and label is not None and vector.is_valid:
                    v = vector.values.to_numpy(zero_copy_only=False)
                    wide = v.astype(np.float64)
                    if usable(wide):
                        node, raw = xxhash.xxh3_64_intdigest(wide.tobytes() + label.encode()) - 2**63, v.astype(kind).tobytes()
                nodes.append(node)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(1), pa.array(raws, pa.binary())], names=["vec_id", "node", "label", "vector"])

    rows = rows.mapInArrow(clean, "vec_id long, node long, label string, vector binary")
    ids = staged(rows.select("vec_id", "node"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector")
    )
    blocks = staged(packed(nodes, kind, search), maxRecordsPerFile=FILE_BLOCKS, compression="none")
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch_rows, BATCH_PAIRS)
    try:
        found = staged(compared(blocks, kind, search))
    finally:
        spark.conf.set(batch_rows, BATCH_ROWS)
    facts = class_facts(firsts(blocks), found)
    out = ids.where("node IS NOT NULL").join(facts, "node").select("vec_id", "n_links", F.col("class_id").alias("component_id"))
    alone = ids.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def digest(table: DataFrame) -> DataFrame:
    return near_vectors(table)


SQL = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.other = link.a
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM link l WHERE l.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""
