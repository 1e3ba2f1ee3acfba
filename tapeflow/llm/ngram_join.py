"""N-gram Jaccard join with Bayesian candidate pruning (operator 1).

1. A text's set of five-word shingles gives 128 MinHash values and their 32 bands of four. Texts of equal sets are one class,
   counted before anything is compared.
2. Classes that share a band fall in one bucket. Only counts and checksums of buckets are gathered; buckets of the same members
   are compared once, at their first band. A pair at similarity 0.8 shares no band with a probability below 5e-8.
3. A bucket is a cell of one task; a larger one is dealt over blocks, and cells are pairs of blocks, so no task holds more than
   two blocks. Links are not sent as pairs: cells return the number of links and one link to a root for each member.
4. In a cell, pairs are compared at their first common band only. MinHash values are compared sixteen at a time, and a pair is
   dropped once the posterior probability that it reaches the threshold is below the tolerance. The rest is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Ids, joined_groups, narrow, prepare, texts, words
from tapeflow.llm.components import class_facts, dealt_cells, roots
from tapeflow.session import staged

HASHES, ROWS, STEP = 128, 4, 16
BANDS = HASHES // ROWS
ODD = np.random.default_rng(3).integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = np.random.default_rng(4).integers(0, 2**64, HASHES, np.uint64)


@dataclass(frozen=True)
class Join:
    """words per shingle; least Jaccard similarity; posterior below which a pair is dropped; members of a block."""

    size: int = 5
    threshold: Fraction = Fraction(4, 5)
    tolerance: float = 1e-9
    block: int = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def shingle_sets(found: list[str], size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; below ``size`` words all words are one, no words give none."""
    number = Ids()
    look = number.__getitem__
    split = [list(map(look, words(t))) for t in found]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    out = []
    for ids in split:
        w = hashes[ids] if ids else np.zeros(0, np.uint64)
        n = max(min(1, len(w)), len(w) - size + 1)
        h = np.full(n, 0x51ED270B, np.uint64)
        for i in range(min(size, len(w))):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n])
        out.append(np.unique(h))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of one set."""
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096]
        # by hash functions outside, so that each stays in the cache
        low = np.minimum(low, (np.multiply.outer(ODD, x) + SHIFT[:, None]).min(1) >> np.uint64(32)).astype(np.uint32)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band with the band's number in its last five bits."""
    v = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.full(BANDS, 0x2545F491, np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + v[:, i])
    return key << np.uint64(5) | np.arange(BANDS, dtype=np.uint64)


@lru_cache
def least_matches(threshold: Fraction, tolerance: float) -> list[int]:
    """Matches needed after each step: fewer leave a posterior below the tolerance, from an even prior.

    After m matches of n the similarity has a Beta(m + 1, n - m + 1) posterior, whose upper tail is a binomial sum.
    """
    t = float(threshold)
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common shingles of each pair."""
    if len(i) <= 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    order = np.argsort(flat, kind="stable")
    first = np.ones(len(flat), bool)
    first[1:] = flat[order][1:] != flat[order][:-1]
    at = np.empty(len(flat), np.int64)
    at[order] = np.cumsum(first) - 1
    several = np.bincount(at) > 1  # the others can't be common
    column = np.cumsum(several) - 1
    keep = several[at]
    out = np.zeros(len(i), np.int64)
    a, b = np.searchsorted(used, i), np.searchsorted(used, j)
    owner, column = owner[keep], column[at[keep]]
    wide = 64 * 256  # columns at once
    for c in range(0, int(several.sum()), wide):
        here = (column >= c) & (column < c + wide)
        bits = np.zeros((len(used), wide // 8), np.uint8)
        np.bitwise_or.at(bits, (owner[here], (column[here] - c) >> 3), (1 << ((column[here] - c) & 7)).astype(np.uint8))
        lanes = bits.view(np.uint64)
        lanes = lanes[:, : -(-(min(int(several.sum()) - c, wide)) // 64)]
        for p in range(0, len(i), 4096):
            out[p : p + 4096] += np.bitwise_count(lanes[a[p : p + 4096]] & lanes[b[p : p + 4096]]).sum(1, dtype=np.int64)
    return out


def cell_links(side: np.ndarray, band: int, sig: np.ndarray, sets: list[np.ndarray], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a cell whose first common band is this one."""
    inside = side[0] == 2
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    size = np.array([len(s) for s in sets], np.int64)
    num, den = join.threshold.numerator, join.threshold.denominator
    need = least_matches(join.threshold, join.tolerance)
    bands = sig.reshape(len(sig), BANDS, ROWS)
    found = []
    for a in left:
        b = left[left > a] if inside else right
        b = b[np.minimum(size[a], size[b]) * den >= num * np.maximum(size[a], size[b])]
        if band and len(b):
            b = b[~(bands[b, :band] == bands[a, :band]).all(2).any(1)]
        matches = np.zeros(len(b), np.int64)
        for step, least in enumerate(need):
            if not len(b):
                break
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (sig[b, part] == sig[a, part]).sum(1)
            keep = matches >= least
            b, matches = b[keep], matches[keep]
        if len(b):
            found.append((np.full(len(b), a), b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    both = shared(sets, i, j)
    near = both * den >= num * (size[i] + size[j] - both)
    return i[near], j[near]


def classes(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, mark, node, bands) of documents with an id and a word; node and mark are 64-bit hashes of the set of shingles and of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts(batch.column(1)), join.size)
            full = np.array([len(s) > 0 for s in sets], bool)
            some = [s for s in sets if len(s)]
            node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in some), np.uint64, len(some))
            bands = np.stack([band_keys(signature(s)) for s in some]).view(np.int64) if some else np.zeros((0, BANDS), np.int64)
            ids, mark = (batch.column(c).filter(pa.array(full)) for c in (0, 2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(some) + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([ids, mark, pa.array(node.view(np.int64)), lists], names=["doc_id", "mark", "node", "bands"])

    marked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(each, "doc_id long, mark long, node long, bands array<long>")


def cells_of(nodes: DataFrame, join: Join) -> DataFrame:
    """(cell, side, band, node) of all members of buckets to compare."""
    band = nodes.select("node", F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    first = F.min(F.struct(F.col("key").bitwiseAND(BANDS - 1).alias("band"), "key")).alias("first")
    buckets = buckets.groupBy("n", "members").agg(first).select(F.col("first.key").alias("key"), F.col("first.band").alias("band"), F.ceil(F.col("n") / join.block).cast("int").alias("blocks"))
    members = band.join(buckets, "key").select("key", F.col("band").cast("int").alias("band"), "node", "blocks")
    return dealt_cells(members, ["band", "node"])


def with_sets(cells: DataFrame, docs: DataFrame, first: DataFrame, join: Join) -> DataFrame:
    """Sets and signatures of the members, made again from the text of one document of each.

    An id may stand for several texts, so a set goes to the node that is its hash and not to all nodes of the id.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for doc_id, found in zip(batch.column(0).to_pylist(), shingle_sets(texts(batch.column(1)), join.size), strict=True):
                if len(found):
                    raw = found.tobytes()
                    sets[doc_id, xxhash.xxh3_64_intdigest(raw)] = found, raw
            cols = [pa.array([k[0] for k in sets], pa.int64()), pa.array(np.fromiter((k[1] for k in sets), np.uint64, len(sets)).view(np.int64))]
            cols += [pa.array([signature(x).tobytes() for x, _ in sets.values()], pa.binary()), pa.array([raw for _, raw in sets.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "set_node", "sig", "shingles"])

    wanted = first.join(cells.select("node").distinct(), "node", "left_semi")
    text = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = text.mapInArrow(each, "doc_id long, set_node long, sig binary, shingles binary")
    own = wanted.join(sets, (wanted["node"] == sets["set_node"]) & (wanted["rep"] == sets["doc_id"]))
    return cells.join(own.dropDuplicates(["node"]).select("node", "copies", "sig", "shingles"), "node")


def compared(members: DataFrame, join: Join) -> DataFrame:
    """(node, links, root) for every member and cell in which it has links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined_groups(batches, "cell"):
            cell = table["cell"].to_numpy()
            side, band, node, copies = (table[c].to_numpy() for c in ("side", "band", "node", "copies"))
            raw_sig, raw = table["sig"].to_pylist(), table["shingles"].to_pylist()
            cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cut, np.append(cut[1:], len(cell)), strict=True):
                sig = np.frombuffer(b"".join(raw_sig[a:b]), np.uint32).reshape(-1, HASHES)
                sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                i, j = cell_links(side[a:b], int(band[a]), sig, sets, join)
                if len(i):
                    c = copies[a:b]
                    links = np.bincount(i, c[j], b - a) + np.bincount(j, c[i], b - a)
                    at = np.flatnonzero(links)
                    out.append((node[a:b][at], links[at].astype(np.int64), node[a:b][roots(i, j, b - a)[at]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "links", "root"])

    near = members.select("cell", "side", "band", "node", "copies", "sig", "shingles").repartition("cell").sortWithinPartitions("cell")
    return near.mapInArrow(each, "node long, links long, root long")


def marked_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """What ``near_duplicates`` gives, with mark, a hash of the text (null where the text has no words); docs as ``narrow`` gives them."""
    all_rows = staged(classes(docs, join))
    first = all_rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    nodes = staged(first)
    cells = staged(cells_of(nodes, join))
    firsts = nodes.select("node", "rep", "copies")
    found = staged(compared(with_sets(cells, docs, firsts, join), join))
    facts = class_facts(firsts, found)
    full = all_rows.select("doc_id", "mark", "node").join(facts, "node").select("doc_id", "mark", "class_id", "n_links", "copy_of")
    bare = docs.where(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    no_links = [F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of")]
    out = full.unionByName(bare.select("doc_id", F.lit(None).cast("long").alias("mark"), *no_links))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def near_duplicates(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, copy_of, kept of every row.

    class_id is the least id that links reach, itself included; n_links counts the other rows whose similarity reaches the
    threshold, copies included; copy_of is the least id with the same shingles; kept holds for the document that names its class.
    A text without words links with nothing and is kept, also where it is repeated. A missing id has no class, links with
    nothing and is kept. Rows of one id count as rows; if their texts differ, each is compared by its own text.
    """
    prepare(docs.sparkSession)
    return marked_duplicates(narrow(docs, id_col, text_col), join).drop("mark")


def without_duplicates(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document names its class, with all their columns unchanged.

    Where rows of one id have different texts, each stays or goes by its own text; rows of the id that names a class stay together.
    """
    prepare(docs.sparkSession)
    found = marked_duplicates(narrow(docs, id_col, text_col), join)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_text")).distinct()
    same = (docs[id_col].cast("long") == gone["gone"]) & (F.xxhash64(docs[text_col]) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM word
), one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingle
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS n_both
  FROM one x JOIN one y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair WHERE 5 * n_both >= 4 * (na + nb - n_both)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
), same AS (
  SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS copy_of FROM shingle
)
SELECT d.doc_id, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS class_id,
  (SELECT count(*) FROM link l WHERE l.a = d.doc_id) AS n_links, copy_of,
  d.doc_id = (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS kept
FROM documents d JOIN same USING (doc_id)
"""
