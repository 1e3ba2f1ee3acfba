"""Benchmark decontamination with suffix arrays over shards of the training documents (operator 12).

Words of benchmark items are numbered; other words and document ends are 0. A task cuts its documents into shards of bounded
words and sorts the suffixes of each shard into a suffix array, as deep as a window. Every test suffix that opens a window is
found in each shard by binary search over packed words; the interval between its bounds holds all locations. A location is
extended to the longest verbatim match there, so each match comes out once, at its left end. Suffixes with fewer known words
ahead than the shortest window hold no window and are left out of the array.

Documents are whole inside a shard, so nothing is shuffled. Items are broadcast in blocks of a checked size; a larger benchmark
takes one pass over the documents for each block, and matches of a row are put together by id and two hashes of its text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Ids, expand, prepare, runs, texts, utf8

#: Words of one suffix array, and bytes of benchmark text sent to all tasks at once.
SHARD_WORDS, BLOCK_BYTES = 1 << 21, 32 << 20
#: Bytes of words in lower case; all others become spaces.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
MATCH = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


def item_words(text: str | None) -> list[bytes]:
    return utf8(text or "").translate(LOWER).split()


def packed(ids: np.ndarray, bits: int, per: int) -> np.ndarray:
    """``per`` words from each place in one number, the first in the highest bits."""
    n = len(ids)
    wide = np.concatenate([ids, np.zeros(per, ids.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(per):
        key = key << np.uint64(bits) | wide[i : i + n]
    return key


def suffix_array(key: np.ndarray, starts: np.ndarray, per: int, depth: int) -> np.ndarray:
    """``starts`` in the order of their first ``depth`` words at least, ``per`` words a round; only suffixes still tied are sorted again."""
    order = starts[np.argsort(key[starts], kind="stable")]
    new = runs(key[order])
    for done in range(per, depth, per):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        p, group = order[tied], np.cumsum(new)[tied]
        after = key[p + done]
        by = np.lexsort((after, group))
        order[tied] = p[by]
        new[tied] = runs(group) | runs(after[by])
    return order


def bisect(key: np.ndarray, order: np.ndarray, off: int, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """First place in [lo, hi) of each query whose words at ``off`` are at least (``right``: above) ``value``."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        k = key[order[mid] + off]
        up = k <= value[live] if right else k < value[live]
        lo[live] = np.where(up, mid + 1, lo[live])
        hi[live] = np.where(up, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


@dataclass
class Shard:
    """Numbered words of whole documents, each followed by a 0, and their suffix array."""

    ids: np.ndarray
    key: np.ndarray
    order: np.ndarray
    bits: int
    per: int

    @classmethod
    def of(cls, ids: np.ndarray, items: Items) -> Shard:
        bits, per = items.bits, items.per
        # known words ahead of each place
        gap = np.flatnonzero(ids == 0)
        ahead = np.append(gap, len(ids))[np.searchsorted(gap, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else gap
        starts = np.flatnonzero(ahead >= items.shortest)
        ids = np.append(ids, np.zeros(items.depth + per, ids.dtype))
        key = packed(ids, bits, per)
        return cls(ids, key, suffix_array(key, starts, per, int(items.size.max(initial=0))), bits, per)

    def intervals(self, windows: np.ndarray, size: np.ndarray, tkey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in suffix order of the suffixes that start with the ``size`` words at each test place."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order))
        for off in range(0, int(size.max(initial=0)), self.per):
            live = np.flatnonzero((size > off) & (lo < hi))
            if not len(live):
                break
            rest = np.maximum(self.per - (size[live] - off), 0) * self.bits
            mask = (np.uint64(1) << rest.astype(np.uint64)) - np.uint64(1)
            want = tkey[windows[live] + off]
            a, b = lo[live], hi[live]
            lo[live] = bisect(self.key, self.order, off, a, b, want & ~mask, False)
            hi[live] = bisect(self.key, self.order, off, lo[live], b, want | mask, True)
        return lo, np.maximum(lo, hi)


class Items:
    """Benchmark rows (item id, text): numbered words, test suffixes, distinct windows and where each stands."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        self.vocab = Ids()
        self.vocab[b" "] = 0  # no word
        self.names = [x or "" for x, _ in rows]
        parts, self.item, self.offset = [], [], []
        windows: dict[bytes, list[int]] = defaultdict(list)
        at = 0
        self.depth = 1
        for i, (_, text) in enumerate(rows):
            ids = np.array([*map(self.vocab.__getitem__, item_words(text)), 0], np.int32)
            n = len(ids) - 1
            for s in range(max(n - window + 1, min(n, 1))):
                windows[ids[s : min(s + window, n)].tobytes()].append(at + s)
            parts.append(ids)
            self.item.append(np.full(n + 1, i))
            self.offset.append(np.arange(n + 1))
            at += n + 1
            self.depth = max(self.depth, n)
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
        self.ids, self.item, self.offset = join(parts, np.int32), join(self.item, np.int64), join(self.offset, np.int64)
        self.bits = max(1, (len(self.vocab) - 1).bit_length())
        self.per = max(1, 63 // self.bits)
        self.ids = np.append(self.ids, np.zeros(self.depth + self.per, np.int32))
        self.key = packed(self.ids, self.bits, self.per)
        self.size = np.array([len(w) // 4 for w in windows], np.int64)
        self.shortest = int(self.size.min(initial=window))
        self.first = np.array([x[0] for x in windows.values()], np.int64)
        self.count = np.array([len(x) for x in windows.values()], np.int64)
        self.places = join(list(windows.values()), np.int64)
        self.vocab = dict(self.vocab)

    def numbered(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, found, repeat(0)), np.int32, len(found))

    def matches(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(document, its word, test place, words) of the longest matches in numbered documents, by document and word."""
        size = np.array([len(x) + 1 for x in docs], np.int64)
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        body = np.ones(len(flat), bool)
        body[begin + size - 1] = False
        if docs:
            flat[body] = np.concatenate(docs)
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not len(self.size) or not len(flat):
            return none
        shard = Shard.of(flat, self)
        lo, hi = shard.intervals(self.first, self.size, self.key)
        hits = hi - lo
        if not hits.any():
            return none
        # each location with each place of its window
        at = shard.order[expand(lo, hits)]
        of = np.repeat(np.arange(len(hits)), hits)
        begin_place = np.cumsum(self.count) - self.count
        place = self.places[expand(begin_place[of], self.count[of])]
        at, words = np.repeat(at, self.count[of]), np.repeat(self.size[of], self.count[of])
        # only the left end of a match; matches of whole short items have no left
        left = (at > 0) & (self.offset[place] > 0)
        left &= (shard.ids[at - 1] == self.ids[place - 1]) & (shard.ids[at - 1] > 0)
        at, place, words = at[~left], place[~left], words[~left]
        live = np.arange(len(at))
        while len(live):
            more = (shard.ids[at[live] + words[live]] == self.ids[place[live] + words[live]]) & (self.ids[place[live] + words[live]] > 0)
            live = live[more]
            words[live] += 1
        doc = np.searchsorted(begin, at, side="right") - 1
        by = np.lexsort((place, at))
        return doc[by], (at - begin[doc])[by], place[by], words[by]


def keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h1, h2): rows of equal id and text share their hashes, and their matches."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.md5(text.cast("binary"))
    half = lambda a: F.conv(F.substring(whole, a, 15), 16, 10).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), half(1).alias("h1"), half(16).alias("h2"))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks that hold about ``block_bytes`` of text each, one at a time on the driver."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    blocks = -(-size // block_bytes)
    for i in range(max(1, blocks)):
        part = rows if blocks <= 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        yield [(r.item, r.text) for r in part.orderBy("item", "text").collect()]


def searched(docs: DataFrame, rows: list[tuple], window: int, only_hits: bool, shard_words: int) -> DataFrame:
    """(doc_id, h1, h2, n_words, matches) for ``keys`` rows against one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(Items(rows, window))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        held: list[pa.RecordBatch] = []
        numbered: list[np.ndarray] = []
        words = 0

        def done() -> pa.RecordBatch:
            doc, at, place, n = items.matches(numbered)
            table = pa.Table.from_batches(held).combine_chunks()
            edge = np.searchsorted(doc, np.arange(len(numbered) + 1)).astype(np.int32)
            names = np.array(items.names, object)[items.item[place]] if len(place) else []
            fields = [pa.array(names, pa.string()), pa.array(at), pa.array(items.offset[place]), pa.array(n)]
            found = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(fields, fields=list(MATCH_TYPE.value_type)))
            cols = [table[c].combine_chunks() for c in ("doc_id", "h1", "h2")]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            cols += [pa.array([len(x) for x in numbered], pa.int64()), found.cast(MATCH_TYPE)]
            out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "h1", "h2", "n_words", "matches"])
            return out.filter(pa.array(np.diff(edge) > 0)) if only_hits else out

        for batch in batches:
            if not batch.num_rows:
                continue
            for text in texts(batch.column("text")):
                numbered.append(items.numbered(item_words(text)))
                words += len(numbered[-1])
            held.append(batch.select(["doc_id", "h1", "h2"]))
            if words >= shard_words:
                yield done()
                held, numbered, words = [], [], 0
        if held:
            yield done()

    return docs.mapInArrow(each, f"doc_id long, h1 long, h2 long, n_words long, matches {MATCH}")


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", only_hits: bool = False, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, h1, h2, n_words, matches) of every row, or of rows with matches only.

    A match is (item_id, doc_word, item_word, n_words): a longest run of equal words, at least ``window`` long, or the whole item
    where that is shorter. Null and empty texts have no words, and an item without words matches nothing. A null item id is an
    empty string. Repeated rows each get their matches. Other columns are ignored.
    """
    wide = keys(docs, id_col, text_col)
    blocks = item_blocks(benchmark, item_col, item_text, block_bytes)
    parts = [searched(wide, rows, window, only_hits or i > 0, shard_words) for i, rows in enumerate(blocks)]
    if len(parts) == 1:
        return parts[0]
    same = ["doc_id", "h1", "h2"]
    # equal rows have equal matches: one of each pass is enough
    found = reduce(DataFrame.unionByName, [p.groupBy(*same, F.lit(i).alias("pass")).agg(F.first("n_words").alias("n_words"), F.first("matches").alias("matches")) for i, p in enumerate(parts)])
    whole = found.groupBy(*same).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    if only_hits:
        return whole.where(F.size("matches") > 0)
    key = [wide[c].eqNullSafe(F.col(f"m.{c}")) for c in same]
    return wide.join(whole.alias("m"), key, "left").select(*[wide[c] for c in same], "m.n_words", "m.matches")


def covered_words(found: Column) -> Column:
    """Words inside any match: the union of the spans, read from left to right."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m.doc_word.alias("a"), (m.doc_word + m.n_words).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct(
        (s.n + F.greatest(x.b - F.greatest(x.a, s.end), F.lit(0))).alias("n"), F.greatest(s.end, x.b).alias("end")
    )
    return F.aggregate(spans, start, step).n


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """n_words, n_hit, items (sorted ids of items with a window in the text) and longest (words of the longest match) of every row.

    Options as for ``matches``; a repeated item id counts once.
    """
    found = matches(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item_id)))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m.n_words)), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", covered_words(F.col("matches")).alias("n_hit"), items.alias("items"), longest.alias("longest"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts hold no window of any item."""
    bad = matches(docs, benchmark, id_col=id_col, text_col=text_col, only_hits=True, **options).select("doc_id", "h1", "h2").distinct()
    marks = ("decontamination_a", "decontamination_b")
    hashes = dict(zip(marks, ("h1", "h2"), strict=True))
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    marked = docs.withColumns({m: F.conv(F.substring(text, a, 15), 16, 10).cast("long") for m, a in zip(marks, (1, 16), strict=True)})
    bad = bad.select(F.col("doc_id").alias("decontamination_id"), *[F.col(h).alias(f"{m}_bad") for m, h in hashes.items()])
    on = [marked[id_col].cast("long").eqNullSafe(bad.decontamination_id), *[marked[m] == bad[f"{m}_bad"] for m in marks]]
    return marked.join(bad, on, "left_anti").drop(*marks)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), test AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda s : array_to_string(w[s : s + 9], ' '))) AS win
  FROM item WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM test),
place AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc, sizes WHERE len(w) >= n)
), hit AS (
  SELECT p.r, p.s, p.n, t.item FROM place p JOIN test t ON t.win = p.win AND t.n = p.n
), covered AS (
  SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS i FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
), word AS (
  SELECT r, d.w, i.item, i.w AS v FROM (SELECT DISTINCT r, item FROM hit) h JOIN doc d USING (r) JOIN item i ON i.item = h.item
), same AS (
  SELECT r, item, a - b AS diagonal, a FROM (
    SELECT r, item, a, unnest(list_filter(generate_series(1, len(v)), lambda k : v[k] = x)) AS b
    FROM (SELECT r, item, v, unnest(generate_series(1, len(w))) AS a, unnest(w) AS x FROM word)
  )
), longest AS (
  SELECT r, max(n) AS longest FROM (
    SELECT r, count(*) AS n FROM (SELECT *, a - row_number() OVER (PARTITION BY r, item, diagonal ORDER BY a) AS g FROM (SELECT DISTINCT * FROM same))
    GROUP BY r, item, diagonal, g
  ) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, coalesce(longest, 0) AS longest
FROM doc LEFT JOIN covered USING (r) LEFT JOIN names USING (r) LEFT JOIN longest USING (r)
"""
