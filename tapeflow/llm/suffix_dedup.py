"""Removal of repeated byte strings with longest-previous-factor arrays over sharded suffixes (operator 2).

A string of ``length`` bytes is removed where it also starts earlier. Every such string picks an anchor by its own bytes (the
smallest hash among its 32-byte grams), so equal strings pick equal anchors wherever they stand. Starts that share an anchor lie
side by side and form a context, a stretch of fewer than two lengths.

* Documents are dealt into blocks. Each block tells the anchor's shard the hashes of its distinct contexts. A context that an
  earlier document has too is settled at once, and so is an anchor that has one context only: that leaves the ends of repeats.
* Contexts of anchors with several go to the anchor's shard as bytes. The shard sorts their suffixes by their first ``length``
  bytes. A suffix has a longest previous factor of at least ``length`` where the previous or next smaller position in suffix
  order shares its rank; those starts are repeats.
* An anchor with more than ``HOT`` contexts would make a large shard. Its starts are dealt by the hash of the whole string
  instead, one record for each distinct string of a block.

All groups are bounded by a block, or by the number of blocks. Texts are shuffled once; that exchange serves all three passes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import block_of, expand, parts_for, prepare, runs, spans_to_mask, utf8
from tapeflow.llm.line_dedup import NO_ID, mixed_bits

#: Contexts of one anchor: more than IN_BLOCK in a block, or HOT in all, and its strings are dealt singly.
IN_BLOCK, HOT = 4, 1000
#: Starts looked at together.
CHUNK = 1 << 20
PLACE_BITS = 30
SOLE, REPEATED, SEVERAL, SINGLY = range(4)
SEEN = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<u4")])
HEAD = np.dtype([("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
SINGLE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<u4")])
MANY = np.uint32(0xFFFFFFFF)
LETTERS = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Grams:
    """Hashes of all grams of some bytes, by doubling."""

    def __init__(self, data: np.ndarray):
        self.powers = {1: LETTERS[data]}

    def power(self, size: int) -> np.ndarray:
        if size not in self.powers:
            half = self.power(size // 2)
            self.powers[size] = self.join(half, half[size // 2 :], size)
        return self.powers[size]

    @staticmethod
    def join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        n = max(0, min(len(a), len(b)))
        out = a[:n] * np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
        out += b[:n]
        out ^= out >> np.uint64(29)
        return out

    def whole(self, length: int) -> np.ndarray:
        """Hash of the gram of any length at each place."""
        out, done = None, 0
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                part = self.power(1 << bit)[done:]
                out = part if out is None else self.join(out, part, length + bit)
                done += 1 << bit
        return out


@dataclass
class Block:
    """Documents of a block end to end, in order of id, and their contexts."""

    order: np.ndarray
    ids: np.ndarray
    data: np.ndarray
    stops: np.ndarray
    length: int

    @classmethod
    def of(cls, table: pa.Table, length: int) -> Block:
        raw = [utf8(x or "") for x in table["text"].to_pylist()]
        ids = [NO_ID if x is None else x for x in table["id"].to_pylist()]
        order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
        data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        if len(data) >= 2**32:
            raise OverflowError(f"a block of {len(data)} bytes: places have four bytes, so its documents need more blocks")
        stops = np.cumsum([len(raw[i]) for i in order], dtype=np.int64)
        return cls(np.array(order), np.array([ids[i] for i in order], np.int64), data, stops, length)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.stops, at, side="right")]

    def chunks(self):
        """(first start, starts, grams, which starts lie in one document) of each stretch."""
        begins = np.concatenate([[0], self.stops[:-1]])
        last = np.maximum(self.stops - self.length + 1, begins)  # after the last start of each document
        for at in range(0, len(self.data), CHUNK):
            n = min(CHUNK, len(self.data) - at)
            a, b = np.searchsorted(self.stops, at, side="right"), np.searchsorted(begins, at + n, side="left")
            lo, hi = np.clip(begins[a:b] - at, 0, n), np.clip(last[a:b] - at, 0, n)
            inside = spans_to_mask(lo, np.maximum(lo, hi), n)
            yield at, n, Grams(self.data[at : at + n + self.length - 1]), inside

    def contexts(self) -> tuple[np.ndarray, ...]:
        """first start, starts, anchor's place in it, hash of the anchor, hash of the context."""
        gram = 1 << ((self.length // 3).bit_length() - 1)
        span = self.length - gram + 1
        found = []
        for at, n, grams, inside in self.chunks():
            h = grams.power(gram)
            m = max(0, min(n, len(h) - span + 1))
            if not m or not inside[:m].any():
                continue
            low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
            step = 1
            while 2 * step <= span:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[:m], low[span - step : span - step + m])
            anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            inside = inside[:m]
            first = inside.copy()
            first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
            start = np.flatnonzero(first)
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            stop = np.flatnonzero(last)
            a = anchor[start]
            whole = grams.whole(self.length)
            shape = ((stop - start + 1) << 20 | (a - start)).astype(np.uint64)
            context = mixed_bits(whole[start] * np.uint64(0xD6E8FEB86659FD93) + whole[stop] + shape * np.uint64(0xA0761D6478BD642F), 3)
            found.append((start + at, stop - start + 1, a - start, h[a], context))
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def distinct(self, in_block: int = IN_BLOCK) -> Distinct:
        start, n, _, anchor, context = self.contexts()
        order = np.lexsort((start, context, anchor))
        start, n, anchor, context = start[order], n[order], anchor[order], context[order]
        new_anchor = runs(anchor)
        first = new_anchor | runs(context)
        kinds = np.add.reduceat(first, np.flatnonzero(new_anchor)) if len(first) else np.zeros(0, np.int64)
        many = (kinds > in_block)[np.cumsum(new_anchor) - 1][first] if len(first) else np.zeros(0, bool)
        later = ~first
        return Distinct(start[first], n[first], anchor[first], context[first], many, expand(start[later], n[later]))

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the whole strings at ascending starts."""
        out = np.zeros(len(starts), np.uint64)
        for at, n, grams, _ in self.chunks():
            a, b = np.searchsorted(starts, [at, at + n])
            if a < b:
                out[a:b] = grams.whole(self.length)[starts[a:b] - at]
        return out


@dataclass
class Distinct:
    """Distinct contexts of a block by anchor and hash, their first places, and the starts of their later copies."""

    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    many: np.ndarray
    copies: np.ndarray

    def sent(self, block: Block, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What goes to the shards in order: shard, entry, and for each context the entry that stands for it."""
        head = ~self.many | runs(self.anchor)
        stands = np.cumsum(head) - 1
        seen = np.zeros(int(head.sum()), SEEN)
        at = self.start[head]
        seen["anchor"], seen["context"], seen["doc"], seen["at"] = self.anchor[head], self.context[head], block.doc_of(at), at
        seen["at"][self.many[head]] = MANY
        shard = (mixed_bits(seen["anchor"], 99) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return shard[order], seen[order], back[stands]


def by_shard(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending shard numbers."""
    at = np.flatnonzero(runs(shard))
    return list(zip(shard[at].tolist(), at.tolist(), np.append(at, len(shard))[1:].tolist(), strict=True))


def judged(sent: list[np.ndarray], hot: int = HOT) -> list[bytes]:
    """A code for each entry that blocks sent to a shard."""
    size = np.cumsum([0, *map(len, sent)])
    seen = np.concatenate(sent)
    order = np.lexsort((seen["at"], seen["doc"], seen["context"], seen["anchor"]))
    s = seen[order]
    new_anchor = runs(s["anchor"])
    many = s["at"] == MANY
    first = new_anchor | runs(s["context"]) | many
    heads = np.flatnonzero(new_anchor)
    kinds = np.add.reduceat(first.astype(np.int64), heads) + (hot + 1) * np.add.reduceat(many.astype(np.int64), heads)
    kinds = kinds[np.cumsum(new_anchor) - 1]
    code = np.where(~first, REPEATED, np.where(kinds == 1, SOLE, np.where(kinds <= hot, SEVERAL, SINGLY))).astype(np.uint8)
    out = np.empty(len(seen), np.uint8)
    out[order] = code
    return [out[a:b].tobytes() for a, b in zip(size[:-1], size[1:], strict=True)]


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the first ``length`` bytes of each suffix among all, by prefix doubling; beyond the end come zeros."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    n = len(data)
    key = np.zeros(n + length, np.uint64)
    size = min(8, length)
    for i in range(size):
        key = key << np.uint64(8) | padded[i : i + n + length]
    while True:
        order = np.argsort(key, kind="stable")
        new = runs(key[order])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        if size == length:
            return rank[:n]
        step = min(size, length - size)
        shifted = np.append(rank[step:], np.zeros(step, np.int64))
        key = rank.astype(np.uint64) * np.uint64(len(key) + 1) + shifted.astype(np.uint64)
        size += step


def has_previous_factor(rank: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which suffixes share their rank with an earlier position.

    In suffix order, with equal ranks ordered by position, the previous smaller position of a suffix stands right before it
    unless it is the first of its rank; there neither the previous nor the next smaller position has the rank.
    """
    order = np.lexsort((at, doc, rank))
    out = np.empty(len(rank), bool)
    out[order] = ~runs(rank[order])
    return out


def matched(heads: list[np.ndarray], raw: list[bytes], singles: list[np.ndarray], length: int) -> list[tuple[bytes, bytes]]:
    """Which starts of the contexts and which single strings of each block have an earlier match."""
    head = np.concatenate(heads)
    n = head["n"].astype(np.int64)
    begin = np.cumsum(n + length - 1) - (n + length - 1)
    starts = expand(begin, n)
    one = np.concatenate(singles)
    hit = np.zeros(0, bool)
    if len(starts):
        rank = prefix_ranks(np.frombuffer(b"".join(raw), np.uint8), length)[starts]
        hit = has_previous_factor(rank, np.repeat(head["doc"], n), np.repeat(head["at"].astype(np.int64), n) + starts - np.repeat(begin, n))
    late = has_previous_factor(one["hash"], one["doc"], one["at"])
    a = np.concatenate([[0], np.cumsum([int(h["n"].astype(np.int64).sum()) for h in heads])])
    b = np.concatenate([[0], np.cumsum([len(s) for s in singles])])
    return [(np.packbits(hit[a[i] : a[i + 1]]).tobytes(), np.packbits(late[b[i] : b[i + 1]]).tobytes()) for i in range(len(heads))]


@dataclass
class Unsettled:
    """Contexts and single strings that a block asks shards about, in the order sent."""

    contexts: np.ndarray  # places in Distinct
    context_shard: np.ndarray
    starts: np.ndarray  # of distinct single strings
    hashes: np.ndarray
    start_shard: np.ndarray
    copies: np.ndarray  # starts of single strings that the block has earlier

    @classmethod
    def of(cls, block: Block, d: Distinct, codes: np.ndarray, shards: int) -> Unsettled:
        several = np.flatnonzero(codes == SEVERAL)
        shard = (mixed_bits(d.anchor[several], 98) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        single = codes == SINGLY
        starts = np.sort(expand(d.start[single], d.n[single]))
        hashes = block.strings(starts)
        by = np.lexsort((starts, hashes))
        first = runs(hashes[by])
        copies, by = starts[by[~first]], by[first]
        to = (mixed_bits(hashes[by], 97) % np.uint64(shards)).astype(np.int64)
        by, to = by[np.argsort(to, kind="stable")], np.sort(to)
        return cls(several[order], shard[order], starts[by], hashes[by], to, copies)


def repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, in_block: int = IN_BLOCK, hot: int = HOT
) -> DataFrame:
    """The digest columns of every row, and with ``with_text`` also spans (removed, from and to in bytes) and kept (binary).

    Texts are UTF-8 bytes, a null one is empty. Texts below ``length`` stay whole. Order is by id; a missing id comes first,
    and rows of one id follow one another in byte order, so the second of two equal rows goes. Other columns are ignored. An anchor
    with more than ``in_block`` contexts in a block or ``hot`` in all has its strings dealt singly; the result is the same.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = parts_for(docs, text_col)
    blocks, shards = 2 * partitions, partitions
    dealt = docs.select(
        block_of(F.col(id_col), blocks).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    ).repartition(partitions, "block")

    def survey(table: pa.Table) -> pa.Table:
        block = Block.of(table, length)
        shard, seen, _ = block.distinct(in_block).sent(block, shards)
        parts = by_shard(shard)
        return pa.table(
            {
                "shard": pa.array([s for s, _, _ in parts], pa.int32()),
                "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int32()),
                "seen": pa.array([seen[a:b].tobytes() for _, a, b in parts], pa.binary()),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        codes = judged([np.frombuffer(x, SEEN) for x in table["seen"].to_pylist()], hot)
        return pa.table({"block": table["block"], "shard": table["shard"], "codes": pa.array(codes, pa.binary())})

    def codes_of(d: Distinct, block: Block, shard_column, code_column) -> np.ndarray:
        by = dict(zip(shard_column, code_column, strict=True))
        _, _, stands = d.sent(block, shards)
        return np.frombuffer(b"".join(by[s] for s in sorted(by)), np.uint8)[stands]

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows for shards; what shards said before goes along to the last pass under numbers below zero."""
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("shard", pa.int32()), ("block", pa.int32()), ("heads", pa.binary()), ("raw", pa.binary()), ("singles", pa.binary()))})
        number = table["block"][0].as_py()
        block = Block.of(table, length)
        d = block.distinct(in_block)
        codes = codes_of(d, block, answers["shard"].to_pylist(), answers["codes"].to_pylist())
        u = Unsettled.of(block, d, codes, shards)
        rows = {s: [b"", b"", b""] for s in {*u.context_shard.tolist(), *u.start_shard.tolist()}}
        for s, a, b in by_shard(u.context_shard):
            which = u.contexts[a:b]
            head = np.zeros(len(which), HEAD)
            head["doc"], head["at"], head["n"] = block.doc_of(d.start[which]), d.start[which], d.n[which]
            rows[s][0] = head.tobytes()
            rows[s][1] = block.data[expand(d.start[which], d.n[which] + length - 1)].tobytes()
        for s, a, b in by_shard(u.start_shard):
            one = np.zeros(b - a, SINGLE)
            one["hash"], one["doc"], one["at"] = u.hashes[a:b], block.doc_of(u.starts[a:b]), u.starts[a:b]
            rows[s][2] = one.tobytes()
        rows[-1 - number] = [codes.tobytes(), b"", b""]
        return pa.table(
            {
                "shard": pa.array(list(rows), pa.int32()),
                "block": pa.array([number] * len(rows), pa.int32()),
                **{n: pa.array([r[i] for r in rows.values()], pa.binary()) for i, n in enumerate(("heads", "raw", "singles"))},
            }
        )

    def match(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            found = [(x, b"") for x in table["heads"].to_pylist()]
        else:
            heads, raw, singles = (table[c].to_pylist() for c in ("heads", "raw", "singles"))
            found = matched([np.frombuffer(x, HEAD) for x in heads], raw, [np.frombuffer(x, SINGLE) for x in singles], length)
        return pa.table({"block": table["block"], "shard": table["shard"], "contexts": pa.array([x for x, _ in found], pa.binary()), "strings": pa.array([x for _, x in found], pa.binary())})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.of(table, length)
        d = block.distinct(in_block)
        said = {s: (a, b) for s, a, b in zip(*(answers[c].to_pylist() for c in ("shard", "contexts", "strings")), strict=True)}
        own = next((s for s in said if s < 0), None)
        codes = np.frombuffer(said[own][0], np.uint8) if own is not None else np.zeros(0, np.uint8)
        u = Unsettled.of(block, d, codes, shards)
        again = codes == REPEATED
        gone = [d.copies, expand(d.start[again], d.n[again]), u.copies]
        for s, a, b in by_shard(u.context_shard):
            starts = expand(d.start[u.contexts[a:b]], d.n[u.contexts[a:b]])
            gone.append(starts[np.unpackbits(np.frombuffer(said[s][0], np.uint8), count=len(starts)).astype(bool)])
        for s, a, b in by_shard(u.start_shard):
            gone.append(u.starts[a:b][np.unpackbits(np.frombuffer(said[s][1], np.uint8), count=b - a).astype(bool)])
        start = np.concatenate(gone)
        removed = spans_to_mask(start, start + length, len(block.data))
        begins = np.concatenate([[0], block.stops[:-1]])
        cols: dict[str, list] = {k: [] for k in "doc_id n_bytes n_removed n_spans kept_sha256 spans kept".split()}
        ids = table["id"].to_pylist()
        for i, (a, b) in enumerate(zip(begins.tolist(), block.stops.tolist(), strict=True)):
            mask = removed[a:b]
            edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept = block.data[a:b][~mask].tobytes() if len(lo) else block.data[a:b].tobytes()
            row = (ids[block.order[i]], b - a, int(mask.sum()), len(lo), hashlib.sha256(kept).hexdigest())
            for k, v in zip(cols, (*row, [{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], kept), strict=True):
                cols[k].append(v)
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in list(zip(cols.items(), types, strict=True))[: 7 if with_text else 5]})

    sent = dealt.groupBy("block").applyInArrow(survey, "shard int, block int, seen binary")
    codes = sent.groupBy("shard").applyInArrow(judge, "block int, shard int, codes binary")
    asked = dealt.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(ask, "shard int, block int, heads binary, raw binary, singles binary")
    said = asked.groupBy("shard").applyInArrow(match, "block int, shard int, contexts binary, strings binary")
    schema = DIGEST + (", spans array<struct<start:long,end:long>>, kept binary" if with_text else "")
    return dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(remove, schema)


def digest(docs: DataFrame) -> DataFrame:
    return repeats(docs, with_text=False)


SQL = r"""
WITH whole AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), byte AS (
  SELECT doc_id, unnest(generate_series(1, n)) AS i, h, n FROM whole
), found AS (
  SELECT doc_id, i, i + 99 <= n AND row_number() OVER (PARTITION BY CASE WHEN i + 99 <= n THEN substr(h, CAST(2 * i - 1 AS BIGINT), 200) ELSE doc_id || '-' || i END ORDER BY doc_id, i) > 1 AS again,
    substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS two
  FROM byte
), covered AS (
  SELECT doc_id, i, two, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM found
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered
), summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    sha256(unhex(coalesce(string_agg(two, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
  FROM edges GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM whole LEFT JOIN summed USING (doc_id)
"""
