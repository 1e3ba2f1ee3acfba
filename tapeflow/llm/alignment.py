"""Alignment of two tokenizers with an identity-map fast path (operator 13).

Both tokenizers end a token wherever white space follows another letter, so a text is cut there and a piece of text has the same
tokens in every document. Each worker keeps the groups of pieces it has seen. A group of one token each has equal bytes on both
sides, and an array made from the vocabularies maps an A id to the B id of the same bytes: such groups are counted in vectors
as long as the vocabulary. Only the other groups are counted as pairs, once for each block of documents, in a shuffle.

Documents are encoded once and written as one row for each block: what the digest needs of each document, and its links as
numbers into the distinct pairs of the block. A block gets the counts of its distinct pairs back, so no pair is sent for each
document. Pairs found in very many blocks are bounded in number by how they are chosen, and their counts are broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Ids, expand, narrow, runs, texts, utf8
from tapeflow.session import staged

DEFAULT_A, DEFAULT_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: White space as the pattern of tokenizer A knows it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Pieces remembered in each of two generations, the longest one remembered, and letters encoded together.
TABLE_ROWS, TABLE_CHARS, JOINED_CHARS = 120_000, 32, 50_000
#: Documents and bytes of one block; a longer document is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 200, 250_000
#: Pairs whose counts are broadcast, at most; 24 bytes each.
HOT_PAIRS = 100_000
B_BITS = 32
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two tokenizers: ids and bytes of their tokens.

    A is a byte-level BPE file of the tokenizers library. Its merges are run by rank where that is proven to give the same
    tokens: if every vocabulary string alone becomes one token by the merges, two neighbours that join to a vocabulary string
    are always the two that its merge names. B is a sentencepiece BPE file with byte fallback and a dummy prefix.
    """

    def __init__(self, a: str, b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(a)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        used = [not (self.b.is_control(i) or self.b.is_unknown(i)) for i in range(n)]
        self.b_bytes = [
            b"" if not u else bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else utf8(t.replace(MARK, " ")) for i, (t, u) in enumerate(zip(names, used, strict=True))
        ]
        real = [t for i, t in enumerate(names) if used[i] and not self.b.is_byte(i)]
        if any(MARK in t.lstrip(MARK) for t in real) or self.b.encode("a", out_type=str) != [MARK + "a"]:
            raise ValueError("a piece has a word start inside; texts can't be cut at word starts")
        #: pieces of text: white space and what follows, up to the next white space that no B piece joins to the letter before it
        glued = "".join(c for c in SPACE if c != " " and any(re.search(f"[^{SPACE}{MARK}]{c}|{MARK}{c}", t) for t in real))
        body, rest = f"[{SPACE}]*[^{SPACE}]+", f"[{glued}][{SPACE}]*"
        self.cut = re.compile(f"{body}(?:{rest}[^{SPACE}]+)*(?:{rest}\\Z)?|[{SPACE}]+" if glued else f"{body}|[{SPACE}]+")
        if self.library.encode(" a b", add_special_tokens=False).tokens != ["Ġa", "Ġb"]:
            raise ValueError("this tokenizer is not byte-level, or puts a space before a text")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # A id to the B id of the same bytes: the piece where there is one, else the byte
        by_bytes = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if x and self.b.is_byte(i)}
        by_bytes |= {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if x and not self.b.is_byte(i)}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.ranks = None
        with open(a, encoding="utf-8") as f:
            parts = json.load(f)
        level = parts["pre_tokenizer"]
        alone = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and level.get("use_regex", True) and not parts.get("normalizer")
        if alone and not parts["model"].get("ignore_merges") and all(len(self.library.model.tokenize(t)) == 1 for t in vocab):
            self.ranks = self.by_rank(vocab)
            self.library = None  # no longer needed

    def by_rank(self, vocab: dict[str, int]):
        import tiktoken

        ranks = {self.a_bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("by rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.library.encode(text, add_special_tokens=False).ids

    def encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces as they stand inside a text, and how many each has."""
        plain = [x[0] == " " for x in pieces]
        ids = self.b.encode([x[1:] if p else x for x, p in zip(pieces, plain, strict=True)], num_threads=1)
        mark = self.b.piece_to_id(MARK)
        for i in (i for i, p in enumerate(plain) if not p or not ids[i]):
            if not plain[i]:
                if ids[i][:1] != [mark]:
                    raise ValueError("a piece of text that starts with other white space joins the mark put before it")
                ids[i] = ids[i][1:]  # before other white space no mark stands in a text
            else:
                ids[i] = [mark]  # a space alone
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def same_bytes(self, raw: list[bytes], b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of which pieces the B tokens give the bytes."""
        made = list(map(self.b_bytes.__getitem__, b.tolist()))
        good = np.ones(len(raw), bool)
        if b"".join(made) != b"".join(raw):
            stop = np.cumsum(n).tolist()
            good[:] = [x == b"".join(made[j - k : j]) for x, j, k in zip(raw, stop, n.tolist(), strict=True)]
        return good


#: What is kept of a piece: A tokens (-1 if its bytes differ), B tokens, groups, their text, A ids of identity links, other links.
Row = tuple[int, int, int, str, bytes, bytes]


class Pieces:
    """Groups of pieces of text; two generations, of which the older goes when the newer is full."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.young: dict[str, Row] = {}
        self.old: dict[str, Row] = {}

    def rows(self, found: list[str]) -> list[Row]:
        """A row for each of some distinct pieces."""
        out = list(map(self.young.get, found))
        miss = []
        for i in [i for i, r in enumerate(out) if r is None]:
            x = found[i]
            out[i] = hit = self.old.get(x)
            if hit is None:
                miss.append(i)
            else:
                self.young[x] = hit
        # a piece of white space only, as at the end of a text, would run into the next one
        for some in ([i for i in miss if not found[i][-1].isspace()], *([i] for i in miss if found[i][-1].isspace())):
            at = 0
            while at < len(some):
                end, chars = at, 0
                while end < len(some) and chars < JOINED_CHARS:
                    chars += len(found[some[end]])
                    end += 1
                new = self.fresh([found[i] for i in some[at:end]])
                for i, r in zip(some[at:end], new, strict=True):
                    out[i] = r
                    if len(found[i]) <= TABLE_CHARS:
                        self.young[found[i]] = r
                at = end
        if len(self.young) > TABLE_ROWS:
            self.old, self.young = self.young, {}
        return out

    def fresh(self, pieces: list[str]) -> list[Row]:
        p = self.pair
        raw = list(map(utf8, pieces))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        a = np.array(p.encode_a("".join(pieces)), np.int64)
        if b"".join(map(p.a_bytes.__getitem__, a.tolist())) != b"".join(raw):
            raise ValueError("tokenizer A does not keep all bytes")
        a_end = np.cumsum(p.a_len[a])
        b, per = p.encode_b(pieces)
        good = p.same_bytes(raw, b, per)
        # tokens of both on one line of bytes; where a piece's B bytes differ, its B tokens are left out
        b, per = b[np.repeat(good, per)], np.where(good, per, 0)
        b_size = np.where(good, size, 0)
        b_end = np.cumsum(p.b_len[b]) + np.repeat(stop - size - (np.cumsum(b_size) - b_size), per)
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        ai, bi = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        a_from, b_from = np.append(0, ai + 1)[:-1], np.append(0, bi + 1)[:-1]
        # a bad piece has no common end inside; the next good one starts anew
        owner = np.searchsorted(stop, both)
        first = runs(owner)
        a_piece, b_piece = np.append(0, np.searchsorted(a_end, stop, side="right")), np.append(0, np.cumsum(per))
        a_from[first], b_from[first] = a_piece[owner[first]], b_piece[owner[first]]
        la, lb = a[ai], b[bi]
        ident = (ai == a_from) & (bi == b_from) & (p.same[la] == lb)
        links = la << B_BITS | lb
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spelled = [
            f"{a_text[j]}|{b_text[m]}" if i == j and k == m else ",".join(a_text[i : j + 1]) + "|" + ",".join(b_text[k : m + 1])
            for i, j, k, m in zip(a_from.tolist(), ai.tolist(), b_from.tolist(), bi.tolist(), strict=True)
        ]
        edge = np.searchsorted(owner, np.arange(len(pieces) + 1))
        ones, others = np.append(0, np.cumsum(ident))[edge] * 4, np.append(0, np.cumsum(~ident))[edge] * 8
        one, other = la[ident].astype("<u4").tobytes(), links[~ident].tobytes()
        n_a = np.where(good, np.diff(a_piece), -1).tolist()
        e, o, q = edge.tolist(), ones.tolist(), others.tolist()
        return [
            (n, m, e[i + 1] - e[i], ";".join(spelled[e[i] : e[i + 1]]), one[o[i] : o[i + 1]], other[q[i] : q[i + 1]])
            for i, (n, m) in enumerate(zip(n_a, per.tolist(), strict=True))
        ]


@lru_cache(2)
def pieces_of(a: str, b: str) -> Pieces:
    return Pieces(Pair(a, b))


def file_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) cut into blocks."""
    for batch in batches:
        at = 0
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[at : at + BLOCK_ROWS]), BLOCK_BYTES, side="right"))
            yield batch.slice(at, max(1, fits))
            at += max(1, fits)


COUNTED = "block long, ids binary, facts binary, shas binary, edges binary, one binary, pairs binary, which binary"


def encoded(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents.

    ids: Arrow stream of the ids; facts: A tokens, B tokens, groups of each; shas: length and hash of each; edges: identity links
    and others of each; one: A ids of the identity links; pairs: distinct other links; which: the other links as places in them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(a or file_path(DEFAULT_A), b or file_path(DEFAULT_B))
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            cut, place = table.pair.cut, Ids()
            at = [np.fromiter(map(place.__getitem__, cut.findall(" " + t)), np.int32) if t else np.zeros(0, np.int32) for t in texts(batch.column(1))]
            n_a, n_b, n_groups, spelled, one_raw, other_raw = zip(*table.rows(list(place)), strict=True) if place else [()] * 6
            count = np.fromiter(map(len, at), np.int64, len(at))
            flat = np.concatenate(at).astype(np.int64)
            stop = np.cumsum(count)
            total = lambda x: np.diff(np.append(0, np.cumsum(np.array(x, np.int64)[flat]))[np.append(0, stop)])
            bad = total([n < 0 for n in n_a]) > 0
            facts = np.stack([total(n_a), total(n_b), total(n_groups)], 1)
            facts[bad] = 0
            shas = [hashlib.sha256(";".join(map(spelled.__getitem__, x.tolist())).encode()).digest() if len(x) and not b else b"" for x, b in zip(at, bad.tolist(), strict=True)]
            kept, edges, parts = flat[~np.repeat(bad, count)], np.zeros((len(at), 2), np.int64), []
            for i, (raw, kind) in enumerate(((one_raw, "<u4"), (other_raw, "<i8"))):
                size = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(kind).itemsize
                edges[:, i] = np.where(bad, 0, total(size))
                parts.append(np.frombuffer(b"".join(raw), kind)[expand((np.cumsum(size) - size)[kept], size[kept])])
            one, links = parts
            pairs, which = np.unique(links, return_inverse=True)
            ids = batch.column(0)
            packed_ids = pa.Table.from_arrays([ids], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packed_ids.schema) as writer:
                writer.write_table(packed_ids)
            sha = b"".join(bytes([len(x)]) + x.ljust(32, b"\0") for x in shas)
            parts = [sink.getvalue().to_pybytes(), facts.tobytes(), sha, edges.tobytes(), one.astype("<u4").tobytes(), pairs.tobytes(), which.astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x], pa.binary()) for x in parts]], names=[c.split()[0] for c in COUNTED.split(", ")])
            number += 1

    return narrow(docs, id_col, text_col).mapInArrow(each, COUNTED)


def identity_counts(blocks: DataFrame) -> DataFrame:
    """(a, n): identity links of each A id, added up in one vector for each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.bincount(np.frombuffer(raw, "<u4"))
                if len(n) > len(total):
                    n, total = total, n.astype(np.int64)
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])

    return blocks.select("one").mapInArrow(each, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): distinct links of each block that are no identity links."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, which in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = np.frombuffer(pairs, np.int64)
                n = np.bincount(np.frombuffer(which, "<u4"), minlength=len(pairs))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(pairs), pa.int64()), pa.array(pairs), pa.array(n.astype(np.int64))], names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "which").mapInArrow(each, "block long, pair long, n long")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the digest of every row, and (a_id, b_id, n) of all linked id pairs.

    Null and empty texts, and texts whose tokens do not give the bytes of a space and the text (as those with U+2581), have no
    tokens: zeros and an empty hash. Repeated rows and null ids stay as rows and all count. Other columns are ignored. The files have to
    be at the same place on all workers; without them the installed public vocabularies are found on each worker.
    """
    pair = Pair(a or file_path(DEFAULT_A), b or file_path(DEFAULT_B))
    blocks = staged(encoded(docs, a, b, id_col, text_col))
    spark = blocks.sparkSession
    ones = identity_counts(blocks).toPandas()  # a vector as long as the vocabulary
    by_a = np.zeros(len(pair.same), np.int64)
    by_a[ones["a"].to_numpy(np.int64)] = ones["n"].to_numpy(np.int64)
    found = staged(block_pairs(blocks))
    counts = staged(found.groupBy("pair").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")))
    # the highest count of each B id, a vector as long as the vocabulary too
    best = np.zeros(len(pair.b_len), np.int64)
    np.maximum.at(best, pair.same[pair.same >= 0], by_a[pair.same >= 0])
    top = counts.groupBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")).agg(F.max("n").alias("n")).toPandas()
    at = top["b"].to_numpy(np.int64)
    best[at] = np.maximum(best[at], top["n"].to_numpy(np.int64))
    # pairs in more blocks than this number are fewer than hot_pairs, as their blocks add up to no more than all
    rows = counts.agg(F.sum("blocks").alias("n")).first().n or 0
    many = max(1, rows // hot_pairs)
    hot = F.broadcast(counts.where(F.col("blocks") > many).select("pair", F.col("n").alias("total")))
    rare = counts.where(F.col("blocks") <= many).select("pair", F.col("n").alias("total"))
    slim = found.select("block", "pair")
    told = slim.join(hot, "pair").unionByName(slim.join(hot, "pair", "left_anti").join(rare, "pair"))
    per_block = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "total"))).alias("told"))  # bounded by a block
    sent = spark.sparkContext.broadcast((by_a, best, pair.same))
    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_a, best, same = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, facts, shas, edges, one, pairs, which, total = (batch.column(i)[r] for i in range(8))
                ids = pa.ipc.open_stream(ids.as_py()).read_all()["doc_id"].combine_chunks()
                facts = np.frombuffer(facts.as_py(), np.int64).reshape(-1, 3)
                edges = np.frombuffer(edges.as_py(), np.int64).reshape(-1, 2)
                one = np.frombuffer(one.as_py(), "<u4").astype(np.int64)
                pairs, which = np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(which.as_py(), "<u4")
                total = total.values.to_numpy() if total.is_valid else np.zeros(0, np.int64)
                hit = [by_a[one], total[which]]
                top = [hit[0] == best[same[one]], (total == best[pairs & ((1 << B_BITS) - 1)])[which]]
                sums, bests = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
                for i in range(2):
                    stop = np.cumsum(edges[:, i])
                    for out, x in ((sums, hit[i]), (bests, top[i])):
                        run = np.append(0, np.cumsum(x.astype(np.int64)))
                        out += run[stop] - run[stop - edges[:, i]]
                raw = shas.as_py()
                sha = [raw[i * 33 + 1 : i * 33 + 1 + raw[i * 33]].hex() for i in range(len(edges))]
                cols = [ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, *[pa.array(facts[:, i]) for i in range(3)], pa.array(edges.sum(1)), pa.array(bests), pa.array(sums), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in names.split(", ")])

    fields = ["ids", "facts", "shas", "edges", "one", "pairs", "which"]
    whole = blocks.join(per_block, "block", "left").select(*fields, F.transform("told", lambda x: x.total).alias("told"))
    documents = whole.mapInArrow(each, names)
    ident = spark.createDataFrame([(int(i), int(pair.same[i]), int(by_a[i])) for i in np.flatnonzero(by_a)], "a_id long, b_id long, n long")
    others = counts.select(F.shiftrightunsigned("pair", B_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id"), "n")
    return documents, ident.unionByName(others)


def digest(docs: DataFrame) -> DataFrame:
    return aligned(docs)[0]
