"""Packing along a space-filling curve (operator 9).

Texts are tokenized once; a document's vector is the sum of hashed signs of its tokens in a few dimensions, and its place on a
Hilbert curve through that space is its key. Tokens and keys are written once to the shared folder. Range partitions of the
keys hold neighbouring documents, and each is cut as one stream into sequences, so only the end of a partition is short. That
rest is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import expand, narrow, prepare, texts, width, words
from tapeflow.session import staged

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END = 1
DIMS, BITS = 4, 12
#: Words remembered per worker, and their bytes.
TABLE_ROWS, TABLE_CHARS = 300_000, 16_000_000
#: Words merged and letters looked up at once.
STEP, STEP_CHARS = 20_000, 1_000_000
#: What the tokenizer's file has to name for merges by rank: its cut of words into parts, and the mark of a part's last letter.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LAST = "</w>"
#: Neither stands in a plain word.
STOP, GAP = "\x01", "\n"
#: Letters up to here, in lower case, have no other form after normalization.
PLAIN_TOP = 0x24F
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Merges:
    """Ids of plain words by merging ranks, with a stop behind each part in the place of the mark of its last letter.

    Equal to the library where tokens are numbered in the order of their merges and each is what its own letters merge to. Both
    are proven over the vocabulary; ``proven`` is false for another tokenizer.
    """

    def __init__(self, parts: dict):
        import tiktoken
        from tokenizers import models

        model, self.proven = parts["model"], False
        split = parts["pre_tokenizer"].get("pretokenizers", [{}])
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        letters = {c: i for i, c in enumerate(bytes_to_letters())}
        special = {t["content"] for t in parts["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or [x.get("type") for x in split] != ["Split", "ByteLevel"]
            or split[0]["pattern"] != {"Regex": PARTS}
            or split[1]["add_prefix_space"]
            or split[1]["use_regex"]
            or (model["end_of_word_suffix"], model["ignore_merges"], model["dropout"]) != (LAST, False, None)
            or any(x not in vocab or x + LAST not in vocab for x in letters)
            or any("<|" not in x for x in special)
        ):
            return
        made = [vocab[a + b] for a, b in merges]
        first = min(made, default=0)
        if any(x >= y for x, y in zip(made, made[1:])) or any(max(vocab[x], vocab[x + LAST]) >= first for x in letters):
            return
        whole = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=LAST)
        inner = {t: i for t, i in vocab.items() if not t.endswith(LAST)}
        open_end = models.BPE(vocab=inner, merges=[m for m in merges if m[0] + m[1] in inner])
        for t in vocab:
            alone = open_end.tokenize(t) if t in inner else whole.tokenize(t[: -len(LAST)])
            if len(alone) != 1:
                return
        # ranks: bytes, then bytes with the stop, then merges in their order
        named = {bytes([i]): vocab[c] for c, i in letters.items()} | {bytes([i]) + STOP.encode(): vocab[c + LAST] for c, i in letters.items()}
        for a, b in merges:
            raw = (a + b).removesuffix(LAST)
            named[bytes(letters[c] for c in raw) + (STOP.encode() if (a + b).endswith(LAST) else b"")] = vocab[a + b]
        self.id_of = np.fromiter(named.values(), np.uint32, len(named))
        self.gap = ord(GAP)
        ranks = {raw: i for i, raw in enumerate(named)}
        self.merge = tiktoken.Encoding("parts", pat_str=f"{GAP}|[^{GAP}{STOP}]+{STOP}", mergeable_ranks=ranks, special_tokens={})
        self.part = regex.compile(PARTS)
        self.proven = len(ranks) == 2 * len(letters) + len(merges)

    def odd(self, low: str, words: int) -> np.ndarray:
        """Which lines of a text in lower case are no plain words."""
        code = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        bad = ((code > PLAIN_TOP) | (KIND[np.minimum(code, PLAIN_TOP)] == 0)) & (code != ord(GAP))
        bad[:-1] |= (code[:-1] == ord("<")) & (code[1:] == ord("|"))  # how the special tokens start
        at = np.flatnonzero(bad)
        out = np.zeros(words, bool)
        if len(at):
            out[np.searchsorted(np.flatnonzero(code == ord(GAP)), at)] = True
        return out

    def stopped(self, text: str) -> str:
        """The text with a stop behind each part of its plain words."""
        if "'" in text:
            return self.part.sub(r"\g<0>" + STOP, text)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = KIND[code]
        ends = np.flatnonzero((kind > 0) & ((kind == DIGIT) | (kind != np.append(kind[1:], 0))))
        return np.insert(code, ends + 1, ord(STOP)).tobytes().decode("utf-32-le")

    def ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain lower-case words one after another, and how many each has."""
        quoted = np.fromiter(("'" in w for w in found), bool, len(found))
        order = np.argsort(quoted, kind="stable")
        text = ""
        for some in ([w for w in found if "'" not in w], [w for w in found if "'" in w]):
            if some:
                text += self.stopped(GAP.join(some)) + GAP
        rank = self.merge.encode_to_numpy(text, disallowed_special=())
        gap = rank == self.gap
        size = np.diff(np.flatnonzero(gap), prepend=-1) - 1
        ids = self.id_of[rank[~gap]]
        back = np.argsort(order, kind="stable")
        return ids[expand((np.cumsum(size) - size)[back], size[back])], size[back]


LETTER, DIGIT, SIGN = 1, 2, 3


def letter_kinds() -> np.ndarray:
    """Kind of each plain letter, 0 for white space and control letters."""
    out = np.zeros(PLAIN_TOP + 1, np.uint8)
    for code in (*range(0x21, 0x7F), *range(0xA1, PLAIN_TOP + 1)):
        out[code] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(code))[0], SIGN)
    return out


KIND = letter_kinds()


def bytes_to_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(i if i in prints else next(other)) for i in range(256)]


class WordTable(dict):
    """Numbers words between white space; such words encode alone as they do inside a text, as white space is dropped.

    When the table is full, words that came once since the last time are forgotten, and the rarer ones beyond half of the table.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if [self.encode([x])[0].ids for x in ("a B", "a", "b,")] != [[a, b] for a, b in [[self.tokenizer.token_to_id(y + LAST) for y in "ab"]]] + [
            [self.tokenizer.token_to_id(y + LAST) for y in z] for z in ("a", "b,")
        ]:
            raise ValueError("this tokenizer does not drop white space and case and cut at commas")
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        self.new: list[bytes] = []
        self.ids, self.chars = np.zeros(0, np.uint32), 0
        self.start, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def encode(self, found: list[str]):
        return self.tokenizer.encode_batch_fast(found, add_special_tokens=False)

    def forget(self) -> None:
        """Keep the words in use."""
        least = 2
        half = TABLE_ROWS // 2
        if len(self.uses) > half:
            least = max(least, int(np.partition(self.uses, -half)[-half]) + 1)
        keep = self.uses >= least
        kept = [w for w, k in zip(self, keep.tolist(), strict=True) if k]
        self.chars = sum(map(len, kept))
        if self.chars > TABLE_CHARS // 2:
            keep, kept, self.chars = np.zeros(len(keep), bool), [], 0
        self.clear()
        self.update(zip(kept, range(len(kept))))
        self.ids = self.ids[expand(self.start[keep], self.size[keep])]
        self.size, self.uses = self.size[keep], self.uses[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def found(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after another, and how many each has."""
        shown = b"\n".join(some).decode("utf-8", "replace")
        low = shown.lower()
        plain = ~self.merges.odd(low, len(some)) if self.merges.proven else np.zeros(len(some), bool)
        low = low.split("\n")
        size = np.zeros(len(low), np.int64)
        of = np.flatnonzero(plain)
        ids, size[of] = self.merges.ids([low[i] for i in of.tolist()]) if len(of) else (np.zeros(0, np.uint32), 0)
        odd = np.flatnonzero(~plain)
        if not len(odd):
            return ids, size
        words_of = shown.split("\n")
        other = [e.ids for e in self.encode([words_of[i] for i in odd.tolist()])]
        size[odd] = list(map(len, other))
        at = np.repeat(plain, size)
        out = np.empty(len(at), np.uint32)
        out[at], out[~at] = ids, np.fromiter(chain.from_iterable(other), np.uint32, len(at) - len(ids))
        return out, size

    def numbers(self, flat: list[bytes]) -> np.ndarray:
        """Numbers of words; the ids of those that are new have to be found after."""
        out = np.fromiter(map(self.get, flat, repeat(-1)), np.int64, len(flat))
        gone = np.flatnonzero(out < 0)
        if len(gone):
            missing = [flat[i] for i in gone.tolist()]
            new = list(dict.fromkeys(missing))
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.new += new
            self.chars += sum(map(len, new))
            out[gone] = np.fromiter(map(self.__getitem__, missing), np.int64, len(missing))
        return out

    def look_up(self) -> None:
        """Find the ids of the words that came since."""
        if not self.new:
            return
        ids, size = zip(*(self.found(self.new[i : i + STEP]) for i in range(0, len(self.new), STEP)), strict=True)
        self.ids, self.size = np.concatenate([self.ids, *ids]), np.concatenate([self.size, *size])
        self.start = np.cumsum(self.size) - self.size
        self.uses = np.concatenate([self.uses, np.zeros(len(self.new), np.int64)])
        self.new.clear()

    def tokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each with the end id, and the number for each text."""
        if len(self) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.forget()
        count = np.zeros(len(found), np.int64)
        numbers, flat, chars = [np.zeros(0, np.int64)], [], 0
        for i, text in enumerate(found):
            some = words(text)
            count[i] = len(some)
            flat += some
            chars += len(text)
            if chars > STEP_CHARS:
                numbers.append(self.numbers(flat))
                flat, chars = [], 0
        numbers.append(self.numbers(flat))
        self.look_up()
        flat = np.concatenate(numbers)
        self.uses += np.bincount(flat, minlength=len(self.uses))
        size = self.size[flat]
        edge = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(size, out=edge[1:])
        stop = np.cumsum(count)
        per_doc = edge[stop] - edge[stop - count] + 1
        out = np.full(int(per_doc.sum()), END, np.uint32)
        last = np.cumsum(per_doc) - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = self.ids[expand(self.start[flat], size)]
        return out, per_doc


@lru_cache(2)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def signs(rows: int) -> np.ndarray:
    """Fixed random directions of token ids."""
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (rows, DIMS))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of whole-number points on a Hilbert curve: Gray code of coordinates turned bit by bit."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] ^ turn) >> bit & 1)
    return key


def curve_keys(ids: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from the ids of all."""
    table = signs(1 << max(16, int(ids.max(initial=0)).bit_length()))
    start = np.cumsum(per_doc) - per_doc
    total = np.stack([np.add.reduceat(table[:, i][ids], start) for i in range(DIMS)], 1) if len(ids) else np.zeros((0, DIMS))
    z = total / np.sqrt(per_doc)[:, None] / 2
    return hilbert(np.floor((z / (1 + np.abs(z)) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS)


def tokenized(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, wide, ids): the place on the curve and the ids as unsigned little-endian numbers, of 32 bits if wide, else 16.

    A null or empty text has the end id only. Other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer or tokenizer_path())
        for batch in batches:
            if batch.num_rows:
                ids, per_doc = table.tokens(texts(batch.column(1)))
                wide = int(ids.max()) > 0xFFFF
                size = 4 if wide else 2
                stop = np.cumsum(per_doc) * size
                raw = ids.astype(f"<u{size}").tobytes()
                parts = [raw[a:b] for a, b in zip(stop - per_doc * size, stop, strict=True)]
                cols = [batch.column(0), pa.array(curve_keys(ids, per_doc)), pa.array([wide] * len(parts)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "wide", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, key long, wide boolean, ids binary")


def cut(at: np.ndarray, size: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut spans that lie end to end at the given places: (which span, where the piece starts, its length)."""
    stops = at + size
    inner = edges[(edges > at[0]) & (edges < stops[-1])] if len(at) else edges[:0]
    starts = np.unique(np.concatenate([at, inner]))
    which = np.searchsorted(at, starts, side="right") - 1
    return which, starts, np.minimum(np.append(starts[1:], stops[-1:]), stops[which]) - starts


def pack(tokens: DataFrame, length: int = 2048, with_ids: bool = True, partitions: int | None = None) -> DataFrame:
    """Pieces of tokenized documents in sequences of ``length``; ``tokens`` as ``tokenized`` gives them, written before.

    Documents follow one another along the curve and are cut where a sequence is full. At the end of each range partition the
    rest is cut into sequences of falling powers of two. Equal documents are spread by a hash of the id, so no key can fill one
    partition. Sequence ids are unique, not gapless. Documents of repeated ids are packed as often as they occur.
    """
    prepare(tokens.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # of the open sequence: id, start, tokens of the document, ids
        done = 0  # sequences

        def rows(doc, start, total, ids, sequence, offset):
            crc = [zlib.crc32(x.tobytes()) for x in ids]
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())]
            cols += [pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        def emit(items, edges):
            """Pieces of items lying end to end from 0, cut at edges; sequences end at edges."""
            size = np.array([len(x[3]) for x in items], np.int64)
            at = np.cumsum(size) - size
            which, begin, long = cut(at, size, edges)
            number = np.searchsorted(edges, begin, side="right")
            offset = begin - np.concatenate([[0], edges])[number]
            inside = begin - at[which]
            pieces = [(items[w][0], items[w][1] + int(i), items[w][2], items[w][3][i : i + n]) for w, i, n in zip(which, inside, long, strict=True)]
            return pieces, number, offset

        for batch in batches:
            if not batch.num_rows:
                continue
            for doc, wide, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                held.append((doc, 0, len(ids), ids))
            whole = sum(len(x[3]) for x in held) // length
            if not whole:
                continue
            edges = np.arange(1, whole + 1) * length
            pieces, number, offset = emit(held, edges)
            full = int(np.searchsorted(number, whole))
            if full:
                yield rows(*zip(*pieces[:full], strict=True), base + done + number[:full], offset[:full])
            held, done = pieces[full:], done + whole
        if held:
            rest = sum(len(x[3]) for x in held)
            edges = np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])
            pieces, number, offset = emit(held, edges)
            yield rows(*zip(*pieces, strict=True), base + done + number, offset)

    n = partitions or width(tokens.sparkSession)
    order = ["key", "spread", "doc_id"]
    spread = tokens.select("doc_id", "wide", "ids", "key", F.xxhash64("doc_id").alias("spread"))
    near = spread.repartitionByRange(n, "key", "spread").sortWithinPartitions(*order).select("doc_id", "wide", "ids")
    return near.mapInArrow(each, PIECES + (", ids array<int>" if with_ids else ""))


def packed(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write once to the shared folder, pack. An empty table gives no pieces."""
    return pack(staged(tokenized(docs, tokenizer, id_col, text_col)), length, with_ids)


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs, with_ids=False)
