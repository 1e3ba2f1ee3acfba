"""Spelling variants by search schemes on a bidirectional FM-index (operator 11).

Words are counted in tasks and added up. A vocabulary word at one error from another has one half of it unchanged, so a cell
holds all words with the same first (or last) letters, as many as every half has, and a word is looked for in its two cells
only. A cell is the delimited text of its words with a Burrows-Wheeler transform in both directions. Each word's left half is
matched exactly, from its last letter back to the delimiter, and then extended to the right allowing one error, up to the next
delimiter; its right half is matched to the delimiter on the right and extended to the left. States are intervals of suffix
ranks in both directions; all words of a cell are extended together. A pair belongs to the scheme of the left half wherever
that half is a common prefix, so nothing is found twice.

What leaves a cell is one row for each word: how many near words it has, and the largest of them; pairs are not shuffled. Letter
groups with more words than a cell are dealt into parts by a hash, and every part is looked for in every part. Forms grow in
count, so chains are short, and roots are found by pointer jumping over written tables.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import expand, narrow, runs, texts, utf8
from tapeflow.session import staged

#: Letters of a word; only A to Z are lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One occurrence in about this many loses a letter.
SLIP = 199
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of one cell, and distinct words counted in a task before they are sent.
CELL_WORDS, COUNTED_WORDS = 20_000, 200_000


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, slip: int = SLIP) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``min_letters`` after slips, with their occurrences over all documents.

    A run whose crc32 with its document's id is divisible by ``slip`` loses one letter. A null id counts as an empty string in it. Null
    and empty texts have no words; repeated rows count again; other columns are ignored.
    """
    found = re.compile(f"{RUN}{{{min_letters},}}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                mine = Counter(found.findall(utf8(text).translate(LOWER).decode("utf-8", "surrogatepass")))
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                marks = map(zlib.crc32, map(str.encode, mine), repeat(start))
                for word in [w for w, h in zip(mine, marks, strict=True) if h % slip == 0]:
                    gone = zlib.crc32(word.encode(), start) % len(word)
                    n = mine.pop(word)
                    if len(word) > min_letters:
                        total[word[:gone] + word[gone + 1 :]] += n
                total.update(mine)
            if len(total) > COUNTED_WORDS:
                yield out()
                total.clear()
        yield out()

    return narrow(docs, id_col, text_col).mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """Letters of a text by bits: ranks of a letter and of smaller letters before any place."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            one = (text >> bit & 1).astype(bool)
            self.levels.append(np.append(0, np.cumsum(one, dtype=np.int32)).astype(np.int32))
            self.zeros.append(len(text) - int(one.sum()))
            text = np.concatenate([text[~one], text[one]])
        self.bits = bits

    def ranks(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of [lo, hi): places of the letter's occurrences within those of the letter (from, to), and how many letters are smaller."""
        lo, hi, less = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        start = np.zeros(len(lo), np.int64)  # where the letter's node starts on this level
        for ones, zeros, bit in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            up = (letter >> bit & 1).astype(bool)
            a, b, s = ones[lo], ones[hi], ones[start]
            less += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi, start = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b), np.where(up, zeros + s, start - s)
        return lo - start, hi - start, less

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, letter) of all distinct letters in each interval."""
        which, letter = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = ones[lo], ones[hi]
            low, high = b - a < hi - lo, b > a
            which = np.concatenate([which[low], which[high]])
            letter = np.concatenate([letter[low] << 1, letter[high] << 1 | 1])
            lo, hi = np.concatenate([(lo - a)[low], (zeros + a)[high]]), np.concatenate([(hi - b)[low], (zeros + b)[high]])
        return which, letter


def text_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; letters are positive and the last one is the smallest of all."""
    n = len(text)
    rank, size = text.astype(np.int64), 1
    while True:
        key = rank * (n + 256) + np.append(rank[size:], np.zeros(min(size, n), np.int64))[:n]
        order = np.argsort(key, kind="stable")
        new = runs(key[order])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        size *= 2


class Index:
    """Bidirectional FM-index of delimited words: the text and its reverse, with intervals that are moved together."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(raw, return_inverse=True)
        text = np.append(text + 1, 0)  # the delimiter is 1
        self.bits = max(1, int(text.max()).bit_length())
        # in suffix order, the delimiter before a word tells which word follows
        self.order = text_order(text)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=1 << self.bits)))
        self.before = Wavelet(text[self.order - 1], self.bits)
        back = np.append(text[-2::-1], 0)
        self.after = Wavelet(back[text_order(back) - 1], self.bits)
        self.word_at = np.cumsum(text == 1) - 1  # number of the word after each delimiter
        self.n = len(text)

    def coded(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + 1, -1)

    def all(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the empty string: start in the text's order, start in the reverse's, size."""
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n)

    def extend(self, state: tuple, letter: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals with a letter put on one side; the size is 0 where it does not occur."""
        mine, other, size = state if left else (state[1], state[0], state[2])
        known = letter > 0
        c = np.where(known, letter, 1)
        a, b, less = (self.before if left else self.after).ranks(c, mine, mine + size)
        mine, other, size = self.first[c] + a, other + less, np.where(known, b - a, 0)
        return (mine, other, size) if left else (other, mine, size)

    def letters(self, state: tuple, left: bool) -> tuple[np.ndarray, np.ndarray]:
        lo = state[0] if left else state[1]
        return (self.before if left else self.after).letters(lo, lo + state[2])


def near_words(index: Index, words: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (query, word of the index) at one error, where the query's left half (else its right half) is unchanged."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(size.max(initial=0)) + 1
    raw = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), wide)
    letters = index.coded(raw)
    half = size // 2
    query = np.arange(len(words))
    state = index.all(len(words))
    # the half that stays: away from the error side, letter by letter, to its delimiter
    for step in range(int(np.where(left, half, size - half).max(initial=0)) + 1):
        at = half - 1 - step if left else half + step
        inside = (at >= 0) if left else (at < size)
        edge = (at == -1) if left else (at == size)
        c = np.where(inside, letters[query, np.clip(at[query], 0, wide - 1)], 1)
        moved = index.extend(state, c, left)
        state = tuple(np.where(inside | edge, m, s) for m, s in zip(moved, state, strict=True))
    live = state[2] > 0
    query, state = query[live], tuple(s[live] for s in state)
    # the next letter to read on the error side
    at = half[query] if left else half[query] - 1
    wrong = np.zeros(len(query), bool)
    found_q, found_w = [], []
    move = 1 if left else -1
    while len(query):
        over = (at == size[query]) if left else (at == -1)
        c = np.where(over, 1, letters[query, np.clip(at, 0, wide - 1)])
        same = index.extend(state, c, not left)
        # reading on; at the end of the word this is the delimiter, which only counts after an error
        stop = over & wrong & (same[2] > 0)
        if stop.any():
            lo, n = same[0][stop], same[2][stop]
            rows = expand(lo, n)
            start = index.order[rows]
            found_q.append(np.repeat(query[stop], n))
            found_w.append(start)
        parts = [(query, at + move, wrong, *same, ~over)]
        right = np.flatnonzero(~wrong)
        if len(right):
            q, p, s, end = query[right], at[right], tuple(x[right] for x in state), over[right]
            # a letter of the query is left out
            parts.append((q, p + move, np.ones(len(q), bool), *s, ~end))
            which, letter = index.letters(s, not left)
            keep = (letter > 1)
            which, letter = which[keep], letter[keep]
            t = index.extend(tuple(x[which] for x in s), letter, not left)
            # another letter in its place, or one more before it
            parts.append((q[which], p[which] + move, np.ones(len(which), bool), *t, ~end[which] & (letter != c[right][which])))
            parts.append((q[which], p[which], np.ones(len(which), bool), *t, np.ones(len(which), bool)))
        joined = [np.concatenate([p[i][p[6] & (p[5] > 0)] for p in parts]) for i in range(6)]
        query, at, wrong = joined[:3]
        state = tuple(joined[3:])
        if len(query):  # the same letters left out or put in at several places lead to one state
            order = np.lexsort((*state, wrong, at, query))
            order = order[np.logical_or.reduce([runs(x[order]) for x in (query, at, wrong, *state)])]
            query, at, wrong, state = query[order], at[order], wrong[order], tuple(s[order] for s in state)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, start = np.concatenate(found_q), np.concatenate(found_w)
    # every match spans delimiter, word, delimiter; it starts at the first
    pair = np.unique(np.stack([q, index.word_at[start]], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def cell_rows(left: bool, index_words: list[str], index_n: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Of each query: near words in the cell, the largest one's count and name."""
    count, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
    if not index_words or not words:
        return count, best_n, best
    index = Index(index_words)
    q, w = near_words(index, words, left)
    if not left and len(q):  # a common left half is the other scheme's
        size = np.fromiter(map(len, words), np.int64, len(words))
        keep = np.array([words[i][: size[i] // 2] != index_words[j][: size[i] // 2] for i, j in zip(q.tolist(), w.tolist(), strict=True)], bool)
        q, w = q[keep], w[keep]
    if not len(q):
        return count, best_n, best
    place = np.empty(len(index_words), np.int64)
    place[np.array(sorted(range(len(index_words)), key=index_words.__getitem__))] = np.arange(len(index_words))
    order = np.lexsort((place[w], -index_n[w], q))
    q, w = q[order], w[order]
    at = np.flatnonzero(runs(q))
    count[q[at]] = np.diff(np.append(at, len(q)))
    best_n[q[at]] = index_n[w[at]]
    for i, j in zip(q[at].tolist(), w[at].tolist(), strict=True):
        best[i] = index_words[j]
    return count, best_n, best


def dealt(words: DataFrame, cell_words: int) -> DataFrame:
    """(side, cell, i, j, word, n, indexed): words in the cells of their first and last letters, as part of the index and as queries."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), k.alias("letters")) for s, k in ((True, F.substring("word", 1, 3)), (False, F.substring(F.reverse("word"), 1, 3)))])
    both = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.side", "e.letters")
    # at most 90^3 groups of letters on each side
    groups = both.groupBy("side", "letters").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum(F.when(F.col("k") <= cell_words, F.col("k"))).over(Window.partitionBy("side").orderBy("letters").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(
        "side", "letters", F.ceil(F.col("k") / cell_words).cast("int").alias("parts"),
        F.when(F.col("k") <= cell_words, F.floor(before / cell_words).cast("string")).otherwise(F.concat(F.lit("="), "letters")).alias("cell"),
    )
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    placed = both.join(F.broadcast(staged(groups)), ["side", "letters"]).select("word", "n", "side", "cell", "parts", mine.alias("mine"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    indexed = placed.select("side", "cell", F.col("mine").alias("i"), each.alias("j"), "word", "n", F.lit(True).alias("indexed"))
    # a group in one part looks its own words up
    asked = placed.where("parts > 1").select("side", "cell", each.alias("i"), F.col("mine").alias("j"), "word", "n", F.lit(False).alias("indexed"))
    return indexed.unionByName(asked)


def near_summary(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, n_near, best): how many words of (word, n) are at one error from each, and the largest one as (n, word)."""

    def each(table: pa.Table) -> pa.Table:
        left, big = table["side"][0].as_py(), table["cell"][0].as_py()[0] == "="
        indexed = table["indexed"].to_numpy()
        index = table.filter(pa.array(indexed))
        asked = table.filter(pa.array(~indexed)) if big else index
        asked_words = asked["word"].to_pylist()
        count, best_n, best = cell_rows(left, index["word"].to_pylist(), index["n"].to_numpy(), asked_words)
        cols = [pa.array(asked_words, pa.string()), pa.array(asked["n"].to_numpy()), pa.array(count), pa.array(best_n), pa.array(best, pa.string())]
        return pa.table(cols, names=["word", "n", "n_near", "best_n", "best"])

    rows = dealt(words, cell_words).groupBy("side", "cell", "i", "j").applyInArrow(each, "word string, n long, n_near long, best_n long, best string")
    # largest count first, then the smallest word
    rank = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return rows.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(rank).alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words of 6 letters or more.

    Halves are then at least 3 letters long, as the cells need. An empty vocabulary gives no rows.
    """
    best_n = -F.col("best.n")
    far = best_n >= ratio * F.col("n")
    forms = staged(near_summary(words, cell_words).select("word", "n", "n_near", F.when(far, F.col("best.word")).alias("form"), F.when(far, best_n).alias("form_n")))
    # counts grow by the ratio along a chain, so its length is known; each round doubles the way gone
    most = forms.agg(F.max("form_n").alias("n")).first().n
    way = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = 0 if most is None else math.floor(math.log(most, ratio)) + 1
    for _ in range(max(0, steps - 1).bit_length()):
        way = staged(way)
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        way = way.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    root: Column = F.coalesce("root", "word")
    return forms.join(way, "word", "left").select("word", "form", root.alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, **columns) -> DataFrame:
    return corpus_words(docs, **columns).where(F.col("n") >= min_count)


def digest(docs: DataFrame) -> DataFrame:
    return variants(staged(vocabulary(docs)))
