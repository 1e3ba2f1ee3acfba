"""Quality rules: repetition found with a suffix array of words (operator 10).

Each Arrow batch numbers its words and sorts all suffixes of its documents together by prefix
doubling, the document being the first letter, so suffixes of different documents never share a
prefix. Longest common prefixes of neighbours in suffix order give the LCP intervals: a suffix's
longest repeated prefix is the larger of its two neighbour values, and the union of those spans is
the union of all maximal repeated substrings. The work is a map over documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import Ids, narrow, prepare, spans_to_mask, texts, words

SYMBOLS = "#*$%&|<>"
#: Words of suffixes sorted at once; longer batches are cut at documents. Results don't depend on it, a worker's memory does.
SORT_WORDS = 100_000
METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat_pct are the base rule; the rest is the suffix-array rule.

    Maximal repeats of at least ``min_repeat`` words may cover ``max_covered_pct`` percent of the
    words, and none may be longer than ``max_repeat`` words.
    """

    min_words: int = 10
    max_repeat_pct: int = 20
    min_repeat: int = 10
    max_covered_pct: int = 20
    max_repeat: int = 100


def suffix_order(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP of neighbours (lcp[i] belongs to order[i-1], order[i]), per document.

    ids: word numbers; doc: document of each word, ascending; ends: end of the word's document.
    """
    n = len(ids)
    place = np.arange(n)
    ranks: list[tuple[int, np.ndarray]] = []

    def rank_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.ones(n, bool)
        first[1:] = k[1:] != k[:-1]
        start = np.maximum.accumulate(np.where(first, place, 0))
        rank = np.empty(n, np.int64)
        rank[order] = start
        return rank, order

    n_ids, n_docs = int(ids.max()) + 1, int(doc.max()) + 1
    rank, order = rank_of(doc.astype(np.int64) * n_ids + ids)
    ranks.append((1, rank))
    assert n_docs * n_ids < 2**62
    h = 1
    while True:
        sorted_rank = rank[order]
        same = np.zeros(n, bool)
        same[1:] = sorted_rank[1:] == sorted_rank[:-1]
        same[:-1] |= same[1:]
        at = np.flatnonzero(same)  # places in suffix order that are not settled
        if not len(at):
            break
        p = order[at]
        nxt = np.where(p + h < ends[p], rank[np.minimum(p + h, n - 1)] + 1, 0)
        key = sorted_rank[at] * (n + 1) + nxt
        by = np.argsort(key, kind="stable")
        order = order.copy()
        order[at] = p[by]
        k = key[by]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        start = np.maximum.accumulate(np.where(first, at, 0))
        rank = rank.copy()
        rank[order[at]] = start
        h *= 2
        ranks.append((h, rank))
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    length = np.zeros(max(0, n - 1), np.int64)
    live = np.flatnonzero(doc[a] == doc[b])
    for step, rank in reversed(ranks):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x + step <= ends[a[live]]) & (y + step <= ends[b[live]])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        length[live] += np.where(inside & (rank[x] == rank[y]), step, 0)
    lcp[1:] = length
    return order, lcp


def repeated(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length in words of the longest prefix of each suffix that its document has elsewhere too."""
    out = np.zeros(len(ids), np.int64)
    if len(ids):
        order, lcp = suffix_order(ids, doc, ends)
        after = np.append(lcp[1:], 0)
        out[order] = np.maximum(lcp, after)
    return out


def measure(docs: list[str], limits: Limits) -> dict[str, np.ndarray]:
    """The metrics of some documents, as arrays."""
    n = len(docs)
    out = {c.split()[0]: np.zeros(n, bool if c.endswith("boolean") else np.int64) for c in METRICS.split(", ")}
    at = 0
    while at < n:
        # only the words of the documents that are sorted together are held
        split = [words(docs[at])]
        total, upto = len(split[0]), at + 1
        while upto < n:
            more = words(docs[upto])
            if total + len(more) > SORT_WORDS:
                break
            split.append(more)
            total += len(more)
            upto += 1
        for i in range(at, upto):
            t = docs[i]
            out["word_chars"][i] = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))
            out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
            lines = t.split("\n")
            if len(lines) > 1:
                full = [x for x in lines if x and x.strip(" \t\x0b\x0c\r")]
                out["n_dup_lines"][i] = len(full) - len(set(full))
        part = np.array([len(w) for w in split], np.int64)
        out["n_words"][at:upto] = part
        number = Ids()
        ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, total)
        del split, number
        doc = np.repeat(np.arange(upto - at), part)
        stops = np.cumsum(part)
        longest = repeated(ids, doc, np.repeat(stops, part))
        place = np.arange(total)
        for name, least in (("n_repeat_words", 5), ("covered_words", limits.min_repeat)):
            start = place[longest >= least]
            mask = spans_to_mask(start, start + longest[start], int(total))
            out[name][at:upto] = np.bincount(doc[mask], minlength=upto - at)
        best = np.zeros(upto - at, np.int64)
        np.maximum.at(best, doc, longest)
        out["longest_repeat"][at:upto] = best
        at = upto
    lengths = out["n_words"]
    out["base_failed"] = (lengths < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_pct * lengths)
    worse = (100 * out["covered_words"] > limits.max_covered_pct * lengths) | (out["longest_repeat"] > limits.max_repeat)
    out["kept"] = ~out["base_failed"] & ~worse
    return out


def repetition_metrics(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of metrics for each row of ``docs``, with its id.

    A null or empty text has no words, so it fails the base rule. Repeated rows give repeated rows;
    a null id stays null; other columns are ignored whatever their names.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(texts(batch.column(1)), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], names=["doc_id", *got])

    return narrow(docs, id_col, text_col).mapInArrow(each, f"doc_id long, {METRICS}")


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns unchanged."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(texts(batch.column(at)), limits)["kept"]))

    return docs.mapInArrow(each, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    cols = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept covered_words".split()
    return repetition_metrics(docs).select(*map(F.col, cols))


SQL = r"""
WITH word AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), piece AS (
  SELECT doc_id, k, unnest(generate_series(1, len(w) - k + 1)) AS i, w FROM word, (VALUES (5), (10), (101)) AS size(k)
), again AS (
  SELECT doc_id, k, i FROM (
    SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, md5(array_to_string(w[i : i + k - 1], ' '))) AS n FROM piece
  ) WHERE n > 1
), place AS (
  SELECT DISTINCT doc_id, k, i + unnest(generate_series(0, k - 1)) AS at FROM again
), cover AS (
  SELECT doc_id, count(*) FILTER (k = 5) AS five, count(*) FILTER (k = 10) AS ten, count(*) FILTER (k = 101) AS long FROM place GROUP BY doc_id
), line AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM word)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(five, 0) AS n_repeat_words, coalesce(ten, 0) AS covered_words, coalesce(long, 0) > 0 AS over_long
  FROM word LEFT JOIN line USING (doc_id) LEFT JOIN cover USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_words <= 20 * n_words AND NOT over_long AS kept, covered_words
FROM base
"""
