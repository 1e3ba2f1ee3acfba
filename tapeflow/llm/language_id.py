"""Language identification by sparse multinomial logistic regression on TF-IDF letter n-grams (operator 8).

Document frequencies come from all rows that may be learned from. The regression is fitted on a bounded sample of them with
follow-the-regularised-leader and an elastic net; a fifth of the sample is held back to find the temperature of the scores.
Only letters and the marks on them count (Unicode categories L and M): anything else is one blank between words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import prepare
from tapeflow.llm.linear import Ftrl, bounded_sample, logits, softmax, temperature

DIMS_BITS, LONGEST = 15, 3
DIMS = 1 << DIMS_BITS
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Rows of the sample at most, and the learner."""

    rows: int = 4000
    learner: Ftrl = field(default_factory=lambda: Ftrl(alpha=1.0, l1=0.02, l2=0.02))


def ranges(chars: np.ndarray) -> str:
    """Pattern ranges of ascending code points."""
    first = np.append(True, np.diff(chars) > 1)
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(chars[first], chars[np.append(first[1:], True)], strict=True))


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """What is no letter or mark, and a letter; a quicker pattern for the former, and the characters up to U+FFFF that it gets wrong."""
    every = [chr(i) for i in range(sys.maxunicode + 1)]
    kinds = np.array([unicodedata.category(c)[0] for c in every])
    quick = re.compile(r"[\W\d_]+")
    word = np.array([not quick.match(c) for c in every])
    letter, mark = kinds == "L", kinds == "M"
    wrong = word != (letter | mark)
    # long lists of ranges above U+FFFF make a pattern slow; such texts are told by their largest character
    wrong[0x10000:] = False
    sets = [ranges(np.flatnonzero(x)) for x in (letter | mark, letter, wrong)]
    return re.compile(f"[^{sets[0]}]+"), re.compile(f"[{sets[1]}]"), quick, re.compile(f"[{sets[2]}]")


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often each occurs; none without a letter."""
    others, letter, quick, odd = patterns()
    low = (text or "").lower()
    slow = not low.isascii() and (max(low) > "\uffff" or odd.search(low))
    letters = (others if slow else quick).sub(" ", low).strip()
    if not letter.search(letters):
        return None
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, counts = c.copy(), np.zeros(DIMS, np.int64)
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
            h ^= h >> np.uint32(15)
        place = (h * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - DIMS_BITS)
        counts += np.bincount(place, minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def features(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.log1p(np.minimum(counts, 65535)) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many rows each hashed n-gram occurs, and in the last place the number of rows with a letter."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                got = gram_counts(text)
                if got:
                    df[got[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["slot", "n"])

    total = np.zeros(DIMS + 1, np.int64)
    for slot, n in docs.select(text_col).mapInArrow(each, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():  # one row a slot at most
        total[slot] = n
    return total


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def predict(self, found: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Name and probability of the likeliest language of each text."""
        names, score = [UNKNOWN] * len(found), np.zeros(len(found))
        grams = [gram_counts(t) for t in found] if self.names else []
        some = [i for i, g in enumerate(grams) if g]
        if some:
            p = softmax(logits([features(*grams[i], self.idf) for i in some], self.weights) / self.heat)
            for i, row in zip(some, p, strict=True):
                k = int(row.argmax())
                names[i], score[i] = self.names[k], min(1.0, float(row[k]))
        return names, score


def fit_language_model(docs: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from all rows of ``docs`` that have a language; rows without a letter teach nothing. No rows give a model without names."""
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = document_frequencies(known, "text")
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [gram_counts(t) for t in batch.column(1).to_pylist()]
            at = [g and g[0].astype("<u2").tobytes() for g in got]
            n = [g and np.minimum(g[1], 65535).astype("<u2").tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["id", "lang", "at", "n"])

    sample = bounded_sample(known, F.col("id"), fit.rows).mapInArrow(grams, "id string, lang string, at binary, n binary").where("at IS NOT NULL")
    rows = sorted(map(tuple, sample.collect()), key=lambda r: (r[0] or "", r[1], r[2], r[3]))  # fit.rows at most
    names = sorted({r[1] for r in rows})
    x = [features(np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u2").astype(np.int64), idf) for r in rows]
    y = np.array([[r[1] == name for name in names] for r in rows], float).reshape(len(rows), len(names))
    held = np.arange(len(rows)) % 5 == 4
    if len(rows) < 20:
        held[:] = False
    weights = fit.learner.fit([r for r, h in zip(x, held, strict=True) if not h], y[~held], DIMS) if names else np.zeros((DIMS + 1, 0))
    heat = temperature(logits([r for r, h in zip(x, held, strict=True) if h], weights), y[held]) if names else 1.0
    return LanguageModel(names, idf, weights, heat)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its text alone; ``und`` with score 0 for a null text or one without a letter."""
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    return predict_language(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
