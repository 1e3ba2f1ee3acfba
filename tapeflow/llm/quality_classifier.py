"""Quality classifier from weak labels (operator 4).

Heuristic labellers vote on every document, good, bad or not at all, in two tasks: whether it is well formed, and whether it is
civil. For civility there are word lists and, where some rows have toxicity labels, word starts found almost only in toxic ones of
a bounded sample of labelled rows. Votes are counted by pattern over all documents; expectation-maximisation on these counts estimates the share of good
documents and each labeller's rates in both classes; labels take no part in that. The posterior of a document's pattern is its weak
label. A hashed linear scorer is fitted to the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import narrow, prepare, texts
from tapeflow.llm.linear import Ftrl, bounded_sample, logits, temperature
from tapeflow.session import staged

#: Words of insult by what they are aimed at.
INSULTS = {
    "person": "idiot idiots moron morons loser losers clown clowns fool fools imbecile imbeciles".split(),
    "worth": "trash garbage worthless useless scum vermin filth".split(),
    "scorn": "stupid pathetic disgusting dumb repulsive".split(),
}
FORM = ("symbols", "neighbours", "top_word", "capitals", "lines", "sentences", "word_length")
STARTS = (4, 5, 6, 7, 8)
CIVIL = (*INSULTS, *(f"starts_{n}" for n in STARTS))
NONE, GOOD, BAD = range(3)
WORD = re.compile(r"[^\W\d_]+")
BITS = 18
DIMS = 1 << BITS


@dataclass(frozen=True)
class Fit:
    """Rows of the sample and labelled rows at most, the learner, and the score from which a document is kept."""

    rows: int = 8000
    labelled: int = 20_000
    learner: Ftrl = field(default_factory=lambda: Ftrl(alpha=0.5, l1=0.3, l2=0.1, epochs=3))
    keep: float = 0.5


CAPITAL = re.compile("[A-Z\u00c0-\u00de\u0391-\u03a9\u0410-\u042f]")
Starts = dict[int, frozenset[str]]


def word_starts(kinds: set[str], n: int) -> set[str]:
    return {w[:n] for w in kinds if len(w) >= n}


class Places(dict):
    """Hashed places of words, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = at = xxhash.xxh3_64_intdigest(word) & (DIMS - 1)
        return at


PLACES, START_PLACES = Places(), Places()


def votes(text: str, starts: Starts) -> tuple[list[int], list[int], list[str], set[str]]:
    """Votes on form and on civility, style marks, and the set of lower-case words."""
    lower = WORD.findall(text.lower())
    count = Counter(lower)
    kinds = count.keys()
    n = len(lower)
    civil = [BAD if any(w in kinds for w in INSULTS[k]) else GOOD if n else NONE for k in INSULTS]
    first = {s[: STARTS[0]] for known in starts.values() for s in known}
    likely = [w for w in kinds if w[: STARTS[0]] in first] if first else []
    for k in STARTS:
        known = starts.get(k)
        civil.append(NONE if not known or not n else GOOD if known.isdisjoint(w[:k] for w in likely) else BAD)
    if not n:
        return [BAD] * len(FORM), civil, ["empty"], kinds
    letters = sum(map(len, lower))
    symbols = sum(map(text.count, "#*$%&|<>")) / n
    neighbours = sum(map(str.__eq__, lower, lower[1:])) / n
    top = max(count.values()) / n
    capitals = len(CAPITAL.findall(text)) / letters
    lines = [x for x in text.split("\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    ends = (text.count(".") + text.count("!") + text.count("?")) / n
    long = letters / n
    measured = {"symbols": symbols, "neighbours": neighbours, "top_word": top, "capitals": capitals, "lines": again, "ends": ends, "long": long}
    form = [
        BAD if symbols > 0.1 else GOOD,
        NONE if n < 12 else BAD if neighbours > 0.3 else GOOD,
        NONE if n < 20 else BAD if top > 0.25 else GOOD,
        NONE if letters < 10 else BAD if capitals > 0.4 else GOOD,
        NONE if len(lines) < 3 else BAD if again > 0.3 else GOOD,
        NONE if n < 30 else BAD if ends < 0.005 or ends > 0.5 else GOOD,
        BAD if long < 2.5 or long > 15 else GOOD,
    ]
    marks = [f"{k}={min(9, int(20 * v))}" for k, v in measured.items() if k != "long"] + [f"long={min(20, int(long))}"]
    return form, civil, marks, kinds


def pattern(marks: list[int]) -> int:
    """Votes as one number in base three."""
    out = 0
    for v in marks:
        out = 3 * out + v
    return out


def unpacked(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([patterns // 3 ** (labellers - 1 - i) % 3 for i in range(labellers)], 1)


@dataclass
class WeakLabels:
    """Share of good documents and chance of each vote (class, labeller, vote) in good and bad ones."""

    prior: float
    rates: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200, most_false: float | None = 5e-4) -> WeakLabels:
        """Expectation-maximisation; labellers start as mostly right on good documents and half right on bad ones.

        Kinds of bad documents hardly overlap, so two free classes would split along the largest kind. The heuristics are strict
        instead: a good document is called bad by one of them at the rate ``most_false`` at most, and missed ones are for the data.
        With None all rates are free, which is right for labellers that err independently in both classes.
        """
        v = unpacked(patterns, labellers)
        rates = np.tile(np.array([[[0.1, 0.85, 0.05]], [[0.1, 0.4, 0.5]]]), (1, labellers, 1))
        out = cls(0.8, rates)
        for _ in range(rounds):
            p = out.good(patterns)
            w = np.stack([p * counts, (1 - p) * counts])
            total = w.sum(1)
            if not total.sum():
                break
            rates = np.stack([np.stack([(w * (v[:, i] == k)).sum(1) + 0.5 for k in range(3)], 1) for i in range(labellers)], 1)
            rates /= rates.sum(2, keepdims=True)
            if most_false is not None:
                over = np.maximum(0, rates[0, :, BAD] - most_false)
                rates[0, :, BAD] -= over
                rates[0, :, GOOD] += over
            new = cls(float((total[0] + 1) / (total.sum() + 2)), rates)
            done = np.abs(new.rates - out.rates).max() < 1e-9
            out = new
            if done:
                break
        return out

    def good(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior of good for vote patterns; a labeller that does not vote says nothing."""
        labellers = self.rates.shape[1]
        v = unpacked(np.asarray(patterns), labellers)
        at = np.arange(labellers)
        log = [np.where(v == NONE, 0.0, np.log(r[at, v] / (1 - r[at, NONE]))).sum(1) for r in self.rates]
        return 1 / (1 + np.exp(np.clip(np.log((1 - self.prior) / self.prior) + log[1] - log[0], -500, 500)))


def hashed(marks: list[str], kinds: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's features: its words, their first five letters, and its style marks with more weight."""
    seed = xxhash.xxh3_64_intdigest
    at = set(map(PLACES.__getitem__, kinds))
    at.update(map(START_PLACES.__getitem__, [w[:5] + "-" for w in kinds if len(w) > 4]))
    at = np.fromiter(at, np.int64, len(at))
    own = np.unique(np.fromiter((seed("mark " + m) & (DIMS - 1) for m in marks), np.int64, len(marks)))
    at = np.sort(at)
    at = at[~np.isin(at, own, assume_unique=True)]
    return np.concatenate([at, own]), np.concatenate([np.full(len(at), 0.5), np.ones(len(own))])


@dataclass
class QualityModel:
    starts: Starts
    form: WeakLabels
    civil: WeakLabels
    weights: np.ndarray  # of bad form and of incivility
    heat: tuple[float, float]
    keep: float

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Chance of good form and of civility."""
        z = logits(rows, self.weights)
        return np.stack([1 / (1 + np.exp(np.clip(z[:, k] / self.heat[k], -500, 500))) for k in (0, 1)], 1)


def toxic_starts(docs: DataFrame, labels: DataFrame, fit: Fit, id_col: str = "doc_id", text_col: str = "text") -> Starts:
    """Word starts in many toxic rows and in next to no other row of the sample of ``labels`` (doc_id, toxic)."""
    some = bounded_sample(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).alias("toxic")), F.col("label_id"), fit.labelled)
    known = F.broadcast(staged(some))  # fit.labelled narrow rows at most
    rows = narrow(docs, id_col, text_col).join(known, F.col("doc_id") == F.col("label_id")).select("toxic", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                kinds = {w.lower() for w in WORD.findall(text)}
                count.update((s, toxic) for n in STARTS for s in word_starts(kinds, n))
                count["", toxic] += 1
        keys = list(count)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([count[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["start", "toxic", "n"])

    tally = rows.mapInArrow(each, "start string, toxic boolean, n long").groupBy("start").agg(
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(~F.col("toxic"), F.col("n"))), F.lit(0)).alias("other")
    )
    tally = staged(tally)
    total = tally.where("start = ''").first()
    least = max(8, total["bad"] // 200) if total else 8
    strong = tally.where((F.col("start") != "") & (F.col("bad") >= least) & (F.col("other") * 20 <= F.col("bad")))
    found = [r[0] for r in strong.collect()]  # each stands in a 200th of the toxic sample at least
    return {n: frozenset(s for s in found if len(s) == n) for n in STARTS}


def vote_patterns(docs: DataFrame, starts: Starts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, civil): the votes of every row as numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [votes(t, starts)[:2] for t in texts(batch.column(1))]
            cols = [pa.array([pattern(g[k]) for g in got], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "form", "civil"])

    return docs.select(F.col(id_col).cast("string").alias("id"), text_col).mapInArrow(each, "id string, form long, civil long")


def fit_quality_model(docs: DataFrame, labels: DataFrame | None = None, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Weak labels from the votes of all rows, a scorer from a bounded sample. ``labels`` (doc_id, toxic) may cover some rows."""
    prepare(docs.sparkSession)
    starts = toxic_starts(docs, labels, fit, id_col, text_col) if labels is not None else {}
    tally = staged(vote_patterns(docs, starts, id_col, text_col).groupBy("form", "civil").count())
    weak = []
    for task, labellers in (("form", len(FORM)), ("civil", len(CIVIL))):
        seen = tally.groupBy(task).agg(F.sum("count")).collect()  # 3 ** labellers rows at most
        weak.append(WeakLabels.fit(*(np.array([r[i] for r in seen], np.int64) for i in range(2)), labellers))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [votes(t, starts) for t in texts(batch.column(1))]
            x = [hashed(g[2], g[3]) for g in got]
            good = [w.good(np.array([pattern(g[k]) for g in got], np.int64)) for k, w in enumerate(weak)]
            cols = [batch.column(0), *map(pa.array, good), *(pa.array([r[k].astype(t).tobytes() for r in x], pa.binary()) for k, t in ((0, "<i4"), (1, "<f4")))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "form", "civil", "at", "x"])

    some = bounded_sample(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), F.col("id"), fit.rows)
    rows = some.mapInArrow(each, "id string, form double, civil double, at binary, x binary").collect()  # fit.rows at most
    rows = sorted(map(tuple, rows), key=lambda r: (r[0] or "", r[3], r[4]))
    x = [(np.frombuffer(r[3], "<i4").astype(np.int64), np.frombuffer(r[4], "<f4").astype(float)) for r in rows]
    held = np.arange(len(rows)) % 5 == 4
    train = [r for r, h in zip(x, held, strict=True) if not h]
    weights, heat = [], []
    for k in (1, 2):
        good = np.array([r[k] for r in rows], float)
        y = np.stack([good, 1 - good], 1).reshape(len(rows), 2)
        w = fit.learner.fit(train, y[~held], DIMS) if len(rows) else np.zeros((DIMS + 1, 2))
        bad = w[:, 1] - w[:, 0]
        z = logits([r for r, h in zip(x, held, strict=True) if h], bad[:, None])
        weights.append(bad)
        heat.append(temperature(np.concatenate([np.zeros_like(z), z], 1), y[held]))
    return QualityModel(starts, weak[0], weak[1], np.stack(weights, 1), (heat[0], heat[1]), fit.keep)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weak_form, weak_civil (posteriors of the votes), form, civil (scores), score (their product), kept, for every row.

    A null or empty text has bad form. Repeated rows and null ids are scored like any other; other columns are ignored.
    """
    prepare(docs.sparkSession)
    sparse = np.flatnonzero(model.weights.any(1))
    values = model.weights[sparse]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((DIMS + 1, 2))
        weights[sparse] = values
        own = QualityModel(model.starts, model.form, model.civil, weights, model.heat, model.keep)
        for batch in batches:
            got = [votes(t, own.starts) for t in texts(batch.column(1))]
            p = own.scores([hashed(g[2], g[3]) for g in got])
            weak = [w.good(np.array([pattern(g[k]) for g in got], np.int64).reshape(-1)) for k, w in enumerate((own.form, own.civil))]
            kept = (p >= own.keep).all(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (*weak, p[:, 0].copy(), p[:, 1].copy(), p[:, 0] * p[:, 1], kept))],
                names=["doc_id", "weak_form", "weak_civil", "form", "civil", "score", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, weak_form double, weak_civil double, form double, civil double, score double, kept boolean")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, fit_quality_model(docs, labels))
