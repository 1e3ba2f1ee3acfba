"""Gaussian hidden Markov models over long series, one model for each series key, without a series in one task.

A row turns the vector of state weights by a small matrix (transition times emission), and a run of rows by the product of
theirs. Products are associative, so blocks of rows are multiplied on their own, block products are scanned in groups of
``FAN`` (and groups of groups, as many levels as needed), and every block gets the weights that reach it from both ends. The
same code in the max-plus algebra gives the most likely path. Only sums for each key go to the driver, which updates the
parameters: a few dozen numbers a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import all_of, attach, int_div
from tapeflow.functions.series import BLOCK_ROWS, number_rows
from tapeflow.session import staged

#: Block products scanned in one group; floor of a variance of standardized values.
FAN, MIN_VARIANCE = 4_096, 1e-3
SCAN = "blk long, into array<double>, out_of array<double>"


@dataclass
class Model:
    """Start, transition (from, to), means and variances (state, feature) of one key."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)

    def emission(self, x: np.ndarray) -> np.ndarray:
        """Log density of rows in each state."""
        gap = x[:, None, :] - self.mean[None]
        return -0.5 * (np.log(2 * np.pi * self.variance).sum(1)[None] + (gap**2 / self.variance[None]).sum(2))

    def matrices(self, x: np.ndarray, first: bool, log: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, from, to): one matrix a row, and what was taken off each row's log density. Before the first row any state leads to the start."""
        density = self.emission(x)
        top = np.zeros(len(x)) if log else density.max(1)
        with np.errstate(divide="ignore"):
            move = np.log(self.move) if log else self.move
            start = np.log(self.start) if log else self.start
        here = density if log else np.exp(density - top[:, None])
        out = move[None] + here[:, None] if log else move[None] * here[:, None]
        if first and len(x):
            out[0] = (start + here[0] if log else start * here[0])[None]
        return out, top


def times(a: np.ndarray, b: np.ndarray, log: bool) -> np.ndarray:
    """Product of matrices in the chosen algebra; sums are kept near one, as only directions matter."""
    if log:
        return (a[..., :, :, None] + b[..., None, :, :]).max(-2)
    out = a @ b
    return out / out.max(axis=(-2, -1), keepdims=True)


def product(m: np.ndarray, log: bool) -> np.ndarray:
    """Product of matrices in order, two by two."""
    while len(m) > 1:
        even = times(m[0 : len(m) // 2 * 2 : 2], m[1::2], log)
        m = np.concatenate([even, m[len(m) // 2 * 2 :]])
    return m[0]


def unit(v: np.ndarray, log: bool) -> np.ndarray:
    return v - v.max() if log else v / v.sum()


def scanned(m: np.ndarray, into: np.ndarray, out_of: np.ndarray, log: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights before and after each matrix, from those before the first and after the last."""
    before, after = np.empty(m.shape[:2]), np.empty(m.shape[:2])
    for i in range(len(m)):
        before[i] = into
        into = unit((into[:, None] + m[i]).max(0) if log else into @ m[i], log)
    for i in range(len(m) - 1, -1, -1):
        after[i] = out_of
        out_of = unit((m[i] + out_of[None]).max(1) if log else m[i] @ out_of, log)
    return before, after


def carries(blocks: DataFrame, key: str, log: bool, fan: int = FAN) -> DataFrame:
    """(key, blk, into, out_of) from (key, blk, m): the weights that reach each block from both ends."""
    kind = blocks.schema[key].dataType.simpleString()
    last = blocks.agg(F.max("blk").alias("n")).first().n
    grouped = blocks.withColumn("_up", int_div("blk", fan))

    def matrices(pdf: pd.DataFrame) -> np.ndarray:
        m = np.stack(pdf["m"].to_list())
        n = round(m.shape[1] ** 0.5)
        return m.reshape(-1, n, n)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        m = matrices(pdf)
        one = np.zeros(m.shape[1]) if log else np.ones(m.shape[1])
        into, out_of = (np.array(pdf[c].iloc[0], float) if c in pdf and pdf[c].iloc[0] is not None else one for c in ("into", "out_of"))
        before, after = scanned(m, into, out_of, log)
        return pd.DataFrame({key: pdf[key], "blk": pdf["blk"], "into": list(before), "out_of": list(after)})

    if last is None or last < fan:
        return blocks.groupBy(key).applyInPandas(scan, f"{key} {kind}, {SCAN}")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        return pd.DataFrame({key: pdf[key].iloc[:1], "blk": pdf["_up"].iloc[:1], "m": [product(matrices(pdf), log).ravel()]})

    upper = carries(staged(grouped.groupBy(key, "_up").applyInPandas(fold, f"{key} {kind}, blk long, m array<double>")), key, log, fan)
    told = grouped.join(upper.withColumnRenamed("blk", "_up"), [key, "_up"])
    return told.groupBy(key, "_up").applyInPandas(scan, f"{key} {kind}, {SCAN}")


def ordered(pdf: pd.DataFrame, row: str) -> tuple[pd.DataFrame, np.ndarray]:
    """A block's rows in order and their values."""
    pdf = pdf.sort_values(row)
    return pdf, np.stack(pdf["x"].to_list()).astype(float)


@dataclass
class Chains:
    """Rows (key, row, x) in blocks, written once."""

    rows: DataFrame
    key: str
    row: str
    fan: int = FAN

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], key: str, row: str, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> Chains:
        """``row`` numbers the rows of each key from 0 without gaps."""
        x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
        return cls(staged(df.select(key, F.col(row).cast("long").alias(row), int_div(row, block_rows).alias("blk"), x).repartition(key, "blk")), key, row, fan)

    def head(self) -> str:
        return f"{self.key} {self.rows.schema[self.key].dataType.simpleString()}"

    def reached(self, models: Mapping[object, Model], log: bool) -> DataFrame:
        """Blocks with the weights that reach them."""
        key, row = self.key, self.row

        def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, x = ordered(pdf, row)
            m, _ = models[pdf[key].iloc[0]].matrices(x, pdf["blk"].iloc[0] == 0, log)
            return pd.DataFrame({key: pdf[key].iloc[:1], "blk": pdf["blk"].iloc[:1], "m": [product(m, log).ravel()]})

        products = self.rows.groupBy(self.key, "blk").applyInPandas(multiply, f"{self.head()}, blk long, m array<double>")
        return carries(staged(products), self.key, log, self.fan)

    def in_blocks(self, reached: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(key, first, rows, x, into, out_of)`` of every block."""
        key, row = self.key, self.row

        def each(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            pdf, x = ordered(pdf, row)
            return fn(pdf[key].iloc[0], pdf["blk"].iloc[0] == 0, pdf, x, np.array(told["into"].iloc[0]), np.array(told["out_of"].iloc[0]))

        return self.rows.groupBy(self.key, "blk").cogroup(reached.groupBy(self.key, "blk")).applyInPandas(each, schema)

    def sums(self, models: Mapping[object, Model]) -> dict[object, np.ndarray]:
        """Expected counts of each key, flat: start, moves, state weights, weighted sums and squares, log likelihood."""

        column = self.key

        def expected(key, first, pdf, x, into, out_of):
            model = models[key]
            m, top = model.matrices(x, first, False)
            before, after = scanned(m, unit(into, False), out_of, False)
            both = before[:, :, None] * m * after[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            weight = both.sum(1)
            gain = np.log(np.einsum("ti,tij->t", before / before.sum(1, keepdims=True), m)).sum() + top.sum()
            start, moves = (weight[0], both[1:].sum(0)) if first else (np.zeros(model.states), both.sum(0))
            flat = [start, moves.ravel(), weight.sum(0), (weight.T @ x).ravel(), (weight.T @ x**2).ravel(), [gain]]
            flat = np.concatenate(flat)
            return pd.DataFrame({column: [key] * len(flat), "at": np.arange(len(flat)), "v": flat})

        found = self.in_blocks(self.reached(models, False), expected, f"{self.head()}, at int, v double").groupBy(self.key, "at").agg(F.sum("v").alias("v"))
        out: dict[object, list] = {}
        for r in found.orderBy(self.key, "at").collect():  # some dozens of numbers a key
            out.setdefault(r[self.key], []).append(r.v)
        return {k: np.array(v) for k, v in out.items()}

    def fit(self, models: Mapping[object, Model], rounds: int = 200, tolerance: float = 1e-2) -> tuple[dict[object, Model], dict[object, list[float]]]:
        """Expectation-maximization from given models: (models, log likelihoods of every round). A key stops once a round gains less than ``tolerance``."""
        models, curve = dict(models), {k: [] for k in models}
        live = set(models)
        for _ in range(rounds):
            some = self if len(live) == len(models) else Chains(self.rows.where(F.col(self.key).isin(sorted(live))), self.key, self.row, self.fan)
            for k, flat in some.sums(models).items():
                gain = flat[-1]
                if curve[k] and gain - curve[k][-1] < tolerance:
                    live.discard(k)
                else:
                    models[k] = updated(flat, models[k])
                curve[k].append(float(gain))
            if not live:
                break
        return models, curve

    def path(self, models: Mapping[object, Model]) -> DataFrame:
        """(key, row, state): the most likely path of every key. Equal paths are told apart at each row by the smaller state."""

        column, row = self.key, self.row

        def walk(key, first, pdf, x, into, out_of):
            m, _ = models[key].matrices(x, first, True)
            before, after = scanned(m, into, out_of, True)
            best = (before[:, :, None] + m + after[:, None, :]).max(1).argmax(1)
            return pd.DataFrame({column: pdf[column], row: pdf[row], "state": best.astype(np.int64)})

        return self.in_blocks(self.reached(models, True), walk, f"{self.head()}, {self.row} long, state long")


def updated(flat: np.ndarray, model: Model) -> Model:
    """Parameters of most likelihood for expected counts; a state that nothing reaches keeps its own."""
    n, d = model.states, model.mean.shape[1]
    start, moves, weight, total, square = np.split(flat[:-1], np.cumsum([n, n * n, n, n * d]))
    moves, total, square = moves.reshape(n, n), total.reshape(n, d), square.reshape(n, d)
    left, used = moves.sum(1, keepdims=True), weight[:, None] > 1e-9
    mean = np.where(used, total / np.maximum(weight, 1e-300)[:, None], model.mean)
    variance = np.where(used, np.maximum(square / np.maximum(weight, 1e-300)[:, None] - mean**2, MIN_VARIANCE), model.variance)
    return Model(start / start.sum(), np.where(left > 1e-9, moves / np.maximum(left, 1e-300), model.move), mean, variance)


def first_models(df: DataFrame, features: Sequence[str], key: str, states: Mapping[object, int], by: str) -> dict[object, Model]:
    """Starting models: the rows of each key cut into as many parts as states at exact percentiles of ``by``."""
    wanted = {n: [i / n for i in range(1, n)] for n in set(states.values())}
    parts = []
    for n, shares in wanted.items():
        some = df.where(F.col(key).isin([k for k, v in states.items() if v == n]))
        cuts = some.groupBy(key).agg(F.percentile(by, F.array(*map(F.lit, shares))).alias("cuts"))
        state = F.size(F.filter("cuts", lambda c: c < F.col(by)))
        parts.append(some.join(F.broadcast(cuts), key).withColumn("_s", state))
    out: dict[object, Model] = {}
    for part in parts:
        for r in part.groupBy(key, "_s").agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)]).collect():
            n, d = states[r[key]], len(features)
            model = out.setdefault(r[key], Model(np.full(n, 1 / n), np.full((n, n), 0.1 / max(1, n - 1)) + np.eye(n) * (0.9 - 0.1 / max(1, n - 1)), np.zeros((n, d)), np.ones((n, d))))
            model.mean[r["_s"]] = [r[f"m{i}"] for i in range(d)]
            model.variance[r["_s"]] = [max(r[f"v{i}"], MIN_VARIANCE) for i in range(d)]
    return out


#: Fewest rows of a fit, rows for each state, most states.
MIN_ROWS, ROWS_PER_STATE, MOST_STATES = 300, 250, 3


def hidden_regimes(
    rows: DataFrame, features: Sequence[str], span: int, key: str = "product_id", order: str = "open_time", by: str | None = None,
    rounds: int = 200, block_rows: int = BLOCK_ROWS, fan: int = FAN,
) -> DataFrame:
    """(key, order, features, state): the most likely hidden states of each key, on its standardized complete rows.

    Rows with a missing or infinite feature are left out, and keys with fewer than ``MIN_ROWS`` others have no states. Models start from rows cut at percentiles of
    ``by`` (default: the first feature), so a fit has no random part. ``span`` is the width of a numbering block in units of ``order``.
    """
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")) for f in features]
    kept = staged(number_rows(rows.select(key, order, *features).where(all_of(finite)), [key], order, span, "_row"))
    facts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)])
    facts = staged(facts.where(F.col("_n") >= MIN_ROWS))
    states = {r[key]: min(MOST_STATES, max(2, r["_n"] // ROWS_PER_STATE)) for r in facts.select(key, "_n").collect()}  # a number a key
    if not states:
        return kept.limit(0).select(key, order, *features, F.lit(0).cast("long").alias("state"))
    spread = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i in range(len(features))]
    z = {f: (F.col(f) - F.col(f"_m{i}")) / s for i, (f, s) in enumerate(zip(features, spread, strict=True))}
    scaled = staged(attach(kept, facts, [key]).select(key, "_row", *[c.alias(f) for f, c in z.items()]))
    chains = Chains.of(scaled, features, key, "_row", block_rows, fan)
    models, _ = chains.fit(first_models(scaled, features, key, states, by or features[0]), rounds)
    return kept.join(chains.path(models), [key, "_row"]).drop("_row")
