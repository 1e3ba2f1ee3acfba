"""Hidden Markov models in blocks against plain sequential code."""

import itertools

import numpy as np
import pytest

from tapeflow.operators import hidden_states as H


def log_sum(a, axis=None):
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def sequential(model, x):
    """Expected counts, log likelihood and best path by textbook recursions in logs."""
    b, move = model.emission(x), np.log(model.move)
    n, k = b.shape
    alpha, beta, best, back = np.empty((n, k)), np.zeros((n, k)), np.empty((n, k)), np.zeros((n, k), int)
    alpha[0] = best[0] = np.log(model.start) + b[0]
    for t in range(1, n):
        alpha[t] = log_sum(alpha[t - 1][:, None] + move, 0) + b[t]
        best[t] = (best[t - 1][:, None] + move).max(0) + b[t]
        back[t] = (best[t - 1][:, None] + move).argmax(0)
    for t in range(n - 2, -1, -1):
        beta[t] = log_sum(move + (b[t + 1] + beta[t + 1])[None], 1)
    total = log_sum(alpha[-1])
    weight = np.exp(alpha + beta - total)
    moves = sum(np.exp(alpha[t - 1][:, None] + move + (b[t] + beta[t])[None] - total) for t in range(1, n)) + np.zeros((k, k))
    path = [int(best[-1].argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.concatenate([weight[0], moves.ravel(), weight.sum(0), (weight.T @ x).ravel(), (weight.T @ x**2).ravel(), [total]]), path[::-1]


def series(rng, n, k):
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.93 else int(rng.integers(k))
        out.append(rng.normal([state * 1.5, -state], [0.6 + 0.3 * state, 0.8]))
    return np.array(out)


def model(rng, k):
    move = rng.dirichlet(np.ones(k), k) * 0.4 + 0.6 * np.eye(k)
    return H.Model(rng.dirichlet(np.ones(k)), move, rng.normal(size=(k, 2)), rng.uniform(0.5, 2, (k, 2)))


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    data = {"A": series(rng, 700, 3), "B": series(rng, 333, 2), "C": series(rng, 1, 2), "D": series(rng, 64, 2)}
    rows = [(p, i, float(a), float(b)) for p, x in data.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "product_id string, n long, u double, v double").repartition(5)
    return data, {p: model(rng, 3 if p == "A" else 2) for p in data}, df


@pytest.mark.parametrize("block_rows, fan", [(32, 4), (10_000, 100)])
def test_blocks_give_the_sequential_counts_and_path(case, block_rows, fan):
    data, models, df = case
    chains = H.Chains.of(df, ["u", "v"], "product_id", "n", block_rows, fan)  # 22 blocks in groups of 4: three levels
    got = chains.sums(models)
    paths = {}
    for r in chains.path(models).collect():
        paths.setdefault(r.product_id, {})[r.n] = r.state
    for p, x in data.items():
        want, path = sequential(models[p], x)
        np.testing.assert_allclose(got[p], want, rtol=1e-8, atol=1e-8)
        assert [paths[p][i] for i in range(len(x))] == path


def test_small_chain_against_all_paths(spark):
    rng = np.random.default_rng(2)
    x, m = series(rng, 6, 2), model(rng, 2)
    df = spark.createDataFrame([("A", i, *map(float, r)) for i, r in enumerate(x)], "product_id string, n long, u double, v double")
    b = m.emission(x)
    score = {s: np.log(m.start[s[0]]) + b[0][s[0]] + sum(np.log(m.move[s[t - 1], s[t]]) + b[t][s[t]] for t in range(1, 6)) for s in itertools.product((0, 1), repeat=6)}
    chains = H.Chains.of(df, ["u", "v"], "product_id", "n", 2, 2)
    assert tuple(r.state for r in chains.path({"A": m}).orderBy("n").collect()) == max(score, key=score.get)
    assert abs(chains.sums({"A": m})["A"][-1] - log_sum(np.array(list(score.values())))) < 1e-9


def test_fit_rises_and_finds_the_states(spark):
    rng = np.random.default_rng(9)
    truth, rows = {}, []
    for p, n in (("A", 900), ("B", 400), ("C", 40)):
        state = (np.arange(n) // 50 % 2).tolist()
        truth[p] = state
        rows += [(p, 60_000 * i, float(rng.normal(3 * s, 1)), float(rng.normal(-2 * s, 1 + s))) for i, s in enumerate(state)]
    rows += [("A", 60_000 * 2_000, None, 1.0), ("B", 60_000 * 2_000, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "product_id string, open_time long, u double, v double")
    found = {}
    for r in H.hidden_regimes(df, ["u", "v"], 60_000 * 256, rounds=6, block_rows=128, fan=3).collect():
        found.setdefault(r.product_id, {})[r.open_time // 60_000] = r.state
    assert set(found) == {"A", "B"} and len(found["B"]) == 400 and len(set(found["A"].values())) == 3
    same = sum(found["B"][i] == s for i, s in enumerate(truth["B"])) / 400
    assert same > 0.97
    models = {"B": H.Model(np.ones(2) / 2, np.full((2, 2), 0.5), np.array([[0.0, 0], [3, -2]]), np.ones((2, 2)))}
    chains = H.Chains.of(df.where("product_id = 'B' AND open_time < 24000000").selectExpr("product_id", "open_time div 60000 AS n", "u", "v"), ["u", "v"], "product_id", "n", 64)
    _, curve = chains.fit(models, rounds=5, tolerance=1e-9)
    assert all(b > a for a, b in zip(curve["B"], curve["B"][1:])) and len(curve["B"]) == 5


def test_no_key_has_enough_rows(spark):
    df = spark.createDataFrame([("A", 1, 0.5, 0.5)], "product_id string, open_time long, u double, v double")
    assert H.hidden_regimes(df, ["u", "v"], 1_000).count() == 0
