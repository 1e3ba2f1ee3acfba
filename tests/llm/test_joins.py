"""Operators on pairs, components and the pipeline, against plain Python."""

import math
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from plain import brute_lines, brute_rules

from tapeflow import session
from tapeflow.llm import mixing, ngram_join, packing, vector_join
from tapeflow.llm.components import components, roots


def reached(nodes, links):
    """Least node that links reach."""
    out = {n: n for n in nodes}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if out[y] > n:
                    out[y] = n
                    todo.append(y)
    return out


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4))}


def brute_near(rows):
    """doc_id, class_id, n_links, copy_of of rows with ids."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    links, pairs, least = Counter(), [], {}
    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets):
            if i != j and s and len(s & t) * 5 >= 4 * len(s | t):
                links[i] += 1
                pairs.append((a, b))
        if s:
            least[frozenset(s)] = min(a, least.get(frozenset(s), a))
    group = reached({a for a, _ in sets}, pairs)
    return Counter((a, group[a], links[i], least.get(frozenset(s), a)) for i, (a, s) in enumerate(sets))


@pytest.mark.parametrize("block", [1024, 2])
def test_ngram_join(docs, rows, no_docs, block):
    join = ngram_join.Join(block=block)
    got = ngram_join.near_duplicates(docs, join).collect()
    assert Counter(tuple(r)[:4] for r in got if r["doc_id"] is not None) == brute_near(rows)
    none = [r for r in got if r["doc_id"] is None]
    assert len(none) == 2 and all(r["class_id"] is None and r["n_links"] == 0 and r["kept"] for r in none)
    assert sum(r["n_links"] for r in got) > 10
    if block == 1024:
        assert ngram_join.near_duplicates(no_docs).count() == 0
        kept = ngram_join.without_duplicates(docs)
        gone = {r["doc_id"] for r in got if not r["kept"]}
        assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in gone)


def test_one_id_with_several_texts_keeps_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near_a, near_b = a.replace("a59", "z"), b.replace("b59", "z")
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (5, a), (5, c), (5, c), (6, near_b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs)
    assert got.columns == ["doc_id", "class_id", "n_links", "copy_of", "kept"]
    assert Counter((r["doc_id"], r["n_links"]) for r in got.collect()) == Counter([(1, 2), (1, 2), (2, 2), (3, 2), (5, 2), (5, 1), (5, 1), (6, 2)])
    kept = Counter(tuple(r) for r in ngram_join.without_duplicates(docs).collect())
    assert kept == Counter([(1, a), (1, b), (5, c), (5, c)])


def test_a_large_group_of_near_copies_loses_no_link(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Join(block=16)).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_near(rows)
    assert sum(r["n_links"] for r in got) > 3000


def test_posterior_needs_fewer_matches_than_any_true_pair_lacks():
    need = ngram_join.least_matches(Fraction(4, 5), 1e-9)
    assert need == sorted(need)
    for n, least in zip(range(16, 129, 16), need, strict=True):
        missed = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert least > 0 and missed < 1e-8


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reached({x for p in links for x in p}, links)
    assert all(want[n] == c for n, c in got.items()) and {n for p in links if p[0] != p[1] for n in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    i, j = (np.array(x) for x in zip(*[p for p in links if max(p) < 300], strict=True))
    assert roots(i, j, 300).tolist() == [reached(range(300), [p for p in links if max(p) < 300])[k] for k in range(300)]


@pytest.mark.parametrize("members", [2048, 3])
def test_vector_join(spark, members):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 20))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.standard_normal(20) * (0.22 if i % 3 else 1.5)
        rows.append([i, [float(np.float32(x)) for x in v], int(i % 2)])
    rows += [[200 + i, rows[i][1], rows[i][2]] for i in (3, 3, 9)]
    rows += [[300, rows[0][1], None], [301, None, 1], [302, [], 1], [303, [0.0] * 20, 1], [304, [1.0, None] * 10, 1], [305, [float("nan")] * 20, 1]]
    rows += [[306, [float("inf")] * 20, 1], [307, [1.0, 2.0], 1], [308, [2.0, 4.0], 1], [None, rows[0][1], 0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS key", "3 AS kept")
    good = [(r[0], np.array(r[1], float), r[2]) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links, pairs = Counter(), []
    for i, (a, v, x) in enumerate(good):
        for j, (b, w, y) in enumerate(good):
            if i != j and x == y and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.93:
                links[i] += 1
                pairs.append((a, b))
    ids = [r[0] for r in rows]
    group = reached({i for i in ids if i is not None}, pairs)
    got = vector_join.near_vectors(table, vector_join.Search(members=members)).collect()
    want = Counter((r[0], links[i], group[r[0]], r[0] == group[r[0]]) for i, r in enumerate(good))
    want.update((i, 0, i, True) for i in ids if i not in {g[0] for g in good})
    assert Counter(map(tuple, got)) == want
    assert sum(links.values()) > 100
    if members == 2048:
        assert vector_join.near_vectors(table.limit(0)).count() == 0


def test_vectors_are_written_once_and_not_copied_to_be_compared(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 64)).astype(np.float32)
    v[1::4] = v[::4] + rng.standard_normal((1000, 64)).astype(np.float32) * 0.3
    label = rng.integers(0, 3, 4000)
    label[1::4] = label[::4]
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum(1) - 1
    table = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int")
    before = {p for paths in session._STAGED.values() for p in paths}
    got = {r.vec_id: r.n_links for r in vector_join.near_vectors(table, vector_join.Search(members=100)).collect()}
    assert [got[i] for i in range(4000)] == want.tolist() and want.sum() > 1000
    written = [Path(p.removeprefix("file:")) for paths in session._STAGED.values() for p in paths if p not in before]
    assert sum(f.stat().st_size for p in written for f in p.rglob("*.parquet")) < 2 * v.nbytes


def test_pipeline_stages_against_plain_python(spark, docs, first_rows):
    """Each stage on what the one before kept."""
    docs = spark.createDataFrame(first_rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, "")
    rows = [r for r in first_rows if brute_rules(r[1])[6]]
    assert Counter(map(tuple, good.collect())) == Counter(rows)
    lines = stage["line_dedup"](spark, good, "")
    want = {w[0]: w[3] for w in brute_lines(rows)}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = brute_near([(i, t) for i, t in want.items()])
    kept = {a for a, c, _, _ in near if a == c}
    distinct = stage["ngram_join"](spark, lines, "")
    assert {r["doc_id"] for r in distinct.collect()} == kept and distinct.columns == docs.columns
    mix = stage["mixing"](spark, distinct, "")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(distinct).collect()}
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({i: n for i, n in plan.items() if n}) and mix.columns == docs.columns
    table = packing.word_table(packing.tokenizer_path())
    total = sum(n * (len(table.tokenizer.encode(want[i], add_special_tokens=False).ids) + 1) for i, n in plan.items())
    assert stage["packing"](spark, mix, "").groupBy().sum("length").first()[0] == total


def test_pipeline_runs_whole(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns
