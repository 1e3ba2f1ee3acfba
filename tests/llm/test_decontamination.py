"""Benchmark decontamination against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import CLASHES, COLUMNS

from tapeflow.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    mine = words(text)
    hit, names = set(), set()
    for item_id, other in items:
        other = words(other)
        n = min(window, len(other))
        windows = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if tuple(mine[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add("" if item_id is None else str(item_id))
    joined = ",".join(sorted(names))
    most = max(len(words(t)) for _, t in items)
    longest = max([n for n in range(1, min(len(mine), most) + 1) if any_run(mine, items, n, window)], default=0) if hit else 0
    return len(mine), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit), longest


def any_run(mine, items, n, window):
    grams = {tuple(mine[i : i + n]) for i in range(len(mine) - n + 1)}
    for _, other in items:
        other = words(other)
        if n >= min(window, len(other)) and any(tuple(other[i : i + n]) in grams for i in range(len(other) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]  # few words: ties, overlaps and repeats everywhere
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = line(40)
    items = [
        (1, " ".join(passage)), (10, " ".join(passage[5:30]).upper()), (2, " ".join(line(25))), (2, " ".join(line(14))), (3, "short item ends"),
        (4, ""), (5, None), (None, " ".join(line(11))), (6, "éÉ café x"), (7, " ".join(passage)), (8, "!!! ... ?"), (9, "solo"),
    ]
    docs = []
    for i in range(80):
        text = line(rng.randint(0, 120))
        if i % 3 == 0:
            a = rng.randrange(28)
            text[len(text) // 2 : len(text) // 2] = passage[a : a + rng.randint(8, 40)]
        if i % 5 == 0:
            text += ["Short", "ITEM", "ends"]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text), None, "s", 1))
    docs += [(90, None, None, None, None), (91, "", None, "s", 0), (92, " -- ", None, "s", 0), (92, " ".join(passage), None, "s", 0), (92, "nothing", None, "s", 0)]
    docs += [(None, " ".join(passage * 3), None, "s", 1), (None, "é café", None, "s", 1), (93, "éÉ CAFé X", None, "s", 1), (94, "solo " * 3_000, None, "s", 1), (94, "solo " * 3_000, None, "s", 1)]
    return docs, items


def frames(spark, case):
    from pyspark.sql import functions as F

    docs, items = case
    return spark.createDataFrame(docs, COLUMNS).withColumns({c: F.lit(1) for c in CLASHES}).repartition(3), spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(0))


def result(df):
    return Counter(tuple(r[c] for c in "doc_id n_words n_hit n_items items_sha256 contaminated longest".split()) for r in df.collect())


def test_digest_is_the_plain_one(spark, case):
    docs, items = case
    got = result(D.digest(*frames(spark, case)))
    assert got == Counter((d[0], *brute(d[1], items)) for d in docs)
    assert sum(n for r, n in got.items() if r[5]) > 30


def test_blocks_of_items_and_small_shards_change_nothing(spark, case):
    docs, items = case
    want = Counter((d[0], *[brute(d[1], items)[i] for i in (0, 1, 5)]) for d in docs)
    for options in ({"block_bytes": 300}, {"shard_words": 1}, {"block_bytes": 200, "shard_words": 50}):
        found = D.contamination(*frames(spark, case), **options)
        assert Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "longest").collect()) == want
        named = Counter((r.doc_id, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect())
        assert named == Counter((d[0], brute(d[1], items)[3]) for d in docs)


def test_other_windows_and_matches(spark, case):
    docs, items = case
    frame, tests = frames(spark, case)
    got = Counter((r.doc_id, r.n_hit) for r in D.contamination(frame, tests, window=3).collect())
    assert got == Counter((d[0], brute(d[1], items, 3)[1]) for d in docs)
    by_id = {str(i): [words(t) for j, t in items if j == i] for i, _ in items}
    for r in D.matches(frame, tests, only_hits=True).collect():
        texts = [words(d[1]) for d in docs if d[0] == r.doc_id]
        for m in r.matches:
            run = [t[m.doc_word : m.doc_word + m.n_words] for t in texts]
            others = by_id["None" if m.item_id == "" else m.item_id]
            assert any(run_ == o[m.item_word : m.item_word + m.n_words] and len(run_) == m.n_words for run_ in run for o in others)


def test_affected_documents_go(spark, case):
    docs, items = case
    frame, tests = frames(spark, case)
    kept = D.decontaminated(frame, tests)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d[0], d[1]) for d in docs if not brute(d[1], items)[4])


def test_empty_tables(spark, case):
    frame, tests = frames(spark, case)
    assert D.digest(frame.limit(0), tests).count() == 0
    none = result(D.digest(frame, tests.limit(0)))
    assert sum(none.values()) == len(case[0]) and not any(r[5] for r in none)
    assert D.decontaminated(frame, tests.limit(0)).count() == len(case[0])
