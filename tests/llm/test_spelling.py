"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeflow.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for x in RUN.findall(text or ""):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{x}".encode())
            if h % 199 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            if len(x) >= 6:
                total[x] += 1
    return total


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        mine = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(mine, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(mine)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], form[w] and words[form[w]]))
    return rows


def collected(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(4)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 25, 26, 130, 700, 3_500]) for _ in range(700)}
    for i, (w, n) in enumerate((("aaaaaa", 5), ("aaaaaaa", 25), ("aaaaaaaa", 125), ("aaaaaaaaa", 625), ("aaaaaaaaaa", 3_125), ("zebraÿ", 5), ("zebraz", 25), ("zebraÀ", 25))):
        words[w] = n
    words["x" * 400] = 5
    words["x" * 401] = 50
    return words


def test_variants_are_the_plain_ones(spark, vocabulary):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    want = brute(vocabulary)
    assert collected(S.variants(df)) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])
    # cells of few words: many cells, and groups of letters in parts
    assert collected(S.variants(df, cell_words=40)) == want
    assert collected(S.variants(df.limit(0))) == set()


def test_words_of_documents(spark, docs, rows, no_docs):
    assert {r.word: r.n for r in S.corpus_words(docs).collect()} == dict(brute_words(rows))
    rng = random.Random(6)
    syllables = "ka lo mi ten ra vu shi on er zu pol né ÿs".split()
    texts = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).title() for _ in range(400)), "", "", 1) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n long")
    words = brute_words(texts)
    assert {r.word: r.n for r in S.corpus_words(frame).collect()} == dict(words)
    assert collected(S.digest(frame)) == brute({w: n for w, n in words.items() if n >= 5})
    assert collected(S.digest(docs)) == brute({w: n for w, n in brute_words(rows).items() if n >= 5})
    assert S.digest(no_docs).count() == 0


def test_index_intervals_hold_all_places():
    words = ["banana", "ananas", "bandan", "nanban"]
    index = S.Index(words)
    text = "\n" + "\n".join(words) + "\n"
    rng = random.Random(1)
    for _ in range(300):
        state, pattern = index.all(1), ""
        for _ in range(rng.randint(1, 5)):
            c, left = rng.choice("abnds\n"), rng.random() < 0.5
            pattern = c + pattern if left else pattern + c
            state = index.extend(state, index.coded(np.array([ord(c)])), left)
        want = [i for i in range(len(text)) if text.startswith(pattern, i)]
        assert int(state[2][0]) == len(want), pattern
        if want:
            lo = int(state[0][0])
            assert sorted(index.order[lo : lo + len(want)].tolist()) == want
