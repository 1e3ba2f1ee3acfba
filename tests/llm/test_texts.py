"""Operators on single documents and on lines, against plain Python."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from plain import brute_lines, brute_rules

from tapeflow.llm import common, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_counts


def by_text(docs, out, *, key="doc_id"):
    """Rows of a result by id; rows of a null or repeated id as a list."""
    found = defaultdict(list)
    for r in out.collect():
        found[r[key]].append(r)
    return found


def expected(rows, value):
    found = defaultdict(list)
    for doc_id, text, *_ in rows:
        found[doc_id].append(value(doc_id, text))
    return {k: sorted(v) for k, v in found.items()}


def held(found, *columns):
    return {k: sorted(tuple(r[c] for c in columns) for r in v) for k, v in found.items()}


# --- token counts


def test_token_counts_are_those_of_the_library(docs, rows, no_docs):
    model = token_counts.counter(token_counts.model_path()).model
    got = held(by_text(docs, token_counts.digest(docs)), "n_bytes", "n_tokens", "over_limit")
    want = expected(rows, lambda _, t: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096))
    assert got == want
    assert token_counts.digest(no_docs).count() == 0


def test_single_token_proof_is_right():
    counter = token_counts.counter(token_counts.model_path())
    some = [w for w in counter.single if not w.startswith("\n")][::97]
    assert len(some) > 50 and all(len(counter.model.encode(w)) == 1 for w in some)


def test_long_runs_without_merges_are_counted_as_by_the_library():
    counter = token_counts.counter(token_counts.model_path())
    long = [c * 5_000 for c in "7漢😀•ก"] + ["12233" * 1_000, "漢字かな。" * 900, "a漢" * 3_000, "don't" + "9" * 2_000 + "ing"]
    for text in long + [f"x {t} y\n{t}\n  {t} " for t in long]:
        assert counter.count(text) == len(counter.model.encode(text)), text[:30]


# --- quality rules


def test_quality_rules(docs, rows, no_docs):
    got = held(by_text(docs, quality_rules.digest(docs)), *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept covered_words".split())
    assert got == expected(rows, lambda _, t: brute_rules(t))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(r[1] for r in rows if brute_rules(r[1])[6])
    assert quality_rules.digest(no_docs).count() == 0


def test_longest_repeat_and_lcp():
    for text in ("a b c a b c a", "a a a a", "a b", "", "x y z x y w x y z"):
        words = text.split()
        want = max([k for k in range(1, len(words)) if len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) < len(words) - k + 1], default=0)
        assert quality_rules.measure([text, "x y"], quality_rules.Limits())["longest_repeat"][0] == want


# --- line dedup


def test_line_dedup(docs, rows, no_docs):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = Counter(map(tuple, line_dedup.digest(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    want = brute_lines(rows)
    assert got == Counter((a, b, c, sha(d)) for a, b, c, d in want)
    assert sum(c for _, _, c, _ in want) > 10
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "", r["source"]) for r in out.collect()) == Counter((r[0], w[3], r[3]) for r, w in zip(rows, want, strict=True))
    assert line_dedup.digest(no_docs).count() == 0 and line_dedup.line_dedup(no_docs).columns == no_docs.columns


def test_perfect_hash_is_minimal_and_rejects_by_fingerprint():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64))
    index = line_dedup.PerfectHash(keys)
    assert index.size == len(keys) and sorted(index.index(keys).tolist()) == list(range(len(keys)))
    assert index.index(keys[:0]).tolist() == [] and line_dedup.PerfectHash(keys[:0]).index(keys[:2]).tolist() == [-1, -1]


def test_line_arrays_tell_counts_of_all_lines_and_reject_others():
    import numpy as np

    rng = np.random.default_rng(2)
    entries = np.zeros(3000, line_dedup.ENTRY)
    entries["hash"], entries["print"] = rng.integers(0, 2**63, (2, 3000), np.uint64)
    entries["docs"], entries["last"] = rng.integers(1, 9, 3000), rng.integers(-5, 10**6, 3000)
    arrays = line_dedup.LineArrays(entries)
    docs, last = arrays.probe(entries[::-1])
    assert (docs[::-1] == entries["docs"]).all() and (last[::-1] == entries["last"]).all()
    other = entries.copy()
    other["print"] ^= np.uint64(1 << 40)
    assert not arrays.probe(other)[0].any() and not line_dedup.LineArrays(entries[:0]).probe(other)[0].any()
    # the same place in the hash, another fingerprint
    moved = entries.copy()
    moved["print"] += np.uint64(1)
    moved["hash"] = line_dedup.line_keys(entries) ^ line_dedup.mixed_bits(moved["print"], 7)
    assert (line_dedup.line_keys(moved) == line_dedup.line_keys(entries)).all() and not arrays.probe(moved)[0].any()


def test_blocks_follow_the_bytes_of_texts(docs, rows, no_docs, monkeypatch):
    total = sum(len((r[1] or "").encode()) for r in rows)
    least = common.width(docs.sparkSession)
    assert common.parts_for(docs) == common.parts_for(no_docs) == least
    assert common.parts_for(docs, part_bytes=total // (3 * least)) >= 3 * least
    plain = Counter(map(tuple, line_dedup.digest(docs).collect()))
    monkeypatch.setattr(line_dedup, "parts_for", lambda *a: 3 * least)
    assert Counter(map(tuple, line_dedup.digest(docs).collect())) == plain


# --- suffix dedup


def brute_suffixes(rows, length):
    low = float("-inf")
    order = sorted(range(len(rows)), key=lambda i: (low if rows[i][0] is None else rows[i][0], (rows[i][1] or "").encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "in_block", "hot"), [(100, 4, 1000), (48, 1, 1000), (48, 4, 1)])
def test_suffix_dedup(docs, rows, no_docs, length, in_block, hot):
    """Also with every unsettled string dealt singly."""
    got = suffix_dedup.repeats(docs, length, with_text=False, in_block=in_block, hot=hot)
    assert Counter(map(tuple, got.collect())) == Counter(brute_suffixes(rows, length))
    if length == 100:
        assert suffix_dedup.digest(no_docs).count() == 0
        for r in suffix_dedup.repeats(docs, length).collect():
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])


def test_suffix_dedup_of_contexts_with_over_255_starts(spark):
    """At 900 bytes a context has up to 645 starts; their number took one byte once."""
    import random

    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = [noise(2_000) for _ in range(4)]
    rows = [(i, noise(400 + 37 * i) + shared[i % 4][: 1_200 + 90 * i] + noise(300)) for i in range(8)]
    got = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 900, with_text=False)
    assert Counter(map(tuple, got.collect())) == Counter(brute_suffixes(rows, 900))


def test_suffix_judgement_of_hot_anchors():
    import numpy as np

    seen = np.zeros(6, suffix_dedup.SEEN)
    seen["anchor"], seen["context"], seen["doc"] = [1, 1, 1, 2, 3, 3], [5, 6, 5, 7, 8, 0], [3, 2, 1, 1, 1, 2]
    seen["at"][5] = suffix_dedup.MANY
    codes = np.frombuffer(suffix_dedup.judged([seen])[0], np.uint8).tolist()
    assert codes == [suffix_dedup.REPEATED, suffix_dedup.SEVERAL, suffix_dedup.SEVERAL, suffix_dedup.SOLE, suffix_dedup.SINGLY, suffix_dedup.SINGLY]


# --- mixing


def brute_mix(rows, weights=(5, 2, 1)):
    size = [len((r[1] or "").encode().split()) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {n: sum(z for r, z in zip(rows, size, strict=True) if r[3] == n) for n in names}
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size)
    while open_:  # share by weight, close what is above its limit, share the rest again
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level >= 2 * own[n]}
        if not full:
            target |= {n: weight[n] * level for n in open_}
            break
        target |= {n: 2.0 * own[n] for n in full}
        left -= sum(2 * own[n] for n in full)
        open_ -= full
    return size, own, target


def test_mixing(docs, rows, no_docs):
    size, own, target = brute_mix(rows)
    plan = mixing.mix_plan(docs)
    got = plan.collect()
    want = Counter((r[0], z, own[r[3]]) for r, z in zip(rows, size, strict=True))
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == want
    for name, total in own.items():
        mine = [r for r in got if r["source_size"] == total and abs(r["target"] - target[name]) < 1e-6]
        assert mine, name
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in Counter(x for r in got for x in [r["doc_id"]] * r["copies"]).items()})
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_mix_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix_plan(docs).collect():
        by[r["source_size"], r["target"]][0] += r["taken"]
    for (_, target), (taken, _) in by.items():
        assert abs(taken - target) < 0.02 * target + 50


def test_mixing_runs_without_python(docs):
    plan = mixing.mix_plan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- packing


def test_packing_is_a_round_trip(docs, rows, no_docs):
    table = packing.word_table(packing.tokenizer_path())
    ids = lambda t: table.tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END]
    got = packing.packed(docs).collect()
    docs_of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs_of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        raw = b"".join(int(x).to_bytes(4, "little") for x in r["ids"])
        assert r["ids_crc32"] == zlib.crc32(raw) and r["length"] == len(r["ids"]) > 0
    for doc_id, pieces in docs_of.items():
        want = Counter(tuple(ids(r[1])) for r in rows if r[0] == doc_id)
        if sum(want.values()) == 1:
            (whole,) = want
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(whole) and p["ids"] == list(whole[at : at + p["length"]])
                at += p["length"]
            assert at == len(whole)
        else:
            assert sum(p["length"] for p in pieces) == sum(len(k) * n for k, n in want.items())
    assert set(docs_of) == {r[0] for r in rows}
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed(no_docs).count() == 0


def test_words_have_the_ids_of_the_library(monkeypatch):
    rng = random.Random(1)
    letters = "aAbBéÉñİıſßªº½²'\u2019.,-_|<>12\u0301\u00ad\x01\xa0\x85 \n\tΣσς漢😀ŉǅɐ"
    some = ["İstanbul's", "don'T'll 12½ ª'veº <|endoftext|> a<|b e\u0301 ﬁ a\x01b", "'s't're", "", "x" * 3000, "हिन्दी漢字!!"]
    some += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    for rows, proven in ((300_000, True), (500, True), (300_000, False)):
        monkeypatch.setattr(packing, "TABLE_ROWS", rows)
        table = packing.WordTable(packing.tokenizer_path())
        assert table.merges.proven
        table.merges.proven = proven
        for i in range(0, len(some), 100):
            ids, per_doc = table.tokens(some[i : i + 100])
            want = [table.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END] for t in some[i : i + 100]]
            assert ids.tolist() == [x for w in want for x in w] and per_doc.tolist() == list(map(len, want))
        assert len(table) <= rows + 3000


def test_other_tokenizers_are_not_merged_by_rank():
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        parts = json.load(f)
    assert not packing.Merges(parts | {"normalizer": None}).proven
    first, second, *rest = parts["model"]["merges"]
    assert not packing.Merges(parts | {"model": parts["model"] | {"merges": [second, first, *rest]}}).proven


def test_hilbert_curve_visits_neighbours():
    import numpy as np

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).max() == 1


# --- language


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs, rows, no_docs):
    got = by_text(docs, language_id.digest(docs))
    for doc_id, text, *_ in rows:
        if doc_id in (80, 81, 83):
            assert [(r["lang_pred"], r["score"]) for r in got[doc_id]] == [("und", 0.0)]
    assert {r["lang_pred"] for v in got.values() for r in v} == {"xy", "und"}
    assert language_id.digest(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, "a word", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.digest(nothing).collect()} == {"und"}


# --- quality classifier


def test_weak_labels_find_known_rates():
    import numpy as np

    rng = np.random.default_rng(0)
    good = rng.random(40_000) < 0.7
    hit = np.array([0.6, 0.7, 0.8])
    votes = np.where(rng.random((len(good), 3)) < 0.1, 0, np.where(~good[:, None] & (rng.random((len(good), 3)) < hit), 2, 1))
    patterns, counts = np.unique(votes @ [9, 3, 1], return_counts=True)
    weak = quality_classifier.WeakLabels.fit(patterns, counts, 3)
    bad = weak.rates[1, :, 2] / weak.rates[1, :, 1:].sum(1)
    assert abs(weak.prior - 0.7) < 0.03 and np.abs(bad - hit).max() < 0.05
    assert weak.good(np.array([13]))[0] > 0.9 > 0.1 > weak.good(np.array([2 * 9 + 4]))[0]


def test_free_weak_labels_find_false_marks_too():
    import numpy as np

    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    false, hit = np.linspace(0.02, 0.1, 7), np.linspace(0.3, 0.8, 7)
    bad = rng.random((len(good), 7)) < np.where(good[:, None], false, hit)
    votes = np.where(rng.random(bad.shape) < 0.1, 0, np.where(bad, 2, 1))
    patterns, counts = np.unique(votes @ 3 ** np.arange(7)[::-1], return_counts=True)
    weak = quality_classifier.WeakLabels.fit(patterns, counts, 7, most_false=None)
    rate = weak.rates[:, :, 2] / weak.rates[:, :, 1:].sum(2)
    assert abs(weak.prior - 0.8) < 0.02 and np.abs(rate[0] - false).max() < 0.01 and np.abs(rate[1] - hit).max() < 0.03


def test_quality_classifier_agrees_with_labels_it_never_saw(spark, sf):
    folder = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.digest(docs, labels).join(labels, "doc_id").collect()
    form = sum((r["form"] >= 0.5) == bool(r["quality"]) for r in rows) / len(rows)
    clean = [r["kept"] for r in rows if r["quality"] and not r["toxic"]]
    toxic = [r["kept"] for r in rows if r["toxic"]]
    assert form > 0.97 and sum(clean) / len(clean) > 0.97 and sum(toxic) / len(toxic) < 0.35


def test_quality_classifier_of_odd_rows(docs, rows, no_docs):
    got = quality_classifier.score_quality(docs, quality_classifier.fit_quality_model(docs)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score_quality(no_docs, quality_classifier.fit_quality_model(no_docs)).count() == 0


def test_quality_rules_hold_the_words_of_one_sort_at_a_time():
    docs = [" ".join(f"w{i}x{j}" for j in range(900)) for i in range(1500)] + ["", "na " * 2000]
    apart = [quality_rules.measure([d], quality_rules.Limits()) for d in docs[-3:]]
    tracemalloc.start()
    got = quality_rules.measure(docs, quality_rules.Limits())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    for name, found in got.items():
        assert found[-3:].tolist() == [x[name][0] for x in apart], name
