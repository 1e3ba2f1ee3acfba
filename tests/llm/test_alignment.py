"""Tokenizer alignment against the two libraries and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tapeflow.llm import alignment as A


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text as (id, bytes) by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.file_path(A.DEFAULT_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.file_path(A.DEFAULT_B))
    letters = A.byte_letters()

    def tokens(text):
        mine = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        name = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        other = [(i, name(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        if not text or b"".join(x for _, x in mine) != whole or b"".join(x for _, x in other) != whole:
            return [], []
        return mine, other

    return tokens


def groups(mine, other):
    def ends(tokens):
        at, out = 0, {}
        for i, (_, x) in enumerate(tokens):
            at += len(x)
            out[at] = i
        return out

    a, b = ends(mine), ends(other)
    out, i, j = [], 0, 0
    for e in sorted(a.keys() & b.keys()):
        out.append(([t for t, _ in mine[i : a[e] + 1]], [t for t, _ in other[j : b[e] + 1]]))
        i, j = a[e] + 1, b[e] + 1
    return out


def brute(texts, tokens):
    per = [(groups(*tokens(t)), *map(len, tokens(t))) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for gs, _, _ in per for g in gs)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for gs, n_a, n_b in per:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        sha = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out.append((n_a, n_b, len(gs), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out, count


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_digest_is_the_plain_one(docs, rows, no_docs, plain):
    want, count = brute([r[1] or "" for r in rows], plain)
    documents, pairs = A.aligned(docs)
    assert documents.columns == COLUMNS
    assert Counter(map(tuple, documents.collect())) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == dict(count)
    assert A.digest(no_docs).count() == 0
    assert sum(w[0] == 0 for w in want) >= 4


def test_few_broadcast_pairs_change_nothing(spark, docs, rows, plain):
    want, _ = brute([r[1] or "" for r in rows], plain)
    documents, _ = A.aligned(docs.repartition(7), hot_pairs=3)
    assert Counter(map(tuple, documents.collect())) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))


def odd_texts(n):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\n\n", "\t", " \n ", "\xa0", "　", " ", " ", "᠎", "\x1c", "\x85", "\r\n", "a", "The", "don't", "it's", "'s", "'", "1234"]
    bits += ["漢字", "é", "😀", "👩‍👩‍👧", "▁", "<s>", "<0x41>", "<|endoftext|>", "!!", "...", "x" * 70, "\x00", "naïve", "Ünï", "ñ", "हिन्दी", "ﬁ", "é"]
    bits += ["​", "﻿", "½", "word", "quick", "--", "http://a.b/c?d=e", "{}", "0x1F"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_odd_texts_have_the_tokens_of_the_libraries(spark, plain):
    texts = odd_texts(3_000)
    table = A.Pieces(A.Pair(A.file_path(A.DEFAULT_A), A.file_path(A.DEFAULT_B)))
    assert table.pair.ranks is not None
    for t in texts:
        found = table.pair.cut.findall(" " + t) if t else []
        known = dict(zip(dict.fromkeys(found), table.rows(list(dict.fromkeys(found))), strict=True))
        want = groups(*plain(t))
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        if any(known[x][0] < 0 for x in found):
            assert not want, repr(t)
        else:
            assert ";".join(known[x][3] for x in found) == text, repr(t)


def test_generations_keep_what_is_used(monkeypatch):
    monkeypatch.setattr(A, "TABLE_ROWS", 3)
    table = A.Pieces(A.Pair(A.file_path(A.DEFAULT_A), A.file_path(A.DEFAULT_B)))
    first = table.rows([" one", " two"])
    for i in range(20):
        table.rows([f" w{i}", " one"])
    assert " one" in table.young | table.old and len(table.young) <= 5 and " two" not in table.young | table.old
    assert table.rows([" two"]) == first[1:]
