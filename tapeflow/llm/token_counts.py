"""Token counts with a whole-token shortcut (operator 3).

The vocabulary shows where no merge can reach: no piece has a word-start mark after another letter,
and some characters stand in no piece of two or more. Texts are cut there, so pieces of text encode
alone as they do inside; letters are cut off a word's end while no piece has them after the one before. A proof
over the vocabulary, done once per worker with the library itself, lists the strings that encode alone as one token; pre-tokens found in that list count one each.
Only the rest go to the library, once per distinct string and worker while its table has room.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import narrow, texts, utf8

MARK = "▁"
#: Distinct other pre-tokens remembered per worker, and the longest one remembered.
TABLE_ROWS, TABLE_CHARS = 300_000, 64
DEFAULT_MODEL = "piece_bpe_32k.model"


class PieceCounter(dict):
    """Token count by pre-token, for a sentencepiece BPE model with a dummy prefix.

    Keys are the text of a word without its leading mark. Keys that start with a newline stand for
    what follows such a boundary, where no mark is put.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        real = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        if any(MARK in p.lstrip(MARK) for p in real):
            raise ValueError("a piece has a word start inside; texts can't be cut at word starts")
        if any("\n" in p for p in real):
            raise ValueError("newlines merge in this vocabulary")
        if self.model.encode("a", out_type=str) != [MARK + "a"] or self.model.encode("a  b ", out_type=str) != [MARK + "a", MARK, MARK + "b", MARK]:
            raise ValueError("the model normalizes white space")
        #: letters that some piece has side by side; no merge joins others
        self.joined = {p[i : i + 2] for p in real for i in range(len(p) - 1)}
        self.newline = len(self.model.encode("\n")) - 1
        self.mark = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.single = self.prove(real)
        self.fixed = len(self.single)
        self.update(self.single)

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """Which vocabulary strings encode alone as one token, as word or after a newline."""
        starts = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
        proven = {w: 1 for w, ids in zip(starts, self.model.encode(starts, num_threads=1), strict=True) if len(ids) == 1}
        inner = [p for p in pieces if MARK not in p]
        # the mark before the newline and the newline itself come first
        alone = self.model.encode(["\n" + p for p in inner], num_threads=1)
        return proven | {"\n" + p: 1 for p, ids in zip(inner, alone, strict=True) if len(ids) == 2 + self.newline - 1}

    def merge(self, word: str) -> int:
        """Tokens of a pre-token by the library."""
        n = len(self.model.encode(word, num_threads=1))
        return n - 1 - self.newline if word[:1] == "\n" else n

    def __missing__(self, word: str) -> int:
        # a loop: runs of letters that no piece joins can be as long as the text
        end, n = len(word), 0
        while end > 1 and word[end - 2] not in "\n " and word[end - 1] != " " and word[end - 2 : end] not in self.joined:
            end -= 1
            n += self.known("\n" + word[end])
        if end == len(word):
            return self.keep(word, self.merge(word))
        return self.keep(word, n + self.known(word[:end]))

    def known(self, word: str) -> int:
        """Tokens of a word from whose end nothing can be cut."""
        n = self.get(word)
        return self.keep(word, self.merge(word)) if n is None else n

    def keep(self, word: str, n: int) -> int:
        if len(word) <= TABLE_CHARS:
            if len(self) > self.fixed + TABLE_ROWS:
                self.clear()
                self.update(self.single)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        total = 0
        look = self.__getitem__
        for i, line in enumerate(text.split("\n")):
            if i:
                total += self.newline
                head, space, line = line.partition(" ")
                if head:
                    total += look("\n" + head)
                if not space:
                    continue
            # each space, and the one put before the text, starts a word; spaces in a row merge
            if "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                total += sum(map(self.spaced, re.findall(r" *[^ ]+| +$", " " + line)))
            else:
                total += sum(map(look, line.split(" ")))
        return total

    def spaced(self, run: str) -> int:
        """Tokens of spaces and the word after them; the first space is the prefix put by the model."""
        word = run.lstrip(" ")
        if word and len(run) == len(word) + 1:
            return self[word]
        return self[run[1:]] if len(run) > 1 else self.mark


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit of every row; ``model`` is the file of a sentencepiece BPE model.

    A null or empty text has no bytes and no tokens. Repeated rows and null ids stay as rows; other
    columns are ignored. The file has to be at the same place on all workers; without one, the
    installed public vocabulary is found on each worker.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model or model_path()).count
        for batch in batches:
            found = texts(batch.column(1))
            n = np.fromiter(map(count, found), np.int64, len(found))
            size = np.fromiter((len(utf8(t)) for t in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def digest(docs: DataFrame) -> DataFrame:
    return token_counts(docs).select(F.col("doc_id"), "n_bytes", "n_tokens", "over_limit")
