"""What language identification counts as a letter."""

import numpy as np

from tapeflow.llm import language_id as L


def test_numbers_and_signs_are_no_letters():
    for text in ("½", "²³", "Ⅷ", "①", "12 _ 3", "...", "́", "😀", "", None):
        assert L.gram_counts(text) is None, text
    for text in ("a", "É", "漢", "ǅ", "ª", "x²", "ʰ"):
        assert L.gram_counts(text) is not None, text


def test_marks_stay_with_their_letters():
    same = lambda a, b: all(map(np.array_equal, L.gram_counts(a), L.gram_counts(b)))
    assert not same("हिन्दी", "ह न द")
    assert not same("été", "e te")
    assert same("un,deux  trois9", "un deux trois")
