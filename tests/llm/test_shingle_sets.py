"""Shingles of a text as a set with occurrences, found text by text."""

from collections import Counter

import numpy as np
import pyarrow as pa

from affinis.llm import near_duplicates as module
from affinis.llm.text import mix, words

TEXTS = ["", None, "a", "a b", "a b c d", "a b c d e", "a a a a a a a", "x y x y x y x y x y", "", "q w e r t y u", None]


def _plain(text):
    hashes = words(pa.array([text], pa.string()))[0].tolist()
    runs = [hashes[at : at + 5] for at in range(max(1, len(hashes) - 4))] if hashes else []
    folded = []
    for run in runs:
        total = 0
        for one in run:
            total = (total * 0x100000001B3 + one) % (1 << 64)
        folded.append(total)
    return Counter(mix(np.array(folded, dtype=np.uint64)).tolist())


def test_sets_equal_plain_python_without_a_sort_of_the_batch(monkeypatch):
    def refuse(*_):
        raise AssertionError("a sort of all texts together")

    monkeypatch.setattr(np, "lexsort", refuse)
    for texts in (TEXTS, TEXTS[:1], TEXTS[2:3], TEXTS[::-1]):
        row, key, count = module._counted_sets(pa.array(texts, pa.string()))
        expected = [(at, one, times) for at, text in enumerate(texts) for one, times in sorted(_plain(text).items())]
        assert list(zip(row.tolist(), key.tolist(), count.tolist(), strict=True)) == expected
