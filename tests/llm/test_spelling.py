"""Phrases are spelled as they stand, and summed before they leave a task."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortweave.llm import phrase_mining


class _Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("rows", [1 << 16, 3])
def test_phrases_are_spelled_as_they_stand(monkeypatch, rows):
    monkeypatch.setattr(phrase_mining, "SPELL_ROWS", rows)
    texts = ["a  b\tA b, c", "b", None, "", " É é\U0001f600 x\ny z w", "end", "a b"]
    langs = ["en", "en", "en", "fr", "fr", "fr", "fr"]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])
    every = [_Held(np.packbits(np.ones(1 << phrase_mining.SLOT_BITS, dtype=bool)))] * 3
    found = Counter()
    monkeypatch.setattr(phrase_mining, "HELD_ROWS", 2 * rows)
    for part in phrase_mining._spelled(every)(iter([batch])):
        assert part.num_rows <= max(rows, 2)
        for lang, words, phrase, f in zip(*part.to_pydict().values()):
            found[lang, words, phrase] += f
    wanted = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in zip(langs, texts):
        for piece in (text or "").translate(low).replace(",", "\n").split("\n"):
            words = piece.replace("\t", " ").split()
            wanted[lang, 0, ""] += len(words)
            for k in (1, 2, 3):
                wanted.update((lang, k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    assert found == +wanted
