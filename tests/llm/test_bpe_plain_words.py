"""Plain words are encoded without the word pattern, with the tokenizer's own ids."""

import random

import numpy as np
import pytest

from kinetable.llm import bpe
from kinetable.llm.queries import tokenizer_path


class _Unused:
    def search(self, s):
        raise AssertionError(s)

    findall = search


def test_plain_words_need_no_pattern(monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDE", k=r.randint(1, 14)))
    texts = [" ".join(word() + r.choice(["", "", *".,;:!?)"]) for _ in range(200)) for _ in range(20)] + ["a" * 5000 + "."]
    want = [bpe.Codec(tokenizer_path()).whole.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "UNSURE", _Unused()), monkeypatch.setattr(bpe, "WORDS", _Unused())
    got = bpe.Codec(tokenizer_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("end", ["", *map(chr, range(1, 128)), "é", "ß.", "İ", "..", "'s", "<|"])
def test_any_end_of_a_word(end):
    c = bpe.Codec(tokenizer_path()) if not hasattr(test_any_end_of_a_word, "c") else test_any_end_of_a_word.c
    test_any_end_of_a_word.c = c
    texts = [f"Word{end}", f"w{end}", f"{end}word", f"Wo{end}rd next{end}", end]
    want = [c.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == want
