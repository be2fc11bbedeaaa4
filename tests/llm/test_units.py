"""Texts whose white space balances: as many parts as words, though a run of white space is longer than one."""

import random

import numpy as np
import pytest

from tidemark.llm.tokens import Encoder

TEXTS = ["a\tb\tc\n\n", "one\xa0two\xa0three\n\n", "x\ty\tz\n\n\nnext", "a\rb\n\n", "a b  ", "  a\x0bb\x85c", "a\tb  c", "a　b\n \nc\x1cd"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_balanced_white_space(name):
    encoder = Encoder(name)
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


class Calls:
    """Counts the calls of an object's methods."""

    def __init__(self, of):
        self.of, self.n = of, 0

    def __getattr__(self, name):
        self.n += 1
        return getattr(self.of, name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_pieces_go_to_the_model_together(name):
    encoder = Encoder(name)
    encoder.model = Calls(encoder.model)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(600))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert encoder.model.n <= 2


@pytest.mark.parametrize("most", [3, 40, 100_000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_mixed_texts_with_dictionaries_that_start_anew(name, most):
    rng = random.Random(most)
    parts = ["a", "The", "thing", "ÉtÉ", "ßü", "Į", "İ", "½", "²", "7", "42", "'s", "'", "it's", ".", ",,", "<|", "é", "你好", "ый", "\t", "\n", " ", " ", " ", " ", "\r\n", "  ", "\0", "\x7f", "\xad", "\xa0", "_"]
    texts = [None, "", " ", "\n", "\n\n"] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(400)]
    encoder = Encoder(name, most)
    for i in range(0, len(texts), 80):
        for text, ids in zip(texts[i : i + 80], encoder.encode(texts[i : i + 80]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, text
    assert not any("\xa0" in key.decode() for held in (encoder.units, encoder.pieces) for key in held.known)
