"""Ids of the fast encoder against the tokeniser itself, on texts full of odd white space."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evidentia.llm import packing

SPACES = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", "\x1c", "\x1f", "\x85", " ", "　", "\x0b", "\x0c", ""]
PARTS = ["a", "word", "It's", "we'll", "'s", "12", "3.5", "...", ".", ",", "é", "漢字", "-", "naïve", "😀", "x1", "</s>", "<s>", "\x00", "é"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.public_tokenizer())


def same(encoder, text):
    got = np.frombuffer(encoder.ids(text), dtype="<u4").tolist()
    return got == encoder.whole.encode(text, add_special_tokens=False).ids


def test_texts_that_failed_before(encoder):
    for text in ("a\tb  c", "-\xa0漢 ", ".\t. ", "\n\n", "\x1c\n\n a", "a\x85\n\nb", "a \tb", "a\t b", "", " ", "\n", " a", "a ", "a\n", "\na"):
        assert same(encoder, text), repr(text)


def test_random_texts(encoder):
    rng = random.Random(11)
    for k in range(20_000):
        spaces = SPACES[: rng.choice([5, 9, len(SPACES)])]
        text = "".join(rng.choice(PARTS) + rng.choice(spaces) for _ in range(rng.randint(0, 12)))
        text = rng.choice(["", rng.choice(spaces)]) + text
        assert same(encoder, text), (k, repr(text))


def test_given_texts(encoder, some_documents):
    assert all(same(encoder, text or "") for _, text, *_ in some_documents)
