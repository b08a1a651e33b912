"""Pieces of the byte vocabulary against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest

from waymark.llm.tokens import Pieces

PATHS = {"lead": "byte_bpe_50k.json", "drop": "word_bpe_49k.json"}


@pytest.mark.parametrize("cut", sorted(PATHS))
def test_pieces_have_the_ids_of_whole_texts(cut):
    known = Pieces(public_tokenizers.path(PATHS[cut]), cut, limit=500)
    dealt = random.Random(4)
    parts = ["a", "Wort", "été", "straße", "x1", "42", "'s", "'ll", "'", " ", " ", " ", "\n", "  ", "\t", " ", "　", "<|endoftext|>", "ж", "中文", "×", "½", "\U0001f600", "\x1f", "\x00", "é", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]
    made = ["", None, "\n", " ", "\n\n", "a\n\n", " a", "a " * 3000, "b" * 3000, "#" * 1500]
    made += ["".join(dealt.choices(parts, k=dealt.randint(1, 40))) for _ in range(3000)]
    made += [" ".join("".join(dealt.choices("abcé'#$%-_.,9", k=dealt.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    for texts in (made, made[::-1]):  # again with what is remembered
        for text, ids in zip(texts, known.batch(texts, chars=5000)):
            assert np.frombuffer(ids, "<u4").tolist() == known.library.encode(text or "", add_special_tokens=False).ids, text


def test_words_before_any_mark_are_known_without_it():
    known = Pieces(public_tokenizers.path(PATHS["lead"]), "lead")
    known.batch(["Isre### Isre$$$ Isre%%% Isre&&& Isre*** Isre-Isre's"])
    assert set(known.new) == {"Isre", " Isre", "###", "$$$", "%%%", "&&&", "***", "-Isre's"}
