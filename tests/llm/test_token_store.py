"""Texts to ids many at a time: the library's own ids, whatever stands at the borders of words and texts."""

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import token_store


def test_ids_are_the_librarys_whatever_words_and_texts_meet():
    enc, rng = token_store.Encoder(token_store.default_tokenizer(), remembered=500), random.Random(11)
    pieces = [*" \n.,'!a1_-", "ab", "é", "×", "÷", " the", "'s", "'ll", "中", "\t", " ", " ", "<|endoftext|>", "й", "ß", "\0", "́", "٣", "½", "😀", " b.", "\x85", "\r"]
    calm = [x for x in pieces if not x.isspace() and x not in ("\0", "<|endoftext|>")]
    texts = [None, "", "a", ".", "!", "a.", ".b", " a", "a\n", "x" * 3000, "it's 12. élève, ×, a×. (d) 'e' \"f\"..."]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choices(calm, k=rng.randrange(1, 5))).strip() for _ in range(6)) for _ in range(2000)]
    for some in (texts, texts[:3], ["", None], []):
        ids, ends = enc.encode(pa.array(some, pa.string()))
        for text, own in zip(some, np.split(ids, ends[:-1]) if some else [], strict=True):
            assert own.tolist() == [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, token_store.END_ID], repr(text)


def test_words_are_learned_once_and_without_their_punctuation():
    enc = token_store.Encoder(token_store.default_tokenizer())
    known, learned, learn = set(enc.words.to_pylist()), [], enc._learn
    enc._learn = lambda new: learned.extend(new) or learn(new)
    words = ["".join(random.Random(i).choices("abcdeé", k=9)) for i in range(40)]
    for mark in ("", ".", ",", "!)", "..."):
        enc.encode(pa.array([" ".join(f"{w}{mark}" for w in words), "\n".join(f"{w}{mark}" for w in words)]))
    assert sorted(set(learned)) == sorted(learned)
    assert set(learned) | known == {*words, *(f" {w}" for w in words[1:]), "\n", ".", ",", "!)", "..."} | known
