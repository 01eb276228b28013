"""Words are looked up without the signs after them, and texts go as Arrow columns."""

import random

import pyarrow as pa

from cohortry.llm import token_files as tf


def test_a_word_is_kept_once_whatever_signs_follow_it():
    encoder = tf.WordEncoder(tf.default_tokenizer())
    names = ["haus", "Fenster", "été", "œuvre"[1:]]
    signs = ["", ",", ".", "!?", ":)", "..."]
    texts = [" ".join(n + s for n in names) for s in signs]
    assert encoder.encode(texts) == [encoder._whole(t) for t in texts]
    # Every pair of a word and its signs used to be a word of its own.
    assert len(encoder.words) <= len(names) + len(signs)


def test_every_latin_sign_and_space_between_words_gives_the_ids_of_the_whole_tokenizer():
    encoder = tf.WordEncoder(tf.default_tokenizer())
    signs = [chr(c) for c in range(0x100)] + ["İ", "ſ", " ", "　", "́", "中", "<|"]
    texts = [form.format(s) for s in signs for form in (
        "ab{0}cd", "ab,{0}cd", "{0}ab.", "ab{0}", "ab{0}, cd", "Ab {0} cÉ{0}.", "{0}", "a'{0},", "e{0}|.")]
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids == encoder._whole(text), repr(text)


def test_portions_and_slices_of_a_column_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé, .'1\tЖ<|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    column = pa.array(["x", *texts]).slice(1)
    monkeypatch.setattr(tf, "SPLIT_CHARS", 100)
    encoder = tf.WordEncoder(tf.default_tokenizer(), 40)
    assert encoder.encode(column) == encoder.encode(texts) == [encoder._whole(t) for t in texts]
    assert encoder.encode([]) == []
