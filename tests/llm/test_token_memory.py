"""What a token worker keeps, and that it changes no id."""

import random

import corpus_pipeline
from cohortry.llm import token_files as tf


def _texts(n=120):
    rng = random.Random(3)
    new = lambda: "".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(3, 9)))
    common = [new() for _ in range(30)]
    words = lambda: [rng.choice(common) if rng.random() < 0.5 else new() for _ in range(40)]
    return [" ".join(w + rng.choice(["", "", ",", ".", "!?", "'s", "7"]) for w in words()) for _ in range(n)] + ["", "  "]


def test_few_kept_words_and_small_portions_give_the_ids_of_the_whole_tokenizer(monkeypatch):
    monkeypatch.setattr(tf, "KEPT_WORDS", 200)
    monkeypatch.setattr(tf, "KEPT_SIGNS", 2)
    monkeypatch.setattr(tf, "SPLIT_CHARS", 1500)
    encoder = tf.WordEncoder(tf.default_tokenizer())
    assert encoder.by_words
    texts = _texts()
    assert encoder.encode(texts) == [encoder._whole(t) for t in texts]
    # A portion's own words come on top of those kept.
    assert len(encoder.words) + len(encoder.older) < 2 * (200 + 400) and len(encoder.signs) <= 2


def test_a_worker_keeps_at_most_two_rounds_of_words(monkeypatch):
    monkeypatch.setattr(tf, "KEPT_WORDS", 100)
    encoder = tf.WordEncoder(tf.default_tokenizer())
    for text in _texts():
        encoder.encode([text])
    # All words of a text, and all pieces in them, used to be kept up to the same number each.
    kept = [d for d in vars(encoder).values() if isinstance(d, dict)]
    assert sum(map(len, kept)) < 400


def test_the_number_of_kept_words_can_be_named():
    encoder = tf._encoder(tf.default_tokenizer(), 50)
    assert encoder.kept == 50 and tf._encoder(tf.default_tokenizer(), 50) is encoder
    assert encoder.encode(_texts(20)) == tf._encoder(tf.default_tokenizer()).encode(_texts(20))
    assert corpus_pipeline.KEPT_WORDS < tf.KEPT_WORDS
