"""Token ids: words learned without offsets, tables of pairs, and expansion by the ids of each rule."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from textward.llm import repair_ids as ri

FILE = public_tokenizers.path("word_bpe_49k.json")


class _Counted:
    """The tokenizer of words, which counts the calls that also make offsets."""

    def __init__(self, library):
        self.library, self.calls = library, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.library.encode(*args, **kwargs)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_words_are_learned_without_offsets():
    draw = random.Random(5)
    letters = ["a", "e", "th", "ing", "ß", "é", "ж", "İ", "7", "'s", "'", "-", "…", "</w>", "€", "«", "x" * 40]
    texts = ["".join(draw.choice([*letters, " ", " ", "\n"]) for _ in range(draw.randrange(120))) for _ in range(2_000)] + ["", None, "a <|endoftext|> b", "It's o'clock, they'Ve 12ab...", "word word"]
    encoder = ri.Encoder(FILE, 1)
    encoder.of_words = _Counted(encoder.of_words)
    got = encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [[*encoder.library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert encoder.of_words.calls == 0


def test_every_word_has_one_token_that_ends_it():
    encoder = ri.Encoder(FILE, 1)
    assert int(encoder.ending.sum()) > 256
    for words in (["a"], ["\x01", "ÿ", "語", "語語", "!", "0"], ["in", "inin", "’"]):
        encoder._learn(words)
        for w in words:
            ids = np.frombuffer(encoder.words[w], "<u4")
            assert ids.tolist() == encoder.of_words.encode(w, add_special_tokens=False).ids
            assert encoder.ending[ids].tolist() == [False] * (len(ids) - 1) + [True]


@pytest.mark.parametrize("first", [100, 49_408, 70_000])
@pytest.mark.parametrize("per_round", [1, 50, 4_096, 70_000])
def test_blocks_expand_to_their_ids(first, per_round):
    draw = np.random.default_rng(first + per_round)
    few = 3_000 if per_round > 1 else 300
    for ids in ([], [5], [7] * 5_000, draw.integers(0, 90, few), draw.zipf(1.3, 10 * few) % 100, np.tile(draw.integers(0, 90, 700), 20)):
        ids = np.array(ids, "<u4")
        block = ri.Block(ri.compress(ids, np.array([len(ids)]), first, per_round=per_round))
        assert np.array_equal(block.expand(block.symbols), ids)
        assert np.array_equal(block._rounds(block.symbols), ids)
        assert np.array_equal(block.read(len(ids) // 3, len(ids) // 2), ids[len(ids) // 3 : len(ids) // 2]) or not len(ids)


def test_pairs_at_one_place_wait_and_are_not_lost(monkeypatch):
    ids = np.tile(np.random.default_rng(1).integers(0, 90, 400), 12).astype("<u4")
    whole = ri.Block(ri.compress(ids, np.array([len(ids)]), 100))
    monkeypatch.setattr(ri, "_hashed", lambda pairs: (pairs % 7).astype(np.intp))
    crowded = ri.Block(ri.compress(ids, np.array([len(ids)]), 100))
    assert np.array_equal(crowded.expand(crowded.symbols), ids)
    assert len(crowded.symbols) < 1.2 * len(whole.symbols)
