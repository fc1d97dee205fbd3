"""SentencePiece BPE by prefixes, held against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from textward.llm import piece_bpe

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


def test_ids_equal_the_library(library):
    coder, draw = piece_bpe.Coder(MODEL), random.Random(3)
    pieces = list(coder.piece.values())
    texts = ["", " ", "▁a", "\0x", "ﬁ①", "a\tb\n\r\n", "🙂🙂", "  a  b ", "é", "<s></s><0x41>", "aaaaaaaaaaaaaaaaaaaaaaa"]
    for _ in range(1_500):
        texts.append("".join(draw.choice(pieces) for _ in range(draw.randrange(1, 9))))
        texts.append("".join(draw.choice(" ▁ab\n\t①é好的、12") for _ in range(draw.randrange(40))))
        texts.append(" " * draw.randrange(70) + draw.choice(pieces) + " " * draw.randrange(40))
        texts.append("".join(chr(draw.choice((draw.randrange(1, 0x3000), draw.randrange(0xE000, 0x20000)))) for _ in range(10)))
    for t in texts:
        assert _ids(coder, t) == library.encode(t, add_bos=True, add_eos=True), t


def test_long_words_take_linear_time(library):
    draw, coder = random.Random(4), piece_bpe.Coder(MODEL)
    for letters in ("abcdefghij", "a", "etaoinsr▁"):
        word = "".join(draw.choice(letters) for _ in range(300_000))
        assert _ids(coder, word) == library.encode(word, add_bos=True, add_eos=True)


def test_bounded_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEEP_WORDS", 5)
    monkeypatch.setattr(piece_bpe, "KEEP_SEAMS", 5)
    coder = piece_bpe.Coder(MODEL)
    for t in ["one two three four five six seven", "two eight one nine", "one two three"] * 3:
        assert _ids(coder, t) == library.encode(t, add_bos=True, add_eos=True)


def test_a_seam_holds_iff_merging_leaves_it(library):
    coder, draw = piece_bpe.Coder(MODEL), random.Random(5)
    short = [i for i, p in coder.piece.items() if len(p) < 5 and "▁" not in p]
    for _ in range(3_000):
        a, b = draw.choice(short), draw.choice(short)
        whole = library.encode("\t" + coder.piece[a] + coder.piece[b])[2:]  # ids of the dummy space and the tab first
        assert coder._fits(a, b) == (whole == [a, b]), (coder.piece[a], coder.piece[b])


def test_a_model_whose_merges_skip_order_is_refused():
    coder = piece_bpe.Coder(MODEL)
    coder.piece, coder.rank = {1: "abc"}, {"ab": 5.0, "abc": 2.0}
    with pytest.raises(ValueError, match="order of their scores"):
        coder._edges(1)


def test_round_trip_rows(spark, library):
    rows = [(1, "Étion  dans\nçouelle 12", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x"), (4, "w" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string").repartition(3)
    got = sorted(map(tuple, piece_bpe.round_trip(df, MODEL).collect()), key=str)

    def expected(key, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    assert got == sorted((expected(k, t) for k, t, _ in rows), key=str)
    coded = piece_bpe.encode(df, MODEL)
    assert {r.doc_id: r.decoded for r in piece_bpe.decode(coded, MODEL).collect()} == {k: t or "" for k, t, _ in rows}
    assert piece_bpe.round_trip(df.where("false"), MODEL).count() == 0
    assert piece_bpe.decode(spark.createDataFrame([(7, None)], "doc_id int, ids array<int>"), MODEL).collect()[0].decoded == ""
