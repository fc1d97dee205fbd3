"""Ranked lexical search, held against scores of all documents."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from textward.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, k):
    counts = [(key, Counter(_terms(t))) for key, t in docs]
    with_terms = [c for _, c in counts if c]
    n_docs, total = len(with_terms), sum(sum(c.values()) for c in with_terms)
    df = Counter(t for c in with_terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if c else 0
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1_000 * c[t] + 20 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_terms_of_any_text():
    for text in ["", None, "AbC_d-é9 ÀÉ\tx\0y", "日本 語x{1}~", "İI ﬁ"]:
        assert [t.decode() for t in lexical.terms_of(text)] == _terms(text)


@pytest.mark.parametrize("first, block", [(20_000, 5_000), (1, 2), (40, 3)])
def test_search_equals_all_scores(spark, monkeypatch, first, block):
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical, "FOCUS", 3)
    draw = random.Random(first)
    words = [f"w{k}" for k in range(60)] + ["É", "été", "X1", "x1"]
    text = lambda most: " ".join(draw.choice(words[: draw.randrange(2, len(words))]) for _ in range(draw.randrange(1, most)))
    docs = [(k, text(60)) for k in range(300)] + [(k, "w1 w2 w3") for k in range(400, 420)] + [(500, None), (501, "  "), (502, "w5"), (502, "w5"), (None, "w1 w2 w3"), (503, "w9 " * 5_000)]
    items = [(k, text(12)) for k in range(8)] + [(20, None), (21, "absent"), (22, "w1 w2 W3"), (23, "w5 w5")]
    d = spark.createDataFrame([(*x, "other") for x in docs], "doc_id long, text string, score string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, lexical.search(d, i, 10).collect()))
    assert [g[:2] + g[3:] for g in got] == [b[:2] + b[3:] for b in sorted(_brute(docs, items, 10), key=lambda b: b[:2])]
    assert got == sorted(_brute(docs, items, 10), key=lambda b: b[:2])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), items.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), items).collect()[0].doc_id == 1


def test_few_vectors_are_scored(spark):
    """The bounds leave out most vectors of texts that share only common terms with a query."""
    draw = random.Random(7)
    docs = [(k, " ".join(f"c{draw.randrange(40)}" for _ in range(60)) + f" r{k % 200}") for k in range(2_000)]
    items = [(1, " ".join(f"r{k}" for k in range(10)) + " " + " ".join(f"c{k}" for k in range(8)))]
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, x in items for t in lexical.terms_of(x)}))}
    counted = lexical._counted(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), vocabulary)
    vectors = lexical._vectors(counted, 2_000, 122_000)
    block = lexical._Block(pa.Table.from_pandas(vectors.toPandas(), preserve_index=False).combine_chunks().to_batches()[0])
    ids = np.arange(len(vocabulary))
    query = lexical._Query(ids, np.array([7_000 if t.startswith(b"r") else 400 for t in vocabulary], np.int64))
    exact = block.scores(np.arange(len(block.doc)), query.weights[np.argsort(query.terms)])
    bound = block.bounds(len(block.doc), query)
    assert (bound + 1 >= exact).all()
    scored = (bound >= np.sort(exact)[-20]).sum()
    assert 20 <= scored <= 100
