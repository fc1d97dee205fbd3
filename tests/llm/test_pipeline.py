"""The pipeline on the smallest data, each stage against brute force on its own input."""

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from textward.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == docs.columns for d in kept[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SF).where("predicted = 1").collect()}
    assert ids[1] == ids[0] - toxic
    from test_operators import brute_components

    rows = sorted((r.doc_id, r.text) for r in kept[1].collect())
    comp = brute_components([t for _, t in rows])[1]
    assert ids[2] == {d for k, (d, _) in enumerate(rows) if comp[k] == k}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[a : a + 10]) for t in items for w in [decontaminate.words((t or "").encode())] for a in range(max(1, len(w) - 9)) if w}
    clean = set()
    for r in kept[2].collect():
        w = decontaminate.words((r.text or "").encode())
        if not any(tuple(w[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert ids[3] == clean and ids[4] == clean and P.PATTERN


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, long, "b"), (1, "another text of the same id " + long[::-1], "c"), (3, None, "d"), (4, "", "e"), (4, "", "e"), (None, "no id but these words here", "f"), (5, "x " * 30_000, "g")]
    # columns that the stages use themselves
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumns({c: F.lit(k) for k, c in enumerate(("h", "id", "component_id", "hit_text", "toxic", "label"))})
    for d in (docs, docs.limit(0)):
        kept = d
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            path = str(tmp_path / f"{d is docs}{k}")
            stage(spark, kept, SF).write.parquet(path)
            kept = spark.read.parquet(path)
            assert kept.columns == docs.columns
        got = sorted(((r.doc_id, (r.text or "")[:7]) for r in kept.collect()), key=str)
        out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        if d is docs:
            assert got == sorted([(1, "word0 w"), (1, "another"), (3, ""), (4, ""), (4, ""), (None, "no id b"), (5, "x x x x")], key=str)
            assert sorted(r.n_tokens > 0 for r in out.collect()) == [False] * 3 + [True] * 4
        else:
            assert got == [] and out.count() == 0


def test_rows_that_differ_in_other_columns_alone(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, f"u{k}", None if k % 2 else k) for k in range(12)] + [(2, "some other words that are here once", "v", 1)]
    got = set()
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], "doc_id long, text string, url string, source int").repartition(3 + turn)
        got.add(tuple(sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())))
    assert len(got) == 1 and [r[0] for r in next(iter(got))] == [1, 2]
