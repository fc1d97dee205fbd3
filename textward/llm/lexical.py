"""Ranked lexical search: for each query text, the documents of highest score, by vectors in the order of their lengths (as LEMP does).

A pass over the whole texts writes each document's number of terms and how often it holds each term of the queries. Counts of documents and
terms over all of them give each term its weight and each document its impact vector, whose product with a query's vector of weights is the
score. Vectors are written in buckets of their norm (Euclidean length), longest first within a file. A first search of the buckets of longest
vectors gives each query a score that its best k reach at least. By Cauchy-Schwarz no shorter vector than that score divided by the query's
norm can reach it; the scan of the second search leaves out such buckets for all queries, and in a task each query ends at the first vector that is
too short for it. Among the others a query's heaviest coordinates are multiplied out, and the rest is bounded by the norms of what is left of both
vectors. Only survivors of that bound are scored, exactly, in 64-bit integers. A task keeps the best k of each query, so that no more than that is
shuffled from it.

Queries are read in blocks of bounded size, each of which is one pass over the documents; the terms of a block are sent to all tasks.

Defined results: null texts have no terms; documents and queries without terms have no rows; repeated rows are documents, or queries, of their
own; equal scores go by doc_id, null last; empty tables give no rows; other columns are left out, so that their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textward.llm._shared import cut, forget, ship

#: Bytes and number of query texts that are searched for in one pass.
BLOCK_BYTES, BLOCK_ITEMS = 4_000_000, 5_000
#: Documents of the longest vectors that are searched first, and buckets of norms: four to each doubling.
FIRST, PER_DOUBLING = 20_000, 4
#: A query's heaviest coordinates, which are multiplied out before the rest is bounded.
FOCUS = 12
NO_ID = np.iinfo(np.int64).max

#: Bytes as the terms have them: A-Z in lower case, ASCII letters, digits and all of other characters kept, the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TERM_BYTES).split()


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document: how many terms it has, and which of the vocabulary how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            n, sizes, terms, counts = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(raw)
                held = Counter(map(get, words))
                held.pop(None, None)
                n.append(len(words))
                terms += held.keys()
                counts += held.values()
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _vectors(counted: DataFrame, documents: int, total: int) -> DataFrame:
    """(doc_id, bucket, norm, terms, impacts) of the documents that hold a term of the queries, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            tf = counts.flatten().to_numpy().astype(np.int64)
            lengths = counts.value_lengths().to_numpy()
            m = np.array([50 + (50 * n * documents) // total for n in batch.column(1).to_pylist()], np.int64)
            impacts = (1_000_000_000 * tf) // (1_000 * tf + 20 * np.repeat(m, lengths))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            norms = np.sqrt(np.add.reduceat(np.square(impacts.astype(np.float64)), offsets[:-1])) if len(tf) else np.zeros(0)
            buckets = np.floor(PER_DOUBLING * np.log2(np.maximum(norms, 1))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(impacts, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets), pa.array(norms), terms, values], ["doc_id", "bucket", "norm", "terms", "impacts"])

    rows = counted.where(F.size("terms") > 0).mapInArrow(run, "doc_id long, bucket int, norm double, terms array<int>, impacts array<long>")
    return rows.sortWithinPartitions(F.desc("norm"))


class _Block:
    """Vectors of a batch in two orders: by document, and by term."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        self.doc = ids.fill_null(NO_ID).to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.argsort(-batch.column("norm").to_numpy(), kind="stable")
        self.norm = batch.column("norm").to_numpy()[order]
        self.doc, self.null = self.doc[order], self.null[order]
        lists, impacts = (batch.column(c).take(pa.array(order)) for c in ("terms", "impacts"))
        lengths = lists.value_lengths().to_numpy()
        self.terms, self.impacts = lists.flatten().to_numpy(), impacts.flatten().to_numpy()
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        rows = np.repeat(np.arange(len(order)), lengths)
        by_term = np.argsort(self.terms, kind="stable")
        self.post_term, self.post_row, self.post_impact = self.terms[by_term], rows[by_term], self.impacts[by_term]

    def bounds(self, most: int, query: _Query) -> np.ndarray:
        """What the first `most` vectors can score at most: the focus multiplied out, and the norms of the rest."""
        product, square = np.zeros(most), np.zeros(most)
        lows = np.searchsorted(self.post_term, query.focus)
        highs = np.searchsorted(self.post_term, query.focus, "right")
        for weight, a, b in zip(query.focus_weights.tolist(), lows.tolist(), highs.tolist(), strict=True):
            b = a + int(np.searchsorted(self.post_row[a:b], most))
            x = self.post_impact[a:b].astype(np.float64)
            product[self.post_row[a:b]] += weight * x
            square[self.post_row[a:b]] += x * x
        return product + query.rest_norm * np.sqrt(np.maximum(self.norm[:most] ** 2 - square, 0.0))

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors, by a query's weights of all terms."""
        lengths = self.begin[rows + 1] - self.begin[rows]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(lengths.sum()) + np.repeat(self.begin[rows] - starts, lengths)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], starts)


class _Query:
    """A query's weights by term, its norm, and its focus."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        heavy = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[heavy], weights[heavy]
        self.norm = float(np.sqrt(np.square(self.weights.astype(np.float64)).sum()))
        self.focus, self.focus_weights = self.terms[:FOCUS], self.weights[:FOCUS]
        self.rest_norm = float(np.sqrt(np.square(self.weights[FOCUS:].astype(np.float64)).sum()))


def _search(vectors: DataFrame, queries: list[_Query], least: list[int], terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k documents of each query, among those that score `least` or more."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]
        floors, dense = list(least), np.zeros(terms, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _Block(batch)
            for q, query in enumerate(queries):
                need = floors[q]
                # a float's error is far below these margins
                most = int(np.searchsorted(-block.norm, -(need / query.norm) * (1 - 1e-9), "right")) if query.norm else 0
                if not most:
                    continue
                rows = np.flatnonzero(block.bounds(most, query) * (1 + 1e-9) + 1 >= need)
                if not len(rows):
                    continue
                dense[query.terms] = query.weights
                found = block.scores(rows, dense)
                dense[query.terms] = 0
                good = found >= need
                if not good.any():
                    continue
                score, doc, null = (np.concatenate(x) for x in zip(best[q], (found[good], block.doc[rows[good]], block.null[rows[good]])))
                order = np.lexsort((null, doc, -score))[:k]
                best[q] = score[order], doc[order], null[order]
                if len(order) == k:
                    floors[q] = max(floors[q], int(best[q][0][-1]))
        size = [len(x[0]) for x in best]
        score, doc, null = (np.concatenate([x[c] for x in best]) if best else [] for c in range(3))
        ids = pa.array(doc, pa.int64(), mask=null) if len(size) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size), pa.int32()), ids, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The queries, so many at a time, as they come to the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(tuple(row))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES or len(block) >= BLOCK_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each query text, highest first, equal scores by doc_id."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    parts = [_one_block(docs, block, kind, k) for block in _blocks(items.select(F.col(item_col), F.col(item_text_col).cast("string")))]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _one_block(docs: DataFrame, block: list[tuple], kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    held = [{vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)} for _, text in block]
    counted = cut(_counted(docs, vocabulary), "lexical-counts")
    documents, total = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block's queries have terms
        df[term] = n
    weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    queries = [_Query(ids := np.array(sorted(t), np.int64), weights[ids]) for t in held]
    vectors = cut(_vectors(counted, documents, max(total, 1)), "lexical-vectors")
    forget(counted)
    sizes = sorted(((r.bucket, r["count"]) for r in vectors.groupBy("bucket").count().collect()), reverse=True)  # a row for each quarter of a doubling
    first, seen = 0, 0
    for first, n in sizes:
        seen += n
        if seen >= FIRST:
            break
    least = [1] * len(queries)
    reached = _ranked(_search(vectors.where(F.col("bucket") >= first), queries, least, len(vocabulary), k), k).where(F.col("rank") == k)
    for r in reached.select("item", "score").collect():  # one number for each query of the block
        least[r.item] = max(1, r.score)
    shortest = min((x / q.norm for x, q in zip(least, queries, strict=True) if q.norm), default=0.0) * (1 - 1e-9)
    found = cut(_ranked(_search(vectors.where(F.col("norm") >= shortest), queries, least, len(vocabulary), k), k), "lexical-found")
    forget(vectors)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents), b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
tf AS (SELECT row, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT row, doc_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))) AS x FROM tf JOIN df USING (term), s),
p AS (SELECT item, item_id, row, doc_id, sum(x)::BIGINT AS score FROM (SELECT item, item_id, unnest(t) AS term FROM b) JOIN x USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 50
"""
