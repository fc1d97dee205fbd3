"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy search on it.

Index. Equal vectors are one node that keeps its MEMBERS least ids, as many as an answer can hold. Every vector is
indexed. So that inner products order as distances do, a component is added that gives all vectors the largest norm. A first
graph comes from random hyperplanes: nodes sorted by the bits of a tree's code are cut into leaves of LEAF neighbours in
that order. Each round of NN-descent then joins neighbours of neighbours: a node meets its S nearest and about S of those
that list it, their vectors come to it by a join, and pairs that are better than a node's worst neighbour go back to it; a
node keeps its K best. Half-precision is enough for the graph.

Search. Queries start at their own nodes (and the nodes of largest norm). A round takes each query's E best candidates that
were not expanded, joins their neighbours, scores them, and keeps EF, until no query has one left among its best. Queries
go in blocks of QUERY_BLOCK, whose vectors are broadcast: a bound that does not depend on the data. The nearest are
scored again in double precision on the original vectors.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components take no part; ties go to the
smaller id; with fewer candidates than k all are returned; an empty table gives no rows. Vectors must have one length
(the most frequent; others take no part). Of rows with one id, that of least bytes counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textward.llm._shared import cut, forget, ship

K, S, TREES, LEAF = 28, 22, 12, 512
#: Share of the graph's edges that a round must change for another one to follow.
CHANGED = 0.001
E, EF = 64, 256
QUERY_BLOCK = 20_000
ENTRIES = 8
BITS = 24


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most[0] if most else 0))


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of binary vectors as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[pa.Array]]:
    """Runs of equal keys of sorted batches, several at a time: lists of columns that end where a key ends."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if left is not None:
            now = pa.concat_tables([left, now])
        keys = now.column(key).to_numpy()
        whole = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if whole:
            yield [c.combine_chunks() for c in now.slice(0, whole).columns]
        left = now.slice(whole)
    if left is not None and left.num_rows:
        yield [c.combine_chunks() for c in left.columns]


_NEAR = "id long, w array<long>, s array<float>"
_STATE = "query_id long, w array<long>, s array<float>, seen array<boolean>, front array<long>"


def _starts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)


def _best(of: np.ndarray, w: np.ndarray, s: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each `of`, the k entries of best score and then of least w, in this order, each w once (seen, if any of them was)."""
    seen = np.zeros(len(of), bool) if seen is None else seen
    for last in (True, False):
        order = np.lexsort((-s, ~seen, w, of) if last else (w, -s, of))
        of, w, s, seen = of[order], w[order], s[order], seen[order]
        if last:
            first = np.concatenate([[True], (of[1:] != of[:-1]) | (w[1:] != w[:-1])]) if len(of) else np.empty(0, bool)
            of, w, s, seen = of[first], w[first], s[first], seen[first]
    at = _starts(of)
    keep = np.arange(len(of)) - np.repeat(at, np.diff(np.append(at, len(of)))) < k
    return of[keep], w[keep], s[keep], seen[keep]


def _lists(of: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The distinct `of`, which are neighbours, and the columns as lists."""
    at = _starts(of)
    offsets = pa.array(np.append(at, len(of)).astype(np.int32))
    return [pa.array(of[at]), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)]


def _flat(keys: pa.Array, *lists: pa.Array) -> list[np.ndarray]:
    """The keys, once for each entry, and the entries."""
    return [np.repeat(keys.to_numpy(), lists[0].value_lengths().to_numpy()), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)]


def _top(near: DataFrame) -> DataFrame:
    """The K best neighbours of each node, from rows of any of its neighbours."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 0):
            of, w, s, _ = _best(*_flat(*columns), K)
            yield pa.RecordBatch.from_arrays(_lists(of, w, s), ["id", "w", "s"])

    return near.repartition("id").sortWithinPartitions("id").mapInArrow(top, _NEAR)


class Index:
    """nodes: (id, members, v32 binary, x16 binary with the added component, norm); graph: (id, w, s), the neighbours and their scores, best first."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20):
        spark = vectors.sparkSession
        ship(spark)
        rows = usable(vectors, id_col, vec_col)
        members = k + 1

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[bytes, list[int]] = {}
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(v, []).append(i)
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array([sorted(set(x))[:members] for x in held.values()], pa.list_(pa.int64()))], ["v", "members"])

        rows = rows.mapInArrow(pack, "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))
        same = rows.mapInArrow(combine, "v binary, members array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))), 1, members).alias("members"))
        self.vectors = cut(same.select(F.col("members")[0].alias("id"), "members", "v"), "ann-vectors")
        first = self.vectors.select("v").first()
        self.dim = len(first.v) // 8 if first else 0
        if not self.dim:
            self.graph = self.nodes = None
            return
        dim = self.dim

        def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1), np.float64, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary()), pa.array(np.linalg.norm(v, axis=1))], ["id", "v", "norm"])

        self.nodes = cut(self.vectors.select("id", "v").mapInArrow(norms, "id long, v binary, norm double"), "ann-nodes")
        self.entries = [r.id for r in self.nodes.orderBy(F.desc("norm"), "id").limit(ENTRIES).collect()]
        top = self.nodes.agg(F.max("norm")).first()[0]

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1), np.float32, dim).astype(np.float64) / top
                x = np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

        points = cut(self.nodes.select("id", "v").mapInArrow(added, "id long, x binary"), "ann-points")
        graph = cut(self._forest(points), "ann-graph")
        turn, share = 0, 1.0
        while share >= CHANGED:
            better = cut(self._descend(points, graph, turn), "ann-graph")
            edges = better.join(graph.select("id", F.col("w").alias("old")), "id").agg(F.sum(F.size(F.array_except("w", "old"))).alias("new"), F.sum(F.size("w")).alias("n")).first()
            turn, share = turn + 1, (edges.new or 0) / max(edges.n or 0, 1)
            forget(graph)
            graph = better
        self.graph = graph

    def _forest(self, points: DataFrame) -> DataFrame:
        width = self.dim + 1

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(20).standard_normal((TREES, width, BITS)).astype(np.float32)
            planes[:, -1] = 0  # the added component is never negative
            powers = 1 << np.arange(BITS - 1, -1, -1)
            for batch in batches:
                x = _matrix(batch.column(1), np.float16, width).astype(np.float32)
                for t in range(TREES):
                    code = ((x @ planes[t] > 0) * powers).sum(1) + (t << BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), batch.column(0), batch.column(1)], ["code", "id", "x"])

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = None
            for batch in batches:
                now = pa.Table.from_batches([batch])
                if left is not None:
                    now = pa.concat_tables([left, now])
                while now.num_rows >= 2 * LEAF:
                    yield leaf(now.slice(0, LEAF))
                    now = now.slice(LEAF)
                left = now
            if left is not None and left.num_rows:
                yield leaf(left)

        def leaf(t: pa.Table) -> pa.RecordBatch:
            tree = t.column(0).to_numpy() >> BITS
            ids, x = t.column(1).to_numpy(), _matrix(t.column(2), np.float16, width).astype(np.float32)
            s = x @ x.T
            s[(tree[:, None] != tree) | (ids[:, None] == ids)] = -9
            n = min(K, len(ids))
            w = np.argpartition(-s, n - 1, axis=1)[:, :n]
            score = np.take_along_axis(s, w, 1)
            ok = score > -9
            return pa.RecordBatch.from_arrays(_lists(np.repeat(ids, ok.sum(1)), ids[w][ok], score[ok]), ["id", "w", "s"])

        coded = points.mapInArrow(codes, "code long, id long, x binary").repartitionByRange("code", "id").sortWithinPartitions("code", "id")
        return _top(coded.mapInArrow(leaves, _NEAR))

    def _descend(self, points: DataFrame, graph: DataFrame, turn: int) -> DataFrame:
        width = self.dim + 1
        worst = F.when(F.size("w") >= K, F.element_at("s", -1)).otherwise(F.lit(-9.0)).cast("float")
        ahead = graph.select(F.col("id").alias("pivot"), F.explode(F.slice("w", 1, S)).alias("id"))
        # of those that list a node about S are taken, by hash: hubs stay small
        listed = ahead.groupBy("id").agg(F.count("*").alias("n"))
        back = ahead.join(listed, "id").where(F.pmod(F.xxhash64("pivot", "id", F.lit(turn)), F.lit(1_000_000)) * F.col("n") < S * 1_000_000).select(F.col("id").alias("pivot"), F.col("pivot").alias("id"))
        pairs = ahead.unionByName(back).unionByName(graph.select(F.col("id").alias("pivot"), "id")).distinct()
        members = pairs.join(points.join(graph.select("id", worst.alias("worst")), "id"), "id").select("pivot", "id", "worst", "x")
        met = members.repartition("pivot").sortWithinPartitions("pivot")

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pivot, ids, worst, x in _groups(batches, 0):
                pivot, ids, worst, x = pivot.to_numpy(), ids.to_numpy(), worst.to_numpy(), _matrix(x, np.float16, width).astype(np.float32)
                ends = np.append(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot))
                out_u, out_w, out_s, a = [], [], [], 0
                for b in ends.tolist():
                    s = x[a:b] @ x[a:b].T
                    np.fill_diagonal(s, -9)
                    n = min(K, b - a)  # of one pivot's proposals no more can stay
                    w = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    score = np.take_along_axis(s, w, 1)
                    u, c = np.nonzero(score > worst[a:b, None] + 1e-4)
                    out_u.append(ids[a + u])
                    out_w.append(ids[a + w[u, c]])
                    out_s.append(score[u, c])
                    a = b
                u, w, s, _ = _best(*(np.concatenate(o) for o in (out_u, out_w, out_s)), K)
                if len(u):
                    yield pa.RecordBatch.from_arrays(_lists(u, w, s), ["id", "w", "s"])

        return _top(met.mapInArrow(local, _NEAR).unionByName(graph))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """queries: ids of indexed rows (query_id). (query_id, rank, vec_id, score): each query's k nearest other rows."""
        spark = queries.sparkSession
        schema = "query_id long, rank int, vec_id long, score double"
        if self.graph is None:
            return spark.createDataFrame([], schema)
        ids = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").alias("qv")).groupBy("query_id").agg(F.min("qv").alias("qv"))
        n = ids.count()
        blocks = -(-n // QUERY_BLOCK) if n else 0
        out = None
        for b in range(blocks):
            part = ids if blocks == 1 else ids.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            found = self._block(cut(part, "ann-queries"), k)
            out = found if out is None else out.unionByName(found)
        return out if out is not None else spark.createDataFrame([], schema)

    def _block(self, queries: DataFrame, k: int) -> DataFrame:
        dim, spark = self.dim, queries.sparkSession
        local = queries.orderBy("query_id").collect()  # at most about QUERY_BLOCK vectors
        names = np.array([r.query_id for r in local], np.int64)
        sent = spark.sparkContext.broadcast((names, np.frombuffer(b"".join(r.qv for r in local), np.float64).reshape(-1, dim).astype(np.float32)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                of = batch.column(0).to_numpy()
                s = np.einsum("ij,ij->i", q[np.searchsorted(names, of)], _matrix(batch.column(2), np.float32, dim))
                # one row for each pair, however batches fall
                ends = pa.array(np.arange(len(of) + 1, dtype=np.int32))
                one = lambda values: pa.ListArray.from_arrays(ends, values)
                yield pa.RecordBatch.from_arrays([batch.column(0), one(batch.column(1)), one(pa.array(s, pa.float32())), one(pa.array(np.zeros(len(of), bool)))], ["query_id", "w", "s", "seen"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for of, w, s, seen in _groups(batches, 0):
                of, w, s, seen = _flat(of, w, s, seen)
                of, w, s, seen = _best(of, w, s, EF, seen)
                # the first E that were not expanded
                at, open_ = _starts(of), np.cumsum(~seen)
                before = np.repeat(open_[at] - ~seen[at], np.diff(np.append(at, len(of))))
                now = ~seen & (open_ - before <= E)
                ends = np.concatenate([[0], np.cumsum(now)])[np.append(at, len(of))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*_lists(of, w, s, seen | now), pa.ListArray.from_arrays(pa.array(ends), pa.array(w[now]))], ["query_id", "w", "s", "seen", "front"])

        def scored(pairs: DataFrame) -> DataFrame:
            return pairs.join(self.nodes.select(F.col("id").alias("w"), "v"), "w").select("query_id", "w", "v").mapInArrow(score, "query_id long, w array<long>, s array<float>, seen array<boolean>")

        def merged(rows: DataFrame) -> DataFrame:
            return cut(rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, _STATE), "ann-state")

        own = self.vectors.select("id", F.col("v").alias("qv")).join(queries, "qv").select("query_id", "id")
        start = own.join(self.graph, "id", "left").select("query_id", F.explode(F.concat(F.array("id"), F.coalesce("w", F.array().cast("array<long>")), F.array(*(F.lit(x) for x in self.entries)))).alias("w")).distinct()
        state = merged(scored(start))
        while state.where(F.size("front") > 0).limit(1).count():
            pairs = state.select("query_id", F.explode("front").alias("id")).join(self.graph, "id").select("query_id", F.explode("w").alias("w")).distinct()
            after = merged(state.drop("front").unionByName(scored(pairs)))
            forget(state)
            state = after
        # one more than k nodes, as the query's own may be one; a node stands for its members
        best = state.select("query_id", F.explode(F.slice("w", 1, 2 * k + 2)).alias("w"))
        full = best.join(self.vectors.select(F.col("id").alias("w"), "members", "v"), "w").join(queries, "query_id")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = np.einsum("ij,ij->i", _matrix(batch.column(2), np.float64, dim), _matrix(batch.column(3), np.float64, dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["query_id", "members", "score"])

        rows = full.select("query_id", "members", "v", "qv").mapInArrow(exact, "query_id long, members array<long>, score double").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their components."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(v.values.to_numpy() + 0.0).tobytes() for v in batch.column(1)], pa.binary())], ["id", "v"])


def queries_of(vectors: DataFrame, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, v): the rows whose id is divisible by `every`, as queries."""
    rows = usable(vectors, id_col, vec_col).where(F.pmod("id", F.lit(every)) == 0)
    return rows.mapInArrow(pack, "id long, v binary").withColumnRenamed("id", "query_id")
