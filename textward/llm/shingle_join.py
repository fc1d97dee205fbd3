"""Jaccard join of documents on word 5-grams, and the components of its links, by T-occurrence search.

A document's set is its distinct shingles, as 64-bit hashes. Documents with equal sets are one node (a hash of the
set). Two nodes link when 100 |x & y| >= 75 |x | y|, so they share at least ceil(0.75 n) shingles of either. By that, with all
sets in the order of their hashes, their prefixes of n - ceil(0.75 n) + l(n) shingles, where l(n) = n // 10 + 1, share at
least min(l(x), l(y)). Everything up to the search only leaves out what this rules out:

1. Postings (shingle, node) of prefixes. A task combines its own, so a shingle that many documents have is one row
   of each task in the shuffle. Postings whose shingle has one node go.
2. Nodes with fewer than l(ceil(0.75 n)) postings left go, and then again shingles with one node.
3. Of lists of at most SHORT nodes, pairs are counted. A pair stays if its count and what longer lists could add reach
   min(l(x), l(y)), and if its sizes allow a link. Longer lists give a star from their least node, among those nodes whose
   postings in long lists alone could be enough.
4. The components of these edges are blocks that links never leave. A block above BLOCK shingles is dealt to chunks, and
   every two chunks make a block together, so a task's memory is bounded.
5. In a block, a breadth-first search asks for the neighbours of one node after the other among the nodes that no
   component has yet: T-occurrence with DivideSkip. The short lists are merged by counting, the L longest are probed by
   binary search for candidates with T - L or more, and the exact sizes decide. Copies of thousands thus cost one
   query and the rest is small; the lists are made anew when half of their nodes are taken.

Defined results: a null or empty text, or one of white space alone, has an empty set and is linked with nothing;
repeated rows and copies are linked; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import cut, forget, kept, ship
from textward.llm.components import components

WIDTH = 5
SHORT = 8
#: Shingles of a block, postings that a task combines at a time, rows of a broadcast table, and words that a worker keeps.
BLOCK = 1_500_000
COMBINE = 1_000_000
BROADCAST_ROWS = 300_000
KEEP_WORDS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """One worker's hashes of the words that it has met."""

    def __init__(self):
        self.words: dict[bytes, bytes] = {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """The text's set, sorted."""
        words = (raw or b"").translate(_LOWER).split()  # bytes split at ASCII white space alone
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        try:
            joined = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > KEEP_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_digest(w)
            joined = b"".join(map(known.__getitem__, words))
        h = np.frombuffer(joined, np.uint64)
        width = min(WIDTH, len(h))
        out = h[: len(h) - width + 1] + np.uint64(width)
        for k in range(1, width):
            out = out * _BASE + h[k : len(h) - width + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def least_shared(n):
    """ceil(0.75 n), for numbers, arrays and columns."""
    return F.floor((n * 3 + 3) / 4) if isinstance(n, Column) else (n * 3 + 3) // 4


def extra(n):
    """l(n)."""
    return F.floor(n / 10) + 1 if isinstance(n, Column) else n // 10 + 1


_NODES = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
_ROWS = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("multi", pa.bool_())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = kept("shingles", None, Shingler)
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], schema=_NODES)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of prefixes. A row with s null stands for its shingle k in the shuffle, multi if this task has others of it; those others have s and need no meeting."""
    shingles, seen = kept("shingles", None, Shingler), set()
    parts, nodes, sizes, total = [], [], [], 0

    def close() -> pa.RecordBatch:
        lengths = [len(p) for p in parts]
        s, node, n = np.concatenate(parts).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
        order = np.argsort(s, kind="stable")
        s, node, n = s[order], node[order], n[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        multi = ~first | np.concatenate([s[1:] == s[:-1], [False]])
        spread = (node ^ s) if len(s) else s
        return pa.RecordBatch.from_arrays([pa.array(np.where(first, s, spread)), pa.array(s, mask=first), pa.array(node), pa.array(n), pa.array(multi)], schema=_ROWS)

    for batch in batches:
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            s = shingles(raw)
            if not len(s) or (node := node_of(s)) in seen:
                continue
            seen.add(node)
            if len(seen) > 1_000_000:
                seen.clear()
            n = len(s)
            parts.append(s[: n - least_shared(n) + extra(n)])
            nodes.append(node)
            sizes.append(n)
            total += len(parts[-1])
            if total > COMBINE:
                yield close()
                parts, nodes, sizes, total = [], [], [], 0
    if parts:
        yield close()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by k: the postings (s, node, n) of shingles that have other nodes."""
    left: list[np.ndarray] | None = None
    schema = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])

    def out(k, node, n, multi) -> pa.RecordBatch:
        first = np.concatenate([[True], k[1:] != k[:-1]])
        at = np.flatnonzero(first)
        low, high, any_multi = np.minimum.reduceat(node, at), np.maximum.reduceat(node, at), np.maximum.reduceat(multi, at)
        keep = np.repeat((low != high) | any_multi, np.diff(np.append(at, len(k))))
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(node[keep]), pa.array(n[keep])], schema=schema)

    for batch in batches:
        k, s, node, n, multi = (batch.column(i) for i in range(5))
        met = s.is_null().to_numpy(zero_copy_only=False)
        if not met.all():
            direct = pa.array(~met)
            yield pa.RecordBatch.from_arrays([s.filter(direct), node.filter(direct), n.filter(direct)], schema=schema)
        now = [x.to_numpy(zero_copy_only=False)[met] for x in (k, node, n, multi)]
        if left is not None:
            now = [np.concatenate(x) for x in zip(left, now, strict=True)]
        if not len(now[0]):
            left = None
            continue
        whole = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last shingle may go on
        if whole:
            yield out(*(x[:whole] for x in now))
        left = [x[whole:] for x in now]
    if left is not None and len(left[0]):
        yield out(*left)


class Lists:
    """Inverted lists of a block's nodes, which are numbers; a list is sorted by node."""

    def __init__(self, sets: list[np.ndarray], nodes: np.ndarray):
        self.sets, self.sizes, self.nodes = sets, np.array([len(s) for s in sets], np.int64), nodes
        s, who = np.concatenate([sets[k] for k in nodes.tolist()]), np.repeat(nodes, self.sizes[nodes])
        order = np.argsort(s, kind="stable")
        s, self.who = s[order], who[order]
        self.at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        self.keys, self.ends = s[self.at], np.append(self.at[1:], len(s))

    def near(self, x: int) -> np.ndarray:
        """Nodes that link with x."""
        mine = self.sets[x]
        k = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        k = k[self.keys[k] == mine]
        if not len(k):
            return k
        a, b = self.at[k], self.ends[k]
        need, lengths = int(least_shared(len(mine))), b - a
        if len(k) < need:
            return k[:0]
        # DivideSkip: the more lists are set aside, the fewer candidates are needed among the rest
        longest = int(lengths.max())
        aside = min(need - 1, int(need / (0.01 * np.log2(longest + 1) + 1))) if longest > 16 else 0
        order = np.argsort(lengths, kind="stable")
        split = len(order) - aside
        short, long = order[:split], order[split:]
        if aside:
            long = long[lengths[long] > 4]  # a list so short is merged
            short = np.setdiff1d(order, long, assume_unique=True)
        la = lengths[short]
        where = np.repeat(a[short] - (np.cumsum(la) - la), la) + np.arange(int(la.sum()))
        found, count = np.unique(self.who[where], return_counts=True)
        keep = count >= need - len(long)
        found, count = found[keep], count[keep]
        for j in long[np.argsort(lengths[long], kind="stable")].tolist():
            if not len(found):
                return found
            members = self.who[a[j] : b[j]]
            p = np.minimum(np.searchsorted(members, found), len(members) - 1)
            count = count + (members[p] == found)
        return found[100 * count >= 75 * (len(mine) + self.sizes[found] - count)]


def block_components(nodes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The least node linked with each node, over links within the block."""
    n = len(nodes)
    root, free = np.full(n, -1), np.ones(n, bool)
    lists, left = Lists(sets, np.arange(n)), n
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed], group, todo = False, [seed], [seed]
        left -= 1
        while todo and left:
            x = todo.pop()
            if left * 2 < len(lists.nodes):
                lists = Lists(sets, np.flatnonzero(free))
            near = lists.near(x)
            near = near[free[near]]
            free[near] = False
            left -= len(near)
            group += near.tolist()
            todo += near.tolist()
        root[group] = int(nodes[group].min())
    return root


def _solve(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_numpy()
    nodes, at = np.unique(nodes, return_index=True)
    raw = table.column("raw").to_pylist()
    root = block_components(nodes, [np.frombuffer(raw[k], np.uint64) for k in at.tolist()])
    return pa.table({"a": pa.array(nodes, pa.int64()), "b": pa.array(root, pa.int64()), "part": pa.array([table.column("g")[0].as_py() > 1] * len(nodes))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of documents that stand for nodes of blocks; a row of the same id with another text is left out."""
    shingles = kept("shingles", None, Shingler)
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            sets = [shingles(t) for t in part.column(0).cast(pa.binary()).to_pylist()]
            mine = pa.array([bool(len(s)) and node_of(s) == k for s, k in zip(sets, part.column(1).to_pylist(), strict=True)])
            own = part.filter(mine)
            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), pa.array([s.tobytes() for s, m in zip(sets, mine.to_pylist(), strict=True) if m], pa.binary())], ["node", "root", "g", "raw"])


def _edges(shared: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) whose components hold every link, from postings (s, node, n); and tables to forget. Copies that different tasks met repeat a posting: counts may be too large, which keeps more and loses nothing."""
    made = []
    some = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    lists_of = lambda df: df.groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("s", "df")
    for _ in range(2):
        lists = lists_of(shared)
        counted = cut(shared.join(lists, "s"), "join-lists")
        need = extra(least_shared(F.col("n")))
        nodes = counted.groupBy("node", "n").agg(F.count("*").alias("c"), F.count_if(F.col("df") > SHORT).alias("h")).where(F.col("c") >= need)
        nodes = cut(nodes.select("node", "h", (F.col("h") >= need).alias("heavy")), "join-nodes")
        shared = cut(counted.drop("df").join(some(nodes.select("node")), "node", "left_semi"), "join-shared")
        made += [counted, nodes, shared]
    rows = cut(shared.join(lists_of(shared), "s").join(some(nodes), "node"), "join-rows")
    made.append(rows)
    # a list of at most SHORT nodes
    few = rows.where(F.col("df") <= SHORT).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("node", "n", "h"))).alias("l")).select("l", F.posexplode("l").alias("i", "x"))
    pairs = few.select("x", F.explode(F.slice("l", F.col("i") + 2, SHORT)).alias("y")).groupBy("x", "y").agg(F.count("*").alias("c"))
    n, m = F.col("x.n"), F.col("y.n")
    pairs = pairs.where((F.col("c") + F.least("x.h", "y.h") >= F.least(extra(n), extra(m))) & (F.least(n, m) * 4 >= F.greatest(n, m) * 3)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = rows.where((F.col("df") > SHORT) & F.col("heavy"))
    stars = many.join(many.groupBy("s").agg(F.min("node").alias("a")), "s").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return pairs.unionByName(stars), made


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, n_shingles, component_id) per document; component_id is the least id that links lead to."""
    return classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def text_hash(text_col: str) -> Column:
    """What tells the rows of one id apart in classes()."""
    return F.xxhash64(F.col(text_col).cast("string"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, h, n_shingles, component_id, root) per document: h is its text's hash; root tells components apart that have the same least id, and is null for an empty set."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    members = cut(given.withColumn("h", text_hash("text")).mapInArrow(_nodes, "id long, h long, node long, n long"), "join-members")
    rows = given.mapInArrow(_postings, "k long, s long, node long, n int, multi boolean").repartition("k").sortWithinPartitions("k")
    shared = cut(rows.mapInArrow(_shared, "s long, node long, n int"), "join-postings")
    edges, made = _edges(shared)
    blocks = components(edges)
    for t in made:
        forget(t)

    nodes = cut(members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n")), "join-classes")
    inside = nodes.join(blocks, "node")
    sizes = inside.groupBy("root").agg(F.sum("n").alias("size"))
    g = F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(F.col("size") * 2 / BLOCK)).cast("int")
    wanted = cut(inside.join(sizes, "root").select("id", "node", "root", g.alias("g")), "join-wanted")
    small = wanted.count() <= BROADCAST_ROWS
    texts = given.join(F.broadcast(wanted) if small else wanted, "id").select("text", "node", "root", "g")
    sets = texts.mapInArrow(_sets, "node long, root long, g int, raw binary")
    # a block alone, or its chunk with each other chunk
    mine = F.pmod("node", "g").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("g") - 1), lambda j: (F.col("g") == 1) | (j != F.col("mine")))
    dealt = sets.withColumn("mine", mine).withColumn("j", F.explode(others)).select("node", "root", "g", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("j"), "raw")
    solved = cut(dealt.groupBy("root", "i", "j").applyInArrow(_solve, "a long, b long, part boolean"), "join-solved")
    roots = solved.where("NOT part").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if solved.where("part").limit(1).count():
        roots = roots.unionByName(components(solved.where("part")))

    classes = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    of_node = classes.join(least, "root").select("node", "component_id", "root")
    out = members.join(of_node, "node", "left")
    return out.select("id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "root")
