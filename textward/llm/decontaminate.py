"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are reduced to the same words: A-Z lower-cased, runs of digits, ASCII letters and non-ASCII
characters kept. Every window of `width` consecutive words of an item (the whole item, if it has fewer words,
but not none) is a pattern of the automaton, whose symbols are words. Its states are numbered by levels, so that one sorted
array of (state, word) is all of its edges, with failure and output links beside it: about 40 bytes for each byte of items.
A task scans each reduced text once: a batch's words are laid in lanes that advance together, each after the
`width` - 1 words before it. A match's end and length give the words that are hit; these are mapped to code-point offsets of
the original text. The items go to each worker once. Items whose texts exceed `CHUNK_BYTES` together are
taken in several chunks of that size, each with a scan that is written before the next begins, so that what a worker holds is bounded for any benchmark.

Defined results: a null or empty text has no words and no hits; an item whose text is null or has no words is never
found; items without an id are found as one, a null at the end of item_ids that counts but is no part of the digest; repeated rows each get their own row; an empty benchmark or table gives no hits or no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm._shared import cut, kept, ship

#: Bytes of item texts in one automaton.
CHUNK_BYTES = 8_000_000
#: Bytes of a text that are split into words at a time.
PIECE = 1_000_000

#: Lower-cases A-Z and turns ASCII characters that are no letters or digits into spaces; UTF-8 bytes beyond ASCII stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))

_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("hit_words", pa.list_(pa.int32())),
    pa.field("item_ids", pa.list_(pa.string())),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
]


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Windows:
    """The automaton of all items' windows. State 0 is the root; state k + 1 is reached by the edge keys[k]; states of a level follow those of the level before."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.width, self.ids = width, {}
        texts = [np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in words(raw)), np.int64) for _, raw in items]
        self.span = len(self.ids) + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(0, np.int64)])
        of_size = np.minimum(sizes, width)
        per = np.where(sizes > 0, sizes - of_size + 1, 0)
        item = np.repeat(np.arange(len(items)), per)
        start = np.repeat(np.cumsum(sizes) - sizes, per) + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        n, state = of_size[item], np.zeros(len(item), np.int64)
        keys, self.fail = np.empty(int(n.sum()), np.int64), np.zeros(int(n.sum()) + 1, np.int32)
        self.levels, self.begin = [0, 1], None
        self.keys, self.root = keys[:0], np.zeros(self.span, np.int64)
        for d in range(width):
            live = np.flatnonzero(n > d)
            if not len(live):
                break
            edges, at = np.unique(state[live] * self.span + flat[start[live] + d], return_inverse=True)
            first = self.levels[-1]
            state[live] = first + at
            if d:
                self.fail[first : first + len(edges)] = self.step(self.fail[edges // self.span], edges % self.span)
            else:
                self.root[edges] = first + np.arange(len(edges))
            keys[first - 1 : first - 1 + len(edges)] = edges
            self.keys = keys[: first - 1 + len(edges)]
            self.levels.append(first + len(edges))
        self.keys, self.fail = self.keys.copy(), self.fail[: self.levels[-1]].copy()
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.keys // self.span, minlength=self.levels[-1]))]).astype(np.int32)
        # what ends in a state: its own items, and the next shorter pattern that does
        names = sorted({i for i, _ in items}, key=lambda x: (x is None, x))
        place = {x: k for k, x in enumerate(names)}
        pairs = np.unique(np.stack([state, np.array([place[i] for i, _ in items], np.int64)[item]]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        self.names, self.item_of = names, pairs[1]
        self.ends = np.unique(pairs[0])
        self.first = np.searchsorted(pairs[0], np.append(self.ends, self.levels[-1]))
        ends = np.zeros(self.levels[-1], bool)
        ends[self.ends] = True
        self.link = np.zeros(self.levels[-1], np.int32)
        for a, b in zip(self.levels[1:], self.levels[2:], strict=False):
            shorter = self.fail[a:b]
            self.link[a:b] = np.where(ends[shorter], shorter, self.link[shorter])
        self.out = np.where(ends, np.arange(self.levels[-1], dtype=np.int32), self.link)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; words of no item (0) lead to the root."""
        to = np.zeros(len(word), np.int64)
        todo = np.flatnonzero(word)
        state, word = state[todo].astype(np.int64), word[todo].astype(np.int64)
        while len(todo):
            top = state == 0
            to[todo[top]] = self.root[word[top]]
            todo, state, word = todo[~top], state[~top], word[~top]
            edge = state * self.span + word
            if self.begin is None:
                at = np.searchsorted(self.keys, edge)
            else:  # most states have one edge or none
                at = self.begin[state]
                many = np.flatnonzero(self.begin[state + 1] - at > 1)
                at[many] = np.searchsorted(self.keys, edge[many])
            found = self.keys.take(at, mode="clip") == edge if len(self.keys) else np.zeros(len(edge), bool)
            to[todo[found]] = at[found].astype(np.int64) + 1
            todo, word, state = todo[~found], word[~found], self.fail[state[~found]].astype(np.int64)
        return to

    def matches(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of last words of matches and the states of the patterns that end there, of a row of word ids."""
        if not len(self.keys) or not word.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, length = self.width - 1, max(64, int(len(word) ** 0.5))
        lanes = -(-len(word) // length)
        padded = np.zeros(before + lanes * length, np.int32)
        padded[before : before + len(word)] = word
        lane = np.lib.stride_tricks.sliding_window_view(padded, length + before)[::length]
        state, places, states = np.zeros(lanes, np.int64), [], []
        for k in range(length + before):
            state = self.step(state, lane[:, k])
            if k >= before and len(hot := np.flatnonzero(self.out[state])):
                places.append(hot * length + k - before)
                states.append(self.out[state[hot]])
        place, state = np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*states, np.zeros(0, np.int32)])
        places, states = [place], [state]
        while len(place):
            more = self.link[state] > 0
            place, state = place[more], self.link[state[more]]
            places.append(place)
            states.append(state)
        return np.concatenate(places), np.concatenate(states)

    def scan(self, raws: list[bytes]) -> list[tuple[int, np.ndarray, list[str | None]]]:
        """For each text: its number of words, the positions of those that are hit, and the items found, nulls last."""
        rows = [self._numbered(raw) for raw in raws]
        sizes = np.array([len(r) for r in rows], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        apart = np.zeros(1, np.int32)
        place, state = self.matches(np.concatenate([x for r in rows for x in (r, apart)] or [apart]))
        longest = np.searchsorted(self.levels, state, side="right") - 1
        edges = np.bincount(place - longest + 1, minlength=int(sizes.sum()) + len(rows) + 1) if len(place) else np.zeros(1, np.int64)
        if len(place):
            edges = edges - np.bincount(place + 1, minlength=len(edges))
        hit, of = np.cumsum(edges) > 0, np.searchsorted(begin, place, side="right") - 1
        items: list[list] = [[] for _ in rows]
        if len(place):
            pairs = np.unique(np.stack([of, np.searchsorted(self.ends, state)]), axis=1)
            counts = self.first[pairs[1] + 1] - self.first[pairs[1]]
            at = np.repeat(self.first[pairs[1]] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            for k, i in np.unique(np.stack([np.repeat(pairs[0], counts), self.item_of[at]]), axis=1).T.tolist():
                items[k].append(self.names[i])
        return [(int(n), np.flatnonzero(hit[a : a + n]), found) for n, a, found in zip(sizes, begin, items, strict=True)]

    def _numbered(self, raw: bytes) -> np.ndarray:
        """The ids of a text's words, 0 for those of no item."""
        folded, out, at = raw.translate(_FOLD), [np.zeros(0, np.int32)], 0
        while at < len(folded):
            end = folded.find(b" ", at + PIECE)
            end = len(folded) if end < 0 else end
            out.append(np.fromiter(map(self.ids.get, folded[at:end].split(), repeat(0)), np.int32))
            at = end
        return np.concatenate(out)


def spans(raw: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of the runs of words that are hit."""
    if not len(hit):
        return []
    inside = np.concatenate([[False], np.frombuffer(raw.translate(_FOLD), np.uint8) != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    fresh = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
    first, last = hit[fresh], hit[np.append(fresh[1:], len(hit)) - 1]
    return [{"start": a, "end": b} for a, b in zip(points[edges[2 * first]].tolist(), points[edges[2 * last + 1]].tolist(), strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, hit_words (positions), item_ids (sorted as strings) and spans in place of columns of these names."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.drop(*_SCHEMA.names).withColumns({f.name: F.lit(None).cast(f.dataType) for f in _SCHEMA})
    names, at = out.columns, out.columns.index(text_col)
    for k, chunk in enumerate(_chunks(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("raw")).where("raw IS NOT NULL"))):
        if k:  # one automaton at a time
            out = cut(out, "hits")
        sent, mark = spark.sparkContext.broadcast(chunk), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, mark=mark, again=k > 0) -> Iterator[pa.RecordBatch]:
            auto = kept("windows", (mark, width), lambda: Windows(sent.value, width))
            for batch in batches:
                texts = [raw or b"" for raw in batch.column(at).cast(pa.binary()).to_pylist()]
                rows = auto.scan(texts)
                if again:
                    hits, items = (batch.column(names.index(f.name)).to_pylist() for f in _ARROW[1:3])
                    rows = [(n, np.union1d(hit, np.array(h, np.int64)), sorted({*found, *i}, key=lambda x: (x is None, x))) for (n, hit, found), h, i in zip(rows, hits, items, strict=True)]
                values = [[n for n, _, _ in rows], [hit.astype(np.int32) for _, hit, _ in rows], [found for _, _, found in rows], [spans(raw, hit) for raw, (_, hit, _) in zip(texts, rows, strict=True)]]
                full = {name: batch.column(k) for k, name in enumerate(names)} | {f.name: pa.array(x, f.type) for f, x in zip(_ARROW, values, strict=True)}
                yield pa.RecordBatch.from_arrays([full[name] for name in names], names)

        out = out.mapInArrow(run, out.schema)
    return out


def _chunks(items: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in chunks whose size is bounded, one at a time on the driver; at least one, so that words are counted."""
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = int(size // CHUNK_BYTES * 2) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k)
        yield [(r.item, bytes(r.raw)) for r in part.collect()]


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what find() returned."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
