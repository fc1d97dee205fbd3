"""Token ids as binary files, compressed by Re-Pair grammars.

Documents are dealt to partitions by ranges of their ids and sorted there, encoded, and gathered to blocks of at most
about `block_ids` ids (a longer document is a block by itself). In a block the most frequent pairs of neighbouring ids
become nonterminals, all pairs of a round at once (where occurrences overlap, from the left, every other one), round
after round until no pair occurs `least` times or the symbols are used up. A block is one binary value of the file
format below, and Spark writes the blocks as a table, so that a lost executor leaves no half-written file and any store
will do.

Format, little-endian: b"RPB1"; four u32: rules, symbols, documents, ids; one u32: bytes per symbol (2 or 4); the rules
(two symbols each); the expansion length of each rule (u32); the symbols; the end of each document (u32, in ids).
Symbol s < first is the id s; symbol first + k is rule k; first (u32) stands before the rules.

Tokenizing. The distinct words of some megabytes of text are encoded by the tokenizers library, once per worker while
they are kept, and the texts' ids are gathered from theirs. Texts that hold an added token's content, or characters that
the library might treat otherwise than this splitting, go through the library whole.

Defined results: a null or empty text is the end id alone; rows of one id stay neighbours, ordered by their texts' hash;
an empty table is a table without blocks; other columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textward.llm._shared import cut, kept, ship, slices

MAGIC = b"RPB1"
#: Words that a worker keeps the ids of, and characters of text that it splits at a time.
KEEP_WORDS = 500_000
TEXT_CHARS = 4_000_000

#: The library's split pattern; a line feed goes after each match.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_ALIKE = re.compile("[\t\n\r -~\u00a0¡£-©«-±´¶-¸»¿-įĲ-ɏА-я–—‘-”…€]*").fullmatch


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k] to starts[k] + lengths[k], one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _distinct(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and for each string the place of its own among them."""
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Encoder:
    """One worker's tokenizer and the ids of the words that it has met."""

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        # for words that are split and in lower case already
        self.of_words = Tokenizer.from_file(file)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.end = end_id
        self.words: dict[str, bytes] = {"": b""}
        # tokens that end a word: each word has one of them, its last
        vocabulary = self.of_words.get_vocab()
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix := getattr(self.of_words.model, "end_of_word_suffix", None):
            self.ending[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids with the end id, as little-endian unsigned 32-bit integers."""
        given = texts.fill_null("").to_pylist()
        low = pc.utf8_lower(texts.fill_null(""))
        # the library whole for texts with added tokens, or characters that it may treat otherwise than this splitting
        plain = np.array([_ALIKE(t) is not None for t in given], bool)
        for content in self.added:
            plain &= ~pc.match_substring(low, content).to_numpy(zero_copy_only=False)
        split = iter(self._plain(low.filter(pa.array(plain))))
        return [next(split) if ok else np.array([*self.library.encode(t, add_special_tokens=False).ids, self.end], "<u4") for t, ok in zip(given, plain.tolist(), strict=True)]

    def _plain(self, low: pa.Array) -> list[np.ndarray]:
        if not len(low):
            return []
        # no match of the pattern goes beyond white space: distinct runs without it are split to words, and distinct words encoded
        runs = pc.utf8_split_whitespace(low)
        kinds, run = _distinct(runs.flatten())
        mixed = pc.invert(pc.utf8_is_alpha(kinds))
        pieces = pc.split_pattern(pc.replace_with_mask(kinds, mixed, pc.replace_substring_regex(kinds.filter(mixed), _PIECES, "\\0\n")), "\n")
        words, word = _distinct(pieces.flatten())
        words = words.to_pylist()
        coded = list(map(self.words.get, words))
        if unknown := [k for k, c in enumerate(coded) if c is None]:
            self._learn([words[k] for k in unknown])
            for k in unknown:
                coded[k] = self.words[words[k]]
        if len(self.words) > KEEP_WORDS:  # those of this batch stay
            self.words = dict(zip(words, coded, strict=True)) | {"": b""}
        flat, size = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, sums = flat[_ranges((np.cumsum(size) - size)[word], size[word])], np.concatenate([[0], np.cumsum(size[word])])
        # of each distinct run: where its ids begin and how many they are
        at = pieces.offsets.to_numpy() - pieces.offsets[0].as_py() if len(kinds) else np.zeros(1, np.int64)
        begin, size = sums[at[:-1]], np.diff(sums[at])
        ids, sums = flat[_ranges(begin[run], size[run])], np.concatenate([[0], np.cumsum(size[run])])
        ends = sums[runs.offsets.to_numpy() - runs.offsets[0].as_py()][1:]
        ids = np.insert(ids, ends, self.end).astype("<u4", copy=False)
        ends = ends + np.arange(1, len(ends) + 1)
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, new: list[str]) -> None:
        """Words of one kind of character, joined by spaces: each is a piece of its own to the library."""
        for a in range(0, len(new), 500):
            part = new[a : a + 500]
            ids = np.array(self.of_words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(part):  # the library split a word further, or its tokens don't show where a word ends
                self.words.update((w, np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in part)
                continue
            raw, b = ids.tobytes(), 0
            for w, c in zip(part, (4 * ends).tolist(), strict=True):
                self.words[w] = raw[b:c]
                b = c


#: Places of the table that compress() looks pairs up in.
PLACES = 1 << 18


def _hashed(pairs: np.ndarray) -> np.ndarray:
    """A place below PLACES for each pair of symbols."""
    if pairs.dtype == np.uint64:
        pairs = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return ((pairs * np.uint32(2654435761)) >> np.uint32(14)).astype(np.intp)


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = 8, per_round: int = 4096) -> bytes:
    """A block of the file format."""
    most = 65536 if first < 60_000 and (not len(ids) or int(ids.max()) < first) else first + 16_384
    first = max(first, int(ids.max()) + 1 if len(ids) else 0)
    s, rules, lengths = ids.astype(np.uint64 if most > 65536 else np.uint32), [], []
    shift = 32 if most > 65536 else 16
    size = np.ones(first, np.uint32)
    while len(s) > 1 and first + len(rules) < most:
        keys = (s[:-1] << shift) | s[1:]
        sorted_keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        n = np.diff(np.append(at, len(sorted_keys)))
        room = min(per_round, most - first - len(rules))
        good = np.flatnonzero(n >= least)
        if not len(good):
            break
        if len(good) > room:
            good = good[np.argpartition(n[good], len(good) - room)[len(good) - room :]]
        chosen = sorted_keys[at[good]]
        # a table by hashes finds the positions; of pairs that share a place in it one waits for the next round
        table, place = np.zeros(PLACES, np.uint16 if per_round < 65536 else np.uint32), _hashed(chosen)
        table[place] = np.arange(1, len(chosen) + 1)
        alone = table[place] == np.arange(1, len(chosen) + 1)
        chosen = chosen[alone]
        table[place[alone]] = np.arange(1, len(chosen) + 1)
        rule = table.take(_hashed(keys))
        near = np.flatnonzero(rule > 0)
        rule = rule[near] - 1
        hit = chosen[rule] == keys[near]
        pos, rule = near[hit], rule[hit]
        # occurrences that follow one another overlap: every other one of a run is taken
        starts = np.concatenate([[True], np.diff(pos) > 1])
        number = np.arange(len(pos))
        take = (number - np.maximum.accumulate(np.where(starts, number, 0))) & 1 == 0
        pos, rule = pos[take], rule[take]
        used = np.bincount(rule, minlength=len(chosen)) > 0
        rule = (np.cumsum(used) - 1)[rule]
        pair = chosen[used]
        left, right = (pair >> shift).astype(np.int64), (pair & ((1 << shift) - 1)).astype(np.int64)
        s[pos] = rule + first + len(rules)
        keep = np.ones(len(s), bool)
        keep[pos + 1] = False
        s = s[keep]
        rules += zip(left.tolist(), right.tolist(), strict=True)
        size = np.concatenate([size, size[left] + size[right]]).astype(np.uint32)
        lengths = size[first:]
    wide = 2 if first + len(rules) <= 65536 else 4
    kind = "<u2" if wide == 2 else "<u4"
    head = MAGIC + struct.pack("<6I", len(rules), len(s), len(ends), len(ids), wide, first)
    return head + np.array(rules, kind).tobytes() + np.asarray(lengths, "<u4").tobytes() + s.astype(kind).tobytes() + np.asarray(ends, "<u4").tobytes()


class Block:
    """A block of the file format, read."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_rules, n_symbols, n_docs, self.n_ids, wide, self.first = struct.unpack_from("<6I", raw, 4)
        kind, at = ("<u2" if wide == 2 else "<u4"), 28
        self.rules = np.frombuffer(raw, kind, 2 * n_rules, at).reshape(-1, 2)
        at += 2 * n_rules * wide
        self.lengths = np.frombuffer(raw, "<u4", n_rules, at)
        at += 4 * n_rules
        self.symbols = np.frombuffer(raw, kind, n_symbols, at)
        self.ends = np.frombuffer(raw, "<u4", n_docs, at + wide * n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols; those of many are put together from the ids of each rule."""
        if len(symbols) < 4 * len(self.rules):
            return self._rounds(symbols)
        of_rules = self._rounds(np.arange(self.first, self.first + len(self.rules)))
        begins, sizes = np.cumsum(self.lengths, dtype=np.int64) - self.lengths, np.ones(len(symbols), np.int64)
        over = np.flatnonzero(symbols >= self.first)
        rule = symbols[over].astype(np.int64) - self.first
        sizes[over] = self.lengths[rule]
        where = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[where] = symbols
        out[_ranges(where[over], sizes[over])] = of_rules[_ranges(begins[rule], sizes[over])]
        return out

    def _rounds(self, symbols: np.ndarray) -> np.ndarray:
        """A round replaces every nonterminal by its two symbols."""
        s = symbols.astype(np.uint32)
        rules = self.rules.astype(np.uint32)
        while len(at := np.flatnonzero(s >= self.first)):
            two = rules[s[at] - self.first]
            counts = np.ones(len(s), np.int64)
            counts[at] = 2
            where = np.cumsum(counts) - counts
            out = np.empty(int(where[-1] + counts[-1]), np.uint32)
            out[where] = s
            out[where[at]], out[where[at] + 1] = two[:, 0], two[:, 1]
            s = out
        return s

    def read(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop, by the expansion lengths alone: symbols outside are not expanded."""
        sizes = np.ones(len(self.symbols), np.int64)
        over = self.symbols >= self.first
        sizes[over] = self.lengths[self.symbols[over].astype(np.int64) - self.first]
        ends = np.cumsum(sizes)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - skipped : stop - skipped]


def write(docs: DataFrame, tokenizer_file: str, end_id: int = 1, block_ids: int = 1 << 19, first: int = 49_408, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of blocks that was written and read back: part, block, ids array (the documents' keys), n_ids, raw."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # rows of one id go by their text's hash; equal rows, which may stand in any order, by where they came from
    spread = given.repartitionByRange("id", "h", F.spark_partition_id()).sortWithinPartitions("id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("ids", (tokenizer_file, end_id), lambda: Encoder(tokenizer_file, end_id))
        part, block, keys, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            raw = compress(np.concatenate(parts), np.cumsum([len(x) for x in parts]), first)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), pa.array([keys], pa.list_(pa.int64())), pa.array([size]), pa.array([raw], pa.binary())], ["part", "block", "ids", "n_ids", "raw"])

        for batch in batches:
            for a, b in slices(pc.utf8_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False), TEXT_CHARS):
                rows = batch.slice(a, b - a)
                for k, x in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1)), strict=True):
                    if keys and size + len(x) > block_ids:
                        yield close()
                        block, keys, parts, size = block + 1, [], [], 0
                    keys.append(k)
                    parts.append(x)
                    size += len(x)
        if keys:
            yield close()

    return cut(spread.mapInArrow(run, "part long, block long, ids array<long>, n_ids long, raw binary"), "ids")


def read(blocks: DataFrame) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids_crc32) per document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, keys, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                b = Block(raw)
                flat, ends = b.expand(b.symbols).astype("<u4"), b.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(memoryview(flat[i:j])) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n), pa.array([block] * n), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    # ids before a block: those of the parts before, of which there are no more than partitions, and those before it in its part
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", earlier("n", W.orderBy("part")).alias("first"))
    bases = blocks.select("part", "block", "n_ids").withColumn("within", earlier("n_ids", W.partitionBy("part").orderBy("block"))).join(parts, "part").select("part", "block", (F.col("first") + F.col("within")).alias("base"))
    docs = blocks.mapInArrow(run, "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
