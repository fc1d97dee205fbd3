"""SentencePiece BPE encoding by a table of prefixes, inside Spark tasks.

Merging by score leaves each prefix of a word with one last token, whatever follows. A task therefore walks over a word once: an
automaton of all pieces gives the pieces that end at each place, and the one that fits behind the last token of the prefix before it is
written down as this prefix's last token. Two tokens fit if merging their joint text would leave them apart, which the merges at their
seam decide. Ids are then recovered backwards, from the last prefix to the first. Time is linear in the text, also in words without spaces.
Characters that no piece holds stand alone and become bytes. Normalization and decoding are the library's.

No text is shuffled, a worker keeps a bounded number of words, and a lost task only repeats its own rows.

Defined results: a null or empty text has the begin and end ids alone and decodes to an empty text; ids of repeated texts repeat; a null
doc_id stays null; an empty table gives an empty table; other columns of the input are left out, so that their names can't clash.
Models must be merge-type (BPE) ones without user-defined symbols; one whose merges do not run in the order of their scores is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import kept, ship, slices

#: Words (and parts of words) and seams that a worker keeps, and characters of text that it splits at a time.
KEEP_WORDS, KEEP_SEAMS = 300_000, 500_000
TEXT_CHARS = 1_000_000
SPACE = "▁"


class Coder:
    """One worker's automaton of a model's pieces, with the words and seams that it has met."""

    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        self.piece = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)}
        self.rank = {p: -sp.get_score(i) for i, p in self.piece.items()}
        known = {c for p in self.piece.values() for c in p}
        if not known <= self.rank.keys():
            raise ValueError("characters of pieces must be pieces themselves")
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = None if sp.unk_id() in self.bytes else self.bytes
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        # a word ends before a run of spaces if no piece goes on over one, and at characters that no piece holds
        ends = "".join(c for c in "\n\r\t" if c not in known)
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece.values())
        self.words_of = re.compile((f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" if apart else f"[^{ends}]+") + (f"|[{ends}]" if ends else "")).findall
        self.edges: dict[int, tuple | None] = {}
        self.seams: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pairs = {p[k : k + 2] for p in self.piece.values() for k in range(len(p) - 1)}
        self.parts: dict[str, list[int]] = {}

    def _edges(self, token: int) -> tuple | None:
        """The parts at the left and at the right edge of a token while it is merged, each with the rank of the merge that takes it up; None if merging its text gives something else."""
        parts, left, right, before = list(self.piece[token]), [], [], -inf
        while len(parts) > 1:
            rank, k = min((self.rank.get(a + b, inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == inf:
                return None
            if rank < before:
                raise ValueError(f"the merges of {self.piece[token]!r} do not run in the order of their scores")
            if k == 0:
                left.append((parts[0], rank))
            if k == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            before = rank
        return [*left, (parts[0], inf)], [*right, (parts[0], inf)]

    def _stands(self, token: int) -> bool:
        """Whether merging a token's text gives the token."""
        if token not in self.edges:
            self.edges[token] = self._edges(token)
        return self.edges[token] is not None

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the texts of two tokens leaves them apart: no merge over the seam may come before those that take up the parts at its sides."""
        if not (self._stands(a) and self._stands(b)):
            return False
        lefts, rights = iter(self.edges[a][1]), iter(self.edges[b][0])
        (x, x_goes), (y, y_goes) = next(lefts), next(rights)
        while True:
            over = self.rank.get(x + y, inf)
            if over < x_goes and over <= y_goes and over < inf:  # of equal ranks the leftmost merges first
                return False
            if x_goes == y_goes == inf:
                return True
            if x_goes <= y_goes:
                x, x_goes = next(lefts)
            else:
                y, y_goes = next(rights)

    def _alone(self, char: str) -> list[int]:
        """Ids of a character that no piece holds."""
        return [self.unknown] if self.bytes is None else [self.bytes[b] for b in char.encode()]

    def _run(self, run: str) -> list[int]:
        """Ids of a run of characters that pieces hold."""
        last, seams, pieces = [-1] * len(run) + [0], self.seams, self.piece  # the entry of the empty prefix is at -1
        for at, (token, n) in self.automaton.iter(run):
            if last[at] >= 0:
                continue
            if at >= n:
                seam = last[at - n] << 32 | token
                fits = seams.get(seam)
                if fits is None:
                    fits = seams[seam] = self._fits(last[at - n], token)
            else:
                fits = self._stands(token)
            if fits:
                last[at] = token
        ids, at = [], len(run) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(pieces[last[at]])
        ids.reverse()
        return ids

    def word(self, word: str) -> list[int]:
        """Ids of a part of a text that no merge leaves. It is cut further wherever no piece holds the two characters that meet; such parts are met again more often."""
        ids, begin = [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in self.pairs:
                part = word[begin:k]
                if part not in self.parts:
                    self.parts[part] = self._run(part) if part[0] in self.rank else self._alone(part)
                ids += self.parts[part]
                begin = k
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, with the begin and end ids."""
        split = [self.words_of(self.library.normalize(t)) if t else [] for t in texts]
        met = set().union(*split)
        new = [w for w in met if w not in self.words]
        if len(self.words) + len(new) > KEEP_WORDS:  # those of these texts stay
            self.words = {w: self.words[w] for w in met & self.words.keys()}
        if len(self.parts) > KEEP_WORDS:
            self.parts.clear()
        if len(self.seams) > KEEP_SEAMS:
            self.seams.clear()
        for w in new:
            self.words[w] = np.array(self.word(w), "<u4").tobytes()
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        get = self.words.__getitem__
        return [b"".join((begin, *map(get, s), end)) for s in split]

    def decode(self, coded: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(c, "<u4").tolist()) for c in coded]


def _coder(model_file: str) -> Coder:
    return kept("pieces", model_file, lambda: Coder(model_file))


def _mapped(docs: DataFrame, model_file: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """docs through make(coder, texts) -> arrays, a bounded number of characters at a time."""
    ship(docs.sparkSession)
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False), TEXT_CHARS):
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *make(coder, texts.slice(a, b - a).to_pylist())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def _lists(coded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids) per document, with the model's begin and end ids."""
    return _mapped(docs, model_file, id_col, text_col, "ids array<int>", lambda coder, texts: [_lists(coder.encode(texts))])


def decode(coded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id_col, decoded) per list of ids; a null list decodes to an empty text, and an id outside the model is an error."""
    ship(coded.sparkSession)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_file)
        for batch in batches:
            texts = [coder.library.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to: encode() and decode() in one pass, so that the ids stay in the worker."""

    def digests(coder: Coder, texts: list[str | None]) -> list[pa.Array]:
        coded = coder.encode(texts)
        ids = [hashlib.sha256(c).hexdigest() for c in coded]
        decoded = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(coded)]
        return [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_file, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
