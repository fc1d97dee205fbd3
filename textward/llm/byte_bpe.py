"""Byte-level BPE encoding and decoding with DuckDB queries inside Spark tasks.

A task splits its texts into words and keeps the distinct ones that it has not met. Their bytes become
token-position rows of a DuckDB table. A recursive query joins the rows with the merge table, contracts
each word's leftmost pair of least rank, and repeats until no word has a pair left. Decoding is an ordered
aggregation of the tokens' bytes. Nothing is shuffled, and a lost task only repeats its own rows.

Defined results: a null or empty text has no ids; the ids of repeated texts repeat; an empty table gives an
empty table; other columns of the input are left out, so that their names can't clash. A null list of ids
decodes to empty bytes; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import kept, ship, slices

#: Distinct words that a worker keeps the ids of, and bytes of new words that go to one DuckDB query.
KEEP_WORDS = 200_000
QUERY_BYTES = 200_000
#: Characters of text that a worker splits at a time.
TEXT_CHARS = 1_000_000
#: A word of more bytes goes to DuckDB by itself, so many rounds a query that the recursion's rows stay few.
LONG_WORD = 2000

#: Token-position rows: a word, a position, its token, the next position and its token.
_SEED = """
WITH one AS MATERIALIZED (
  SELECT w, k::INT AS pos, bytes.id FROM (SELECT w, tok, unnest(range(1, length(tok) + 1)) AS k FROM words WHERE tok NOT IN (SELECT tok FROM vocab)) u
  JOIN bytes ON bytes.tok = u.tok[k])
SELECT a.w, a.pos, a.id, b.pos AS npos, b.id AS nid FROM one a LEFT JOIN one b ON b.w = a.w AND b.pos = a.pos + 1
"""
#: The rows after one round: in each word, the leftmost pair of least rank becomes one token. Words without a pair are left out.
_ROUND = """
WITH best AS (SELECT w, min({{'c': c, 'pos': pos, 'npos': npos}}) AS m FROM {rows} JOIN merges ON a = id AND b = nid GROUP BY w),
pair AS (SELECT best.w, m.c AS c, m.pos AS p, m.npos AS np, r.npos AS npos2, r.nid AS nid2 FROM best JOIN {rows} r ON r.w = best.w AND r.pos = m.npos)
SELECT r.w, r.pos, CASE WHEN r.pos = p THEN c ELSE r.id END AS id,
       CASE WHEN r.pos = p THEN npos2 ELSE r.npos END AS npos,
       CASE WHEN r.pos = p THEN nid2 WHEN r.npos = p THEN c ELSE r.nid END AS nid, r.round + 1 AS round
FROM {rows} r JOIN pair ON r.w = pair.w WHERE r.pos <> np AND r.round < {rounds}
"""
#: Round after round until no word has a pair, or so many rounds; then each word's last rows.
_ENCODE = """
WITH RECURSIVE bpe AS (SELECT w, pos, id, npos, nid, 0 AS round FROM ({seed}) UNION ALL ({round})),
last AS (SELECT w, max(round) AS round FROM bpe GROUP BY w)
SELECT bpe.* FROM bpe JOIN last USING (w, round)
"""
#: One round of one long word: all pairs at once that are of least rank among the pairs around them, as far as a token reaches that might take one of
#: their parts before their turn ({reach} bytes, the longest token in the word). A token that could make a pair of lower rank with a neighbour is contracted where it is the
#: leftmost of its rank around; others wherever they are, every other one of a run of overlapping ones. The result is that of contracting one pair after another.
_LONG_ROUND = """
WITH pair AS (SELECT pos, npos, c, min(c) OVER (ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND 2 * {reach} FOLLOWING) AS low, min(c) OVER (ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS low_before,
      coalesce(lag(c) OVER (ORDER BY pos) = c AND lag(npos) OVER (ORDER BY pos) = pos, false) AS goes_on FROM bpe JOIN merges ON a = id AND b = nid WHERE round < {rounds}),
run AS (SELECT *, sum((NOT goes_on)::INT) OVER (ORDER BY pos) AS g FROM pair),
turn AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) AS k, bool_and(c = low) OVER (PARTITION BY g) AS whole FROM run),
take AS (SELECT pos, npos, c FROM turn WHERE c = low AND CASE WHEN c IN (SELECT x FROM unsafe) THEN coalesce(low_before > c, true) ELSE whole AND k % 2 = 1 END),
stay AS (SELECT r.pos, coalesce(take.c, r.id) AS id, r.round + 1 AS round FROM bpe r LEFT JOIN take ON take.pos = r.pos WHERE r.pos NOT IN (SELECT npos FROM take) AND EXISTS (SELECT 1 FROM take))
SELECT 0 AS w, pos, id, lead(pos) OVER (ORDER BY pos) AS npos, lead(id) OVER (ORDER BY pos) AS nid, round FROM stay
"""
_WORDS = f"""
SELECT w, list(id) AS ids FROM (SELECT w, id FROM ({_ENCODE.format(seed=_SEED, round=_ROUND.format(rows="bpe", rounds=10**9))}) ORDER BY w, pos) GROUP BY w
UNION ALL
SELECT w, [id] FROM words JOIN vocab USING (tok)
"""


class Coder:
    """One worker's DuckDB tables of a rank file and the ids of the words that it has met."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words: dict[str, bytes] = {"": b""}
        self.pattern = regex.compile(pattern)
        self.plain = _plain(pattern)
        self.db = db = duckdb.connect()
        db.execute("SET threads = 1; SET memory_limit = '300MB'; SET preserve_insertion_order = false")
        # a token's bytes are written as the characters of the same numbers, since they need not be UTF-8
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "tok": [t.decode("latin-1") for t in ranks]})
        db.register("given", vocab)
        db.execute("CREATE TABLE vocab AS SELECT * FROM given ORDER BY id")
        db.execute("CREATE TABLE bytes AS SELECT * FROM vocab WHERE length(tok) = 1")
        db.execute("""CREATE TABLE merges AS SELECT l.id AS a, r.id AS b, v.id AS c
            FROM (SELECT id, tok, unnest(range(1, length(tok))) AS k FROM vocab WHERE length(tok) > 1) v
            JOIN vocab l ON l.tok = left(v.tok, v.k) JOIN vocab r ON r.tok = substr(v.tok, v.k + 1)""")
        db.execute("CREATE TABLE unsafe AS SELECT DISTINCT x FROM (SELECT a AS x, c FROM merges UNION ALL SELECT b, c FROM merges) WHERE c < x")
        db.execute("CREATE TABLE by_id AS SELECT list(tok ORDER BY i) AS toks FROM (SELECT unnest(range(0, max(id) + 1)) AS i FROM vocab) LEFT JOIN vocab ON id = i")

    def split(self, text: str) -> list[str]:
        """The pattern's matches; by the faster engine where both engines' classes agree on every character."""
        if self.plain is not None and _ALIKE(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def learn(self, words: list[str]) -> None:
        """Get the ids of new words from DuckDB, a bounded number of bytes at a time."""
        batch, size = [], 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_WORD:
                self._one(word, raw)
                continue
            batch.append((word, raw))
            size += len(raw)
            if size >= QUERY_BYTES:
                self._many(batch)
                batch, size = [], 0
        if batch:
            self._many(batch)

    def _many(self, batch: list[tuple[str, bytes]]) -> None:
        self.db.register("words", pa.table({"w": pa.array(range(len(batch)), pa.int32()), "tok": [raw.decode("latin-1") for _, raw in batch]}))
        found = self.db.sql(_WORDS).to_arrow_table()
        ids = found["ids"].combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4", copy=False)
        for w, a, b in zip(found["w"].to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            self.words[batch[w][0]] = flat[a:b].tobytes()

    def _one(self, word: str, raw: bytes) -> None:
        db = self.db
        db.register("words", pa.table({"w": pa.array([0], pa.int32()), "tok": [raw.decode("latin-1")]}))
        rounds = max(1, 3_000_000 // len(raw))
        reach = db.execute("SELECT max(length(vocab.tok)) FROM vocab, words WHERE contains(words.tok, vocab.tok)").fetchall()[0][0]
        db.execute(f"CREATE OR REPLACE TEMP TABLE now AS {_SEED}")
        while True:
            step = _ENCODE.format(seed="SELECT * FROM now", round=_LONG_ROUND.format(rounds=rounds, reach=reach))
            db.execute(f"CREATE OR REPLACE TEMP TABLE nxt AS {step}")
            more = db.execute("SELECT count(*) FROM nxt WHERE round = ?", [rounds]).fetchall()[0][0]
            db.execute("CREATE OR REPLACE TEMP TABLE now AS SELECT w, pos, id, npos, nid FROM nxt")
            if not more:
                break
        # the whole word may be one token; it then has no rows
        ids = [x for (x,) in db.execute("SELECT id FROM (SELECT pos, id FROM now UNION ALL SELECT 0, id FROM words JOIN vocab USING (tok)) ORDER BY pos").fetchall()]
        self.words[word] = np.asarray(ids, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> pa.Array:
        split = [self.split(t) if t else [] for t in texts]
        distinct = set().union(*split)
        if len(self.words) > KEEP_WORDS:  # those of these texts stay
            self.words = {w: self.words[w] for w in distinct & self.words.keys()}
        self.learn([w for w in distinct if w not in self.words])
        get = self.words.__getitem__
        parts = [b"".join(map(get, s)) for s in split]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))

    def decode(self, ids: pa.Array) -> list[bytes]:
        self.db.register("coded", pa.table({"k": pa.array(range(len(ids)), pa.int32()), "ids": ids}))
        found = self.db.sql("SELECT k, list_aggregate(list_select(toks, list_transform(ids, lambda i: i + 1)), 'string_agg', '') AS s FROM coded, by_id ORDER BY k").to_arrow_table()
        return [(s or "").encode("latin-1") for s in found["s"].to_pylist()]

    def digests(self, ids: pa.Array) -> pa.Array:
        """SHA-256 of each list's decimal ids, joined by commas."""
        self.db.register("coded", pa.table({"k": pa.array(range(len(ids)), pa.int32()), "ids": ids}))
        return self.db.sql("SELECT sha256(array_to_string(ids, ',')) AS s FROM coded ORDER BY k").to_arrow_table()["s"].combine_chunks().cast(pa.string())


#: Characters that Python's and the regex module's classes for letters, digits and white space treat alike.
_ALIKE = re.compile("[\t\n\r -~ ¡£-©«-±´¶-¸»¿-ɏΑ-ΡΣ-ωА-я–—‘-”…€]*").fullmatch


def _plain(pattern: str) -> re.Pattern | None:
    """The pattern for Python's own engine, if its Unicode classes are those that can be written for it."""
    known = {r"\p{L}+": r"[^\W\d_]+", r"\p{N}+": r"\d+", r"[^\s\p{L}\p{N}]+": r"(?:[^\s\w]|_)+"}
    for a in sorted(known, key=len, reverse=True):
        pattern = pattern.replace(a, known[a])
    return None if r"\p" in pattern else re.compile(pattern)


def _coder(ranks_file: str, pattern: str) -> Coder:
    return kept("bpe", (ranks_file, pattern), lambda: Coder(ranks_file, pattern))


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids) per document; the pattern's matches are encoded separately and there are no special tokens."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, TEXT_CHARS):
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), coder.encode(texts.slice(a, b - a).to_pylist())], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id_col, ids, decoded) per list of ids; decoded is binary, since ids may end within a character."""
    ship(coded.sparkSession)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, 1_000_000):
                part = ids.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), part, pa.array(coder.decode(part), pa.binary())], ["id", "ids", "decoded"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to (and the ids): encode() and decode() in one pass, so that the ids stay in the worker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False), TEXT_CHARS):
                ids = coder.encode(texts.slice(a, b - a).to_pylist())
                decoded = [hashlib.sha256(x).hexdigest() for x in coder.decode(ids)]
                columns = [keys.slice(a, b - a), ids.value_lengths().cast(pa.int64()), coder.digests(ids), pa.array(decoded, pa.string())] + [ids] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
