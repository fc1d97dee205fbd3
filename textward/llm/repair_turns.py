"""Repair of the structure of conversations: the cheapest edits that make the turns' role initials read (s?(ua)+)?.

Faults are found by Spark: blank and truncated rows by expressions, duplicates by a window over a conversation's equal rows, which deals a
conversation's rows out by their content. Rows are then dealt by conversation and sorted by turn, and a task streams over them with a Viterbi
search. After each row a state (nothing yet, s, u or a) has one survivor: the cheapest edits so far, and of equally cheap ones the least in
ASCII. Survivors are leaves of a tree of backpointers whose nodes count their references. Once all survivors share an ancestor, its path is
emitted and forgotten. A survivor that another one beats whatever follows is dropped, so that this happens soon.

Ties compare complete edit strings, also of unresolved suffixes. After a row all survivors hold one letter for each row so far, end in one and
lead to different states, so no string begins another; their order is carried along as a rank, and a step compares ranks and then new letters.

Memory holds the batch at hand and the unresolved rows. Those are few unless all survivors stay equally good: a run of rows whose roles are
none of s, u and a stays unresolved to its end. The rows of one conversation, however many, stream through one task, since each edit follows
from those before it; no group is gathered.

Edits: K keeps a row (free), R gives it the role user or assistant (2), D deletes it (3), I inserts an empty turn of user or assistant (2); a
truncated row that stays costs 1 more. Blank and duplicate rows must go.

Defined results: null roles and texts count as one space; rows without a conversation are one conversation; rows without a turn come first;
rows of one turn are ordered by role and text; repeated rows are duplicates; other columns are left out, so that their names can't clash; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.llm._shared import ship

#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in the first and the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted turn, or a changed role, leads to, and its role.
NEXT = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads to.
KEPT = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Turns to insert at the end.
CLOSE = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: At most so much more does the rest cost from the first state than from the second: a system turn goes (3), or turns are inserted to get in step.
BEHIND = {
    (NONE, SYSTEM): 0, (NONE, USER): 2, (NONE, ASSISTANT): 0, (SYSTEM, NONE): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
    (USER, NONE): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, NONE): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2,
}
#: Rows that wait before the tree is first looked at, and rows and characters of edits that go out at a time.
WAIT, OUT_ROWS, OUT_CHARS = 32, 2_000, 2_000_000
SPACES = r"\x20\x09-\x0D"
MUST_GO = ("blank", "duplicate")

EDITS = "conv_id {kind}, seq long, edit string, turn long, fault string, was string, role string, text string, cost long, ends boolean"


class _Node:
    """The edits of one row: inserted turns and what becomes of the row; refs counts survivors and children."""

    __slots__ = ("parent", "letters", "refs")

    def __init__(self, parent: _Node | None, letters: str):
        self.parent, self.letters, self.refs = parent, letters, 0
        if parent is not None:
            parent.refs += 1


def _release(node: _Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


class Conversation:
    """The search over one conversation. add() and close() return the edits that are settled, as (letter, row or None, role, text)."""

    def __init__(self):
        root = _Node(None, "")
        root.refs = 1
        #: By state: cost, rank of the edit string, node.
        self.survivors = {NONE: (0, 0, root)}
        self.rows: deque = deque()
        self.state, self.look, self.most = NONE, WAIT, 0

    def add(self, initial: str, fault: str | None, row) -> list:
        self.rows.append((initial, row))
        best: dict[int, tuple] = {}
        stay = fault == "truncated"
        for at, (cost, rank, _) in self.survivors.items():
            state, letters = at, ""
            for _ in range(3):
                options = [("D", state, cost + 3)]
                if fault not in MUST_GO:
                    options.append(("R", NEXT[state], cost + 2 + stay))
                    if (initial, state) in KEPT:
                        options.append(("K", KEPT[initial, state], cost + stay))
                for letter, to, total in options:
                    found = (total, rank, letters + letter, at)
                    if to not in best or found < best[to]:
                        best[to] = found
                state, letters, cost = NEXT[state], letters + "I", cost + 2
        least = {to: x for to, x in best.items() if all(x[0] <= best[y][0] + BEHIND[y, to] for y in best if y != to)}
        order = {to: k for k, to in enumerate(sorted(least, key=lambda to: least[to][1:3]))}
        now = {}
        for to, (total, _, letters, at) in least.items():
            now[to] = total, order[to], _Node(self.survivors[at][2], letters)
        for _, _, node in now.values():
            node.refs += 1
        for _, _, node in self.survivors.values():
            _release(node)
        self.survivors = now
        self.most = max(self.most, len(self.rows))
        return self._settled() if len(self.rows) >= self.look else []

    def _settled(self) -> list:
        """What all survivors share but the newest row, so that close() always has the last edit. The tree is looked at again when twice as many rows wait, so that looking takes linear time."""
        path, node = [], next(iter(self.survivors.values()))[2]
        while node.parent is not None:
            path.append(node)
            node = node.parent
        out = []
        while node.refs == 1 and len(path) > 1:
            node = path.pop()
            out += self._emit(node.letters)
        node.parent = None
        self.look = max(WAIT, 2 * len(self.rows))
        return out

    def _emit(self, letters: str) -> list:
        out = []
        for letter in letters:
            initial, row = ("", None) if letter == "I" else self.rows.popleft()
            if letter == "D":
                out.append((letter, row, None))
                continue
            self.state = KEPT[initial, self.state] if letter == "K" else NEXT[self.state]
            out.append((letter, row, None if letter == "K" else ROLE[self.state]))
        return out

    def close(self) -> list:
        _, _, state = min((cost + 2 * CLOSE[state], rank, state) for state, (cost, rank, _) in self.survivors.items())
        path, node = [], self.survivors[state][2]
        while node.parent is not None:
            path.append(node)
            node = node.parent
        return [x for node in reversed(path) for x in self._emit(node.letters)] + self._emit("I" * CLOSE[state])


def faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault): each row with its first fault among blank, duplicate (role and text came earlier) and truncated (the last character that is no space is none of . ! ?)."""
    r = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    same = Window.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())
    r = r.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    fault = F.when(~F.col("text").rlike(f"[^{SPACES}]"), "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), "truncated")
    return r.withColumn("fault", fault).drop("same")


def edits(found: DataFrame) -> DataFrame:
    """One row for each edit, of the rows that faults() gives: conv_id, seq (from 0), edit, the row's turn, fault and role before, the role and text after (null if deleted), its cost, and whether it is the conversation's last. A conversation's edits follow one another in a partition."""
    ship(found.sparkSession)
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = EDITS.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = found.select("conv_id", "turn", "role", "text", "fault").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars, seq, at, now, key_kind = [], 0, 0, None, None, None

        def put(settled: list, ends: bool = False) -> None:
            nonlocal chars, seq
            for k, (letter, row, role) in enumerate(settled):
                last = ends and k == len(settled) - 1
                if row is None:
                    out.append((at, seq, letter, None, None, None, role, "", 2, last))
                else:
                    turn, was, text, fault = row
                    cost = {"K": 0, "R": 2, "D": 3}[letter] + (letter != "D" and fault == "truncated")
                    out.append((at, seq, letter, turn, fault, was, None if letter == "D" else role or was, None if letter == "D" else text, cost, last))
                    chars += len(text)
                seq += 1

        def flush() -> pa.RecordBatch:
            nonlocal chars
            types = [key_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            chars = 0
            return batch

        for batch in batches:
            key_kind = batch.column(0).type
            for key, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != at:
                    if now is not None:
                        put(now.close(), True)
                    at, now, seq = key, Conversation(), 0
                put(now.add(role[:1], fault, (turn, role, text, fault)))
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield flush()
        if now is not None:
            put(now.close(), True)
            yield flush()

    return dealt.mapInArrow(run, schema)


DIGEST = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def digest(done: DataFrame) -> DataFrame:
    """One row per conversation of the edits that edits() gives, which must still lie as they came: counts of faults, missing turns and illegal neighbours before, and cost, letters and hash of the repair."""
    ship(done.sparkSession)
    kind = done.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "before": None, "sha": hashlib.sha256(), "any": False}
        now = fresh()
        for batch in batches:
            made = []
            for key, _, edit, turn, fault, was, role, text, cost, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now["cost"] += cost
                now["audit"].append(edit)
                if edit != "I":
                    if fault:
                        now[fault] += 1
                    if now["before"] is not None and now["before"] + was[:1] not in LEGAL:
                        now["illegal"] += 1
                    now["before"] = was[:1]
                    if turn is not None and turn != now["last"]:
                        now["first"] = turn if now["first"] is None else now["first"]
                        now["last"], now["turns"] = turn, now["turns"] + 1
                if edit != "D":
                    now["sha"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode())
                    now["any"] = True
                if ends:
                    gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
                    made.append((key, gaps, *(now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(now["audit"]), now["sha"].hexdigest()))
                    now = fresh()
                elif len(now["audit"]) >= 100_000:
                    now["audit"] = ["".join(now["audit"])] if len(now["audit"]) > 1 else now["audit"]
            if made:
                types = [batch.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                names = [c.split()[0] for c in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    return done.mapInArrow(run, DIGEST.format(kind=kind))


def _crc(conv: str, turn: str) -> Column:
    return F.crc32(F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" "))).cast("binary"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by crc32(conv_id:turn) % 20, null values written as one space. 0 drops a row (dropped is true), 1 empties its text, 2 removes . ! ?, 3 repeats it, 4 makes it the user's."""
    r = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (_crc("conv_id", "turn") % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("dropped"), "_k")
    return r.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))).drop("_k", "_n")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation after damage(), with the digest of its repair; one that lost all its rows has zeros and an empty repair."""
    damaged = damage(conversations)
    gone = damaged.groupBy("conv_id").agg(F.bool_and("dropped").alias("gone")).where("gone")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = gone.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return digest(edits(faults(damaged.where("NOT dropped")))).unionByName(empty)


_BYTES = "list_transform(range(1, length(s) + 1), lambda k: ascii(s[k]))"
_BIT = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: The same with whole edit strings for each row and state.
SQL = rf"""
WITH RECURSIVE crc8 AS (SELECT b, b AS c, 0 AS n FROM range(256) t(b) UNION ALL SELECT b, {_BIT}, n + 1 FROM crc8 WHERE n < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM crc8 WHERE n = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}::BIGINT[]), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]::BIGINT)), 4294967295) % 20 AS k FROM k, crc),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) u(x)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(st, goes, st2, letters, roles) AS (VALUES ('', 0, '', '', []), ('', 2, 'u', 'I', ['user:']), ('', 4, 'a', 'II', ['user:', 'assistant:']), ('s', 0, 's', '', []), ('s', 2, 'u', 'I', ['user:']), ('s', 4, 'a', 'II', ['user:', 'assistant:']),
  ('u', 0, 'u', '', []), ('u', 2, 'a', 'I', ['assistant:']), ('u', 4, 'u', 'II', ['assistant:', 'user:']), ('a', 0, 'a', '', []), ('a', 2, 'u', 'I', ['user:']), ('a', 4, 'a', 'II', ['user:', 'assistant:'])),
e AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, {{'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]}} AS best FROM f
  UNION ALL
  SELECT conv_id, i, st, min({{'cost': cost, 'audit': audit, 'rows': rows}}) FROM (
    SELECT e.conv_id, f.i, CASE x WHEN 'D' THEN ins.st2 WHEN 'K' THEN f.c ELSE CASE ins.st2 WHEN 'u' THEN 'a' ELSE 'u' END END AS st,
      e.best.cost + ins.goes + CASE x WHEN 'D' THEN 3 ELSE CASE x WHEN 'R' THEN 2 ELSE 0 END + (f.fault = 'truncated')::INT END AS cost, e.best.audit || ins.letters || x AS audit,
      e.best.rows || ins.roles::VARCHAR[] || CASE x WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ins.st2 WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END AS rows
    FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i + 1 JOIN ins ON ins.st = e.st, (VALUES ('D'), ('K'), ('R')) v(x)
    WHERE x = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (x = 'R' OR f.c = 's' AND ins.st2 = '' OR f.c = 'u' AND ins.st2 <> 'u' OR f.c = 'a' AND ins.st2 = 'u')) GROUP BY conv_id, i, st),
z AS (SELECT e.conv_id, min({{'cost': best.cost + goes, 'audit': best.audit || letters, 'rows': best.rows || roles::VARCHAR[]}}) AS best FROM e JOIN ins USING (st)
  WHERE st2 IN ('', 'a') AND (e.conv_id, i) IN (SELECT (conv_id, max(n)) FROM f GROUP BY conv_id) GROUP BY e.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
