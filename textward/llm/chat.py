"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are tables. They are hash-joined by the call's identifier; identical copies are first counted into
one row by a partial aggregation, so that no identifier gathers its copies in one task. A call may refer to other calls
("after"), in whatever turn or conversation; its level is the length of the longest chain of references below it, so that
(conv_id, level, turn, call_id) is a topological order. Calls with one reference find the end of their chain by pointer
doubling: rounds follow the logarithm of the longest chain, and each writes one table. Calls with several references
are then peeled off in rounds; a round gives those whose references all lead to known levels theirs, so these rounds follow
how deep such calls lie behind one another, with the chains between them skipped. Arguments are parsed once to a variant and
checked against the tool's schema. The JSON has no white space, its keys are sorted, and nulls are left out.
Everything is DataFrame functions.

Defined results (status): linked; no_result for a call without a result; orphan for a result without a call;
ambiguous for an identifier with different calls or different results (the least of each, by turn and then text, is
used). A null identifier is never linked. level is null for calls in a cycle or that lead to one, or to a call that isn't
there. errors lists, sorted: invalid_json, unknown_tool, missing:FIELD, type:FIELD, range:FIELD. Empty tables
give no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import cut, forget


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # STRING or BIGINT, as schema_of_variant names them
    required: bool = False
    least: int | None = None
    most: int | None = None


Schemas = dict[str, tuple[Field, ...]]


def _errors(name: Column, args: Column, schemas: Schemas) -> Column:
    """The sorted errors of arguments, given as a variant that is null if they are no JSON."""
    checks = [F.when(args.isNull(), F.lit("invalid_json")), F.when(F.coalesce(~name.isin(*schemas), F.lit(True)), F.lit("unknown_tool"))]
    for tool, fields in schemas.items():
        for f in fields:
            path, here = f"$.{f.name}", (name == tool) & args.isNotNull()
            kind = F.schema_of_variant(F.try_variant_get(args, path, "variant"))
            missing = kind.isNull() | (kind == "VOID")
            if f.required:
                checks.append(F.when(here & missing, F.lit(f"missing:{f.name}")))
            checks.append(F.when(here & ~missing & (kind != f.kind), F.lit(f"type:{f.name}")))
            if f.least is not None or f.most is not None:
                value = F.try_variant_get(args, path, "bigint")
                outside = (value < f.least if f.least is not None else F.lit(False)) | (value > f.most if f.most is not None else F.lit(False))
                checks.append(F.when(here & (kind == f.kind) & outside, F.lit(f"range:{f.name}")))
    return F.array_sort(F.array_compact(F.array(*checks)))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of distinct calls (call_id, after); calls without a level are left out."""
    refs = calls.select("call_id", F.array_distinct(F.array_compact(F.coalesce("after", F.array().cast("array<string>")))).alias("refs"))
    # chains end at calls without a reference or with several (many), or at none that is there (end_id null)
    single = F.size("refs") == 1
    refs = cut(refs, "chat-refs")
    jump = cut(refs.select("call_id", F.when(single, F.col("refs")[0]).otherwise(F.col("call_id")).alias("end_id"), F.when(single, 1).otherwise(0).cast("long").alias("steps"), (~single).alias("ended"), (F.size("refs") > 1).alias("many")), "chat-jump")
    open_before, still_open = None, jump.where("NOT ended").count()
    # each round meets the chains up to twice as long and one more; once none is met, the others are cycles
    while still_open and still_open != open_before:
        target = jump.select(F.col("call_id").alias("end_id"), F.col("end_id").alias("next_id"), F.col("steps").alias("more"), F.col("ended").alias("its_ended"), F.col("many").alias("its_many"))
        met = jump.where("NOT ended").drop("ended", "many").join(target, "end_id", "left")
        met = met.select("call_id", F.col("next_id").alias("end_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("its_ended", F.lit(True)).alias("ended"), F.coalesce("its_many", F.lit(False)).alias("many"))
        longer = cut(jump.where("ended").unionByName(met), "chat-jump")
        forget(jump)
        jump, open_before, still_open = longer, still_open, longer.where("NOT ended").count()
    whole = jump.where("ended AND end_id IS NOT NULL")
    out = whole.where("NOT many").select("call_id", F.col("steps").cast("int").alias("level"))
    if not whole.where("many").limit(1).count():
        return out
    ends = whole.select(F.col("call_id").alias("after"), "end_id", "steps", F.col("many").alias("behind"))
    now = refs.where(F.size("refs") > 1).select("call_id", F.explode("refs").alias("after")).join(ends, "after", "left")
    # level: what a reference gives the call, once the call at the end of its chain is known; a lost reference stays unknown
    now = cut(now.select("call_id", "end_id", (F.col("steps") + 1).alias("steps"), F.when(~F.col("behind"), F.col("steps") + 1).alias("level")), "chat-many")
    done = []
    while True:
        free = cut(now.groupBy("call_id").agg(F.every(F.col("level").isNotNull()).alias("free"), F.max("level").alias("level")).where("free").select("call_id", "level"), "chat-level")
        done.append(free)
        if not free.limit(1).count():
            break
        known = free.select(F.col("call_id").alias("end_id"), F.col("level").alias("its_level"))
        rest = now.join(free.select("call_id"), "call_id", "left_anti").join(known, "end_id", "left")
        rest = cut(rest.select("call_id", "end_id", "steps", F.coalesce("level", F.col("its_level") + F.col("steps")).alias("level")), "chat-many")
        forget(now)
        now = rest
    # one scan of all rounds' files rather than a union of the rounds
    levelled = calls.sparkSession.read.schema(done[0].schema).parquet(*(f for d in done for f in d.inputFiles()))
    behind = whole.where("many").join(levelled.withColumnRenamed("call_id", "end_id"), "end_id")
    return out.unionByName(behind.select("call_id", (F.col("level") + F.col("steps")).cast("int").alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids); results: conv_id, turn, call_id, content. One row per identifier (and per row without one)."""
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    r = results.select("conv_id", "turn", "call_id", "content")
    one_c = c.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "conv_id", "name", "arguments", "after")).alias("c"), F.max(F.struct("turn", "conv_id", "name", "arguments", "after")).alias("c2"))
    one_r = r.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("r"), F.max(F.struct("turn", "content", "conv_id")).alias("r2"))
    both = one_c.join(one_r, "call_id", "full")
    loose_c = c.where("call_id IS NULL").select("call_id", F.struct("turn", "conv_id", "name", "arguments", "after").alias("c"))
    loose_r = r.where("call_id IS NULL").select("call_id", F.struct("turn", "content", "conv_id").alias("r"))
    both = both.unionByName(loose_c, allowMissingColumns=True).unionByName(loose_r, allowMissingColumns=True)
    both = cut(both, "chat-linked")

    known = both.where("c IS NOT NULL AND call_id IS NOT NULL")
    order = levels(known.select("call_id", "c.after"))
    same = F.col("c").eqNullSafe(F.coalesce("c2", "c")) & F.col("r").eqNullSafe(F.coalesce("r2", "r"))
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull() & same, "no_result").when(~same, "ambiguous").otherwise("linked")
    args = F.try_parse_json(F.col("c.arguments"))
    out = both.join(order, "call_id", "left").withColumns({"args": args, "status": status})
    out = out.withColumn("errors", F.when(F.col("c").isNotNull(), _errors(F.col("c.name"), F.col("args"), schemas)).otherwise(F.array().cast("array<string>")))
    # the struct's fields are in the order of their names
    doc = F.struct(
        F.col("args").alias("arguments"), F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), F.col("call_id").alias("id"),
        F.col("level").alias("level"), F.col("c.name").alias("name"), F.col("r.content").alias("result"), F.col("status").alias("status"), F.coalesce("c.turn", "r.turn").alias("turn"),
    )
    return out.select(F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.turn", "r.turn").alias("turn"), "call_id", "level", "status", F.array_join("errors", ",").alias("errors"), F.to_json(doc).alias("json"))


#: The tools of tool_messages().
TOOLS: Schemas = {
    "search": (Field("limit", "BIGINT", least=1, most=100), Field("query", "STRING", required=True)),
    "lookup": (Field("key", "STRING", required=True), Field("limit", "BIGINT")),
    "count": (Field("limit", "STRING"), Field("query", "STRING", required=True)),
}


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of plain conversations, which hold none.

    A user's turn makes one to three calls. The first is on its text and comes after the first call of the user's turn before it; the second comes
    after the first, the third after both. In every thirteenth conversation the second also waits for the third, which is a cycle. The assistant's
    next turn answers the first two calls. Tools follow from the place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_of = lambda turn, k: F.md5(F.concat_ws(":", F.lit("call"), "conv_id", turn, k.cast("string")).cast("binary"))
    place = lambda turn, more, of: F.pmod(F.floor(turn / 2) + F.col("conv_id") + more, F.lit(of))
    calls_of = lambda turn: F.sequence(F.lit(0), place(turn, 0, 3).cast("int"))
    turn, k = F.col("turn"), F.col("k")
    users = conversations.where("role = 'user'").select("conv_id", "turn", text.alias("text"), F.explode(calls_of(turn)).alias("k"))
    tool = F.element_at(F.array(*(F.lit(x) for x in ("search", "lookup", "count", "translate"))), (place(turn, k, 4) + 1).cast("int"))
    # to_json of a struct writes valid JSON; every eleventh call is cut short and so is none
    args = F.to_json(F.struct((F.size(F.split("text", " ")) + k).cast("long").alias("limit"), F.when(k == 0, F.col("text")).otherwise(F.md5(F.col("text").cast("binary"))).alias("query")))
    args = F.when(F.pmod(F.col("conv_id") + turn + k, F.lit(11)) == 0, F.lit('{"query":')).otherwise(args)
    own = lambda j: id_of(turn, F.lit(j))
    cycle = (F.pmod("conv_id", F.lit(13)) == 0) & (place(turn, 0, 3) == 2)
    after = F.when(k == 2, F.array(own(0), own(1))).when(k == 1, F.when(cycle, F.array(own(0), own(2))).otherwise(F.array(own(0)))).when(turn >= 2, F.array(id_of(turn - 2, F.lit(0))))
    calls = users.select("conv_id", "turn", id_of(turn, k).alias("call_id"), tool.alias("name"), args.alias("arguments"), after.alias("after"))
    answers = conversations.where("role = 'assistant'").select("conv_id", "turn", text.alias("text"), F.explode(F.slice(calls_of(turn - 1), 1, 2)).alias("k"))
    results = answers.select("conv_id", "turn", id_of(turn - 1, k).alias("call_id"), F.when(k == 0, F.col("text")).otherwise(F.md5(F.col("text").cast("binary"))).alias("content"))
    return calls, results


#: DuckDB SQL of link(*tool_messages(conversations), TOOLS).
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, k, md5('call:' || conv_id || ':' || turn || ':' || k) AS call_id, ['search', 'lookup', 'count', 'translate'][(turn // 2 + conv_id + k) % 4 + 1] AS name,
      (conv_id + turn + k) % 11 = 0 AS broken, (len(string_split(text, ' ')) + k)::BIGINT AS n, CASE WHEN k = 0 THEN text ELSE md5(text) END AS q
      FROM m, range(0, 3) t(k) WHERE role = 'user' AND k <= (turn // 2 + conv_id) % 3),
refs AS (SELECT call_id, md5('call:' || conv_id || ':' || (turn - 2) || ':0') AS ref FROM c WHERE k = 0 AND turn >= 2
      UNION ALL SELECT call_id, md5('call:' || conv_id || ':' || turn || ':' || j) FROM c, range(0, 3) t(j) WHERE j < k OR k = 1 AND j = 2 AND conv_id % 13 = 0 AND (turn // 2 + conv_id) % 3 = 2),
reach AS (SELECT call_id, ref FROM refs UNION SELECT reach.call_id, refs.ref FROM reach JOIN refs ON refs.call_id = reach.ref),
lost AS (SELECT ref FROM refs WHERE ref NOT IN (SELECT call_id FROM c) UNION SELECT call_id FROM reach WHERE call_id = ref),
stuck AS (SELECT ref AS call_id FROM lost UNION SELECT call_id FROM reach WHERE ref IN (SELECT ref FROM lost)),
paths AS (SELECT call_id, 0 AS d FROM c WHERE call_id NOT IN (SELECT call_id FROM stuck)
      UNION SELECT refs.call_id, d + 1 FROM paths JOIN refs ON refs.ref = paths.call_id WHERE refs.call_id NOT IN (SELECT call_id FROM stuck)),
lv AS (SELECT call_id, max(d)::INT AS level FROM paths GROUP BY call_id),
r AS (SELECT conv_id, turn, md5('call:' || conv_id || ':' || (turn - 1) || ':' || k) AS call_id, CASE WHEN k = 0 THEN text ELSE md5(text) END AS content
      FROM m, range(0, 2) t(k) WHERE role = 'assistant' AND k <= ((turn - 1) // 2 + conv_id) % 3),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, call_id, level, c.call_id IS NULL AS no_call, name, broken, n, q, content,
      CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status
      FROM c FULL JOIN r USING (call_id) LEFT JOIN lv USING (call_id)),
e AS (SELECT *, CASE WHEN no_call THEN [] ELSE list_sort(list_filter([CASE WHEN broken THEN 'invalid_json' END, CASE WHEN name = 'translate' THEN 'unknown_tool' END,
      CASE WHEN NOT broken AND name = 'search' AND (n < 1 OR n > 100) THEN 'range:limit' END, CASE WHEN NOT broken AND name = 'lookup' THEN 'missing:key' END,
      CASE WHEN NOT broken AND name = 'count' THEN 'type:limit' END], lambda x: x IS NOT NULL)) END AS errs FROM j)
SELECT conv_id, turn, call_id, level, status, array_to_string(errs, ',') AS errors,
  '{' || concat_ws(',', CASE WHEN NOT no_call AND NOT broken THEN '"arguments":' || json_object('limit', n, 'query', q)::VARCHAR END, '"conv_id":' || conv_id,
  CASE WHEN len(errs) > 0 THEN '"errors":' || to_json(errs)::VARCHAR END, '"id":"' || call_id || '"', '"level":' || level, '"name":"' || name || '"',
  '"result":' || to_json(content)::VARCHAR, '"status":"' || status || '"', '"turn":' || turn) || '}' AS json
FROM e
"""
