"""The registered queries on what a language model writes and on inference with a model, and their DuckDB SQL. The offline model answers from request keys, so SQL can say what it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rng import pick
from textward.operators import inference, rules
from textward.operators import model_samples as ms
from textward.plans import sql
from textward.plans.catalog import query
from textward.session import delete_folder, shared_folder, ship, table
from textward.sources import jsonl
from textward.sources import model_calls as mc

PROMPTS, CLIENT = "textward.operators.model_samples:prompt", "textward.sources.model_calls:OfflineModel"


def _totals(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Samples to ask for of each kind: a row of a count for each of the eight."""
    kinds = table(spark, sf_dir, "orders").groupBy(pick(F.col("o_orderkey"), "llm", ms.KINDS).alias("kind")).agg(F.count("*").alias("n"))
    return {r.kind: r.n for r in kinds.collect()}


def _answers(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    ship(spark)
    return mc.read_answers(spark, _totals(spark, sf_dir), PROMPTS, CLIENT, **options)


_pool = ", ".join(f"('{k}', {i}, {sql.quote(x)}, {len(s)})" for k, s in mc.SENTENCES.items() for i, x in enumerate(s))


def _answers_sql(tries: int) -> str:
    return f"""t AS (SELECT kind, count(*) AS total FROM (SELECT {sql.pick('llm', ms.KINDS, 'o_orderkey')} AS kind FROM orders) GROUP BY kind),
b AS (SELECT kind, batch, least(30, total - batch * 30)::INT AS n, kind || ':' || batch AS key FROM t, unnest(range(0, (total + 29) // 30)) r(batch)),
f AS (SELECT b.*, k, {sql.below('fails', 10, "(key || ':' || k)")} = 0 AS failed FROM b, range({tries}) r(k)),
an AS (SELECT kind, batch, n, key, coalesce(min(k) FILTER (NOT failed) + 1, {tries})::INT AS tries, bool_or(NOT failed) AS answered, {sql.below('shape', 4, 'key')} AS shape FROM f GROUP BY ALL),
pool(kind, idx, said, size) AS (VALUES {_pool}),
cx AS (SELECT an.kind, batch, key || ':' || place AS id, said AS context FROM an, unnest(range(0, n)) p(place) JOIN pool ON pool.kind = an.kind AND idx = {sql.u('says', "(key || ':' || place)")} % size WHERE answered AND shape <> 3)"""


_one = lambda slot, *xs: f"CASE {sql.below(slot, len(xs))} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
_first, _last, _number, _domain = sql.pick("e0", ms.MAIL_FIRST), sql.pick("e1", ms.MAIL_LAST), f"({sql.below('e2', 999)} + 1)", f"'@' || {sql.pick('e3', ms.MAIL_DOMAINS)}"
_left, _right = f"({sql.below('h0', 4)} + 6) || {sql.digits('h1', 4)}", sql.digits("h2", 5)
_whole = f"({sql.pick('c0', ms.CARD_STARTS)} || {sql.digits('c1', 7)} || {sql.digits('c2', 8)})"
_cut = lambda *ps: " || ' ' || ".join(f"substr({_whole}, {a}, {n})" for a, n in ps)
_VALUES = {
    "IN_AADHAAR": sql.VALUES["IN_AADHAAR"],
    "IN_PAN": sql.VALUES["IN_PAN"],
    "EMAIL_ADDRESS": _one("e4", f"{_first} || '.' || {_last} || {_number} || {_domain}", f"{_first} || {_number} || {_domain}", f"{_first} || '_' || {_last} || {_domain}"),
    "PHONE_NUMBER": _one("h3", f"'+91 ' || {_left} || ' ' || {_right}", f"'+91-' || {_left} || '-' || {_right}", f"{_left} || ' ' || {_right}"),
    "US_SSN": f"lpad((1 + {sql.below('s0', 898)} + ({sql.below('s0', 898)} >= 665)::INT)::VARCHAR, 3, '0') || '-' || lpad(({sql.below('s1', 99)} + 1)::VARCHAR, 2, '0') || '-' || lpad(({sql.below('s2', 9999)} + 1)::VARCHAR, 4, '0')",
    "CREDIT_CARD": f"CASE WHEN starts_with({_whole}, '37') THEN {_cut((1, 4), (5, 6), (11, 5))} ELSE {_cut((1, 4), (5, 4), (9, 4), (13, 4))} END",
    "PERSON": f"{sql.pick('n0', ms.FIRST)} || ' ' || {sql.pick('n1', ms.LAST)}",
}
_mark = sql.cases("kind", {k: sql.quote(v) for k, v in ms.PLACEHOLDERS.items()}, "NULL")
_strong = sql.cases("kind", {k: "(" + " OR ".join(f"contains(lower(text), {sql.quote(w)})" for w in words) + ")" for k, words in ms.CONTEXT_WORDS.items()}, "false")
_SAMPLES = f"""m AS (SELECT *, {_mark} AS mark FROM cx), k AS (SELECT *, {sql.cases('kind', _VALUES, 'NULL')} AS value FROM m WHERE mark IS NULL OR contains(context, mark)),
w AS (SELECT *, CASE WHEN mark IS NULL THEN context ELSE replace(context, mark, value) END AS text FROM k),
sm AS (SELECT id, kind, batch, text, mark IS NOT NULL AS flagged, CASE WHEN mark IS NOT NULL THEN kind END AS pii_type, value, (strpos(text, value) - 1)::INT AS start, (strpos(text, value) - 1 + length(value))::INT AS "end",
  CASE WHEN mark IS NULL THEN 10 WHEN {_strong} THEN {sql.below('sure', 2)} + 9 ELSE {sql.below('sure', 3)} + 6 END::INT AS confidence FROM w)"""


@query("model_answers", f"WITH {_answers_sql(3)} SELECT kind, batch, n, tries, answered, CASE WHEN answered AND shape <> 3 THEN n ELSE 0 END::BIGINT AS n_contexts FROM an")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came back for each batch, failed and unreadable answers too."""
    listed = F.try_variant_get(F.try_parse_json(ms.brackets(F.col("raw"))), "$", "array<string>")
    return _answers(spark, sf_dir).select("kind", "batch", "n", "tries", F.col("raw").isNotNull().alias("answered"), F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("n_contexts"))


@query("model_samples", f'WITH {_answers_sql(3)}, {_SAMPLES} SELECT id, kind, batch, text, flagged, pii_type, value, start, "end", confidence FROM sm')
def model_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.samples(ms.sentences(_answers(spark, sf_dir)))


@query("model_conversations", f"""WITH {_answers_sql(3)}, {_SAMPLES} SELECT id, 'Analyze for PII: "' || text || '"' AS asked, flagged, confidence, pii_type AS type, value, start, "end",
  CASE WHEN flagged THEN 'Detected ' || array_to_string(list_transform(string_split(replace(replace(pii_type, '_', ' '), 'IN ', ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE 'No PII detected in text' END AS reason, true AS indented FROM sm""")
def model_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's content is indented JSON; it is parsed."""
    c = ms.conversations(model_samples(spark, sf_dir)).select("id", F.col("conversations")[1]["content"].alias("asked"), F.col("conversations")[2]["content"].alias("said")).withColumn("v", F.try_parse_json("said"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    e = {n: get(f"$.entities[0].{n}", k).alias(n) for n, k in (("type", "string"), ("value", "string"), ("start", "int"), ("end", "int"))}
    return c.select("id", "asked", get("$.flagged", "boolean").alias("flagged"), get("$.confidence", "int").alias("confidence"), *e.values(), get("$.reason", "string").alias("reason"), F.contains("said", F.lit("\n  ")).alias("indented"))


BATCHES = "kind string, batch long, contexts array<string>, run int"


@query("model_resume", f'WITH {_answers_sql(6)}, {_SAMPLES} SELECT id, kind, batch, text, flagged, pii_type, value, start, "end", confidence FROM sm')
def model_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one checkpoint. The first run is written twice, as one that breaks off and starts again would be, and asks with three tries; the second asks only for the batches that the first left unanswered, with three more."""
    path = shared_folder(spark, "answers")
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(ms.brackets(F.col("raw"))), "$", "array<string>"), F.array().cast("array<string>"))
    for run in (0, 0, 1):
        done = mc.done_ranges(jsonl.read_checkpoint(spark, path, BATCHES).where(F.col("run") < run))
        answers = _answers(spark, sf_dir, done=done, first_try=3 * run).where("raw IS NOT NULL")
        jsonl.append_checkpoint(answers.select("kind", "batch", listed.alias("contexts"), F.lit(run).alias("run")), path, ("run",))
    found = jsonl.read_checkpoint(spark, path, BATCHES).select("kind", "batch", F.posexplode("contexts").alias("place", "context"))
    return ms.samples(found.select(F.concat_ws(":", "kind", "batch", "place").alias("id"), "kind", "batch", "context"))


# inference

QUICK = " OR ".join(f"regexp_matches(text, {sql.quote(p)})" for p in rules.QUICK)
_found = sql.quote(inference.OfflineModel.PATTERN.pattern)


@query("model_inference", f"""WITH {sql.DOCS}, {sql.ENTITIES}, {sql.DECISIONS}, q AS (SELECT id, text, coalesce({QUICK}, false) AS hit, length(text) % 7 = 0 AS fails, regexp_matches(text, {_found}) AS mail FROM s)
SELECT q.id, CASE WHEN NOT hit THEN 'scan' WHEN fails THEN 'patterns' ELSE 'model' END AS source, CASE WHEN NOT hit THEN 0 WHEN fails THEN n ELSE mail::INT END::INT AS n_entities,
  CASE WHEN NOT hit THEN 1.0 WHEN fails THEN CASE WHEN n = 0 THEN 1.0 ELSE round(total / (n * 100), 6) END ELSE 0.9 END::DOUBLE AS doc_confidence, (hit AND NOT fails AND NOT mail AND length(q.text) % 2 = 1)::INT AS dropped FROM q JOIN x USING (id)""")
def model_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return inference.screen_with_model(docs, "textward.operators.inference:OfflineModel").select("id", "source", "n_entities", "doc_confidence", "dropped")


@query("hallucination_total", f"""WITH q AS (SELECT text, coalesce({QUICK}, false) AS hit, length(text) % 7 = 0 AS fails, regexp_matches(text, {_found}) AS mail FROM documents)
SELECT count(*) FILTER (WHERE hit AND NOT fails) AS answered, count(*) FILTER (WHERE hit AND fails) AS unanswered, count(*) FILTER (WHERE hit AND NOT fails AND NOT mail AND length(text) % 2 = 1) AS dropped FROM q""")
def hallucination_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all answers: how many entities were not in their texts."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("text")
    found = inference.screen_with_model(docs, "textward.operators.inference:OfflineModel")
    return found.agg(F.count_if(F.col("source") == "model").alias("answered"), F.count_if(F.col("source") == "patterns").alias("unanswered"), F.sum("dropped").alias("dropped"))
