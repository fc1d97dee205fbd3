"""The registered queries and the DuckDB SQL that each is held against.

Detection runs on the documents and pages as they are. They hold few of the entity types, so the other queries run on
samples that Spark makes from the customers' keys (operators/generate.py); sql.SAMPLES makes the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rng import pick, u32, weighted
from textward.functions.spans import all_places
from textward.operators import evaluate as ev
from textward.operators import generate as g
from textward.operators import llm_output as lo
from textward.operators import payload as pl
from textward.operators import rules, sampling
from textward.operators.decide import audit, decide, max_severity, readable, risk_level, severity
from textward.operators.detect import detect, document_confidence, quick_scan, typed
from textward.plans import sql
from textward.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.samples(table(spark, sf_dir, "customer"), "c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(detect(_docs(spark, sf_dir))).groupBy("action").agg(F.count("*").alias("n_docs"), F.sum(F.size("entities")).alias("n_entities"))


_X = f"WITH {sql.DOCS},\n{sql.ENTITIES},\n{sql.DECISIONS}"
_SX = f"WITH {sql.SAMPLES},\n{sql.ENTITIES},\n{sql.DECISIONS}"

query("screen_documents", f"{_X} SELECT action, count(*) AS n_docs, sum(n)::BIGINT AS n_entities FROM x GROUP BY action")(flagship)


# filters


@query("scan_validate_length", "SELECT doc_id, length(text)::INT AS n_points, length(text) BETWEEN 1 AND 10000 AS accepted FROM documents")
def scan_validate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_points"), n.between(1, 10000).alias("accepted"))


_quick = " OR ".join(f"regexp_matches(text, {sql.quote(p)})" for p in rules.QUICK)


@query("prefilter_quick_scan", f"SELECT kind, id, {_quick} AS hit FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)")
def prefilter_quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return _docs(spark, sf_dir).select(F.lit("document").alias("kind"), "id", "text").unionByName(pages).select("kind", "id", quick_scan(F.col("text")).alias("hit"))


# extraction


def _extract(rule_list, docs: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = _docs(spark, sf_dir) if docs else samples_of(spark, sf_dir)
        low = F.lower("text")
        found = F.concat(*(typed(F.col("text"), low, r) for r in rule_list))
        return src.select("id", F.explode(found).alias("e")).select("id", "e.type", "e.value", "e.start", "e.end", "e.cents")

    return run


for _name, _rules, _docs_too in (
    ("extract_email", (rules.EMAIL,), True), ("extract_card", (rules.CARD,), True), ("extract_aadhaar", (rules.AADHAAR,), False), ("extract_pan", (rules.PAN,), False),
    ("extract_ssn", (rules.SSN,), False), ("extract_phone_all", rules.PHONES, False),
):
    _spans = " UNION ALL ".join(sql.spans(r, k) for k, r in enumerate(_rules))
    _m = "m AS (SELECT id, text, lower(text) AS low, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS masked FROM s)"
    query(_name, f'WITH {sql.DOCS if _docs_too else sql.SAMPLES}, {_m} SELECT id, type, value, start, "end", cents FROM ({_spans})')(_extract(_rules, _docs_too))

_ROWS = 'SELECT id, type, value, start, "end", cents::INT AS cents FROM e'


def _entities(df: DataFrame) -> DataFrame:
    return detect(df).select("id", F.explode("entities").alias("e")).select("id", "e.*")


@query("extract_person", f"WITH {sql.DOCS}, {sql.ENTITIES} {_ROWS} WHERE type = 'PERSON'")
def extract_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(_docs(spark, sf_dir)).where("type = 'PERSON'")


@query("detect_full", f"WITH {sql.SAMPLES}, {sql.ENTITIES} {_ROWS}")
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(samples_of(spark, sf_dir))


@query("detect_documents", f"WITH {sql.DOCS}, {sql.ENTITIES} {_ROWS}")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(_docs(spark, sf_dir))


@query("phone_span_dedup", f"WITH {sql.SAMPLES}, {sql.ENTITIES} SELECT id, count_if(type = 'PHONE') AS kept, count(*) FILTER (WHERE type = 'PHONE' AND k > 1) AS dropped FROM d WHERE prio <= 7 GROUP BY id".replace("count_if(type = 'PHONE')", "count(*) FILTER (WHERE type = 'PHONE' AND k = 1)"))
def phone_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, low = samples_of(spark, sf_dir), F.lower("text")
    raw = F.concat(*(typed(F.col("text"), low, r) for r in rules.PHONES))
    kept = F.filter("entities", lambda e: e["type"] == "PHONE")
    others = F.filter("entities", lambda e: e["type"].isin("IN_AADHAAR", "IN_PAN", "EMAIL"))
    out = detect(s.withColumn("_raw", F.size(raw))).where((F.col("_raw") > 0) | (F.size(others) > 0))
    return out.select("id", F.size(kept).cast("long").alias("kept"), (F.col("_raw") - F.size(kept)).cast("long").alias("dropped"))


@query("card_aadhaar_suppression", f"""WITH {sql.SAMPLES}, {sql.ENTITIES} SELECT r.id, r.value, EXISTS (SELECT 1 FROM r a WHERE a.id = r.id AND a.type = 'IN_AADHAAR' AND a.start = r.start) AS suppressed FROM r WHERE type = 'CREDIT_CARD'""")
def card_aadhaar_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    s = samples_of(spark, sf_dir).select("id", typed(F.col("text"), low, rules.CARD).alias("cards"), typed(F.col("text"), low, rules.AADHAAR).alias("a"))
    return s.select("id", F.explode("cards").alias("c"), "a").select("id", "c.value", F.exists("a", lambda x: x["start"] == F.col("c.start")).alias("suppressed"))


@query("doc_confidence", f"{_SX} SELECT id, n AS n_entities, CASE WHEN n = 0 THEN 1.0 ELSE round(total / (n * 100), 6) END AS doc_confidence FROM x".replace("n AS n_entities", "n::INT AS n_entities"))
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(samples_of(spark, sf_dir)).select("id", F.size("entities").alias("n_entities"), document_confidence(F.col("entities")).alias("doc_confidence"))


@query("all_positions", f"WITH {sql.SAMPLES} SELECT id, k - 1 AS place FROM (SELECT id, text, unnest(range(1, length(text) + 1)) AS k FROM s) WHERE value <> '' AND substr(text, k, least(2, length(value))) = substr(value, 1, 2)".replace("k - 1 AS place", "(k - 1)::INT AS place").replace("SELECT id, text, unnest", "SELECT id, text, value, unnest"))
def all_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark, sf_dir).select("id", F.explode(all_places(F.col("text"), F.substring("value", 1, 2))).alias("place"))


@query("placeholder_scan", f"WITH {sql.SAMPLES} SELECT id, regexp_extract(t, '\\{{([A-Z_]+)\\}}', 1) AS placeholder, count(*) AS n FROM s2 WHERE regexp_matches(t, '\\{{([A-Z_]+)\\}}') GROUP BY ALL")
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    t = F.lit("")
    kind = pick(F.col("id"), "type", g.TYPES)
    for k in g.TYPES:
        t = F.when(kind == k, pick(F.col("id"), "template", g.TEMPLATES[k])).otherwise(t)
    return keys.select("id", F.explode(F.regexp_extract_all(t, F.lit(r"\{([A-Z_]+)\}"), F.lit(1))).alias("placeholder")).groupBy("id", "placeholder").agg(F.count("*").alias("n"))


# decisions


@query("severity_lookup", f"WITH {sql.SAMPLES}, {sql.ENTITIES} SELECT id, type, start, ({sql.SEVERITY})::INT AS severity, {sql.TITLE} AS readable FROM e")
def severity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(samples_of(spark, sf_dir)).select("id", "type", "start", severity(F.col("type")).alias("severity"), readable(F.col("type")).alias("readable"))


@query("max_severity", f"{_SX} SELECT id, severity FROM x")
def max_severity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(samples_of(spark, sf_dir)).select("id", max_severity(F.col("entities")).alias("severity"))


def _decided(*columns: str):
    return lambda spark, sf_dir: decide(detect(samples_of(spark, sf_dir))).select("id", *columns)


for _name, _columns in (("decide_action", ("action", "severity", "confidence")), ("verdict_status", ("verdict", "status_code")), ("reason_text", ("reason",)), ("fallback_flag", ("fallback",))):
    query(_name, f"{_SX} SELECT id, {', '.join(_columns)} FROM x")(_decided(*_columns))


@query("risk_level", f"{_SX} SELECT id, CASE WHEN round(confidence * 10) >= 9 THEN 'HIGH' WHEN round(confidence * 10) >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x")
def risk_level_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(detect(samples_of(spark, sf_dir))).select("id", risk_level(F.round(F.col("confidence") * 10)).alias("risk"))


_LOG = "CASE WHEN action = 'BLOCK' THEN 'warning' WHEN n > 0 THEN 'info' ELSE 'debug' END"


@query("audit_log", f"{_X} SELECT id, {_LOG} AS level, action, n > 0 AS flagged, n::INT AS entity_count, types AS entity_types, confidence, severity FROM x")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(decide(detect(_docs(spark, sf_dir))))


# payloads made of conversations: the shape goes by the key

_SHAPES = 9


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.coalesce("text", F.lit("")), F.pmod("conv_id", F.lit(_SHAPES))
    js = lambda *xs: F.to_json(F.struct(*xs))
    message = F.struct(F.lit("user").alias("role"), t.alias("content"))
    parts = F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))
    shapes = [
        js(F.struct(F.array(message, message).alias("messages")).alias("request")),
        js(F.struct(F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages")).alias("request")),
        js(F.struct(t.alias("prompt")).alias("request")),
        js(F.struct(F.array(t, F.lit("end")).alias("prompt")).alias("request")),
        js(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")).alias("response")),
        js(F.struct(F.array(F.struct(t.alias("text"))).alias("choices")).alias("response")),
        js(F.struct(F.lit("x").alias("trace")).alias("metadata")),
        F.concat(F.lit('{"request": '), t),
        F.concat(F.lit("["), js(t.alias("a")), F.lit("]")),
    ]
    body = reduce(lambda a, i: F.when(k == i, shapes[i]).otherwise(a), range(_SHAPES - 1), shapes[-1])
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("trace_id"), body.alias("body"))


_BODY_TEXT = f"""b AS (SELECT conv_id || ':' || turn AS trace_id, coalesce(text, '') AS t, conv_id % {_SHAPES} AS k FROM conversations),
s AS (SELECT trace_id AS id, k, k >= 7 AS failed, CASE k WHEN 0 THEN t || ' ' || t WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN t || ' end' WHEN 4 THEN t WHEN 5 THEN t WHEN 6 THEN '' END AS text FROM b)"""


@query("webhook_extract_text", f"WITH {_BODY_TEXT} SELECT id AS trace_id, text, failed FROM s")
def webhook_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.extract_text(_bodies(spark, sf_dir)).select("trace_id", "text", "failed")


_screened = f"""WITH {_BODY_TEXT.replace("s AS (", "s_ AS (")}, s AS (SELECT id, coalesce(text, '') AS text, failed FROM s_), {sql.ENTITIES}, {sql.DECISIONS}"""
_why = "CASE WHEN failed THEN 'Error during analysis: malformed payload' WHEN text = '' THEN 'No text content to analyze' ELSE reason END"


@query("webhook_screen", f"{_screened} SELECT id AS trace_id, action, verdict, status_code, severity, {_why} AS reason FROM x")
def webhook_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.screen(_bodies(spark, sf_dir)).select("trace_id", "action", "verdict", "status_code", "severity", "reason")


@query("webhook_failopen", f"{_screened} SELECT verdict, status_code, count(*) AS n, min(CASE WHEN failed THEN 0.5 ELSE confidence END) AS least_confidence FROM x WHERE failed GROUP BY ALL")
def webhook_failopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.screen(_bodies(spark, sf_dir)).where("failed").groupBy("verdict", "status_code").agg(F.count("*").alias("n"), F.min("confidence").alias("least_confidence"))


# raw model output made of the samples: the way in which it is right or wrong goes by the key

_WAYS = 11


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples_of(spark, sf_dir).where("flagged")
    k, v = F.pmod("id", F.lit(_WAYS)), F.col("value")
    entity = lambda value, c: F.concat(F.lit('{"type":"'), F.col("entity_type"), F.lit('","value":"'), value, F.lit(f'","start":0,"end":0,"confidence":{c}}}'))
    doc = lambda es, c="9": F.concat(F.lit(f'{{"flagged":true,"confidence":{c},"entities":'), es, F.lit(',"reason":"seen"}'))
    one = lambda value, c="0.9": F.concat(F.lit("["), entity(value, c), F.lit("]"))
    good = doc(one(v))
    ways = [
        good, F.concat(F.lit("```json\n"), good, F.lit("\n```")), F.concat(F.lit("Here it is: "), good, F.lit(" Done.")), doc(F.concat(F.lit("["), entity(v, "0.9"), F.lit(",]"))),
        F.substring_index(good, '"reason"', 1), doc(one(F.lit("not in the text"))), doc(one(F.lit(""))), doc(one(v), "null"), doc(F.lit("null")), F.lit("I found nothing."), doc(one(v, "5"), "1"),
    ]
    raw = reduce(lambda a, i: F.when(k == i, ways[i]).otherwise(a), range(_WAYS - 1), ways[-1])
    return s.select("id", "entity_type", "text", "value", "start", "end", raw.alias("raw"))


_K = f"id % {_WAYS}"
_RAW = f"WITH {sql.SAMPLES}, q AS (SELECT *, {_K} AS k FROM s WHERE flagged)"


@query("llm_json_extract", f"{_RAW} SELECT id, k IN (0, 1, 2, 5, 6, 7, 8, 10) AS parsed, CASE WHEN k IN (0, 1, 2, 5, 6) THEN 9.0 WHEN k = 10 THEN 1.0 WHEN k = 8 THEN 9.0 END AS confidence FROM q".replace("9.0", "9.0::DOUBLE").replace("1.0 ", "1.0::DOUBLE "))
def llm_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).withColumn("v", lo.extract_json(F.col("raw"))).select("id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.confidence", "double").alias("confidence"))


@query("llm_json_robust", f"""{_RAW} SELECT id, k <> 9 AS parsed, CASE WHEN k = 9 THEN NULL WHEN k = 5 THEN 'not in the text' WHEN k = 6 THEN '' WHEN k = 8 THEN NULL ELSE value END AS first_value, CASE WHEN k = 4 THEN 'Extracted from partial output' WHEN k <> 9 THEN 'seen' END AS reason FROM q""")
def llm_json_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _raw(spark, sf_dir).withColumn("v", lo.extract_json_robust(F.col("raw")))
    return v.select("id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.entities[0].value", "string").alias("first_value"), F.try_variant_get("v", "$.reason", "string").alias("reason"))


@query("llm_array_extract", f"{_RAW} SELECT id, CASE WHEN k IN (3, 8, 9) THEN NULL ELSE 1 END AS n FROM q")
def llm_array_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", F.size(F.try_variant_get(F.try_parse_json(lo.brackets(F.col("raw"))), "$", "array<variant>")).alias("n"))


_OK = "k IN (0, 1, 2, 5, 6)"
_PARSED = f"""{_RAW}, p AS (SELECT *, CASE WHEN k IN (3, 4, 7, 8, 9) THEN 'failed' WHEN k = 10 THEN 'invalid' ELSE 'parsed' END AS outcome FROM q)"""


@query("grounding_api", f"""{_PARSED} SELECT id, outcome, CASE WHEN k = 6 THEN '' ELSE value END AS value, CASE WHEN k = 6 THEN 0 ELSE start END AS start, CASE WHEN k = 6 THEN 0 ELSE "end" END AS "end" FROM p WHERE k IN (0, 1, 2, 6)""")
def grounding_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.parse(_raw(spark, sf_dir).drop("value", "start", "end")).select("id", "outcome", F.explode("found").alias("f")).select("id", "outcome", "f.value", "f.start", "f.end")


@query("grounding_strict", f"""{_PARSED} SELECT id, value, start, "end" FROM p WHERE k IN (0, 1, 2)""")
def grounding_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lo.parse(_raw(spark, sf_dir).drop("value", "start", "end"))
    return p.select("id", F.explode(lo.ground(F.col("found"), F.col("text"), False)).alias("f")).select("id", "f.value", "f.start", "f.end")


@query("confidence_normalise", f"{_PARSED} SELECT id, CASE WHEN outcome = 'parsed' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM p")
def confidence_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.parse(_raw(spark, sf_dir)).select("id", "confidence")


@query("unflag_empty", f"{_PARSED} SELECT id, k IN (0, 1, 2, 6) AS flagged, CASE WHEN outcome <> 'parsed' THEN '{lo.FAILED}' WHEN k = 5 THEN '{lo.UNGROUNDED}' ELSE 'seen' END AS reason, (k = 5)::INT AS dropped FROM p")
def unflag_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.parse(_raw(spark, sf_dir)).select("id", "flagged", "reason", "dropped")


@query("model_or_patterns", f"""WITH {sql.SAMPLES}, {sql.ENTITIES}, {sql.DECISIONS} SELECT id, CASE WHEN {_K} = 10 THEN 'patterns' ELSE 'model' END AS source,
  (CASE {_K} WHEN 10 THEN n WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 6 THEN 1 ELSE 0 END)::INT AS n_entities,
  CASE WHEN {_K} = 10 THEN CASE WHEN n = 0 THEN 1.0 ELSE round(total / (n * 100), 6) END WHEN {_K} IN (0, 1, 2, 5, 6) THEN 0.9 ELSE 0.5 END::DOUBLE AS doc_confidence FROM x WHERE flagged""")
def model_or_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.model_or_patterns(_raw(spark, sf_dir)).select("id", "source", "n_entities", "doc_confidence")


# generation

query("gen_samples", f'WITH {sql.SAMPLES} SELECT id, entity_type, text, value, start, "end", flagged FROM s')(samples_of)


def _gen(kind: str):
    return lambda spark, sf_dir: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), g.value_of(kind, F.col("c_custkey")).alias("value"))


for _kind, _name in (("IN_AADHAAR", "gen_aadhaar"), ("IN_PAN", "gen_pan"), ("EMAIL_ADDRESS", "gen_email"), ("PHONE_NUMBER", "gen_phone"), ("US_SSN", "gen_ssn"), ("CREDIT_CARD", "gen_card"), ("PERSON", "gen_person")):
    query(_name, f"SELECT id, {sql.VALUES[_kind]} AS value FROM (SELECT c_custkey AS id FROM customer)")(_gen(_kind))

_two = lambda slot, n: f"lpad(({sql.below(slot, n)} + 1)::VARCHAR, 2, '0')"
_MISS = {
    "order_id": f"'Order ID: ' || {sql.digits('m1', 4)} || ' ' || {sql.digits('m2', 4)} || ' ' || {sql.digits('m3', 4)}",
    "product_code": f"'Product code ' || {sql.letter('m4')} || {sql.letter('m5')} || {sql.letter('m6')} || {sql.digits('m7', 4)} || {sql.letter('m8')}",
    "phone_like": f"'Ticket #' || {sql.digits('m1', 5)} || {sql.digits('m2', 5)}",
    "email_like": "'Write name at domain dot com in the field'",
    "ssn_like": f"'Part no. ' || {sql.digits('m1', 3)} || '-' || {sql.digits('m2', 2)} || '-' || {sql.digits('m3', 4)}",
    "date_like": f"'Due ' || {_two('m1', 28)} || '-' || {_two('m2', 12)} || '-2024'",
    "ip": "'Server ' || " + " || '.' || ".join(sql.below(f"m{k}", 256) for k in range(1, 5)),
    "alphanumeric": "'Serial ' || upper(substr(md5(id::VARCHAR), 1, 8))",
}
_MISSES = f"w AS (SELECT id, kind, {sql.cases('kind', _MISS, chr(39) * 2)} AS text FROM (SELECT c_custkey AS id, {sql.weighted('miss', g.NEAR_MISSES, 'c_custkey')} AS kind FROM customer))"


def _misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.near_misses(table(spark, sf_dir, "customer"), "c_custkey")


query("gen_near_misses", f"WITH {_MISSES} SELECT * FROM w")(_misses)


def varied(text: str, key: str = "id") -> str:
    return f"{sql.pick('v1', g.PREFIXES, key)} || {text} || CASE WHEN {sql.below('v2', 100, key)} < 30 THEN ' (Ref: ' || ({sql.below('v3', 9000, key)} + 1000) || ')' WHEN {sql.below('v4', 100, key)} < 20 THEN ' [' || {sql.pick('v5', g.TAGS, key)} || ']' ELSE '' END"


@query("negative_variation", f"WITH {_MISSES} SELECT id, {varied('text')} AS text FROM w")
def negative_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misses(spark, sf_dir).select("id", g.vary_negative(F.col("id"), F.col("text")).alias("text"))


@query("near_miss_false_positives", f"WITH {_MISSES}, s AS (SELECT id, text FROM w), {sql.ENTITIES}, f AS (SELECT DISTINCT id FROM e) SELECT kind, count(*) AS n, count(f.id) AS flagged FROM w LEFT JOIN f USING (id) GROUP BY kind")
def near_miss_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_misses(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("entities") > 0).alias("flagged"))


def _augment_sql() -> tuple[str, str]:
    """The way that is drawn, and a value written in it, from entity_type, id, value and augmentation."""
    d, ten = "regexp_replace(value, '[^0-9]', '', 'g')", "right(regexp_replace(value, '[^0-9]', '', 'g'), 10)"
    cut = lambda a, n, of=d: f"substr({of}, {a}, {n})"
    groups = lambda x: f"concat_ws(' ', substr({x}, 1, 4), substr({x}, 5, 4), substr({x}, 9, 4))"
    spread = lambda x: f"array_to_string(string_split({x}, ''), ' ')"
    one_of = lambda slot, *xs: f"CASE {sql.below(slot, len(xs))} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
    bound = lambda x, f: f"list_transform([{x}], lambda y: {f('y')})[1]"
    local, domain = "string_split(value, '@')[1]", "string_split(value, '@')[-1]"
    digit = f"substr({d}, i::INT, 1)"
    words = "[" + ", ".join(map(sql.quote, g.DIGIT_WORDS)) + f"][{digit}::INT + 1]"
    ways = {
        "IN_AADHAAR": {
            "clean": groups(d), "no_spaces": d, "dashed": f"concat_ws('-', {cut(1, 4)}, {cut(5, 4)}, {cut(9, 4)})", "mixed_separators": f"{cut(1, 4)} || {sql.pick('x1', g.SEPARATORS)} || {cut(5, 4)} || {sql.pick('x2', g.SEPARATORS)} || {cut(9, 4)}",
            "ocr_corrupted": bound(sql.misread(d, 15), groups), "typo": bound(sql.typo(d), lambda y: f"CASE WHEN length({y}) >= 12 THEN {groups(y)} ELSE {y} END"),
            "partial_masked": one_of("x3", f"'XXXX XXXX ' || {cut(9, 4)}", f"'****-****-' || {cut(9, 4)}", f"{cut(1, 4)} || '-XXXX-' || {cut(9, 4)}"),
            "written_out": sql.each(d, f"CASE WHEN {sql.at('y', 'i')} % 100 < 30 THEN {words} ELSE {digit} END", " "), "spaced_out": spread(d), "truncated": cut(1, 8),
        },
        "IN_PAN": {
            "clean": "value", "lowercase": "lower(value)", "mixed_case": sql.mixed_case("value"), "ocr_corrupted": sql.misread("upper(value)", 20), "spaced": "concat_ws(' ', substr(value, 1, 5), substr(value, 6, 4), substr(value, 10, 1))",
            "partial_masked": one_of("x3", "substr(value, 1, 5) || 'XXXX' || substr(value, 10, 1)", "substr(value, 1, 3) || '****' || substr(value, 8, 3)", "'XXXXX' || substr(value, 6, 5)"), "typo": f"upper({sql.typo('value')})",
        },
        "EMAIL_ADDRESS": {
            "clean": "value", "uppercase": "upper(value)", "spaced_at": "replace(value, '@', ' @ ')", "at_written": "replace(value, '@', ' at ')", "dot_written": "replace(value, '.', ' dot ')", "obfuscated": "replace(replace(value, '@', ' [at] '), '.', ' [dot] ')",
            "typo": f"({sql.typo(local)}) || '@' || {domain}", "partial_masked": f"CASE WHEN length({local}) > 2 THEN left({local}, 1) || '***' || right({local}, 1) ELSE '***' END || '@' || {domain}",
        },
        "PHONE_NUMBER": {
            "clean_indian": f"'+91 ' || {cut(1, 5, ten)} || ' ' || {cut(6, 5, ten)}", "no_country_code": ten, "dashed": f"concat_ws('-', {cut(1, 3, ten)}, {cut(4, 3, ten)}, {cut(7, 4, ten)})",
            "parentheses": f"'(' || {cut(1, 3, ten)} || ') ' || {cut(4, 3, ten)} || '-' || {cut(7, 4, ten)}", "spaced_out": spread(ten), "partial_masked": f"'XXXXXX' || {cut(7, 4, ten)}", "ocr_corrupted": sql.misread("value", 15),
        },
    }
    name = sql.cases("entity_type", {t: sql.weighted("augment", [(a[1], a[2]) for a in g.AUGMENTATIONS if a[0] == t]) for t in ways}, "'passthrough'")
    value = sql.cases("entity_type", {t: sql.cases("augmentation", w, "value") for t, w in ways.items()}, "value")
    return name, value


AUGMENTED_WAY, AUGMENTED_VALUE = _augment_sql()
_ways = ", ".join(f"('{t}', '{n}', {lv}, {c})" for t, n, _, lv, c in g.AUGMENTATIONS)
_AUGMENTED = f"{sql.SAMPLES}, n AS (SELECT *, {AUGMENTED_WAY} AS augmentation FROM s), k(entity_type, augmentation, noise_level, cents) AS (VALUES {_ways}), au AS (SELECT id, entity_type, augmentation, {AUGMENTED_VALUE} AS augmented, coalesce(noise_level, 0) AS noise_level, coalesce(cents, 95) AS cents FROM n LEFT JOIN k USING (entity_type, augmentation))"


@query("augment_values", f"WITH {_AUGMENTED} SELECT * FROM au")
def augment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.augment(samples_of(spark, sf_dir)).select("id", "entity_type", "augmentation", "augmented", "noise_level", "cents")


_table = ", ".join(f"({sql.quote(k)}, {sql.quote(v)})" for k, v in g.CONFUSED.items())
_char = sql.u("'o' || (i - 1)", raw=True), sql.u("'w' || (i - 1)", raw=True)


@query("augment_ocr", f"""WITH {sql.SAMPLES}, k(c, o) AS (VALUES {_table}), ch AS (SELECT id, i, substr(value, i, 1) AS c FROM s, unnest(range(1, length(value) + 1)) t(i)),
p AS (SELECT id, i, CASE WHEN o IS NOT NULL AND {_char[0]} % 100 < 15 THEN substr(o, ({_char[1]} % length(o) + 1)::INT, 1) ELSE ch.c END AS c FROM ch LEFT JOIN k ON k.c = ch.c)
SELECT id, coalesce(string_agg(c, '' ORDER BY i), '') AS augmented FROM s LEFT JOIN p USING (id) GROUP BY id""")
def augment_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark, sf_dir).select("id", g.misread(F.col("id"), F.col("value"), 15).alias("augmented"))


_kc = sql.u("'k' || (i - 1)", raw=True)


@query("augment_case", f"""WITH {sql.SAMPLES}, p AS (SELECT id, string_agg(CASE WHEN {_kc} % 2 = 0 THEN upper(substr(value, i, 1)) ELSE lower(substr(value, i, 1)) END, '' ORDER BY i) AS mixed FROM s, unnest(range(1, length(value) + 1)) t(i) GROUP BY id)
SELECT id, CASE {sql.below('case', 4)} WHEN 0 THEN upper(value) WHEN 1 THEN lower(value) WHEN 2 THEN coalesce(mixed, '') ELSE value END AS augmented FROM s LEFT JOIN p USING (id)""")
def augment_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark, sf_dir).select("id", g.case_noise(F.col("id"), F.col("value")).alias("augmented"))


@query("augment_typo", f"WITH {sql.SAMPLES} SELECT id, {sql.typo('value')} AS augmented FROM s")
def augment_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark, sf_dir).select("id", g.typos(F.col("id"), F.col("value"), F.lit(1)).alias("augmented"))


# draws, splits, tiles


@query("weighted_pick", f"SELECT kind, count(*) AS n FROM (SELECT {sql.weighted('stratum', list(g.STRATA.items()))} AS kind FROM (SELECT o_orderkey AS id FROM orders)) GROUP BY kind")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(weighted(F.col("o_orderkey"), "stratum", list(g.STRATA.items())).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_shares = ", ".join(f"('{k}', {v})" for k, v in g.STRATA.items())


@query("quota_allocation", f"WITH t AS (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1), k(stratum, share) AS (VALUES {_shares}), x AS (SELECT *, total * share // 100 AS n FROM t, k) SELECT c_nationkey, stratum, (n + CASE WHEN stratum = 'easy' THEN total - sum(n) OVER (PARTITION BY c_nationkey) ELSE 0 END)::BIGINT AS n FROM x")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"))
    each = {k: F.floor(F.col("total") * v / 100) for k, v in g.STRATA.items()}
    each["easy"] = F.col("total") - reduce(lambda a, b: a + b, (v for k, v in each.items() if k != "easy"))
    return t.select("c_nationkey", F.explode(F.create_map(*(x for k, v in each.items() for x in (F.lit(k), v.cast("long"))))).alias("stratum", "n"))


@query("exact_split", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {sql.u('split', 'o_orderkey')}, o_orderkey) <= count(*) OVER () * 80 // 100 THEN 'train' ELSE 'eval' END AS split FROM orders")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 80)


@query("batch_tiling", "SELECT c_nationkey, batch, least(30, total - batch * 30) AS n FROM (SELECT c_nationkey, total, unnest(range(0, (total + 29) // 30)) AS batch FROM (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1))")
def batch_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_tiles(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total")), "c_nationkey", "total")


@query("dedup_unique", f"WITH {sql.SAMPLES} SELECT text, min(id) AS id FROM s GROUP BY text")
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unique_texts(samples_of(spark, sf_dir), "text", "id")


@query("resume_antijoin", "SELECT DISTINCT o_custkey AS batch FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return sampling.resume(o.select(F.col("o_custkey").alias("batch")).distinct(), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("batch")), "batch")


@query("shuffle_order", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {sql.u('shuffle', 'c_custkey')}, c_custkey) AS place FROM customer")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("c_nationkey").orderBy(u32(F.col("c_custkey"), "shuffle"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(order).cast("long").alias("place"))


# samples and what they hold


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and near misses under one schema, each with its stratum and confidence."""
    s = g.augment(samples_of(spark, sf_dir))
    stratum = F.when(~F.col("flagged"), "negative").when(F.col("noise_level") == 0, "easy").when(F.col("noise_level") <= 2, "medium").when(F.col("noise_level") == 3, "hard").otherwise("adversarial")
    a = s.select("id", stratum.alias("stratum"), F.replace("text", F.when(F.col("value") == "", F.lit("\u0000")).otherwise(F.col("value")), F.col("augmented")).alias("text"), "flagged", "entity_type", F.when(F.col("flagged"), F.col("cents")).otherwise(95).alias("cents"))
    b = _misses(spark, sf_dir).select("id", F.lit("dangerous").alias("stratum"), "text", F.lit(False).alias("flagged"), F.lit("NONE").alias("entity_type"), F.lit(90).alias("cents"))
    return a.unionByName(b)


_STRATA = f"""WITH {_AUGMENTED}, {_MISSES}, z AS (
SELECT s.id, CASE WHEN NOT flagged THEN 'negative' WHEN noise_level = 0 THEN 'easy' WHEN noise_level <= 2 THEN 'medium' WHEN noise_level = 3 THEN 'hard' ELSE 'adversarial' END AS stratum, CASE WHEN value = '' THEN text ELSE replace(text, value, augmented) END AS text, flagged, s.entity_type, CASE WHEN flagged THEN cents ELSE 95 END AS cents FROM s JOIN au USING (id)
UNION ALL SELECT w.id, 'dangerous', w.text, false, 'NONE', 90 FROM w)"""

query("strata_union", f"{_STRATA} SELECT id, stratum, text, flagged, entity_type, cents FROM z")(_strata)


@query("dist_difficulty", f"{_STRATA} SELECT stratum, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM z GROUP BY stratum".replace("AS percent", "::DOUBLE AS percent"))
def dist_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    # a row for each stratum; the window over all of them is as small
    n = _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


@query("dist_confidence", f"{_STRATA} SELECT CASE WHEN cents > 80 THEN 'high' WHEN cents >= 60 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, min(cents) AS least FROM z GROUP BY 1")
def dist_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy(sampling.bucket(F.col("cents")).alias("bucket")).agg(F.count("*").alias("n"), F.min("cents").alias("least"))


@query("dist_flagged", f"{_STRATA} SELECT flagged, count(*) AS n FROM z GROUP BY 1")
def dist_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("flagged").agg(F.count("*").alias("n"))


@query("dist_entity_type", f"WITH {sql.SAMPLES}, {sql.ENTITIES} SELECT type, count(*) AS n FROM e GROUP BY type")
def dist_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(samples_of(spark, sf_dir)).select(F.explode("entities.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("metadata_zero_fill", f"{_STRATA}, kinds AS (SELECT unnest(['easy', 'medium', 'hard', 'adversarial', 'negative', 'dangerous', 'multi']) AS stratum) SELECT stratum, count(z.id) AS n FROM kinds LEFT JOIN z USING (stratum) GROUP BY stratum")
def metadata_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in (*g.STRATA, "multi")], "stratum string")
    n = _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"))
    return kinds.join(n, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"))


@query("uniqueness", f"{_STRATA} SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeated, round(100.0 * count(DISTINCT text) / count(*), 6)::DOUBLE AS percent FROM z")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _strata(spark, sf_dir).groupBy("text").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    return n.select("n", "n_distinct", (F.col("n") - F.col("n_distinct")).alias("n_repeated"), F.round(F.col("n_distinct") * 100.0 / F.col("n"), 6).alias("percent"))


_USER = """'Analyze for PII: "' || text || '"'"""


@query("conversation_format", f"""WITH {sql.SAMPLES} SELECT id, 0 AS turn, 'system' AS role, 'Find it.' AS content, NULL::BOOLEAN AS flagged, NULL AS type, NULL AS value, NULL::INT AS start FROM s UNION ALL SELECT id, 1, 'user', {_USER}, NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT id, 2, 'assistant', NULL, flagged, CASE WHEN flagged THEN entity_type END, CASE WHEN flagged THEN value END, start FROM s""")
def conversation_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's content is JSON of no fixed layout; it is parsed."""
    c = g.override_prompt(g.conversation(samples_of(spark, sf_dir)), "Find it.").select("id", F.posexplode("conversations").alias("turn", "m"))
    label = F.when(F.col("turn") == 2, F.try_parse_json("m.content"))
    get = lambda path, kind: F.try_variant_get("label", path, kind)
    return c.withColumn("label", label).select("id", "turn", "m.role", F.when(F.col("turn") < 2, F.col("m.content")).alias("content"), get("$.flagged", "boolean").alias("flagged"), get("$.entities[0].type", "string").alias("type"), get("$.entities[0].value", "string").alias("value"), get("$.entities[0].start", "int").alias("start"))


@query("unwrap_user_text", f"WITH {sql.SAMPLES} SELECT id, text FROM s")
def unwrap_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("conversations")[1]["content"]
    c = g.conversation(samples_of(spark, sf_dir))
    return c.where(user.rlike('Analyze for PII: "(.*)"')).select("id", F.regexp_extract(user, 'Analyze for PII: "(.*)"', 1).alias("text"))


@query("dist_nested_json", f"WITH {sql.SAMPLES} SELECT count(*) AS n, count_if(flagged) AS flagged, count_if(entity_type = 'PERSON') AS persons FROM s".replace("count_if(flagged)", "count(*) FILTER (WHERE flagged)").replace("count_if(entity_type = 'PERSON')", "count(*) FILTER (WHERE entity_type = 'PERSON')"))
def dist_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.conversation(samples_of(spark, sf_dir)).select(F.try_parse_json(F.col("conversations")[2]["content"]).alias("v"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.try_variant_get("v", "$.flagged", "boolean")).alias("flagged"), F.count_if(F.try_variant_get("v", "$.entities[0].type", "string") == "PERSON").alias("persons"))


# evaluation: the patterns' answers against the samples' labels; every seventh case is to be judged by hand, every eleventh answer can't be read


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = detect(samples_of(spark, sf_dir))
    return s.select("id", F.col("entity_type").alias("category"), "text", F.when(F.pmod("id", F.lit(11)) != 0, F.size("entities") > 0).alias("predicted"), F.when(F.pmod("id", F.lit(7)) != 0, F.col("flagged")).alias("expected"))


_CASES = f"WITH {sql.SAMPLES}, {sql.ENTITIES}, y AS (SELECT s.id, entity_type AS category, text, CASE WHEN s.id % 11 <> 0 THEN s.id IN (SELECT id FROM e) END AS predicted, CASE WHEN s.id % 7 <> 0 THEN flagged END AS expected FROM s)"
_n = lambda cond: f"count(*) FILTER (WHERE {cond})"
_COUNTS = f"{_n('predicted AND expected')} AS tp, {_n('predicted AND NOT expected')} AS fp, {_n('NOT predicted AND NOT expected')} AS tn, {_n('NOT predicted AND expected')} AS fn, {_n('predicted IS NULL')} AS parse_errors, {_n('expected IS NULL AND predicted IS NOT NULL')} AS uncertain"


@query("confusion_matrix", f"{_CASES} SELECT {_COUNTS} FROM y")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(_cases(spark, sf_dir))


_r = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 6)"


@query("prf1_grade", f"""{_CASES}, k AS (SELECT {_COUNTS} FROM y), v AS (SELECT {_r('(tp + tn)', '(tp + fp + tn + fn)')} AS accuracy, {_r('tp', '(tp + fp)')} AS precision, {_r('tp', '(tp + fn)')} AS recall, {_r('(2 * tp)', '(2 * tp + fp + fn)')} AS f1, fp > fn AS over_flags FROM k)
SELECT *, CASE WHEN f1 >= 0.9 THEN 'excellent' WHEN f1 >= 0.8 THEN 'good' WHEN f1 >= 0.7 THEN 'fair' ELSE 'poor' END AS grade FROM v""")
def prf1_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.scores(confusion_matrix(spark, sf_dir))


_S = "CASE WHEN predicted IS NULL THEN 'ERROR' WHEN expected IS NULL THEN 'CHECK' WHEN predicted = expected THEN 'PASS' ELSE 'FAIL' END"

_GOOD, _BAD = "st IN ('PASS', 'CHECK')", "st = 'FAIL'"


@query("category_breakdown", f"{_CASES}, k AS (SELECT category, {_S} AS st FROM y) SELECT category, {_n(_GOOD)} AS passed, {_n(_BAD)} AS failed, count(*) AS total, {_r(_n(_GOOD), 'count(*)')} AS pass_rate FROM k GROUP BY category")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_category(_cases(spark, sf_dir))


@query("suite_summary", f"{_CASES}, k AS (SELECT {_S} AS st FROM y) SELECT " + ", ".join(f"count(*) FILTER (WHERE st = '{a}') AS {b}" for a, b in (("PASS", "passed"), ("FAIL", "failed"), ("CHECK", "uncertain"), ("ERROR", "errors"))) + " FROM k")
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summary(_cases(spark, sf_dir))


@query("fp_fn_rate", f"{_CASES} SELECT {_r(_n('NOT expected AND (predicted OR predicted IS NULL)'), _n('NOT expected'))} AS fp_rate, {_r(_n('expected AND (NOT predicted OR predicted IS NULL)'), _n('expected'))} AS fn_rate FROM y")
def fp_fn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.error_rates(_cases(spark, sf_dir))


@query("failed_cases", f"{_CASES} SELECT id, category, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short_text, predicted, expected FROM y WHERE predicted <> expected")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.failed_cases(_cases(spark, sf_dir))


@query("latency_stats", "SELECT round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latency(table(spark, sf_dir, "events"), "value")


@query("label_join", f"{_X} SELECT toxic, action, count(*) AS n FROM x JOIN labels ON doc_id = id GROUP BY ALL")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by a label that is not about personal data: how a prediction joins a label table."""
    d = decide(detect(_docs(spark, sf_dir))).select("id", "action")
    return d.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).groupBy("toxic", "action").agg(F.count("*").alias("n"))
