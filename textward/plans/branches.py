"""Registered queries whose rows reach branches that plain documents and samples do not, and their DuckDB SQL, which parses what the queries parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rng import below
from textward.functions.rows import fixed
from textward.operators import generate as g
from textward.operators import llm_output as lo
from textward.operators import payload as pl
from textward.operators.decide import decide
from textward.operators.detect import NONE, detect
from textward.plans import sql
from textward.plans.catalog import query, samples_of
from textward.session import table

_PAGES = "s AS (SELECT page_id AS id, html AS text FROM pages)"


@query("detect_pages", f'WITH {_PAGES}, {sql.ENTITIES} SELECT id, type, value, start, "end", cents::INT AS cents FROM e')
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return detect(pages).select("id", F.explode("entities").alias("e")).select("id", "e.*")


@query("direct_answers", f"""WITH dq AS (SELECT doc_id AS id, text, coalesce(length(text) BETWEEN 1 AND 10000, false) AS fits FROM documents), s AS (SELECT id, CASE WHEN fits THEN text ELSE '' END AS text FROM dq), {sql.ENTITIES}, {sql.DECISIONS}
SELECT dq.id, CASE WHEN fits THEN 200 ELSE 422 END AS status, CASE WHEN fits THEN n > 0 END AS flagged, CASE WHEN fits THEN severity END::INT AS severity, CASE WHEN fits THEN confidence END AS confidence, CASE WHEN fits THEN reason END AS reason,
  CASE WHEN fits THEN action END AS action, CASE WHEN fits THEN length(dq.text) END::INT AS n_text, CASE WHEN fits THEN n END::INT AS n_entities FROM dq JOIN x ON x.id = dq.id""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of a direct answer, taken apart: the nested one's result, and of the flat one what it has more."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    nested, flat = (lambda c: F.col(f"detect.result.{c}")), (lambda c: F.col(f"analyze.{c}"))
    a = pl.answer(docs)
    return a.select("id", "status", nested("flagged").alias("flagged"), nested("severity").alias("severity"), flat("confidence").alias("confidence"), nested("reason").alias("reason"), flat("action").alias("action"), F.length(flat("text")).alias("n_text"), F.when(flat("text").isNotNull(), F.size(flat("entities"))).alias("n_entities"))


#: Raw confidences of well-formed answers; the empty one is left out.
_SCALES = ["1", "2", "10", "0.3", "1.5", "null", "\"high\"", ""]
_SCALE_RAW = f"'Answer: {{\"flagged\":true' || CASE WHEN c = '' THEN '' ELSE ',\"confidence\":' || c END || ',\"entities\":[],\"reason\":\"seen\"}}'"
_SCALED = f"r AS (SELECT id, {_SCALE_RAW} AS raw FROM (SELECT c_custkey AS id, {sql.pick('scale', _SCALES, 'c_custkey')} AS c FROM customer)), j AS (SELECT id, json_extract(regexp_extract(raw, '(?s)(\\{{.*\\}})', 1)::JSON, '$.confidence') AS c FROM r)"


@query("confidence_scales", f"""WITH {_SCALED}, n AS (SELECT id, c, try_cast(c::VARCHAR AS DOUBLE) AS x FROM j)
SELECT id, CASE WHEN c IS NOT NULL AND x IS NULL THEN 'failed' ELSE 'parsed' END AS outcome, CASE WHEN c IS NULL THEN 0.5 WHEN x IS NULL THEN 0.5 WHEN x > 1 THEN x / 10 ELSE x END::DOUBLE AS confidence FROM n""")
def confidence_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of 1 and 2, of ten, below one, null, no number, and none at all."""
    scale = F.element_at(F.array(*(F.lit(c) for c in _SCALES)), (below(F.col("id"), "scale", len(_SCALES)) + 1).cast("int"))
    c = fixed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), c=scale)
    given = F.when(F.col("c") == "", "").otherwise(F.concat(F.lit(',"confidence":'), F.col("c")))
    raw = c.select("id", F.lit("").alias("text"), F.concat(F.lit('Answer: {"flagged":true'), given, F.lit(',"entities":[],"reason":"seen"}')).alias("raw"))
    return lo.parse(raw).select("id", "outcome", "confidence")


_LOW = [30, 55, 60, 95]


@query("fallback_decisions", f"""WITH a AS (SELECT id, {sql.below('n', 4)} AS n, {sql.pick('c1', [str(x) for x in _LOW])}::INT AS c1, {sql.pick('c2', [str(x) for x in _LOW])}::INT AS c2, {sql.pick('c3', [str(x) for x in _LOW])}::INT AS c3 FROM (SELECT c_custkey AS id FROM customer)),
b AS (SELECT id, n, list_sum([c1, c2, c3][:n]) AS total, list_max([c1, c2, c3][:n]) AS top FROM a)
SELECT id, CASE WHEN n = 0 THEN 'ALLOW' ELSE 'FLAG' END AS action, n > 0 AND (total < 60 * n OR top < 60) AS fallback, CASE WHEN n = 0 THEN 1.0 ELSE least(round(total / (n * 100), 6), top / 100) END::DOUBLE AS confidence,
  CASE WHEN n = 0 THEN 'No PII detected' ELSE 'FLAGGED: ' || n || ' Email - logged for review' || CASE WHEN total < 60 * n OR top < 60 THEN ' (low confidence - fallback recommended)' ELSE '' END END AS reason FROM b""")
def fallback_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on entities of a model that is less sure than the patterns ever are."""
    key = F.col("id")
    cents = [F.element_at(F.array(*(F.lit(x) for x in _LOW)), (below(key, f"c{k}", len(_LOW)) + 1).cast("int")) for k in (1, 2, 3)]
    listed = fixed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _c=F.array(*cents), _n=below(key, "n", 4).cast("int"))
    entities = F.transform(F.slice("_c", F.lit(1), F.col("_n")), lambda c: F.struct(F.lit("EMAIL").alias("type"), F.lit("a@b.com").alias("value"), F.lit(0).alias("start"), F.lit(7).alias("end"), c.alias("cents")))
    return decide(listed.withColumn("entities", F.coalesce(entities, F.array().cast(NONE)))).select("id", "action", "fallback", "confidence", "reason")


#: User turns of four kinds: as they should be, of the other formatter, with a line break in the quoted text, and without quotes.
_USER = f"CASE {sql.below('turn', 4)} WHEN 0 THEN 'Analyze for PII: \"' || text || '\"' WHEN 1 THEN 'Detect PII in: \"' || text || '\"' WHEN 2 THEN 'Analyze for PII: \"' || text || chr(10) || '\"' ELSE 'Analyze for PII: ' || text END"


@query("unwrap_mixed_turns", f"""WITH {sql.SAMPLES}, t AS (SELECT id, {_USER} AS said FROM s) SELECT id, regexp_extract(said, 'Analyze for PII: "(.*)"', 1) AS text FROM t WHERE regexp_matches(said, 'Analyze for PII: "(.*)"')""")
def unwrap_mixed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only turns that match are kept."""
    way, text = below(F.col("id"), "turn", 4), F.col("text")
    quoted = lambda prefix, after="": F.concat(F.lit(f'{prefix}: "'), text, F.lit(f'{after}"'))
    said = F.when(way == 0, quoted("Analyze for PII")).when(way == 1, quoted("Detect PII in")).when(way == 2, quoted("Analyze for PII", "\n")).otherwise(F.concat(F.lit("Analyze for PII: "), text))
    t = fixed(samples_of(spark, sf_dir), said=said)
    return t.where(F.col("said").rlike('Analyze for PII: "(.*)"')).select("id", F.regexp_extract("said", 'Analyze for PII: "(.*)"', 1).alias("text"))


#: Assistant turns of which every ninth is cut off.
_LABEL = "CASE WHEN id % 9 = 4 THEN '{\"flagged\": tr' ELSE '{\"flagged\": ' || flagged::VARCHAR || ', \"entities\": [' || CASE WHEN flagged THEN '{\"type\": \"' || entity_type || '\"}' ELSE '' END || ']}' END"


@query("dist_broken_json", f"""WITH {sql.SAMPLES}, l AS (SELECT {_LABEL} AS said FROM s), v AS (SELECT CASE WHEN json_valid(said) THEN said::JSON END AS v FROM l),
c AS (SELECT v IS NOT NULL AS readable, (v->>'$.flagged')::BOOLEAN AS flagged, v->>'$.entities[0].type' AS type FROM v)
SELECT count(*) AS n, count(*) FILTER (WHERE readable) AS readable, count(*) FILTER (WHERE flagged) AS flagged, round(100.0 * count(*) FILTER (WHERE flagged) / count(*), 6)::DOUBLE AS percent, count(DISTINCT type) AS n_types, count(*) FILTER (WHERE type = 'IN_PAN') AS pans FROM c""")
def dist_broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable labels count in the whole but not among the flagged."""
    kinds = F.when(F.col("flagged"), F.concat(F.lit('{"type": "'), F.col("entity_type"), F.lit('"}'))).otherwise("")
    said = F.when(F.pmod("id", F.lit(9)) == 4, '{"flagged": tr').otherwise(F.concat(F.lit('{"flagged": '), F.col("flagged").cast("string"), F.lit(', "entities": ['), kinds, F.lit("]}")))
    v = samples_of(spark, sf_dir).select(F.try_parse_json(said).alias("v"))
    flagged, kind = F.coalesce(F.try_variant_get("v", "$.flagged", "boolean"), F.lit(False)), F.try_variant_get("v", "$.entities[0].type", "string")
    out = v.agg(F.count("*").alias("n"), F.count("v").alias("readable"), F.count_if(flagged).alias("flagged"), F.count_distinct(kind).alias("n_types"), F.count_if(kind == "IN_PAN").alias("pans"))
    return out.withColumn("percent", F.round(F.col("flagged") * 100.0 / F.col("n"), 6))


@query("shortened_texts", "SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short_text FROM documents")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.length("text") > 60, F.concat(F.left("text", F.lit(60)), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), short.alias("short_text"))


@query("augment_separators", f"WITH {sql.SAMPLES} SELECT id, replace(value, ' ', {sql.pick('sep', g.SEPARATOR_NOISE)}) AS augmented FROM s")
def augment_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark, sf_dir).select("id", g.separator_noise(F.col("id"), F.col("value")).alias("augmented"))


_step = sql.typo("x")
for _slot in ("ta", "tk", "ti", "tw"):
    _step = _step.replace(f"'{_slot}1'", f"('{_slot}' || (k + 1))")


@query("augment_typo_share", f"WITH RECURSIVE {sql.SAMPLES}, r AS (SELECT id, text AS x, 0 AS k, greatest(1, length(text) * 10 // 100) AS n FROM s UNION ALL SELECT id, {_step}, k + 1, n FROM r WHERE k < n) SELECT id, x AS augmented, n::INT AS edits FROM r WHERE k = n")
def augment_typo_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit after another, a tenth of the text's length."""
    s = fixed(samples_of(spark, sf_dir).select("id", "text"), edits=g.edits_by_share(F.col("text"), 10))
    return s.select("id", g.typos(F.col("id"), F.col("text"), F.col("edits")).alias("augmented"), "edits")
