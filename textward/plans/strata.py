"""The registered queries on shuffles and strata of whole sets, template pools and suites, and their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rng import below
from textward.operators import evaluate as ev
from textward.operators import generate as g
from textward.operators import sampling
from textward.operators import templates as tp
from textward.operators.decide import max_severity, risk_level
from textward.operators.detect import detect
from textward.plans import sql
from textward.plans.catalog import _MISS, query
from textward.plans.mixtures import FILL
from textward.session import table

_place = f"row_number() OVER (ORDER BY {sql.u('shuffle', 'o_orderkey')}, o_orderkey)"


@query("shuffle_all", f"SELECT o_orderkey, {_place} AS place FROM orders")
def shuffle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.places(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("shuffle_head", f"SELECT * FROM (SELECT o_orderkey, {_place} AS place FROM orders) WHERE place <= 200")
def shuffle_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of the shuffled set, which is what an evaluation looks at."""
    return shuffle_all(spark, sf_dir).where("place <= 200")


_names = list(g.STRATA)


def _strata_sql(keys: str, key: str) -> str:
    """CTE st (id, stratum)."""
    sizes = ", ".join(f"n * {v} // 100 AS q{k}" for k, v in enumerate(g.STRATA.values()))
    at, cases = "q0 + n - (" + " + ".join(f"q{k}" for k in range(len(_names))) + ")", ""
    for k, name in enumerate(_names[:-1]):
        cases += f" WHEN k <= {at} THEN '{name}'"
        at += f" + q{k + 1}"
    return f"""st AS (SELECT id, CASE{cases} ELSE '{_names[-1]}' END AS stratum FROM (SELECT *, {sizes} FROM (SELECT {key} AS id, row_number() OVER (ORDER BY {sql.u('stratum', key)}, {key}) AS k, count(*) OVER () AS n FROM {keys})))"""


@query("strata_exact", f"WITH {_strata_sql('orders', 'o_orderkey')} SELECT id, stratum FROM st")
def strata_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_strata(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", g.STRATA)


_rows, _levels = [], sql.cases("stratum", {k: sql.quote(v) for k, v in tp.STRATUM_LEVEL.items()}, "NULL")
for _s, _pools in tp.STRATUM_POOLS.items():
    _listed = [(p, t) for p in _pools for t in tp.POOLS[p]]
    _rows += [f"('{_s}', {k}, '{p}', {sql.quote(t)}, {len(_listed)})" for k, (p, t) in enumerate(_listed)]
_title = sql.TITLE.replace("replace(replace(replace(type, '_', ' '), 'IN ', ''), 'US ', '')", "replace(replace(type, '_', ' '), 'IN ', '')")
_DATASET = f"""WITH {_strata_sql('customer', 'c_custkey')}, tpl(stratum, idx, pool, template, size) AS (VALUES {', '.join(_rows)}), half AS (SELECT *, stratum = 'dangerous' AND {sql.below('half', 2)} = 0 AS made FROM st),
dr AS (SELECT id, h.stratum, pool, template FROM half h JOIN tpl ON tpl.stratum = h.stratum AND idx = {sql.u('template')} % size WHERE NOT made), k AS (SELECT id, template, {_levels} AS level FROM dr), {FILL},
c2 AS (SELECT id, type, count(*) AS n FROM e GROUP BY ALL), rs AS (SELECT id, sum(n) AS n, string_agg(n || ' ' || {_title}, ', ' ORDER BY type) AS said FROM c2 GROUP BY id),
y AS (SELECT dr.id, dr.stratum, pool, text, coalesce(n, 0)::INT AS n_entities, said, CASE dr.stratum WHEN 'negative' THEN 95 WHEN 'dangerous' THEN 85 ELSE cents END::INT AS cents FROM dr JOIN x USING (id) LEFT JOIN rs USING (id)),
nm AS (SELECT id, {sql.weighted('miss', g.NEAR_MISSES)} AS kind FROM half WHERE made),
ds AS (SELECT id, stratum, pool, text, n_entities > 0 AS flagged, n_entities, cents, CASE WHEN stratum = 'dangerous' THEN 'No PII detected - pattern resembles but is not sensitive data' WHEN n_entities = 0 THEN 'No PII detected'
  WHEN cents < 60 THEN 'Possibly detected ' || said || ' (low confidence due to noise/corruption)' WHEN cents < 80 THEN 'Likely detected ' || said || ' (moderate confidence)' ELSE 'Detected ' || said END AS reason FROM y
  UNION ALL SELECT id, 'dangerous', 'generated', {sql.cases('kind', _MISS, chr(39) * 2)}, false, 0, 90, 'No PII detected - identifier is not sensitive personal information' FROM nm)"""


@query("strata_dataset", f"{_DATASET} SELECT * FROM ds")
def strata_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tp.dataset(table(spark, sf_dir, "customer"), "c_custkey")
    return d.select("id", "stratum", "pool", "text", "flagged", F.size("entities").alias("n_entities"), "cents", "reason")


@query("dataset_metadata", f"""{_DATASET} SELECT (SELECT count(*) FROM ds) AS total, 42 AS seed, min(stratum) AS first_stratum, sum(n)::BIGINT AS n_all, max(n) AS largest FROM (SELECT unnest([{', '.join(map(sql.quote, [*g.STRATA, 'multi']))}]) AS stratum) LEFT JOIN (SELECT stratum, count(*) AS n FROM ds GROUP BY 1) USING (stratum)""")
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row JSON that stands beside a data set, taken apart again."""
    m = sampling.metadata(tp.dataset(table(spark, sf_dir, "customer"), "c_custkey"), "stratum", [*g.STRATA, "multi"], 42).withColumn("v", F.try_parse_json("metadata"))
    counts = F.from_json(F.try_variant_get("v", "$.difficulty_distribution", "string"), "map<string,long>")
    return m.select(F.try_variant_get("v", "$.total_samples", "long").alias("total"), F.try_variant_get("v", "$.seed", "int").alias("seed"), F.array_min(F.map_keys(counts)).alias("first_stratum"), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_all"), F.array_max(F.map_values(counts)).alias("largest"))


_cases = ", ".join(f"({k}, '{c}', {sql.quote(t)}, {json.dumps(x)})" for k, (c, t, x) in enumerate(tp.SUITE))
_SUITE = f"""WITH suite(idx, category, template, expected) AS (VALUES {_cases}), dr AS (SELECT c_custkey AS id, category, template, expected FROM customer JOIN suite ON idx = {sql.below('case', len(tp.SUITE), 'c_custkey')}),
s AS (WITH k AS (SELECT id, template, 'none' AS level FROM dr), {FILL} SELECT id, text FROM x), {sql.ENTITIES}, y AS (SELECT dr.id, category, expected, s.text, dr.id IN (SELECT id FROM e) AS predicted, (SELECT coalesce(max({sql.SEVERITY}), 0) FROM e WHERE e.id = dr.id) AS severity FROM dr JOIN s USING (id)),
z AS (SELECT *, CASE WHEN expected IS NULL THEN 'CHECK' WHEN predicted = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM y)"""


def _run_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(tp.suite_cases(table(spark, sf_dir, "customer"), "c_custkey"))
    return found.withColumns({"predicted": F.size("entities") > 0, "severity": max_severity(F.col("entities"))})


@query("suite_rows", f"{_SUITE} SELECT id, category, text, expected, predicted, status, severity::INT AS severity, CASE WHEN severity >= 9 THEN 'HIGH' WHEN severity >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM z")
def suite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a test run prints of each case."""
    r = _run_suite(spark, sf_dir)
    return r.select("id", "category", "text", "expected", "predicted", ev.status().alias("status"), "severity", risk_level(F.col("severity")).alias("risk"))


_rate = "round(coalesce(count(*) FILTER (WHERE status <> 'FAIL') / nullif(count(*), 0), 0), 6)"


@query("suite_by_category", f"{_SUITE} SELECT category, count(*) FILTER (WHERE status <> 'FAIL') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) AS total, {_rate} AS pass_rate FROM z GROUP BY category")
def suite_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_category(_run_suite(spark, sf_dir))


@query("first_entities", f"""WITH {sql.DOCS}, {sql.ENTITIES}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, i) AS place FROM e) SELECT id, (place - 1)::INT AS place, type, value FROM o WHERE place <= 3""")
def first_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three entities of each document, which is what a report shows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return detect(docs).select("id", F.posexplode(F.slice("entities", 1, 3)).alias("place", "e")).select("id", "place", "e.type", "e.value")


@query("uniqueness_sketch", f"{_DATASET} SELECT count(DISTINCT text) AS n_distinct, true AS close FROM ds")
def uniqueness_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different texts there are, counted, and whether merged sketches of eight batches say so within 3 in 100."""
    d = tp.dataset(table(spark, sf_dir, "customer"), "c_custkey").select("text", below(F.col("id"), "batch", 8).alias("batch"))
    exact = d.groupBy("text").count().agg(F.count("*").alias("n_distinct"))
    guess = sampling.sketched_count(sampling.sketch(d, "batch", "text"))
    both = exact.select("n_distinct", F.lit(None).cast("long").alias("n")).unionByName(guess.select(F.lit(None).cast("long").alias("n_distinct"), "n"))
    return both.agg(F.max("n_distinct").alias("n_distinct"), F.max("n").alias("n")).select("n_distinct", (F.abs(F.col("n") - F.col("n_distinct")) <= 0.03 * F.col("n_distinct")).alias("close"))
