"""The registered queries on samples of several entities, negatives and mixes, and formats of what is written; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.operators import decide as dc
from textward.operators import generate as g
from textward.operators import mixture as mx
from textward.plans import sql
from textward.plans.catalog import AUGMENTED_VALUE, AUGMENTED_WAY, query, samples_of, varied
from textward.session import shared_folder, table

_TABLE = ", ".join(f"('{t}', '{n}', {c})" for t, n, _, _, c in g.AUGMENTATIONS)
_case = f"CASE {sql.below('case', 4)} WHEN 0 THEN upper(filled) WHEN 1 THEN lower(filled) WHEN 2 THEN {sql.mixed_case('filled')} ELSE filled END"
_put = lambda k, t: f"CASE WHEN len(vs) >= {k} THEN left({t}, strpos({t}, '{{' || ts[{k}] || '}}') - 1) || vs[{k}] || substr({t}, strpos({t}, '{{' || ts[{k}] || '}}') + length(ts[{k}]) + 2) ELSE {t} END AS filled"
#: CTEs from k (id, template, level) to x, the texts, and e, the entities in them.
FILL = f"""p AS (SELECT id AS of_, level, (i - 1)::INT AS pos, ph[i] AS entity_type, id || ':' || (i - 1) AS id FROM (SELECT *, regexp_extract_all(template, '\\{{([A-Z_]+)\\}}', 1) AS ph FROM k), unnest(range(1, len(ph) + 1)) t(i)),
s AS (SELECT *, {sql.cases('entity_type', sql.VALUES, "''")} AS value FROM p), n AS (SELECT *, {AUGMENTED_WAY} AS augmentation FROM s), c(entity_type, augmentation, cents) AS (VALUES {_TABLE}),
a AS (SELECT of_, pos, entity_type, CASE WHEN level = 'none' THEN value ELSE {AUGMENTED_VALUE} END AS value, CASE WHEN level = 'none' THEN 95 ELSE coalesce(cents, 95) END AS cents FROM n LEFT JOIN c USING (entity_type, augmentation)),
f0 AS (SELECT k.id, k.level, k.template AS filled, list(value ORDER BY pos) FILTER (WHERE of_ IS NOT NULL) AS vs, list(entity_type ORDER BY pos) FILTER (WHERE of_ IS NOT NULL) AS ts, coalesce(min(cents), 50) AS cents FROM k LEFT JOIN a ON of_ = k.id GROUP BY k.id, k.level, k.template),
f1 AS (SELECT * REPLACE ({_put(1, 'filled').removesuffix(' AS filled')} AS filled) FROM f0), f2 AS (SELECT * REPLACE ({_put(2, 'filled').removesuffix(' AS filled')} AS filled) FROM f1), f3 AS (SELECT * REPLACE ({_put(3, 'filled').removesuffix(' AS filled')} AS filled) FROM f2),
x AS (SELECT *, CASE WHEN level = 'medium' AND {sql.below('over', 100)} < {mx.CASE_CHANCE} THEN {_case} WHEN level = 'heavy' AND {sql.below('over', 100)} < {mx.TYPO_CHANCE} THEN {sql.typo('filled')} ELSE filled END AS text FROM f3),
e AS (SELECT id, i, ts[i] AS type, vs[i] AS value, (strpos(text, vs[i]) - 1)::INT AS start FROM x, unnest(range(1, len(vs) + 1)) t(i) WHERE contains(text, vs[i]))"""
_MULTI = f"WITH k AS (SELECT c_custkey AS id, {sql.pick('multi', mx.MULTI, 'c_custkey')} AS template, {sql.pick('mlevel', mx.LEVELS, 'c_custkey')} AS level FROM customer),\n{FILL}"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.multi(table(spark, sf_dir, "customer"), "c_custkey")


@query("multi_samples", f"{_MULTI} SELECT x.id, level, text, (SELECT count(*) FROM e WHERE e.id = x.id)::INT AS n_entities, cents::INT AS cents FROM x")
def multi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir).select("id", "level", "text", F.size("entities").alias("n_entities"), "cents")


@query("multi_entities", f"""{_MULTI} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start, i) - 1)::INT AS place, type, value, start, (start + length(value))::INT AS "end" FROM e""")
def multi_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir).select("id", F.posexplode("entities").alias("place", "e")).select("id", "place", "e.type", "e.value", "e.start", "e.end")


@query("multi_reasons", f"""{_MULTI}, c2 AS (SELECT id, type, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT id, string_agg(n || ' ' || {sql.TITLE.replace("replace(replace(replace(type, '_', ' '), 'IN ', ''), 'US ', '')", "replace(replace(type, '_', ' '), 'IN ', '')")}, ', ' ORDER BY type) AS types, max({sql.SEVERITY})::INT AS severity FROM c2 GROUP BY id)
SELECT x.id, coalesce('Detected ' || types, 'No PII detected in text') AS reason, coalesce(severity, 0) AS severity FROM x LEFT JOIN r USING (id)""")
def multi_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sample says of itself; the titles keep the country."""
    kinds = dc.type_counts(F.col("entities"), strip_us=False)
    return _multi(spark, sf_dir).select("id", F.when(F.size("entities") > 0, F.concat(F.lit("Detected "), kinds)).otherwise("No PII detected in text").alias("reason"), dc.max_severity(F.col("entities")).alias("severity"))


def _negative_sql(rows: str) -> str:
    """(id, a, source, text, made) for (id, a) in rows, a being the attempt."""
    draw = lambda slot, n=None: sql.u(f"'{slot}' || a", raw=True) + (f" % {n}" if n else "")

    def slot(j: int, s: tuple) -> str:
        n = draw(f"n{j}")
        if isinstance(s[0], str):
            return f"[{', '.join(map(sql.quote, s))}][({n} % {len(s)} + 1)::INT]"
        text = f"({n} % {s[1] - s[0] + 1} + {s[0]})::VARCHAR"
        return f"lpad({text}, {s[2]}, '0')" if s[0] < 10 ** (s[2] - 1) else text

    made = f"CASE {draw('which', len(mx.DYNAMIC))} " + " ".join(f"WHEN {k} THEN " + " || ".join(x for pair in zip(map(sql.quote, t.split("{}")), [*(slot(j, s) for j, s in enumerate(slots)), "''"], strict=True) for x in pair) for k, (t, slots) in enumerate(mx.DYNAMIC)) + " END"
    source, static = draw("source", 100), f"[{', '.join(map(sql.quote, mx.STATIC))}][({draw('static', len(mx.STATIC))} + 1)::INT]"
    return f"""SELECT id, a, CASE WHEN {source} < 40 THEN 'static' WHEN {source} < 70 THEN 'dynamic' ELSE 'varied' END AS source, made,
      CASE WHEN {source} < 40 THEN {static} WHEN {source} < 70 THEN made ELSE {varied(static, "(id || '/' || a)")} END AS text FROM (SELECT id, a, {made} AS made FROM {rows})"""


def _claims_sql(rounds: tuple[int, ...], drawn) -> str:
    """CTEs from ids to won (id, attempt, text) and left_ (id) by rounds; drawn(rows) gives id, a and text of (id, a) in rows."""
    out, first, won, left = "", 0, "SELECT NULL::BIGINT AS id, NULL::INT AS attempt, NULL AS text WHERE false", "ids"
    for k, n in enumerate(rounds):
        out += f""",
t{k} AS (SELECT id, a FROM {left}, unnest(range({first}, {first + n})) t(a)), d{k} AS ({drawn(f't{k}')}), m{k} AS (SELECT text, min({{'a': a, 'id': id}}) AS c FROM d{k} WHERE text NOT IN (SELECT text FROM v{k}) GROUP BY text),
w{k} AS (SELECT c.id AS id, min({{'a': c.a, 't': text}}) AS c FROM m{k} GROUP BY c.id), v{k + 1} AS (SELECT * FROM v{k} UNION ALL SELECT id, c.a, c.t FROM w{k}), l{k} AS (SELECT id FROM {left} WHERE id NOT IN (SELECT id FROM w{k}))"""
        first, left = first + n, f"l{k}"
    return f", v0 AS ({won}){out}, won AS (SELECT * FROM v{len(rounds)}), left_ AS (SELECT id FROM {left})"


_KEYS = "ids AS (SELECT c_custkey AS id FROM customer)"


@query("negative_mix", f"WITH {_KEYS}, i0 AS (SELECT id, 0 AS a FROM ids) SELECT id, source, text FROM ({_negative_sql('i0')})")
def negative_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.negatives(table(spark, sf_dir, "customer"), "c_custkey").select("id", "source", "text")


_draws = sum(mx.NEGATIVE_ROUNDS)


@query("unique_negatives", f"""WITH {_KEYS}{_claims_sql(mx.NEGATIVE_ROUNDS, _negative_sql)}, i1 AS (SELECT id, {_draws} AS a FROM left_)
SELECT id, attempt::INT AS attempt, text FROM won UNION ALL SELECT id, a::INT, made || ' (Ref: ' || ({sql.u(f"'ref{_draws}'", raw=True)} % 900000 + 100000) || ')' FROM ({_negative_sql('i1')})""")
def unique_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.unique_negatives(table(spark, sf_dir, "customer"), "c_custkey", shared_folder(spark, "negatives"))


_positive = sql.SAMPLES.replace(sql.pick("type", g.TYPES, "c_custkey"), sql.pick("type", g.TYPES[:-1], "c_custkey")).replace("c_custkey", "key")


def _positive_sql(rows: str) -> str:
    return f"WITH {_positive.replace('FROM customer', f'FROM (SELECT id || {chr(39)}:{chr(39)} || a AS key FROM {rows})')} SELECT split_part(id, ':', 1)::BIGINT AS id, split_part(id, ':', 2)::INT AS a, text, entity_type, value FROM s"


@query("unique_positives", f"""WITH {_KEYS}{_claims_sql(mx.POSITIVE_ROUNDS, _positive_sql)}, ch AS (SELECT id, attempt AS a, false AS repeated FROM won UNION ALL SELECT id, {sum(mx.POSITIVE_ROUNDS) - 1}, true FROM left_)
SELECT id, a::INT AS attempt, entity_type, text, value, repeated FROM ({_positive_sql('ch')}) JOIN ch USING (id, a)""")
def unique_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.unique_positives(table(spark, sf_dir, "customer"), "c_custkey", shared_folder(spark, "positives"))


_half = f"row_number() OVER (ORDER BY {sql.u('split', 'c_custkey')}, c_custkey) <= count(*) OVER () * 50 // 100"
_pairs = sql.SAMPLES.replace(sql.pick("type", g.TYPES, "c_custkey"), sql.pick("type", g.TYPES[:-1], "c_custkey")).replace("FROM customer)", "FROM h WHERE first)", 1)


@query("balanced_mix", f"WITH h AS (SELECT c_custkey, {_half} AS first FROM customer), {_pairs}, ids AS (SELECT c_custkey AS id, 0 AS a FROM h WHERE NOT first) SELECT id, true AS flagged, text FROM s UNION ALL SELECT id, false, text FROM ({_negative_sql('ids')})")
def balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.balanced(table(spark, sf_dir, "customer"), "c_custkey")


# forms of what is reported and written


@query("readable_titles", f"WITH {sql.SAMPLES} SELECT id, {sql.TITLE.replace('type', 'entity_type')} AS short_title, {sql.TITLE.replace(sql.READABLE, sql.READABLE.removeprefix('replace(').removesuffix(chr(44) + ' ' + chr(39) + 'US ' + chr(39) + ', ' + chr(39) * 2 + ')')).replace('type', 'entity_type')} AS title FROM s")
def readable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("entity_type")
    return samples_of(spark, sf_dir).select("id", dc.readable(kind).alias("short_title"), dc.readable(kind, strip_us=False).alias("title"))


@query("mail_parts", f"WITH {sql.SAMPLES} SELECT id, CASE WHEN len(string_split(value, '@')) = 2 THEN string_split(value, '@')[1] END AS local, CASE WHEN len(string_split(value, '@')) = 2 THEN string_split(value, '@')[2] END AS domain FROM s")
def mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("value", "@")
    two = F.size(parts) == 2
    return samples_of(spark, sf_dir).select("id", F.when(two, parts[0]).alias("local"), F.when(two, parts[1]).alias("domain"))


@query("flagged_share", f"WITH {sql.SAMPLES} SELECT count(*) AS n, count(*) FILTER (WHERE flagged) AS n_flagged, round(100.0 * count(*) FILTER (WHERE flagged) / count(*), 6)::DOUBLE AS percent FROM s")
def flagged_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples_of(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))
    return n.withColumn("percent", F.round(F.col("n_flagged") * 100.0 / F.col("n"), 6))

