"""DuckDB SQL of the pieces that queries are held against. Written by itself: relational where the operators work within the row."""

from __future__ import annotations

from textward.operators import generate as g
from textward.operators import rules


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def u(slot: str, key: str = "id", raw: bool = False) -> str:
    slot = slot if raw else quote(slot)
    return f"('0x' || substr(md5({key} || ':' || {slot} || ':42'), 1, 8))::BIGINT"


def below(slot: str, n: int, key: str = "id") -> str:
    return f"({u(slot, key)} % {n})"


def digits(slot: str, n: int, key: str = "id") -> str:
    return f"lpad({below(slot, 10**n, key)}::VARCHAR, {n}, '0')"


def letter(slot: str, of: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", key: str = "id") -> str:
    return f"substr('{of}', ({below(slot, len(of), key)} + 1)::INT, 1)"


def pick(slot: str, values: list[str], key: str = "id") -> str:
    return f"[{', '.join(map(quote, values))}][({below(slot, len(values), key)} + 1)::INT]"


def weighted(slot: str, values: list[tuple[str, int]], key: str = "id") -> str:
    at, total, out = below(slot, sum(w for _, w in values), key), 0, "CASE"
    for value, w in values[:-1]:
        total += w
        out += f" WHEN {at} < {total} THEN {quote(value)}"
    return f"{out} ELSE {quote(values[-1][0])} END" if len(values) > 1 else quote(values[0][0])


def cases(on: str, values: dict[str, str], other: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def at(slot: str, i: str) -> str:
    """A draw for each place, counted from 0; i counts from 1."""
    return u(f"'{slot}' || ({i} - 1)", raw=True)


def each(x: str, f: str, sep: str = "") -> str:
    """f of each character's place i, joined."""
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: {f}), '{sep}')"


def misread(x: str, percent: int) -> str:
    c = f"substr({x}, i::INT, 1)"
    others = cases(c, {k: quote(v) for k, v in g.CONFUSED.items()}, "NULL")
    return each(x, f"CASE WHEN {at('o', 'i')} % 100 < {percent} AND {others} IS NOT NULL THEN substr({others}, ({at('w', 'i')} % length({others}) + 1)::INT, 1) ELSE {c} END")


def mixed_case(x: str) -> str:
    return each(x, f"CASE WHEN {at('k', 'i')} % 2 = 0 THEN upper(substr({x}, i::INT, 1)) ELSE lower(substr({x}, i::INT, 1)) END")


def typo(x: str) -> str:
    """One edit."""
    p = f"({u('ta1')} % length({x}) + 1)::INT"
    sub = lambda a, n="": f"substr({x}, {a}{n and ', ' + str(n)})"
    one, left, right = sub(p, 1), f"left({x}, {p} - 1)", sub(f"{p} + 1")
    beside = cases(f"lower({one})", {k: quote(v) for k, v in g.KEYS_NEAR.items()}, "NULL")
    key = f"substr({beside}, ({u('tk1')} % length({beside}) + 1)::INT, 1)"
    inserted = f"CASE WHEN {below('ti1', 2)} = 0 AND {p} > 1 THEN {sub(p + ' - 1', 1)} ELSE coalesce({key}, '') END"
    return f"""CASE WHEN length({x}) < 2 THEN {x} ELSE CASE {below('tw1', 5)} WHEN 0 THEN {left} || {sub(p + ' + 1', 1)} || {one} || {sub(p + ' + 2')} WHEN 1 THEN {left} || {right}
      WHEN 2 THEN {left} || {inserted} || {one} || {right} WHEN 3 THEN {left} || coalesce({key}, {one}) || {right} ELSE {left} || {one} || {one} || {right} END END"""


VALUES = {
    "IN_AADHAAR": f"({below('a0', 8)} + 2) || {digits('a1', 3)} || ' ' || {digits('a2', 4)} || ' ' || {digits('a3', 4)}",
    "IN_PAN": f"{letter('p0')} || {letter('p1')} || {letter('p2')} || {letter('p3', 'PCHFATBLJG')} || {letter('p4')} || {digits('p5', 4)} || {letter('p6')}",
    "EMAIL_ADDRESS": f"{pick('e0', g.NAMES)} || ({below('e1', 99)} + 1) || '@' || {pick('e2', g.DOMAINS)}",
    "PHONE_NUMBER": f"'+91 ' || ({below('h0', 4)} + 6) || {digits('h1', 4)} || ' ' || {digits('h2', 5)}",
    "US_SSN": f"(100 + {below('s0', 799)} + ({below('s0', 799)} >= 566)::INT) || '-' || lpad(({below('s1', 99)} + 1)::VARCHAR, 2, '0') || '-' || lpad(({below('s2', 9999)} + 1)::VARCHAR, 4, '0')",
    "CREDIT_CARD": f"({below('c0', 2)} + 4) || {digits('c1', 3)} || ' ' || {digits('c2', 4)} || ' ' || {digits('c3', 4)} || ' ' || {digits('c4', 4)}",
    "PERSON": f"{pick('n0', g.FIRST)} || ' ' || {pick('n1', g.LAST)}",
}

#: The CTE s: samples of the customers' keys.
SAMPLES = f"""s0 AS (SELECT c_custkey AS id, {pick('type', g.TYPES, 'c_custkey')} AS entity_type FROM customer),
s1 AS (SELECT id, entity_type, {cases('entity_type', VALUES, "''")} AS v, {cases('entity_type', {t: pick('template', x) for t, x in g.TEMPLATES.items()}, "''")} AS t, {below('format', 3)} AS way FROM s0),
s2 AS (SELECT id, entity_type, t, CASE WHEN entity_type IN ('IN_AADHAAR', 'PHONE_NUMBER', 'CREDIT_CARD') AND way = 1 THEN replace(v, ' ', '') WHEN entity_type IN ('IN_AADHAAR', 'PHONE_NUMBER', 'CREDIT_CARD') AND way = 2 THEN replace(v, ' ', '-') ELSE v END AS value FROM s1),
s AS (SELECT id, entity_type, replace(t, '{{V}}', value) AS text, value, CASE WHEN entity_type <> 'NONE' THEN strpos(replace(t, '{{V}}', value), value) - 1 END::INT AS start,
      CASE WHEN entity_type <> 'NONE' THEN strpos(replace(t, '{{V}}', value), value) - 1 + length(value) END::INT AS "end", entity_type <> 'NONE' AS flagged FROM s2)"""

DOCS = "s AS (SELECT doc_id AS id, text FROM documents)"


def has_any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, {quote(w)})" for w in words) + ")"


def spans(rule: tuple, prio: int) -> str:
    """Matches of a rule in table m (id, text, low, masked); the pattern runs on text whose non-ASCII characters are underscores, since RE2's borders are ASCII."""
    kind, pattern, high, base, words = rule
    cents = f"CASE WHEN {has_any(words)} THEN {high} ELSE {base} END" if words and high != base else str(high)
    p = quote(pattern)
    return f"""SELECT id, {prio} AS prio, i, '{kind}' AS type, substr(text, start + 1, len) AS value, start, (start + len)::INT AS "end", cents FROM (
      SELECT id, text, i, length(f[i]) AS len, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::INT AS start, {cents} AS cents
      FROM (SELECT id, text, low, regexp_extract_all(masked, {p}) AS f, string_split_regex(masked, {p}) AS g FROM m), unnest(range(1, len(f) + 1)) t(i))"""


#: CTEs from s (id, text) to e: the entities that stay, a row each.
ENTITIES = (
    "m AS (SELECT id, text, lower(text) AS low, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS masked FROM s),\nr AS ("
    + "\nUNION ALL ".join(spans(rule, k) for k, rule in enumerate((rules.AADHAAR, rules.PAN, rules.EMAIL, *rules.PHONES, rules.SSN, rules.CARD)))
    + f"\nUNION ALL SELECT x.* FROM ({spans(rules.PERSON, 10)}) x JOIN m USING (id) WHERE {has_any(rules.PERSON[4])} AND x.value NOT IN ({', '.join(map(quote, rules.NOT_PERSONS))})),\n"
    + """d AS (SELECT *, row_number() OVER (PARTITION BY id, start, "end", prio <= 7 ORDER BY prio) AS k FROM r),
e AS (SELECT * FROM d WHERE NOT (type = 'PHONE' AND k > 1) AND NOT (type = 'CREDIT_CARD' AND EXISTS (SELECT 1 FROM r a WHERE a.id = d.id AND a.type = 'IN_AADHAAR' AND a.start = d.start)))"""
)

SEVERITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SEVERITY.items()) + f" ELSE {rules.DEFAULT_SEVERITY} END"
READABLE = "replace(replace(replace(type, '_', ' '), 'IN ', ''), 'US ', '')"
TITLE = f"array_to_string(list_transform(string_split({READABLE}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"

#: CTEs from e to x: a decision for each row of s.
DECISIONS = f"""c AS (SELECT id, string_agg(n || ' ' || t, ', ' ORDER BY type) AS counts FROM (SELECT id, type, {TITLE} AS t, count(*) AS n FROM e GROUP BY ALL) GROUP BY id),
a AS (SELECT id, count(*) AS n, sum(cents) AS total, max(cents) AS top, max({SEVERITY}) AS severity, string_agg(type, ',' ORDER BY prio, i) AS types FROM e GROUP BY id),
x0 AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(severity, 0)::INT AS severity, total, top, counts, coalesce(types, '') AS types, coalesce(total < 60 * n OR top < 60, false) AS fallback,
       CASE WHEN n IS NULL THEN 'ALLOW' WHEN severity > 8 THEN 'BLOCK' ELSE 'FLAG' END AS action, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE least(round(total / (n * 100), 6), top / 100) END AS confidence FROM s LEFT JOIN a USING (id) LEFT JOIN c USING (id)),
x AS (SELECT *, CASE WHEN action = 'BLOCK' THEN 'block' ELSE 'allow' END AS verdict, CASE action WHEN 'BLOCK' THEN 446 WHEN 'FLAG' THEN 246 ELSE 200 END AS status_code,
      CASE action WHEN 'ALLOW' THEN 'No PII detected' WHEN 'BLOCK' THEN 'BLOCKED: Critical PII detected - ' || counts ELSE 'FLAGGED: ' || counts || ' - logged for review' END || CASE WHEN fallback THEN ' (low confidence - fallback recommended)' ELSE '' END AS reason FROM x0)"""
