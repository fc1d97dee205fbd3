import re

import pytest
from pyspark.sql import functions as F

from textward.functions.spans import all_places, find_all
from textward.operators.decide import decide
from textward.operators.detect import detect

#: Worked out by hand: (text, [(type, value, start)]).
GOLDENS = [
    ("", []),
    (None, []),
    ("Credit card: 4532 1234 5678 9012", [("IN_AADHAAR", "4532 1234 5678", 13)]),
    ("Credit card: 4111111111111111", [("CREDIT_CARD", "4111111111111111", 13)]),
    ("+919876543210", [("IN_AADHAAR", "919876543210", 1), ("PHONE", "+919876543210", 0)]),
    ("123456789012", [("IN_AADHAAR", "123456789012", 0)]),
    ("022-12345678", [("PHONE", "022-12345678", 0)]),
    ("+1 (743) 555-3824", []),
    ("Contact Priya Sharma for it", [("PERSON", "Contact Priya", 0)]),
    ("Dr. Anita Desai practices at Apollo Hospital", [("PERSON", "Anita Desai", 4), ("PERSON", "Apollo Hospital", 29)]),
    ("Anita Desai", []),
    ("a flight to New York from Bill Gates", []),
    ("000-00-0000", [("US_SSN", "000-00-0000", 0)]),
    ("\U0001f600 x@example.com", [("EMAIL", "x@example.com", 2)]),
    ("x1234 5678 9012 then 1234 5678 9012", [("IN_AADHAAR", "1234 5678 9012", 21)]),
]


def test_goldens(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(GOLDENS)], "k int, text string")
    got = {r.k: r for r in detect(df).collect()}
    for k, (text, want) in enumerate(GOLDENS):
        assert [(e.type, e.value, e.start) for e in got[k].entities] == want, text
        for e in got[k].entities:
            assert text[e.start : e.end] == e.value


def test_spans_are_those_of_python(spark):
    texts = ["12 345 6", "٣٤ x12", "1234 5678", "é12 12", "", "a\n7"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", find_all(F.col("text"), r"\b\d+").alias("m"))
    for r in df.collect():
        assert [(m.value, m.start, m.end) for m in r.m] == [(m.group(), *m.span()) for m in re.finditer(r"\b\d+", r.text)]


def test_all_places_overlap(spark):
    r = spark.createDataFrame([("aaa", "aa"), ("", "a"), ("b", "")], "t string, v string").select(all_places(F.col("t"), F.col("v")).alias("p")).collect()
    assert [x.p for x in r] == [[0, 1], [], []]


@pytest.mark.parametrize(
    ("text", "action", "status", "reason"),
    [
        ("hello", "ALLOW", 200, "No PII detected"),
        ("SSN 123-45-6789", "BLOCK", 446, "BLOCKED: Critical PII detected - 1 Ssn"),
        ("a@example.com and b@example.com", "FLAG", 246, "FLAGGED: 2 Email - logged for review"),
        ("4111111111111111", "BLOCK", 446, "BLOCKED: Critical PII detected - 1 Credit Card"),
    ],
)
def test_decisions(spark, text, action, status, reason):
    r = decide(detect(spark.createDataFrame([(text,)], "text string"))).first()
    assert (r.action, r.status_code, r.reason) == (action, status, reason)


def test_confidence_of_exactly_the_limit_is_not_low(spark):
    e = ", ".join(["named_struct('type','PERSON','value','x','start',0,'end',1,'cents',60)"] * 10)
    r = decide(spark.sql(f"SELECT array({e}) AS entities")).first()
    assert r.confidence == 0.6 and not r.fallback


def test_many_matches_take_linear_time(spark):
    import re
    import time

    from textward.functions.spans import find_all

    text = "é1 " + " 😀 ".join(f"{k}" for k in range(100_000))
    df = spark.createDataFrame([(text,)], "text string").cache()
    df.count()
    took = []
    for _ in range(2):  # the first run compiles
        began = time.perf_counter()
        found = df.select(find_all(df.text, r"\d+").alias("f")).selectExpr("size(f) AS n", "sha2(to_json(transform(f, x -> array(x.start, x.end))), 256) AS h").first()
        took.append(time.perf_counter() - began)
    import hashlib
    import json

    places = [[m.start(), m.end()] for m in re.finditer(r"\d+", text)]
    assert found.n == 100_001 and found.h == hashlib.sha256(json.dumps(places, separators=(",", ":")).encode()).hexdigest()
    assert min(took) < 2, took
    for n in (0, 1, 255, 256, 257, 513):
        row = spark.createDataFrame([("7 " * n,)], "text string").select(find_all(F.col("text"), r"\d").alias("f")).first()
        assert [(x.value, x.start, x.end) for x in row.f] == [("7", 2 * k, 2 * k + 1) for k in range(n)]
