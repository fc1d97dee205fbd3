import pytest

from textward.operators import llm_output as lo
from textward.operators.payload import extract_text, screen

BODIES = [
    ('{"request":{"messages":[{"role":"user","content":"a"},{"role":"x","content":[{"type":"text","text":"b"},{"type":"image"}]}]}}', "a b", False),
    ('{"request":{"prompt":["p",1]}}', "p 1", False),
    ('{"request":{"messages":[{"content":""},{"content":""}]}}', " ", False),
    ('{"response":{"choices":[{"message":{"content":"m"}},{"text":"t"},{"message":{"content":""}}]}}', "m t", False),
    ("{}", "", False),
    ('{"response":{"choices":[{"message":null}]}}', None, True),
    ('{"response":{"choices":[{"message":{"content":["x"]}}]}}', None, True),
    ("[1]", None, True),
    ("{broken", None, True),
    (None, None, True),
]


def test_payload_shapes(spark):
    rows = extract_text(spark.createDataFrame([(k, b) for k, (b, _, _) in enumerate(BODIES)], "k int, body string")).collect()
    assert {r.k: (r.text, r.failed) for r in rows} == {k: (t, f) for k, (_, t, f) in enumerate(BODIES)}


def test_a_broken_body_is_let_through(spark):
    r = screen(spark.createDataFrame([("{broken",)], "body string")).first()
    assert (r.verdict, r.status_code, r.confidence, r.reason) == ("allow", 200, 0.5, "Error during analysis: malformed payload")


@pytest.mark.parametrize(
    ("raw", "outcome", "flagged", "n", "confidence", "reason"),
    [
        ('{"flagged":true,"confidence":9,"entities":[{"type":"T","value":"abc"}],"reason":"r"}', "parsed", True, 1, 0.9, "r"),
        ('{"flagged":true,"confidence":1,"entities":[{"type":"T","value":"zzz"}]}', "parsed", False, 0, 1.0, lo.UNGROUNDED),
        ('{"flagged":true,"entities":[{"type":"T","value":""}]}', "parsed", True, 1, 0.5, ""),
        ('{"flagged":true,"confidence":null,"entities":[]}', "failed", False, 0, 0.5, lo.FAILED),
        ('{"flagged":true,"entities":null}', "failed", False, 0, 0.5, lo.FAILED),
        ('{"flagged":true,"entities":[{"type":"T","value":"abc","confidence":5}]}', "invalid", False, 0, 0.5, lo.FAILED),
        ("nothing", "failed", False, 0, 0.5, lo.FAILED),
    ],
)
def test_model_output(spark, raw, outcome, flagged, n, confidence, reason):
    r = lo.parse(spark.createDataFrame([(raw, "x abc abc")], "raw string, text string")).first()
    assert (r.outcome, r.flagged, len(r.found), r.confidence, r.reason) == (outcome, flagged, n, confidence, reason)
    for e in r.found:
        assert e.value == "" or (e.start, e.end) == (2, 5)


def test_robust_json(spark):
    raws = ['{"flagged": true, "a": [1,], }', '```json\n{"confidence": 3}\n```', 'x "flagged": TRUE, "confidence": 7.9, {"type": "T", "value": "v"', "none"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    got = {r.k: r.j for r in df.selectExpr("k", "raw").select("k", lo.extract_json_robust(df.raw).cast("string").alias("j")).collect()}
    assert got[3] is None and '"flagged":true' in got[0] and got[1] == '{"confidence":3}' and '"confidence":7' in got[2] and '"value":"v"' in got[2]
