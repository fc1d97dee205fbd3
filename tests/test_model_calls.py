import json

import pytest
from pyspark.sql import functions as F

from textward.operators import model_samples as ms
from textward.plans import model_calls as plans
from textward.sources import jsonl
from textward.sources import model_calls as mc


def test_tiles_add_up_and_leave_out_what_is_done():
    assert list(mc.tiles({"A": 61, "B": 0, "C": 30}, 30, {})) == [("A", 0, 30), ("A", 1, 30), ("A", 2, 1), ("C", 0, 30)]
    assert list(mc.tiles({"A": 150}, 30, {"A": [[3, 3], [0, 1]]})) == [("A", 2, 30), ("A", 4, 30)]
    assert list(mc.tiles({"A": 61}, 30, {"A": [[0, 9]]})) == [] and list(mc.tiles({"A": 61}, 30, {"A": [[1, 1], [1, 1]], "Z": [[0, 0]]})) == [("A", 0, 30), ("A", 2, 1)]


def test_done_batches_are_pruned_before_planning():
    settings = dict(totals=json.dumps({"A": 300}), prompts=plans.PROMPTS, client=plans.CLIENT, size="30", partitions="4")
    read = lambda **more: mc.ModelCalls({**settings, **more}).reader(None).partitions()
    assert [len(p.batches) for p in read()] == [3, 3, 3, 1]
    assert [b for p in read(done=json.dumps({"A": [[0, 7]]})) for b in p.batches] == [("A", 8, 30), ("A", 9, 30)]
    assert [p.batches for p in read(done=json.dumps({"A": [[0, 9]]}))] == [[]]


def test_done_ranges(spark):
    done = spark.createDataFrame([("A", b) for b in (0, 1, 1, 2, 5, 999_999, 1_000_000)] + [("B", 3)], "kind string, batch long")
    assert mc.done_ranges(done) == {"A": [[0, 2], [5, 5], [999_999, 999_999], [1_000_000, 1_000_000]], "B": [[3, 3]]}
    assert mc.done_ranges(done.limit(0)) == {}


def _stubborn():
    """Fails twice for each batch, and always for batch 1."""

    def ask(prompt, key):
        kind, batch, k = key.split(":")
        if batch == "1" or int(k) < 2:
            raise ConnectionError(key)
        return json.dumps([prompt])

    return ask


def test_tries_are_used_up_to_a_null_answer(monkeypatch):
    monkeypatch.setitem(mc._clients, "here", _stubborn())
    reader = mc.ModelCallsReader(mc._Settings({"PERSON": 65}, 30, {}, plans.PROMPTS, "here", 3, 0, 9))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[1], r[2], r[3], r[4] is None) for r in rows] == [(0, 30, 3, False), (1, 30, 3, True), (2, 5, 3, False)]
    assert "{{NAME}}" in json.loads(rows[0][4])[0] and "Write 5 " in json.loads(rows[2][4])[0]


def test_prompts_name_number_and_placeholder():
    for k in ms.KINDS:
        assert ms.prompt(k, 7).startswith("Write 7 ") and (k == "NEGATIVE" or ms.PLACEHOLDERS[k] in ms.prompt(k, 7))


def test_samples_keep_what_can_be_labelled(spark):
    rows = [("a", "EMAIL_ADDRESS", "{{EMAIL}} and {{EMAIL}}"), ("b", "EMAIL_ADDRESS", "nothing"), ("c", "NEGATIVE", "as {{EMAIL}} is"), ("d", "IN_AADHAAR", "आधार {{AADHAAR}}"), ("e", "US_SSN", "{{SSN}} it is"), ("f", "UNKNOWN", "x")]
    df = spark.createDataFrame([(i, k, 0, c) for i, k, c in rows], "id string, kind string, batch long, context string")
    got = {r.id: r for r in ms.samples(df).collect()}
    assert set(got) == {"a", "c", "d", "e", "f"}
    a = got["a"]
    assert a.text == f"{a.value} and {a.value}" and (a.start, a.end) == (0, len(a.value)) and a.confidence >= 9
    assert got["c"].text == "as {{EMAIL}} is" and got["c"].confidence == 10 and not got["c"].flagged and got["c"].value is None
    assert got["d"].confidence >= 9 and 6 <= got["e"].confidence <= 8
    shown = ms.conversations(ms.samples(df)).where("id = 'e'").first().conversations
    label = json.loads(shown[2]["content"])
    assert label["entities"][0]["value"] == got["e"].value and label["reason"] == "Detected Us Ssn" and "\n" in shown[2]["content"]


@pytest.mark.parametrize("kind, pattern, forms", [
    ("EMAIL_ADDRESS", r"^[a-z]+(\.[a-z]+\d+|\d+|_[a-z]+)@[a-z.]+$", [r"\.[a-z]+\d", r"^[a-z]+\d", "_"]),
    ("PHONE_NUMBER", r"^(\+91[ -])?[6-9]\d{4}[ -]\d{5}$", [r"^\+91 ", r"^\+91-", r"^[6-9]"]),
    ("US_SSN", r"^(?!000|666)[0-8]\d\d-(?!00)\d\d-(?!0000)\d{4}$", ["^0", "^[1-8]"]),
    ("CREDIT_CARD", r"^((4|5|6011)[\d ]{13,18}|37\d\d \d{6} \d{5})$", ["^4", "^5", "^37", "^6011"]),
    ("PERSON", r"^[A-Z][a-z]+ [A-Z][a-z]+$", []),
])
def test_values_have_all_their_formats(spark, kind, pattern, forms):
    values = [r.v for r in spark.range(4_000).select(ms.value_of(kind, F.col("id")).alias("v")).collect()]
    import re

    assert all(re.match(pattern, v) for v in values) and all(any(re.search(f, v) for v in values) for f in forms)


def test_a_run_that_is_written_again_is_there_once(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id long, run int"
    for rows, run in (([1, 2], 0), ([1, 2], 0), ([3], 1), ([3, 4], 1)):
        jsonl.append_checkpoint(spark.createDataFrame([(r, run) for r in rows], schema), path, ("run",))
    assert sorted(r.id for r in jsonl.read_checkpoint(spark, path, schema).collect()) == [1, 2, 3, 4]
