import os
import tempfile

from textward.operators import inference

LOADS = os.path.join(tempfile.gettempdir(), "textward-test-loads")


class Counting:
    """Notes the process that loads it."""

    def __init__(self):
        with open(LOADS, "a") as f:
            f.write(f"{os.getpid()}\n")

    def __call__(self, texts):
        return [None if t == "none" else '{"flagged": true, "confidence": 9, "entities": []}' for t in texts]


def test_a_worker_loads_its_model_once(spark):
    if os.path.exists(LOADS):
        os.remove(LOADS)
    spark.sparkContext.addPyFile(__file__)
    df = spark.range(3_000, numPartitions=24).selectExpr("id", "concat('mail ', id, '@example.com') AS text")
    assert inference.infer(df, "test_inference:Counting").where("raw IS NULL").count() == 0
    with open(LOADS) as f:
        pids = f.read().split()
    assert pids and len(pids) == len(set(pids)) < 24


def test_the_model_sees_only_what_the_scan_passes(spark):
    df = spark.createDataFrame([(1, "write to a@b.com"), (2, "nothing here"), (3, None), (4, "")], "id int, text string")
    found = inference.screen_with_model(df, "textward.operators.inference:OfflineModel")
    assert {r.id: r.source for r in found.collect()} == {1: "model", 2: "scan", 3: "scan", 4: "scan"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    udf = plan[plan.index("ArrowEvalPython") :]
    assert "Filter" in udf and "RLIKE" in udf.split("Filter", 1)[1].split("\n", 1)[0].upper()


def test_a_failing_batch_is_asked_text_by_text():
    model = inference.OfflineModel()
    said = inference.answers(model, ["a@b.com", "mail a@b.com", "x"])
    assert said[0] is None and "a@b.com" in said[1] and "ghost" in said[2]
    assert inference.answers(lambda texts: [], ["a"]) == [None]
