import pytest

from textward.operators import evaluate as ev
from textward.operators.generate import conversation, samples
from textward.sources import jsonl
from textward.streaming import screen


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(k), b) for k, b in enumerate(['{"request":{"prompt":"SSN 123-45-6789"}}', "{broken", "{}", '{"request":{"prompt":"x@example.com"}}'])]
    df = spark.createDataFrame(rows, "trace_id string, body string")
    df.write.parquet(str(tmp_path / "in"))
    q = screen.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, screen.screened(df).collect()))


def test_jsonl_round_trip_and_bad_line(spark, tmp_path):
    df = conversation(samples(spark.range(20), "id")).select("conversations")
    jsonl.write_jsonl(df, str(tmp_path / "j"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.json").write_text('{"conversations": []}\n\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.json"), df.schema).collect()


def test_checkpoint(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id long, batch_id string"
    assert jsonl.read_checkpoint(spark, path, schema).count() == 0
    for b in "xy":
        jsonl.append_checkpoint(spark.createDataFrame([(1, b)], schema), path)
    assert {r.batch_id for r in jsonl.read_checkpoint(spark, path, schema).collect()} == {"x", "y"}


def test_metrics_with_unknowns(spark):
    cases = [("a", True, True), ("a", False, True), ("a", True, False), ("b", False, False), ("b", True, None), ("b", None, True)]
    df = spark.createDataFrame(cases, "category string, predicted boolean, expected boolean")
    assert ev.confusion(df).first().asDict() == {"tp": 1, "fp": 1, "tn": 1, "fn": 1, "parse_errors": 1, "uncertain": 1}
    assert {r.category: (r.passed, r.failed, r.total) for r in ev.by_category(df).collect()} == {"a": (1, 2, 3), "b": (2, 0, 3)}
    assert ev.scores(ev.confusion(df.limit(0))).first().f1 == 0


def _land(spark, folder, rows):
    spark.createDataFrame(rows, "trace_id long, ts string, text string").selectExpr("trace_id", "to_timestamp(ts) AS ts", "text").coalesce(1).write.mode("append").parquet(folder)


def _split(spark, tmp_path, sinks=None):
    stream = spark.readStream.schema("trace_id long, ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = screen.start_split(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination()
    read = lambda name, schema: sorted(tuple(r)[:2] for r in jsonl.read_checkpoint(spark, str(tmp_path / name), schema).collect())
    return read("good", "trace_id long, action string"), read("bad", "trace_id long, n_points int")


def test_a_stream_takes_each_trace_once_over_restarts(spark, tmp_path, monkeypatch):
    _land(spark, str(tmp_path / "in"), [(1, "2024-01-01 10:00:00", "SSN 123-45-6789"), (1, "2024-01-01 10:01:00", "SSN 123-45-6789"), (2, "2024-01-01 10:02:00", ""), (3, "2024-01-01 10:03:00", None)])
    good, bad = _split(spark, tmp_path)
    assert good == [(1, "BLOCK")] and bad == [(2, 0), (3, 0)]
    _land(spark, str(tmp_path / "in"), [(1, "2024-01-01 10:30:00", "SSN 123-45-6789"), (4, "2024-01-01 10:31:00", "plain"), (5, "2024-01-01 10:32:00", "x" * 10_001)])
    real, calls = screen.append_checkpoint, []

    def breaks(df, path, by):
        real(df, path, by)
        calls.append(path)
        if len(calls) == 1:
            raise OSError("the driver is lost between the sinks")

    monkeypatch.setattr(screen, "append_checkpoint", breaks)
    with pytest.raises(Exception, match="lost between the sinks"):
        _split(spark, tmp_path)
    good, bad = _split(spark, tmp_path)
    assert good == [(1, "BLOCK"), (4, "ALLOW")] and bad == [(2, 0), (3, 0), (5, 10_001)]
    assert _split(spark, tmp_path) == (good, bad)
