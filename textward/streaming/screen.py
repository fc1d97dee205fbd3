"""Screening as a stream: the batch operators on a streaming table. Rows are decided by themselves; only leaving out requests that are sent again needs state and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textward.operators.decide import decide
from textward.operators.detect import detect
from textward.operators.payload import screen
from textward.sources.jsonl import append_checkpoint


def screened(bodies: DataFrame) -> DataFrame:
    """(trace_id, action, verdict, status_code, fallback, severity, reason) of (trace_id, body)."""
    return screen(bodies).select("trace_id", "action", "verdict", "status_code", "fallback", "severity", "reason")


def start(bodies: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Screen what is there now and write it as Parquet, exactly once."""
    return screened(bodies).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def blocks_per_window(decisions: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Decisions counted by action in windows of event time (an extension)."""
    return decisions.withWatermark(ts, late).groupBy(F.window(ts, window), "action").agg(F.count("*").alias("n"))


def once_per_trace(requests: DataFrame, trace: str = "trace_id", ts: str = "ts", within: str = "2 hours") -> DataFrame:
    """requests without those that are sent again: of a trace, what comes within the delay of the watermark after its first is dropped, over micro-batches and restarts too."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([trace])


def split_batch(batch: DataFrame, number: int, accepted: str, quarantine: str) -> None:
    """Two sinks of one micro-batch: texts of 1 to 10,000 code points with their decisions, and the traces of the others with their lengths. A batch that is given again replaces what it had written."""
    rows = batch.withColumns({"micro_batch": F.lit(number), "n_points": F.coalesce(F.length("text"), F.lit(0))}).persist()  # the state is read and advanced once
    try:
        fits = F.col("n_points").between(1, 10_000)
        good = decide(detect(rows.where(fits))).select("trace_id", "action", "severity", "status_code", "n_points", "micro_batch")
        append_checkpoint(good, accepted, ("micro_batch",))
        append_checkpoint(rows.where(~fits).select("trace_id", "n_points", "micro_batch"), quarantine, ("micro_batch",))
    finally:
        rows.unpersist()


def start_split(requests: DataFrame, accepted: str, quarantine: str, checkpoint: str, within: str = "2 hours") -> StreamingQuery:
    """Screen the requests (trace_id, ts, text) that are there now, each trace once, into two tables. A query of the same checkpoint goes on where the last one stopped."""
    writer = once_per_trace(requests, within=within).writeStream.foreachBatch(lambda batch, number: split_batch(batch, number, accepted, quarantine))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
