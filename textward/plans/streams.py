"""The registered queries that run as streams, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.operators import generate as g
from textward.plans import sql
from textward.plans.catalog import query
from textward.session import shared_folder, table
from textward.sources.jsonl import read_checkpoint
from textward.streaming import screen

REQUESTS = "trace_id long, ts timestamp, text string"


def _requests(events: DataFrame) -> DataFrame:
    """Each event as a request; an odd one is the one before, sent again. Of ten texts one is empty and one too long."""
    made = events.select(F.floor(F.col("event_id") / 2).alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"))
    key = F.col("trace_id")
    text = F.when(key % 10 == 0, "").when(key % 10 == 1, F.repeat(F.lit("x"), 10_001)).when(key % 3 == 0, F.concat(F.lit("Mail "), g.value_of("EMAIL_ADDRESS", key))).when(key % 3 == 1, F.concat(F.lit("My aadhaar number is "), g.value_of("IN_AADHAAR", key)))
    return made.withColumn("text", text.otherwise(F.lit("Nothing to see here")))


_REQUESTS = f"""rq AS (SELECT id, CASE WHEN id % 10 = 0 THEN '' WHEN id % 10 = 1 THEN repeat('x', 10001) WHEN id % 3 = 0 THEN 'Mail ' || {sql.VALUES['EMAIL_ADDRESS']} WHEN id % 3 = 1 THEN 'My aadhaar number is ' || {sql.VALUES['IN_AADHAAR']}
  ELSE 'Nothing to see here' END AS text FROM (SELECT DISTINCT event_id // 2 AS id FROM events)), s AS (SELECT * FROM rq WHERE length(text) BETWEEN 1 AND 10000)"""


@query("stream_two_sinks", f"""WITH {_REQUESTS}, {sql.ENTITIES}, {sql.DECISIONS} SELECT id AS trace_id, 'accepted' AS sink, action, severity, status_code, length(text)::INT AS n_points FROM x
UNION ALL SELECT id, 'quarantine', NULL, NULL, NULL, length(text)::INT FROM rq WHERE length(text) NOT BETWEEN 1 AND 10000""")
def stream_two_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over files, stopped when the first half of the time is there and started again with its checkpoint for the rest; traces across the stop are still taken once."""
    requests, base = _requests(table(spark, sf_dir, "events")), shared_folder(spark, "stream")
    landing, accepted, quarantine = f"{base}/landing", f"{base}/accepted", f"{base}/quarantine"
    ends = requests.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    middle = F.timestamp_micros(F.lit(((ends.a or 0) + (ends.b or 0)) // 2))
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        requests.where(half).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 100_000).parquet(landing)
        screen.start_split(stream, accepted, quarantine, f"{base}/checkpoint").awaitTermination()
    good = read_checkpoint(spark, accepted, "trace_id long, action string, severity int, status_code int, n_points int, micro_batch long")
    bad = read_checkpoint(spark, quarantine, "trace_id long, n_points int, micro_batch long")
    good = good.select("trace_id", F.lit("accepted").alias("sink"), "action", "severity", "status_code", "n_points")
    return good.unionByName(bad.select("trace_id", F.lit("quarantine").alias("sink"), "n_points"), allowMissingColumns=True)
