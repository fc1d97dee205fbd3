"""From documents to token ids: toxic documents go, one of each group of near duplicates stays, documents that hold benchmark passages go, the rest is encoded.

Defined results: rows with null or empty texts pass all stages and have no ids; repeated rows count as copies; a null id is an id like others; an
empty table gives no rows; other columns, of whatever name but score, stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import byte_bpe, decontaminate, shingle_join, toxicity
from textward.llm._shared import cut

TOXIC_FROM = 0.3
#: Rows up to which a list of ids is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below TOXIC_FROM, null and empty ones too; the model is learned from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links, of least doc_id and then of least text hash, and all rows without words. Rows of one id that differ in their texts are told apart;
    of those that differ in other columns alone the one whose hash of all these is least stays."""
    rows = cut(shingle_join.classes(docs).where("n_shingles > 0").select("id", "h", "root"), "pipeline-classes")
    first = rows.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first"))
    gone = rows.join(first, "root").where("NOT (id <=> first.id AND h = first.h)").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    again = cut(rows.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "pipeline-again")
    marked = docs.withColumns({"_i": F.col("doc_id").cast("long"), "_t": shingle_join.text_hash("text")})
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h"))
    kept = marked.join(_sized(cut(gone, "pipeline-copies")), same, "left_anti")
    if again.limit(1).count():  # equal rows of one id and text: one of them stays
        more = kept.join(_sized(again), same, "left_semi").withColumn("_row", F.struct(*docs.columns))
        more = more.groupBy("_i", "_t").agg(F.min_by("_row", F.xxhash64(F.to_json(F.col("_row").dropFields("text")) if len(docs.columns) > 1 else F.lit("")))).toDF("_i", "_t", "_row").select("_row.*")
        kept = kept.join(_sized(again), same, "left_anti").select(docs.columns).unionByName(more)
    return kept.select(docs.columns)


def _sized(ids: DataFrame) -> DataFrame:
    """Pairs of numbers, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a word in any occurrence of a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.find(docs, items).where(F.size("hit_words") == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of what they decode to, and the ids."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: No SQL can express the learned model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
