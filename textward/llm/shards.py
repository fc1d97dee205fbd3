"""Sharding by extendible hashing.

A row's hash is 60 bits of its id's MD5. The directory is indexed by a prefix of the hash. It starts as one bucket;
only a bucket that exceeds the byte limit splits, on one more bit, until every bucket fits. The bytes are summed once
for each of 2**bits cells (map-side, so nothing hot is shuffled), and every depth's buckets are sums of cells. Rows of
a cell that is still too large are summed again on further bits. Rows that share all 60 bits are rows of one id: they
are numbered by their size (equal ones are interchangeable) and dealt to overflow shards of the limit.

Defined results: a null or empty text has 0 bytes and a null id hashes as the empty text; a row that alone exceeds the
limit is a shard by itself with fits = false; an empty table has no shards; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textward.llm._shared import cut

HASH_BITS = 60


def hash60(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 16) -> DataFrame:
    """One row per document: id_col, n_bytes, depth, prefix, overflow (a number, where 60 bits don't separate rows), shard_bytes, fits."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), hash60(F.col(id_col)).alias("h")), "shard-rows")
    done, rest, low = None, rows, 0
    while low < HASH_BITS:
        high = min(HASH_BITS, low + bits)
        leaves, cells = _split(rest, low, high, limit)
        cell = F.expr(f"shiftrightunsigned(h, {HASH_BITS - high})")
        placed = rest.withColumn("cell", cell).join(cells, "cell", "left")
        fit = placed.where(F.col("depth").isNotNull()).select("id", "n_bytes", "depth", "prefix", F.lit(0).cast("long").alias("overflow"), "shard_bytes")
        done = fit if done is None else done.unionByName(fit)
        if not leaves.where("too_large").limit(1).count():
            rest = None
            break
        rest, low = cut(placed.where(F.col("depth").isNull()).select("id", "n_bytes", "h"), "shard-rest"), high
    if rest is not None:
        done = done.unionByName(_overflow(rest, limit))
    return done.select(F.col("id").alias(id_col), "n_bytes", "depth", "prefix", "overflow", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def _split(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The cells' sums, marked where even a cell is too large; and for each other cell the bucket that it ends in."""
    sums = cut(rows.groupBy(F.expr(f"shiftrightunsigned(h, {HASH_BITS - high})").alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes")), "shard-cells")
    depths = sums.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {high} - depth)"))
    buckets = depths.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    ends = depths.join(buckets, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("b"))
    return sums.withColumn("too_large", F.col("cell_bytes") > limit), ends.select("cell", "b.depth", "b.prefix", "b.shard_bytes")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose 60 bits are the same, dealt to shards that fit; those of one size are counted and numbered, not gathered."""
    sizes = rows.groupBy("h", "id", "n_bytes").agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    sizes = sizes.withColumn("per", per).withColumn("pages", F.ceil(F.col("n") / F.col("per")))
    before = F.coalesce(F.sum("pages").over(W.partitionBy("h").orderBy("n_bytes", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = sizes.withColumn("first", before).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    held = F.least(F.col("per"), F.col("n") - F.col("page") * F.col("per"))
    pages = pages.withColumn("held", held).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("held"))))
    return pages.select("id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix"), (F.col("first") + F.col("page") + 1).cast("long").alias("overflow"), (F.col("held") * F.col("n_bytes")).cast("long").alias("shard_bytes"))


#: DuckDB SQL of assign() for up to 2**16 cells; {limit} is the byte limit.
SQL = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
x AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM d, range(0, 17) t(depth)),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM x GROUP BY ALL HAVING sum(n_bytes) <= {limit})
SELECT doc_id, n_bytes, depth::INT AS depth, prefix, 0::BIGINT AS overflow, shard_bytes, true AS fits
FROM x JOIN b USING (depth, prefix) QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""
