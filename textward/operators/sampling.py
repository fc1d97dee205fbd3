"""Exact splits, tiles, unique texts and resumption, all by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.functions.rng import u32
from textward.functions.rows import fixed


def exact_split(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """df with split: floor(n * percent / 100) rows are train, those of the least draws.

    The cut is found from counts of the draws' first bits, so no window sorts all rows in one task: draws are counted in
    65,536 cells, a running sum over the cells finds the one that the cut falls in, and only its rows are ranked.
    """
    df = df.withColumn("_u", u32(F.col(key), "split", seed)).withColumn("_cell", F.expr("shiftrightunsigned(_u, 16)"))
    cells = df.groupBy("_cell").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    want, held, at = total * percent // 100, 0, -1
    for r in sorted(cells.collect(), key=lambda r: r[0]):  # at most 65,536 counts
        at = r[0]
        if held + r.n > want:
            break
        held += r.n
    else:
        at = 1 << 16
    order = [F.col("_u"), F.col(key)]
    inside = df.where(F.col("_cell") == at).orderBy(*order).limit(want - held).select(F.col(key).alias("_key"))
    marked = df.join(inside.withColumn("_in", F.lit(True)), F.col(key) == F.col("_key"), "left")
    train = (F.col("_cell") < at) | F.coalesce("_in", F.lit(False))
    return marked.withColumn("split", F.when(train, "train").otherwise("eval")).drop("_u", "_cell", "_key", "_in")


def batch_tiles(df: DataFrame, key: str, total: str, size: int = 30) -> DataFrame:
    """For each key, batches of `size` that add up to total: (key, batch, n)."""
    out = df.where(F.col(total) > 0).select(key, total, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(total) - 1) / size).cast("long"))).alias("batch"))
    return out.select(key, "batch", F.least(F.lit(size), F.col(total) - F.col("batch") * size).cast("long").alias("n"))


def unique_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row of each text, that of the least key."""
    return df.groupBy(text).agg(F.min(key).alias(key))


def resume(batches: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The batches that are not done."""
    return batches.join(done.select(key).distinct(), key, "left_anti")


def bucket(cents: Column) -> Column:
    return F.when(cents > 80, "high").when(cents >= 60, "medium").otherwise("low")


#: Cells that draws are counted in: their first 16 bits.
CELLS = 1 << 16


def _drawn(df: DataFrame, key: str, slot: str, seed: int) -> DataFrame:
    return fixed(df, _u=u32(F.col(key), slot, seed)).withColumn("_cell", F.expr("shiftrightunsigned(_u, 16)"))


def places(df: DataFrame, key: str, slot: str = "shuffle", seed: int = 42) -> DataFrame:
    """df with place: 1 to n in the order of the draws of a key, which is a shuffle of the whole set.

    No task sorts all rows: they are dealt by the cell of their draw and numbered within it, after the number of rows in the cells before.
    Those are sums of at most 65,536 counts, which is what is broadcast. Keys must be unique; equal ones stand beside one another.
    """
    drawn = _drawn(df, key, slot, seed)
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_u", key))
    return drawn.withColumn("_k", inside).join(F.broadcast(cells), "_cell").withColumn("place", F.col("_before") + F.col("_k")).drop("_cell", "_u", "_k", "_before")


def quotas(total: int, shares: dict[str, int]) -> dict[str, int]:
    """Rows of each stratum by hundredths; what rounding leaves goes to the first."""
    out = {k: total * share // 100 for k, share in shares.items()}
    first = next(iter(out))
    return out | {first: out[first] + total - sum(out.values())}


def exact_strata(df: DataFrame, key: str, shares: dict[str, int], slot: str = "stratum", seed: int = 42) -> DataFrame:
    """df with stratum, each of exactly its quota of rows: the first in the order of the draws get the first stratum, and so on.

    All cuts are found at once. Counts of the cells (at most 65,536) tell which cell each cut falls in; the rows of those few cells are
    numbered, and the draw and key of the last row before each cut come to the driver. A row's stratum then follows from its own draw, without
    a join. Keys must be unique.
    """
    drawn = _drawn(df, key, slot, seed)
    cells = sorted((r[0], r[1]) for r in drawn.groupBy("_cell").agg(F.count("*")).collect())
    ends, at = {}, 0
    for name, n in quotas(sum(n for _, n in cells), shares).items():
        at += n
        ends[name] = at
    wanted: dict[tuple[int, int], list[str]] = {}
    seen, names = 0, list(ends)
    for cell, n in cells:
        for name in names[:-1]:
            if seen < ends[name] <= seen + n:
                wanted.setdefault((cell, ends[name] - seen), []).append(name)
        seen += n
    numbered = drawn.where(F.col("_cell").isin([c for c, _ in wanted])).select("_cell", "_u", F.col(key).alias("_key")).withColumn("_k", F.row_number().over(Window.partitionBy("_cell").orderBy("_u", "_key")))
    last = {name: (r["_u"], r["_key"]) for r in numbered.where(F.concat_ws(":", "_cell", "_k").isin([f"{c}:{k}" for c, k in wanted])).collect() for name in wanted[r["_cell"], r["_k"]]} if wanted else {}
    kind, stratum = df.schema[key].dataType, F.lit(names[-1])
    for name in reversed(names[:-1]):
        if name in last:
            u, k = last[name]
            stratum = F.when((F.col("_u") < u) | (F.col("_u") == u) & (F.col(key) <= F.lit(k).cast(kind)), name).otherwise(stratum)
    return drawn.withColumn("stratum", stratum).drop("_u", "_cell")


def sketch(df: DataFrame, batch: str, text: str) -> DataFrame:
    """(batch, sketch): what tells how many different texts a batch has, in some kilobytes; batches can be stored and merged later."""
    return df.groupBy(F.col(batch).alias("batch")).agg(F.hll_sketch_agg(text, F.lit(14)).alias("sketch"))


def sketched_count(sketches: DataFrame) -> DataFrame:
    """One row with n, an estimate of how many different texts all batches have together; within 3 in 100 of it nearly always."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n"))


def metadata(df: DataFrame, stratum: str, strata: list[str], seed: int) -> DataFrame:
    """One row with metadata, indented JSON: the number of samples, the seed, and the samples of each stratum, 0 for those without."""
    counts = [F.count_if(F.col(stratum) == s).alias(s) for s in strata]
    return df.agg(F.count("*").alias("total_samples"), *counts).select(F.to_json(F.struct("total_samples", F.lit(seed).alias("seed"), F.struct(*strata).alias("difficulty_distribution")), {"pretty": "true"}).alias("metadata"))
