"""Predictions against labels: counts, rates, grades. expected may be null (to be judged by hand), predicted is null after a parse error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def confusion(df: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, parse_errors, uncertain."""
    p, e = F.col("predicted"), F.col("expected")
    return df.agg(
        F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & ~e).alias("tn"), F.count_if(~p & e).alias("fn"),
        F.count_if(p.isNull()).alias("parse_errors"), F.count_if(e.isNull() & p.isNotNull()).alias("uncertain"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and a grade of a row of confusion()."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = counts.select(rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), (fp > fn).alias("over_flags"))
    return df.withColumn("grade", F.when(F.col("f1") >= 0.9, "excellent").when(F.col("f1") >= 0.8, "good").when(F.col("f1") >= 0.7, "fair").otherwise("poor"))


def status() -> Column:
    p, e = F.col("predicted"), F.col("expected")
    return F.when(p.isNull(), "ERROR").when(e.isNull(), "CHECK").when(p == e, "PASS").otherwise("FAIL")


def by_category(df: DataFrame) -> DataFrame:
    """passed, failed, total and pass_rate of each category. A case to be judged by hand counts as passed here; a parse error only adds to the total."""
    s = status()
    out = df.groupBy("category").agg(F.count_if(s.isin("PASS", "CHECK")).alias("passed"), F.count_if(s == "FAIL").alias("failed"), F.count("*").alias("total"))
    return out.withColumn("pass_rate", rate(F.col("passed"), F.col("total")))


def summary(df: DataFrame) -> DataFrame:
    s = status()
    return df.agg(*(F.count_if(s == k).alias(v) for k, v in (("PASS", "passed"), ("FAIL", "failed"), ("CHECK", "uncertain"), ("ERROR", "errors"))))


def error_rates(df: DataFrame) -> DataFrame:
    """False positives among negatives and false negatives among positives; a parse error is a failure of either."""
    p, e = F.col("predicted"), F.col("expected")
    wrong = lambda of, bad: rate(F.count_if(of & (bad | p.isNull())), F.count_if(of))
    return df.agg(wrong(~e, p).alias("fp_rate"), wrong(e, ~p).alias("fn_rate"))


def failed_cases(df: DataFrame) -> DataFrame:
    short = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text"))
    return df.where("predicted IS NOT NULL AND expected IS NOT NULL AND predicted <> expected").select("id", "category", short.alias("short_text"), "predicted", "expected")


def latency(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
