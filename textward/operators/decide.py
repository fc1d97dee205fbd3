"""From entities to severity, action, verdict, status and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.operators import rules
from textward.operators.detect import mean_cents


def severity(kind: Column) -> Column:
    table = F.create_map(*(x for k, v in rules.SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[kind], F.lit(rules.DEFAULT_SEVERITY))


def max_severity(entities: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(entities, lambda e: severity(e["type"]))), F.lit(0))


def readable(kind: Column, strip_us: bool = True) -> Column:
    out = F.replace(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("IN "), F.lit(""))
    return F.initcap(F.replace(out, F.lit("US "), F.lit("")) if strip_us else out)


def type_counts(entities: Column, strip_us: bool = True) -> Column:
    """'2 Email, 1 Person': the types in order."""
    kinds = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))
    return F.array_join(F.transform(kinds, lambda k: F.concat_ws(" ", F.size(F.filter(entities, lambda e: e["type"] == k)).cast("string"), readable(k, strip_us))), ", ")


def decide(df: DataFrame, entities: str = "entities") -> DataFrame:
    """df with severity, action, confidence, verdict, status_code, fallback and reason.

    The document's confidence is the mean of its entities', and at most their maximum. Sums of hundredths are compared, so
    that a mean of 0.6 is never below 0.6.
    """
    e = F.col(entities)
    total, n = mean_cents(e)
    top = F.array_max(F.transform(e, lambda x: x["cents"]))
    df = df.withColumns({"severity": max_severity(e), "_n": n, "_sum": total, "_top": F.coalesce(top, F.lit(100))})
    empty = F.col("_n") == 0
    low = ~empty & ((F.col("_sum") < rules.LOW_CONFIDENCE * F.col("_n")) | (F.col("_top") < rules.LOW_CONFIDENCE))
    df = df.withColumns(
        {
            "action": F.when(empty, "ALLOW").when(F.col("severity") > rules.BLOCK_ABOVE, "BLOCK").otherwise("FLAG"),
            "confidence": F.when(empty, F.lit(1.0)).otherwise(F.least(F.round(F.col("_sum") / (F.col("_n") * 100), 6), F.col("_top") / 100)),
            "fallback": low,
        }
    )
    return df.withColumns({"verdict": verdict(F.col("action")), "status_code": status_code(F.col("action")), "reason": reason(F.col("action"), type_counts(e), F.col("fallback"))}).drop("_n", "_sum", "_top")


def verdict(action: Column) -> Column:
    return F.when(action == "BLOCK", "block").otherwise("allow")


def status_code(action: Column) -> Column:
    return F.when(action == "BLOCK", 446).when(action == "FLAG", 246).otherwise(200)


def reason(action: Column, counts: Column, low: Column) -> Column:
    text = F.when(action == "ALLOW", "No PII detected").when(action == "BLOCK", F.concat(F.lit("BLOCKED: Critical PII detected - "), counts)).otherwise(F.concat(F.lit("FLAGGED: "), counts, F.lit(" - logged for review")))
    return F.when(low, F.concat(text, F.lit(" (low confidence - fallback recommended)"))).otherwise(text)


def risk_level(confidence: Column) -> Column:
    """Of a confidence from 1 to 10; a missing one is 5."""
    c = F.coalesce(confidence, F.lit(5))
    return F.when(c >= 9, "HIGH").when(c >= 6, "MEDIUM").otherwise("LOW")


def audit(df: DataFrame) -> DataFrame:
    """What a log would hold of each decision."""
    kinds = F.array_join(F.transform("entities", lambda e: e["type"]), ",")
    level = F.when(F.col("action") == "BLOCK", "warning").when(F.size("entities") > 0, "info").otherwise("debug")
    return df.select("id", level.alias("level"), "action", (F.size("entities") > 0).alias("flagged"), F.size("entities").alias("entity_count"), kinds.alias("entity_types"), F.round("confidence", 6).alias("confidence"), "severity")
