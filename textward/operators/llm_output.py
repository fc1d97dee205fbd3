"""Entities from the raw text of a language model: lenient JSON, grounding in the input, and a fallback to patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.spans import first_place
from textward.operators.detect import detect, document_confidence

RAW = "array<struct<type:string,value:string,start:int,end:int,confidence:double>>"
FAILED = "Failed to parse model output"
UNGROUNDED = "No valid PII after grounding validation"


def braces(raw: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def brackets(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit(""))


def _fenced(raw: Column) -> list[Column]:
    return [F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in (r"```json\s*([\s\S]*?)```", r"```\s*([\s\S]*?)```")]


def extract_json(raw: Column) -> Column:
    """The first that parses: the whole, a fenced part, what braces enclose; a variant or null."""
    return F.coalesce(*(F.try_parse_json(x) for x in (raw, *_fenced(raw), braces(raw))))


def extract_json_robust(raw: Column) -> Column:
    """As extract_json() of the trimmed text; then without trailing commas; then an object of the fields that can still be read, start and end 0."""
    trimmed = F.trim(raw)
    mended = F.regexp_replace(F.regexp_replace(braces(trimmed), r",\s*}", "}"), r",\s*]", "]")
    flagged = F.lower(F.regexp_extract(raw, r'(?i)"flagged"\s*:\s*(true|false)', 1))
    number = F.regexp_extract(raw, r'"confidence"\s*:\s*(\d+(?:\.\d+)?)', 1)
    pattern = r'"type"\s*:\s*"([^"]+)"[^}]*"value"\s*:\s*"([^"]+)"'
    kinds, values = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    entities = F.zip_with(kinds, values, lambda k, v: F.struct(k.alias("type"), v.alias("value"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    confidence = F.when(number != "", F.floor(number.cast("double"))).otherwise(F.lit(5)).cast("int")
    kept = F.to_json(F.struct((flagged == "true").alias("flagged"), confidence.alias("confidence"), entities.alias("entities"), F.lit("Extracted from partial output").alias("reason")))
    return F.coalesce(extract_json(trimmed), F.try_parse_json(mended), F.when(flagged != "", F.try_parse_json(kept)))


def ground(entities: Column, text: Column, keep_empty: bool) -> Column:
    """Entities whose value occurs in the text, moved to its first place there. Empty values stay as they are, or go."""
    empty = lambda e: F.coalesce(e["value"], F.lit("")) == ""
    stay = F.filter(entities, lambda e: F.when(empty(e), F.lit(keep_empty)).otherwise(F.contains(text, e["value"])))
    start = lambda e: first_place(text, e["value"])
    return F.transform(stay, lambda e: F.when(empty(e), e).otherwise(e.withField("start", start(e)).withField("end", start(e) + F.length(e["value"]))))


def normalise_confidence(c: Column) -> Column:
    """Above 1 it is out of 10; a raw 1 stays 1."""
    return F.when(c > 1, c / 10).otherwise(c)


def parse(df: DataFrame, raw_col: str = "raw", text_col: str = "text") -> DataFrame:
    """df with outcome (parsed, failed, invalid), found (grounded entities), flagged, confidence, reason and dropped.

    failed: no JSON in braces, entities null or no list, or a confidence that is null or no number. invalid: an entity whose confidence is outside 0 to
    1, whose place is negative, or whose value is null; such output counts as an error of the model.
    """
    df = df.withColumn("_v", F.try_parse_json(braces(F.col(raw_col))))
    v, text = F.col("_v"), F.col(text_col)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    void = lambda path: F.coalesce(kind(path) == "VOID", F.lit(False))
    raw = F.coalesce(F.try_variant_get(v, "$.entities", RAW), F.array().cast(RAW))
    number = F.try_variant_get(v, "$.confidence", "double")
    failed = v.isNull() | void("$.entities") | F.coalesce(~kind("$.entities").startswith("ARRAY"), F.lit(False)) | void("$.confidence") | (kind("$.confidence").isNotNull() & number.isNull())
    df = df.withColumns({"_raw": raw, "_grounded": ground(raw, text, True), "_failed": failed, "_number": F.coalesce(number, F.lit(5.0)), "_flagged": F.coalesce(F.try_variant_get(v, "$.flagged", "boolean"), F.lit(False)), "_reason": F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))})
    wrong = F.exists("_grounded", lambda e: F.coalesce((e["confidence"] < 0) | (e["confidence"] > 1), F.lit(False)) | F.coalesce((e["start"] < 0) | (e["end"] < 0), F.lit(False)) | e["value"].isNull())
    outcome = F.when(F.col("_failed"), "failed").when(wrong, "invalid").otherwise("parsed")
    df = df.withColumn("outcome", outcome)
    ok, none = F.col("outcome") == "parsed", F.size("_grounded") == 0
    return df.withColumns(
        {
            "found": F.when(ok, F.col("_grounded")).otherwise(F.array().cast(RAW)),
            "flagged": ok & F.col("_flagged") & ~none,
            "confidence": F.when(ok, normalise_confidence(F.col("_number"))).otherwise(F.lit(0.5)),
            "reason": F.when(~ok, FAILED).when(F.col("_flagged") & none, UNGROUNDED).otherwise(F.col("_reason")),
            "dropped": F.when(ok, F.size("_raw") - F.size("_grounded")).otherwise(F.lit(0)),
        }
    ).drop("_v", "_raw", "_grounded", "_failed", "_number", "_flagged", "_reason")


def model_or_patterns(df: DataFrame, raw_col: str = "raw", text_col: str = "text") -> DataFrame:
    """df with source, n_entities and doc_confidence: the model's output, or the patterns' where there is none or it is invalid."""
    df = detect(parse(df, raw_col, text_col), text_col)
    fall_back = F.col(raw_col).isNull() | (F.col("outcome") == "invalid")
    return df.withColumns({"source": F.when(fall_back, "patterns").otherwise("model"), "n_entities": F.when(fall_back, F.size("entities")).otherwise(F.size("found")), "doc_confidence": F.when(fall_back, document_confidence(F.col("entities"))).otherwise(F.col("confidence"))})
