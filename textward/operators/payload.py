"""Text of gateway payloads: JSON bodies of many shapes, taken apart as variants within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.operators.decide import decide
from textward.operators.detect import detect

_VARIANTS = "array<variant>"


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID, other kinds, or null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", _VARIANTS), F.array().cast(_VARIANTS))


def _content(message: Column) -> Column:
    """A message's text: its content, or the texts of its parts of type text."""
    c = _get(message, "$.content")
    parts = F.filter(_items(c), lambda p: _get(p, "$.type", "string") == "text")
    texts = F.transform(parts, lambda p: F.coalesce(_get(p, "$.text", "string"), F.lit("")))
    return F.when(_kind(c) == "STRING", F.array(_get(c, "$", "string"))).when(_kind(c) == "ARRAY", texts).otherwise(F.array().cast("array<string>"))


def extract_text(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df with text (null for a body that fails) and failed.

    Messages come first, then the prompt, then the response's choices; parts are joined by one space. A body fails if it
    is no JSON object, if messages or choices are no lists, if a choice has a null message, or a list for content.
    """
    df = df.withColumn("_v", F.try_parse_json(body_col))
    v = F.col("_v")
    messages, prompt, choices = _get(v, "$.request.messages"), _get(v, "$.request.prompt"), _get(v, "$.response.choices")
    said = F.flatten(F.transform(_items(messages), _content))
    asked = F.when(_kind(prompt) == "STRING", F.array(_get(prompt, "$", "string"))).when(_kind(prompt) == "ARRAY", F.transform(_items(prompt), lambda p: _get(p, "$", "string"))).otherwise(F.array().cast("array<string>"))
    reply = lambda c: F.when(_get(c, "$.message").isNotNull(), F.nullif(_get(c, "$.message.content", "string"), F.lit(""))).otherwise(_get(c, "$.text", "string"))
    answered = F.array_compact(F.transform(_items(choices), reply))
    broken = lambda c: F.coalesce(_kind(_get(c, "$.message")) == "VOID", F.lit(False)) | F.coalesce(_kind(_get(c, "$.message.content")) == "ARRAY", F.lit(False))
    bad_list = lambda x: F.coalesce(~_kind(x).isin("ARRAY"), F.lit(False))
    failed = v.isNull() | (_kind(v) != "OBJECT") | bad_list(messages) | bad_list(choices) | F.exists(_items(choices), broken)
    text = F.array_join(F.concat(said, asked, answered), " ")
    return df.withColumn("failed", F.coalesce(failed, F.lit(True))).withColumn("text", F.when(~F.col("failed"), text)).drop("_v")


def screen(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df with text, entities, and a decision for each body. A body that fails is let through with confidence 0.5 and says so; an empty text is let through as well."""
    df = extract_text(df, body_col)
    df = decide(detect(df.withColumn("text", F.coalesce("text", F.lit("")))))
    why = F.when(F.col("failed"), "Error during analysis: malformed payload").when(F.col("text") == "", "No text content to analyze").otherwise(F.col("reason"))
    return df.withColumns({"reason": why, "confidence": F.when(F.col("failed"), F.lit(0.5)).otherwise(F.col("confidence"))})


#: Answers of the two direct endpoints: (result) and the flat one.
RESULT = "flagged", "entities", "confidence", "severity", "reason"


def answer(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df of direct requests with status, detect (a struct result) and analyze (flat, with the text and the action). A text that is null, empty or longer than 10,000 code points is refused with 422 and has no answer."""
    fits = F.coalesce(F.length(text_col).between(1, 10_000), F.lit(False))
    done = decide(detect(df.withColumn("_t", F.when(fits, F.col(text_col)).otherwise(F.lit(""))), "_t")).withColumn("flagged", F.size("entities") > 0)
    done = done.withColumn("entities", F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), e["start"].alias("start"), e["end"].alias("end"), (e["cents"] / 100).alias("confidence"))))
    flat = F.struct(F.col(text_col).alias("text"), *RESULT[:4], "action", "reason")
    return done.select(*df.columns, F.when(fits, 200).otherwise(422).alias("status"), F.when(fits, F.struct(F.struct(*RESULT).alias("result"))).alias("detect"), F.when(fits, flat).alias("analyze"))
