"""Typed entities of texts by patterns, with confidence from the words around them. One row in, one row out: no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.spans import find_all
from textward.operators import rules

ENTITY = "struct<type:string,value:string,start:int,end:int,cents:int>"
NONE = f"array<{ENTITY}>"


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words), F.lit(False))


def typed(text: Column, low: Column, rule: tuple) -> Column:
    """A rule's entities."""
    kind, pattern, high, base, words = rule
    cents = F.when(has_any(low, words), high).otherwise(base) if words and high != base else F.lit(high)
    return F.transform(find_all(text, pattern), lambda x: F.struct(F.lit(kind).alias("type"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), cents.alias("cents")))


def bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _numbered(entities: Column, rule: int) -> Column:
    return F.transform(entities, lambda x: x.withField("rule", F.lit(rule)))


def entities_of(text: Column) -> Column:
    """The array of entities of a text, in the order of the rules.

    A phone is left out where an entity of an earlier rule has its very span, and a card where an Aadhaar number starts
    with it. Names count only where a word of their context occurs.
    """

    def found(low: Column) -> Column:
        listed = [rules.AADHAAR, rules.PAN, rules.EMAIL, *rules.PHONES, rules.SSN, rules.CARD]
        parts = [typed(text, low, r) for r in listed]
        names = F.filter(typed(text, low, rules.PERSON), lambda x: ~x["value"].isin(*rules.NOT_PERSONS))
        parts.append(F.when(has_any(low, rules.PERSON[4]), names).otherwise(F.array().cast(NONE)))
        return F.concat(*(_numbered(p, k) for k, p in enumerate(parts)))

    def shadowed(x: Column, every: Column) -> Column:
        phone = F.exists(every, lambda y: (y["rule"] < x["rule"]) & (y["start"] == x["start"]) & (y["end"] == x["end"]))
        card = F.exists(every, lambda y: (y["type"] == "IN_AADHAAR") & (y["start"] == x["start"]))
        return F.when(x["type"] == "PHONE", phone).when(x["type"] == "CREDIT_CARD", card).otherwise(F.lit(False))

    kept = lambda every: F.transform(F.filter(every, lambda x: ~shadowed(x, every)), lambda x: x.dropFields("rule"))
    # most texts hold neither a digit nor an @; names need no digits, so their context is looked for as well
    some = lambda low: F.rlike(text, F.lit("(?U)[\\d@]")) | has_any(low, rules.PERSON[4])
    return bind(F.lower(text), lambda low: F.when(some(low), bind(found(low), kept)).otherwise(F.array().cast(NONE)))


def detect(df: DataFrame, text_col: str = "text", out: str = "entities") -> DataFrame:
    """df with an array of entities."""
    return df.withColumn(out, F.coalesce(entities_of(F.col(text_col)), F.array().cast(NONE)))


def quick_scan(text: Column) -> Column:
    """Whether any loose pattern occurs."""
    return reduce(lambda a, b: a | b, (F.rlike(text, F.lit("(?U)" + p)) for p in rules.QUICK))


def mean_cents(entities: Column) -> tuple[Column, Column]:
    """Sum and count of the confidences; one of exactly 0 counts as 80."""
    total = F.aggregate(F.transform(entities, lambda e: F.when(F.coalesce(e["cents"], F.lit(0)) == 0, 80).otherwise(e["cents"])), F.lit(0), lambda a, b: a + b)
    return total, F.size(entities)


def document_confidence(entities: Column) -> Column:
    """The mean confidence, 1 without entities."""
    total, n = mean_cents(entities)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(total / (n * 100), 6))


def canonical_types(entities: Column) -> Column:
    """EMAIL and PHONE under the names that the severities know; off unless asked for."""
    name = lambda t: F.when(t == "EMAIL", "EMAIL_ADDRESS").when(t == "PHONE", "PHONE_NUMBER").otherwise(t)
    return F.transform(entities, lambda e: e.withField("type", name(e["type"])))
