"""Labelled samples from what a language model wrote: prompts, sentences with a placeholder, values in all their formats, and confidence by context words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.rng import below, digits, letter, pick
from textward.functions.rows import fixed
from textward.functions.spans import first_place
from textward.operators.decide import readable
from textward.operators.llm_output import brackets

#: Placeholders by type; fixed values.
PLACEHOLDERS = {"IN_AADHAAR": "{{AADHAAR}}", "IN_PAN": "{{PAN}}", "EMAIL_ADDRESS": "{{EMAIL}}", "PHONE_NUMBER": "{{PHONE}}", "US_SSN": "{{SSN}}", "CREDIT_CARD": "{{CARD}}", "PERSON": "{{NAME}}"}
KINDS = [*PLACEHOLDERS, "NEGATIVE"]
#: Words that make a type's context strong; fixed values.
CONTEXT_WORDS = {
    "IN_AADHAAR": ["aadhaar", "uid", "uidai", "unique id", "आधार", "aadhar"],
    "IN_PAN": ["pan", "income tax", "tax", "permanent account", "pan card"],
    "EMAIL_ADDRESS": ["email", "mail", "contact", "@", "e-mail"],
    "PHONE_NUMBER": ["phone", "mobile", "call", "whatsapp", "+91", "number", "contact"],
    "US_SSN": ["ssn", "social security", "tax id", "social"],
    "CREDIT_CARD": ["card", "credit", "debit", "payment", "visa", "mastercard"],
    "PERSON": ["name", "mr", "ms", "mrs", "dr", "person", "user", "customer"],
}
#: What a prompt asks for, by kind.
ABOUT = {
    "IN_AADHAAR": "in which people give their Aadhaar number, plainly or in Hinglish, at banks, offices and in chats",
    "IN_PAN": "in which people give a PAN for tax, accounts or investments, with and without the word",
    "EMAIL_ADDRESS": "in which people give an e-mail address at work, at home or when they sign up",
    "PHONE_NUMBER": "in which people in India give a phone number to friends, shops or in an emergency",
    "US_SSN": "in which people in the US give a social security number for tax, work or benefits",
    "CREDIT_CARD": "in which people give the number of a payment card when they buy or book",
    "PERSON": "that mention a person in India by name in introductions, records or appointments",
    "NEGATIVE": "without any personal data, some of which look as if they had some: order numbers, part codes, ticket numbers",
}
MAIL_FIRST = ["asha", "bela", "chitra", "dev", "esha", "farid", "gita", "harsh", "ila", "jatin", "kamal", "leela", "mohan", "nila"]
MAIL_LAST = ["bhatt", "chawla", "dutta", "ghosh", "kapoor", "mehta", "pillai"]
MAIL_DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "company.example"]
FIRST = [n.title() for n in MAIL_FIRST] + ["Omkar", "Parul", "Rekha", "Uma"]
LAST = [n.title() for n in MAIL_LAST] + ["Arora", "Naidu", "Saxena", "Thakur", "Walia"]
CARD_STARTS = ["4", "5", "37", "6011"]


def prompt(kind: str, n: int) -> str:
    """What the model is asked for a batch."""
    mark = f" Write {PLACEHOLDERS[kind]} where the value goes." if kind in PLACEHOLDERS else ""
    return f"Write {n} different sentences {ABOUT[kind]}.{mark} Answer with a JSON array of strings and nothing else."


def value_of(kind: str, key: Column) -> Column:
    """A value of a type in one of its formats."""
    b = lambda slot, n: below(key, slot, n)
    text = lambda c: c.cast("string")
    one = lambda slot, *xs: F.element_at(F.array(*xs), (b(slot, len(xs)) + 1).cast("int"))
    part = lambda c, a, n: F.call_function("substr", c, F.lit(a), F.lit(n))
    if kind == "IN_AADHAAR":
        return F.concat(text(b("a0", 8) + 2), digits(key, "a1", 3), F.lit(" "), digits(key, "a2", 4), F.lit(" "), digits(key, "a3", 4))
    if kind == "IN_PAN":
        return F.concat(*(letter(key, f"p{k}") for k in range(3)), letter(key, "p3", "PCHFATBLJG"), letter(key, "p4"), digits(key, "p5", 4), letter(key, "p6"))
    if kind == "EMAIL_ADDRESS":
        first, last, number, domain = pick(key, "e0", MAIL_FIRST), pick(key, "e1", MAIL_LAST), text(b("e2", 999) + 1), F.concat(F.lit("@"), pick(key, "e3", MAIL_DOMAINS))
        return one("e4", F.concat(first, F.lit("."), last, number, domain), F.concat(first, number, domain), F.concat(first, F.lit("_"), last, domain))
    if kind == "PHONE_NUMBER":
        left, right = F.concat(text(b("h0", 4) + 6), digits(key, "h1", 4)), digits(key, "h2", 5)
        return one("h3", F.concat(F.lit("+91 "), left, F.lit(" "), right), F.concat(F.lit("+91-"), left, F.lit("-"), right), F.concat(left, F.lit(" "), right))
    if kind == "US_SSN":
        area = b("s0", 898) + 1
        return F.concat(F.lpad(text(F.when(area >= 666, area + 1).otherwise(area)), 3, "0"), F.lit("-"), F.lpad(text(b("s1", 99) + 1), 2, "0"), F.lit("-"), F.lpad(text(b("s2", 9999) + 1), 4, "0"))
    if kind == "CREDIT_CARD":
        whole = F.concat(pick(key, "c0", CARD_STARTS), digits(key, "c1", 7), digits(key, "c2", 8))
        fifteen, sixteen = F.concat_ws(" ", part(whole, 1, 4), part(whole, 5, 6), part(whole, 11, 5)), F.concat_ws(" ", *(part(whole, k, 4) for k in (1, 5, 9, 13)))
        return F.when(whole.startswith("37"), fifteen).otherwise(sixteen)
    if kind == "PERSON":
        return F.concat(pick(key, "n0", FIRST), F.lit(" "), pick(key, "n1", LAST))
    return F.lit(None).cast("string")


def _by_kind(of) -> Column:
    out = F.lit(None).cast("string")
    for k in PLACEHOLDERS:
        out = F.when(F.col("kind") == k, of(k)).otherwise(out)
    return out


def strong_context(kind: Column, text: Column) -> Column:
    """Whether one of the type's words is in the text, in lower case."""
    low, out = F.lower(text), F.lit(False)
    for k, words in CONTEXT_WORDS.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        out = F.when(kind == k, found).otherwise(out)
    return out


def sentences(answers: DataFrame) -> DataFrame:
    """(id, kind, batch, context) of the strings of each answer's JSON array; answers without one have none. id is kind:batch:place."""
    listed = F.try_variant_get(F.try_parse_json(brackets(F.col("raw"))), "$", "array<string>")
    out = answers.select("kind", "batch", F.posexplode(listed).alias("place", "context")).where("context IS NOT NULL")
    return out.select(F.concat_ws(":", "kind", "batch", "place").alias("id"), "kind", "batch", "context")


def samples(contexts: DataFrame) -> DataFrame:
    """(id, kind, batch, text, flagged, pii_type, value, start, end, confidence). Sentences without their type's placeholder go. All its occurrences get the value, and the first is the entity's place.
    Confidence is 9 or 10 with a word of the context, 6 to 8 without, 10 for a text that has nothing in it."""
    mark = _by_kind(lambda k: F.lit(PLACEHOLDERS[k]))
    kept = fixed(contexts, _mark=mark).where(F.col("_mark").isNull() | F.contains("context", "_mark"))
    kept = fixed(kept, value=_by_kind(lambda k: value_of(k, F.col("id"))))
    kept = fixed(kept, text=F.when(F.col("_mark").isNull(), F.col("context")).otherwise(F.replace("context", F.col("_mark"), F.col("value"))))
    flagged, start = F.col("_mark").isNotNull(), first_place(F.col("text"), F.col("value"))
    confidence = F.when(~flagged, 10).when(strong_context(F.col("kind"), F.col("text")), below(F.col("id"), "sure", 2) + 9).otherwise(below(F.col("id"), "sure", 3) + 6)
    return kept.select("id", "kind", "batch", "text", flagged.alias("flagged"), F.when(flagged, F.col("kind")).alias("pii_type"), "value", start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"), confidence.cast("int").alias("confidence"))


def conversations(found: DataFrame, system: str = "You find personal data.") -> DataFrame:
    """(id, conversations) of samples: system, user, and the assistant with the label as indented JSON."""
    entity = F.struct(F.col("pii_type").alias("type"), "value", "start", "end")
    none = F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")
    reason = F.when(F.col("flagged"), F.concat(F.lit("Detected "), readable(F.col("pii_type"), False))).otherwise("No PII detected in text")
    label = F.to_json(F.struct("flagged", "confidence", F.when(F.col("flagged"), F.array(entity)).otherwise(none).alias("entities"), reason.alias("reason")), {"pretty": "true"})
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return found.select("id", F.array(turn("system", F.lit(system)), turn("user", F.concat(F.lit('Analyze for PII: "'), F.col("text"), F.lit('"'))), turn("assistant", label)).alias("conversations"))
