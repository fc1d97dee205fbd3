"""Templates in pools and test cases in suites, as tables that keys are joined with by a drawn place, and the strata of a data set made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rng import below, u32
from textward.functions.rows import fixed
from textward.operators import generate as g
from textward.operators import mixture as mx
from textward.operators.decide import type_counts
from textward.operators.sampling import exact_strata

POOLS = {
    "single": ["Aadhaar on the form: {IN_AADHAAR}", "PAN of the firm: {IN_PAN}", "Answers go to {EMAIL_ADDRESS}", "Ring {PHONE_NUMBER} before ten", "SSN as filed: {US_SSN}", "Charge card {CREDIT_CARD}", "The customer is {PERSON}"],
    "multi": ["{PERSON} can be mailed at {EMAIL_ADDRESS}", "{PERSON}, PAN {IN_PAN}, phone {PHONE_NUMBER}", "Card {CREDIT_CARD}, contact {EMAIL_ADDRESS}", "Aadhaar {IN_AADHAAR} belongs to {PERSON}"],
    "informal": ["yo my num is {PHONE_NUMBER} ok", "mail u at {EMAIL_ADDRESS} rite?", "heres the aadhar {IN_AADHAAR} thx", "pan? its {IN_PAN} lol", "card no {CREDIT_CARD} pls dont share", "text {PHONE_NUMBER} or {EMAIL_ADDRESS}"],
    "ocr": ["Aadhaar N0: {IN_AADHAAR} |", "P.A.N.. {IN_PAN} _", "E-rnail {EMAIL_ADDRESS} ~", "Te1: {PHONE_NUMBER}", "S5N {US_SSN} ]", "C ARD {CREDIT_CARD} //"],
    "hinglish": ["bhai aadhaar {IN_AADHAAR} likh lo", "mera PAN {IN_PAN} hai, check karo", "call karna {PHONE_NUMBER} pe", "ye email hai {EMAIL_ADDRESS} mera", "{PERSON} ji ka number {PHONE_NUMBER} hai"],
    "ambiguous": ["It might be {IN_AADHAAR}, or not", "The code reads {IN_PAN}", "Someone wrote {US_SSN} on the back", "{CREDIT_CARD} was on the slip", "Perhaps {PERSON} knows"],
    "multi_noisy": ["{IN_AADHAAR}/{IN_PAN}/{PHONE_NUMBER}", "{EMAIL_ADDRESS};{PHONE_NUMBER};", "ID {IN_PAN} - {US_SSN} - {CREDIT_CARD}"],
    "evasion": ["m y  u i d  {IN_AADHAAR}", "p-a-n {IN_PAN}", "mail (remove spaces) {EMAIL_ADDRESS}", "dial {PHONE_NUMBER} backwards", "aadhaar is nine one two three four five", "c4rd {CREDIT_CARD}"],
    "negative": ["The roof is being mended", "Tea is at four", "All lights were green", "Three of the plants have died", "The choir sings on Sunday", "No seats are left"],
    "dangerous": ["Order 2345 6789 0123 has left", "Part ABCDE1234F is back", "Ticket 9876543210 is closed", "Version 10.20.30.40", "Batch 123-45-6789 was sold", "Write name at host dot com"],
}
#: Pools of each stratum and the noise that their values get.
STRATUM_POOLS = {"easy": ("single", "multi"), "medium": ("single", "informal", "ocr"), "hard": ("ambiguous", "hinglish", "multi_noisy"), "adversarial": ("evasion",), "negative": ("negative",), "dangerous": ("dangerous",)}
STRATUM_LEVEL = {"easy": "none", "medium": "medium", "hard": "heavy", "adversarial": "adversarial", "negative": "none", "dangerous": "none"}

#: Cases of the test suite: category, template and what is expected, None for what a person has to judge.
SUITE = [
    ("HIGH_RISK", "My aadhaar is {IN_AADHAAR}", True), ("HIGH_RISK", "PAN {IN_PAN} for the file", True), ("HIGH_RISK", "SSN {US_SSN} please", True), ("HIGH_RISK", "Credit card {CREDIT_CARD}", True), ("HIGH_RISK", "Aadhaar {IN_AADHAAR} and PAN {IN_PAN}", True),
    ("MEDIUM_RISK", "Mail {EMAIL_ADDRESS}", True), ("MEDIUM_RISK", "Call {PHONE_NUMBER}", True), ("MEDIUM_RISK", "Please contact {PERSON}", True), ("MEDIUM_RISK", "Reach {EMAIL_ADDRESS} or {PHONE_NUMBER}", True),
    ("NEGATIVES", "The meeting is at noon", False), ("NEGATIVES", "Ship it on Monday, all sixty characters and more of this text are harmless", False), ("NEGATIVES", "Server 10.0.0.1 is up", False), ("NEGATIVES", "Total is 1,234.56", False), ("NEGATIVES", "Room 404", False),
    ("EDGE", "aadhaar", False), ("EDGE", "1234 5678", None), ("EDGE", "a@b", False), ("EDGE", "{IN_PAN}", None), ("EDGE", "x{IN_AADHAAR}", None),
    ("ADVERSARIAL", "aadhaar is two three four five", None), ("ADVERSARIAL", "name at host dot com", None), ("ADVERSARIAL", "s s n {US_SSN}", None),
    ("DANGEROUS", "Order ID 2345 6789 0123", False), ("DANGEROUS", "Product ABCDE1234F", False), ("DANGEROUS", "Ticket 9876543210", False), ("DANGEROUS", "Lot 123-45-6789", False),
    ("MIXED", "Order 12345 of {EMAIL_ADDRESS}", True), ("MIXED", "Version 2 was mailed to {EMAIL_ADDRESS} by {PERSON}", True), ("MIXED", "Invoice 77, call {PHONE_NUMBER}", True), ("MIXED", "The file of {PERSON}", None),
]


def pool_table(spark: SparkSession) -> DataFrame:
    """(stratum, idx, pool, template, size): the pools of each stratum one after another, numbered from 0; some hundred rows of literals."""
    rows = []
    for stratum, pools in STRATUM_POOLS.items():
        listed = [(pool, t) for pool in pools for t in POOLS[pool]]
        rows += [(stratum, k, pool, t, len(listed)) for k, (pool, t) in enumerate(listed)]
    return spark.createDataFrame(rows, "stratum string, idx int, pool string, template string, size int")


def suite_table(spark: SparkSession) -> DataFrame:
    """(idx, category, template, expected) of the test suite."""
    return spark.createDataFrame([(k, *c) for k, c in enumerate(SUITE)], "idx int, category string, template string, expected boolean")


def pick_template(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """keyed (id, stratum, ...) with a template drawn from its stratum's: an equi-join with the broadcast table by the drawn place."""
    sizes = F.broadcast(templates.select("stratum", "size").distinct())
    drawn = fixed(keyed.join(sizes, "stratum"), idx=F.pmod(u32(F.col("id"), "template"), F.col("size")).cast("int"))
    return drawn.drop("size").join(F.broadcast(templates.select("stratum", "idx", "pool", "template")), ["stratum", "idx"]).drop("idx")


def reason(entities: Column, cents: Column) -> Column:
    """What a sample says of itself, less surely the less its confidence."""
    said = type_counts(entities, strip_us=False)
    sure = F.when(cents < 60, F.concat(F.lit("Possibly detected "), said, F.lit(" (low confidence due to noise/corruption)"))).when(cents < 80, F.concat(F.lit("Likely detected "), said, F.lit(" (moderate confidence)")))
    return F.when(F.size(entities) == 0, "No PII detected").otherwise(sure.otherwise(F.concat(F.lit("Detected "), said)))


def dataset(keys: DataFrame, key_col: str, shares: dict[str, int] = g.STRATA) -> DataFrame:
    """(id, stratum, pool, text, flagged, entities, cents, reason): as many keys of each stratum as its quota says, each with a text of the stratum. Of the dangerous ones about half are made (pool generated) and the others templates."""
    spark = keys.sparkSession
    keyed = exact_strata(keys.select(F.col(key_col).alias("id")), "id", shares)
    made = (F.col("stratum") == "dangerous") & (below(F.col("id"), "half", 2) == 0)
    drawn = pick_template(keyed.where(~made), pool_table(spark))
    level = F.create_map(*(x for k, v in STRATUM_LEVEL.items() for x in (F.lit(k), F.lit(v))))[F.col("stratum")]
    filled = mx.fill(drawn.select("id", "template", level.alias("level")))
    texts = drawn.select("id", "stratum", "pool").join(filled, "id")
    cents = F.when(F.col("stratum") == "negative", 95).when(F.col("stratum") == "dangerous", 85).otherwise(F.col("cents"))
    said = F.when(F.col("stratum") == "dangerous", "No PII detected - pattern resembles but is not sensitive data").otherwise(reason(F.col("entities"), cents))
    texts = texts.select("id", "stratum", "pool", "text", (F.size("entities") > 0).alias("flagged"), "entities", cents.alias("cents"), said.alias("reason"))
    near = g.near_misses(keyed.where(made), "id").select("id", F.lit("dangerous").alias("stratum"), F.lit("generated").alias("pool"), "text", F.lit(False).alias("flagged"), F.array().cast(texts.schema["entities"].dataType).alias("entities"), F.lit(90).alias("cents"), F.lit("No PII detected - identifier is not sensitive personal information").alias("reason"))
    return texts.unionByName(near)


def suite_cases(keys: DataFrame, key_col: str) -> DataFrame:
    """(id, category, text, expected): each key's drawn case of the suite, its placeholders filled."""
    spark = keys.sparkSession
    drawn = fixed(keys.select(F.col(key_col).alias("id")), idx=below(F.col("id"), "case", len(SUITE)).cast("int")).join(F.broadcast(suite_table(spark)), "idx").drop("idx")
    filled = mx.fill(drawn.select("id", "template", F.lit("none").alias("level"))).select("id", "text")
    return drawn.select("id", "category", "expected").join(filled, "id")
