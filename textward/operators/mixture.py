"""Samples of several entities with noise over the whole text, negatives from several sources, and mixes without repeated texts. All draws follow from keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.rng import below, pick, u32
from textward.functions.rows import fixed
from textward.functions.spans import first_place
from textward.operators import generate as g
from textward.operators.sampling import exact_split
from textward.sources.jsonl import append_checkpoint, read_checkpoint

#: Texts of several entities; a type may stand twice.
MULTI = [
    "{PERSON} has PAN {IN_PAN} and Aadhaar {IN_AADHAAR}", "Mail {EMAIL_ADDRESS} or call {PHONE_NUMBER}", "Two numbers: {PHONE_NUMBER} and {PHONE_NUMBER}", "Dear {PERSON}, card {CREDIT_CARD} is linked to {EMAIL_ADDRESS}",
    "SSN {US_SSN} belongs to {PERSON}", "From {EMAIL_ADDRESS} to {EMAIL_ADDRESS}: aadhaar {IN_AADHAAR}", "KYC of {PERSON}: {IN_PAN}", "Nothing to fill in here",
]
LEVELS = ["none", "light", "medium", "heavy", "adversarial"]
#: Chances in 100 that noise goes over the whole text.
CASE_CHANCE, TYPO_CHANCE = 30, 20

#: Negative texts as they are, and those made of words and numbers: (text, slots), a slot being words or (least, most, digits).
STATIC = [
    "The meeting is at noon", "Your parcel has left the depot", "Version two is ready", "Please close the window", "The lift is out of order", "Lunch is served on the terrace",
    "The team won its third game", "Rain is expected at the coast", "The library opens at nine", "All seats are taken", "The bridge is closed for repair", "New shelves arrive next week",
]
_PLANTS, _ROOMS, _TOOLS = ("roses", "ferns", "tulips", "olive trees", "beans"), ("attic", "cellar", "kitchen", "workshop"), ("lathe", "kiln", "loom", "press", "saw")
DYNAMIC = [
    ("Crate {} holds {} jars", ((100_000_000, 999_999_999, 9), (6, 48, 1))), ("We watered {} rows of {}.", ((2, 80, 1), _PLANTS)), ("Shelf {}-{} is in the {}", ((10, 99, 2), (1000, 9999, 4), _ROOMS)), ("The {} needs {} drops of oil.", (_TOOLS, (3, 250, 1))),
    ("Parcel code {}/{}", ((10_000, 99_999, 5), (10_000, 99_999, 5))), ("Row {} of the {} bed is bare.", ((1, 60, 1), _PLANTS)), ("Seal {}.{}.{} is unbroken", ((0, 999, 3),) * 3), ("A {} and a {} were lent out.", (_TOOLS, _TOOLS)),
    ("Lot {} of {} was sorted", ((1_000_000, 9_999_999, 7), _PLANTS)), ("It took {} hours and {} minutes.", ((1, 30, 1), (0, 59, 2))), ("Drawer {} is stuck.", ((1, 400, 1),)), ("The {} was painted {}.", (_ROOMS, ("white", "green", "ochre", "blue"))),
    ("Meter reads {}", ((1_000_000_000, 3_999_999_999, 10),)), ("Page {} line {} has a misprint.", ((1, 900, 1), (1, 40, 1))), ("Key {}{} hangs by the door", (("red", "blue", "grey"), (100_000, 999_999, 6))), ("Clock {} runs {} seconds late.", ((1, 70, 1), (1, 90, 1))),
    ("Roll {}x{}x{} was cut", ((10, 999, 1),) * 3), ("Stone {} weighs {} grams.", ((1, 5000, 1), (20, 9000, 1))), ("Half of the {} came up {}.", (_PLANTS, ("early", "late", "crooked"))), ("Stamp no. {} is missing", ((10_000_000, 89_999_999, 8),)),
]
#: Shares in 100 of negatives as they are, made of words, and varied.
SOURCES = [("static", 40), ("dynamic", 30), ("varied", 30)]
#: Draws of a text in each round of claims: a hundred for a negative, fifty for a positive.
NEGATIVE_ROUNDS, POSITIVE_ROUNDS = (1, 2, 4, 8, 16, 32, 37), (1, 2, 4, 8, 16, 19)


def replace_first(text: Column, what: Column, by: Column) -> Column:
    at = first_place(text, what)
    sub = lambda *xs: F.call_function("substr", text, *xs)
    return F.when(at < 0, text).otherwise(F.concat(sub(F.lit(1), at), by, sub(at + F.length(what) + 1)))


def multi(keys: DataFrame, key_col: str) -> DataFrame:
    """(id, level, text, entities, cents): a template's placeholders are replaced one after another by values, which are written less plainly but at level none;
    then the text as a whole gets other cases (medium) or a typo (heavy) by chance. Entities are looked for in what comes out: those that no longer occur are left out, the others stand by
    their first place, in the order of starts. cents is the least of the values' confidences, and 50 without a value."""
    return fill(fixed(keys.select(F.col(key_col).alias("id")), template=pick(F.col("id"), "multi", MULTI), level=pick(F.col("id"), "mlevel", LEVELS)))


def fill(df: DataFrame) -> DataFrame:
    """(id, level, text, entities, cents) of (id, template, level), as multi() says; a template has three placeholders at most."""
    kinds = F.regexp_extract_all("template", F.lit(r"\{([A-Z_]+)\}"), F.lit(1))
    each = df.select(F.col("id").alias("of"), "level", F.posexplode(kinds).alias("pos", "entity_type"))
    each = fixed(each.withColumn("id", F.concat_ws(":", "of", "pos")), value=g.by_type(F.col("entity_type"), lambda t: g.value_of(t, F.col("id"))))
    noisy, plain = F.col("level") != "none", F.col("level") == "none"
    noise = g.augment(each.where(noisy)).select("of", "pos", "entity_type", F.col("augmented").alias("value"), "cents")
    values = each.where(plain).select("of", "pos", "entity_type", "value", F.lit(95).alias("cents")).unionByName(noise)
    # a key's placeholders are at most three
    values = values.groupBy(F.col("of").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "entity_type", "value", "cents"))).alias("v"))
    df = df.join(values, "id", "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<pos:int,entity_type:string,value:string,cents:int>>")))
    filled = F.aggregate("v", F.col("template"), lambda t, x: replace_first(t, F.concat(F.lit("{"), x["entity_type"], F.lit("}")), x["value"]))
    df = fixed(df, _filled=filled)
    id_, chance = F.col("id"), below(F.col("id"), "over", 100)
    text = F.when((F.col("level") == "medium") & (chance < CASE_CHANCE), g.case_noise(id_, F.col("_filled"))).when((F.col("level") == "heavy") & (chance < TYPO_CHANCE), g.typos(id_, F.col("_filled"), F.lit(1))).otherwise(F.col("_filled"))
    df = fixed(df, text=text)
    placed = F.transform("v", lambda x: F.struct(first_place(F.col("text"), x["value"]).cast("int").alias("start"), x["pos"].alias("pos"), x["entity_type"].alias("type"), x["value"].alias("value")))
    entities = F.transform(F.array_sort(F.filter(placed, lambda x: x["start"] >= 0)), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).cast("int").alias("end")))
    return df.select("id", "level", "text", entities.alias("entities"), F.coalesce(F.array_min(F.transform("v", lambda x: x["cents"])), F.lit(50)).alias("cents"))


def _slot(number: Column, slot: tuple) -> Column:
    """One of the words, or a number of at least so many digits."""
    if isinstance(slot[0], str):
        return F.element_at(F.array(*(F.lit(w) for w in slot)), (F.pmod(number, F.lit(len(slot))) + 1).cast("int"))
    least, most, digits = slot
    text = (F.pmod(number, F.lit(most - least + 1)) + least).cast("string")
    return F.lpad(text, digits, "0") if least < 10 ** (digits - 1) else text


def negatives(keys: DataFrame, key_col: str) -> DataFrame:
    """(id, attempt, source, text): a text without personal data from one of the SOURCES. It follows from the key and from the column attempt, which is 0 where there is none."""
    key, attempt = F.col("id"), F.col("attempt")
    slot = lambda name: F.concat(F.lit(name), attempt)
    drawn = keys.select(F.col(key_col).alias("id"), (F.col("attempt") if "attempt" in keys.columns else F.lit(0)).alias("attempt"))
    static = F.element_at(F.array(*(F.lit(t) for t in STATIC)), (F.pmod(u32(key, slot("static")), F.lit(len(STATIC))) + 1).cast("int"))
    drawn = fixed(drawn, _source=F.pmod(u32(key, slot("source")), F.lit(100)), _static=static, _which=F.pmod(u32(key, slot("which")), F.lit(len(DYNAMIC))), **{f"_n{j}": u32(key, slot(f"n{j}")) for j in range(3)})
    made = F.lit("")
    for k, (text, slots) in enumerate(DYNAMIC):
        pieces = text.split("{}")
        filled = [_slot(F.col(f"_n{j}"), s) for j, s in enumerate(slots)]
        made = F.when(F.col("_which") == k, F.concat(*(x for pair in zip(map(F.lit, pieces), [*filled, F.lit("")], strict=True) for x in pair))).otherwise(made)
    source = F.when(F.col("_source") < 40, "static").when(F.col("_source") < 70, "dynamic").otherwise("varied")
    drawn = fixed(drawn, source=source, _made=made)
    text = F.when(F.col("source") == "static", F.col("_static")).when(F.col("source") == "dynamic", F.col("_made")).otherwise(g.vary_negative(F.concat_ws("/", key.cast("string"), attempt.cast("string")), F.col("_static")))
    return fixed(drawn, text=text).select("id", "attempt", "source", "text", "_made")


CLAIMS = "id long, attempt int, text string, round int"


def claim(keys: DataFrame, draw: Callable[[DataFrame], DataFrame], rounds: tuple[int, ...], path: str) -> None:
    """Unique texts by rounds of draws and claims, each written once to a folder: (id, attempt, text) by round.

    In a round every key without a text draws so many, numbered on over the rounds (draw gives id, attempt and text of id and attempt). Texts that
    were taken in an earlier round are left out. Of those who draw a text, the one of the least attempt, and then of the least key, may have it,
    and a key takes the first that it may have; its others are free again. Rounds end when no key is left.
    """
    spark, first = keys.sparkSession, 0
    for k, n in enumerate(rounds):
        taken = read_checkpoint(spark, path, CLAIMS).where(F.col("round") < k)
        left = keys.select(F.col("id").cast("long").alias("id")).join(taken.select("id"), "id", "left_anti")
        tries = left.select("id", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("attempt"))
        fresh = draw(tries).select("id", "attempt", "text").join(taken.select("text"), "text", "left_anti")
        mine = fresh.groupBy("text").agg(F.min(F.struct("attempt", "id")).alias("c")).select("text", "c.attempt", "c.id")
        won = mine.groupBy("id").agg(F.min(F.struct("attempt", "text")).alias("c")).select("id", "c.attempt", "c.text", F.lit(k).alias("round"))
        append_checkpoint(won, path, ("round",))
        first += n
        if not left.join(read_checkpoint(spark, path, CLAIMS).where(F.col("round") == k).select("id"), "id", "left_anti").limit(1).count():
            return


def _with_number(tries: DataFrame) -> DataFrame:
    """Texts made of words with a number of six digits."""
    drawn = negatives(tries, "id")
    ref = F.pmod(u32(F.col("id"), F.concat(F.lit("ref"), F.col("attempt"))), F.lit(900_000)) + 100_000
    return drawn.select("id", "attempt", F.concat("_made", F.lit(" (Ref: "), ref.cast("string"), F.lit(")")).alias("text"))


def unique_negatives(keys: DataFrame, key_col: str, path: str) -> DataFrame:
    """(id, attempt, text): a negative text for each key that no other key has, by claims in `path`. Keys that a hundred draws leave without one claim texts with a number of six digits, in more rounds until each has one. Keys must be unique."""
    ids = keys.select(F.col(key_col).cast("long").alias("id"))
    draws = sum(NEGATIVE_ROUNDS)
    claim(ids, lambda tries: negatives(tries, "id"), NEGATIVE_ROUNDS, path)
    done = read_checkpoint(keys.sparkSession, path, CLAIMS)
    k = len(NEGATIVE_ROUNDS)
    while (left := ids.join(read_checkpoint(keys.sparkSession, path, CLAIMS).select("id"), "id", "left_anti")).limit(1).count():
        fresh = _with_number(left.withColumn("attempt", F.lit(draws))).join(done.select("text"), "text", "left_anti")
        won = fresh.groupBy("text").agg(F.min("id").alias("id")).select("id", F.lit(draws).alias("attempt"), "text", F.lit(k).alias("round"))
        append_checkpoint(won, path, ("round",))
        done, k, draws = read_checkpoint(keys.sparkSession, path, CLAIMS), k + 1, draws + 1
    return done.select("id", "attempt", "text")


def _positives(tries: DataFrame) -> DataFrame:
    """Samples with an entity, of (id, attempt)."""
    drawn = g.samples(tries.select(F.concat_ws(":", "id", "attempt").alias("of")), "of", g.TYPES[:-1])
    parts = F.split("id", ":")
    return drawn.select(parts[0].cast("long").alias("id"), parts[1].cast("int").alias("attempt"), "text", "entity_type", "value")


def unique_positives(keys: DataFrame, key_col: str, path: str) -> DataFrame:
    """(id, attempt, entity_type, text, value, repeated): a text with an entity for each key, by claims in `path`. Keys that fifty draws leave without a text of their own keep the last one, though others have it (repeated)."""
    ids = keys.select(F.col(key_col).cast("long").alias("id"))
    claim(ids, _positives, POSITIVE_ROUNDS, path)
    won = read_checkpoint(keys.sparkSession, path, CLAIMS).select("id", "attempt", F.lit(False).alias("repeated"))
    last = ids.join(won.select("id"), "id", "left_anti").select("id", F.lit(sum(POSITIVE_ROUNDS) - 1).alias("attempt"), F.lit(True).alias("repeated"))
    chosen = won.unionByName(last)
    texts = _positives(chosen.select("id", "attempt"))
    return texts.join(chosen, ["id", "attempt"]).select("id", "attempt", "entity_type", "text", "value", "repeated")


def balanced(keys: DataFrame, key_col: str) -> DataFrame:
    """(id, flagged, text): exactly half of the keys, rounded down, with an entity each, the others with negatives."""
    halves = exact_split(keys.select(F.col(key_col).alias("id")), "id", 50)
    with_one = g.samples(halves.where("split = 'train'"), "id", g.TYPES[:-1]).select("id", F.lit(True).alias("flagged"), "text")
    return with_one.unionByName(negatives(halves.where("split = 'eval'"), "id").select("id", F.lit(False).alias("flagged"), "text"))

