"""Labelled texts from keys: values of each type, templates around them, near misses, and noise. Everything follows from md5 draws, so it is the same at any parallelism and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.rng import below, digits, letter, pick, u32, weighted
from textward.functions.rows import fixed
from textward.functions.spans import first_place
from textward.operators.detect import bind

NAMES = ["amit", "priya", "john", "sara", "li", "maria", "omar", "nina"]
DOMAINS = ["example.com", "mail.example.org", "post.example.net"]
FIRST = ["Amit", "Priya", "John", "Sara", "Omar", "Nina", "Maria", "David"]
LAST = ["Sharma", "Patel", "Smith", "Brown", "Khan", "Garcia", "Rossi", "Meyer"]
TYPES = ["IN_AADHAAR", "IN_PAN", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "PERSON", "NONE"]
TEMPLATES = {
    "IN_AADHAAR": ["My aadhaar number is {V} for the form", "UID on record: {V}", "Number {V} was entered at the desk"],
    "IN_PAN": ["PAN {V} is on the return", "permanent account {V} was checked", "Code {V} was entered"],
    "EMAIL_ADDRESS": ["Write to {V} today", "The address is {V}, please answer", "Mail {V}"],
    "PHONE_NUMBER": ["Call me at {V} after six", "My mobile: {V}", "Number {V} is busy"],
    "US_SSN": ["SSN {V} is required", "social security {V} on file", "Reference {V} was typed"],
    "CREDIT_CARD": ["Credit card {V} was declined", "Pay with visa {V} now", "The digits {V} were read out"],
    "PERSON": ["Please contact {V} about this", "The customer {V} has asked", "We met {V} there"],
    "NONE": ["The meeting is at noon", "Your parcel has left the depot", "Version two is ready"],
}
NEAR_MISSES = [("order_id", 20), ("product_code", 15), ("phone_like", 15), ("email_like", 10), ("ssn_like", 10), ("date_like", 10), ("ip", 10), ("alphanumeric", 10)]
#: Share of each stratum, in hundredths; the rest of rounding goes to the first.
STRATA = {"easy": 25, "medium": 25, "hard": 15, "adversarial": 10, "negative": 10, "dangerous": 15}


def value_of(kind: str, key: Column) -> Column:
    d, b = (lambda slot, n: digits(key, slot, n)), (lambda slot, n: below(key, slot, n))
    text = lambda c: c.cast("string")
    if kind == "IN_AADHAAR":
        return F.concat(text(b("a0", 8) + 2), d("a1", 3), F.lit(" "), d("a2", 4), F.lit(" "), d("a3", 4))
    if kind == "IN_PAN":
        return F.concat(letter(key, "p0"), letter(key, "p1"), letter(key, "p2"), letter(key, "p3", "PCHFATBLJG"), letter(key, "p4"), d("p5", 4), letter(key, "p6"))
    if kind == "EMAIL_ADDRESS":
        return F.concat(pick(key, "e0", NAMES), text(b("e1", 99) + 1), F.lit("@"), pick(key, "e2", DOMAINS))
    if kind == "PHONE_NUMBER":
        return F.concat(F.lit("+91 "), text(b("h0", 4) + 6), d("h1", 4), F.lit(" "), d("h2", 5))
    if kind == "US_SSN":
        area = b("s0", 799) + 100
        return F.concat(text(F.when(area >= 666, area + 1).otherwise(area)), F.lit("-"), F.lpad(text(b("s1", 99) + 1), 2, "0"), F.lit("-"), F.lpad(text(b("s2", 9999) + 1), 4, "0"))
    if kind == "CREDIT_CARD":
        return F.concat(text(b("c0", 2) + 4), d("c1", 3), F.lit(" "), d("c2", 4), F.lit(" "), d("c3", 4), F.lit(" "), d("c4", 4))
    if kind == "PERSON":
        return F.concat(pick(key, "n0", FIRST), F.lit(" "), pick(key, "n1", LAST))
    return F.lit("")


def by_type(kind: Column, of) -> Column:
    out = F.lit("")
    for t in TYPES:
        out = F.when(kind == t, of(t)).otherwise(out)
    return out


def samples(keys: DataFrame, key_col: str, types: list[str] = TYPES) -> DataFrame:
    """(id, entity_type, text, value, start, end, flagged) for each key. Numbers are also written without spaces or with hyphens."""
    id_, kind = F.col("id"), F.col("entity_type")
    df = fixed(keys.select(F.col(key_col).alias("id")), entity_type=pick(id_, "type", types))
    df = fixed(df, _v=by_type(kind, lambda t: value_of(t, id_)), _t=by_type(kind, lambda t: pick(id_, "template", TEMPLATES[t])), _way=below(id_, "format", 3))
    spaced, way = kind.isin("IN_AADHAAR", "PHONE_NUMBER", "CREDIT_CARD"), F.col("_way")
    written = F.when(spaced & (way == 1), F.replace("_v", F.lit(" "), F.lit(""))).when(spaced & (way == 2), F.replace("_v", F.lit(" "), F.lit("-"))).otherwise(F.col("_v"))
    df = fixed(fixed(df, value=written), text=F.replace("_t", F.lit("{V}"), F.col("value")))
    flagged = kind != "NONE"
    start = F.when(flagged, first_place(F.col("text"), F.col("value")))
    return df.select("id", "entity_type", "text", "value", start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"), flagged.alias("flagged"))


def near_misses(keys: DataFrame, key_col: str) -> DataFrame:
    """(id, kind, text): for each key something that only looks like an identifier."""
    key = F.col("id")
    d, b = (lambda slot, n: digits(key, slot, n)), (lambda slot, n: below(key, slot, n).cast("string"))
    texts = {
        "order_id": F.concat(F.lit("Order ID: "), d("m1", 4), F.lit(" "), d("m2", 4), F.lit(" "), d("m3", 4)),
        "product_code": F.concat(F.lit("Product code "), letter(key, "m4"), letter(key, "m5"), letter(key, "m6"), d("m7", 4), letter(key, "m8")),
        "phone_like": F.concat(F.lit("Ticket #"), d("m1", 5), d("m2", 5)),
        "email_like": F.lit("Write name at domain dot com in the field"),
        "ssn_like": F.concat(F.lit("Part no. "), d("m1", 3), F.lit("-"), d("m2", 2), F.lit("-"), d("m3", 4)),
        "date_like": F.concat(F.lit("Due "), F.lpad((below(key, "m1", 28) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((below(key, "m2", 12) + 1).cast("string"), 2, "0"), F.lit("-2024")),
        "ip": F.concat(F.lit("Server "), b("m1", 256), F.lit("."), b("m2", 256), F.lit("."), b("m3", 256), F.lit("."), b("m4", 256)),
        "alphanumeric": F.concat(F.lit("Serial "), F.upper(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8))),
    }
    text = F.lit("")
    for k, x in texts.items():
        text = F.when(F.col("kind") == k, x).otherwise(text)
    df = fixed(keys.select(F.col(key_col).alias("id")), kind=weighted(key, "miss", NEAR_MISSES))
    return fixed(df, text=text)


#: What may stand before a negative text, and in brackets after it; fixed values.
PREFIXES = ["", "Note: ", "FYI: ", "Update: ", "Info: ", "Status: ", "Message: ", "Alert: ", "Notice: ", "Reminder: "]
TAGS = ["v1", "v2", "final", "draft", "updated"]


def vary_negative(key: Column, text: Column) -> Column:
    """One of the prefixes, and for 30 in 100 texts a reference at the end, for 20 in 100 of the others a tag."""
    reference = F.concat(F.lit(" (Ref: "), (below(key, "v3", 9000) + 1000).cast("string"), F.lit(")"))
    tag = F.concat(F.lit(" ["), pick(key, "v5", TAGS), F.lit("]"))
    after = F.when(below(key, "v2", 100) < 30, reference).when(below(key, "v4", 100) < 20, tag).otherwise(F.lit(""))
    return F.concat(pick(key, "v1", PREFIXES), text, after)


#: (type, name, weight in hundredths, noise level, confidence in hundredths); fixed values.
AUGMENTATIONS = [
    ("IN_AADHAAR", "clean", 15, 0, 95), ("IN_AADHAAR", "no_spaces", 10, 1, 90), ("IN_AADHAAR", "dashed", 10, 1, 90), ("IN_AADHAAR", "mixed_separators", 10, 2, 80), ("IN_AADHAAR", "ocr_corrupted", 10, 2, 70),
    ("IN_AADHAAR", "typo", 10, 2, 65), ("IN_AADHAAR", "partial_masked", 10, 3, 60), ("IN_AADHAAR", "written_out", 5, 4, 50), ("IN_AADHAAR", "spaced_out", 10, 4, 55), ("IN_AADHAAR", "truncated", 10, 3, 45),
    ("IN_PAN", "clean", 20, 0, 95), ("IN_PAN", "lowercase", 15, 1, 90), ("IN_PAN", "mixed_case", 15, 2, 80), ("IN_PAN", "ocr_corrupted", 15, 2, 65), ("IN_PAN", "spaced", 10, 1, 85), ("IN_PAN", "partial_masked", 15, 3, 55), ("IN_PAN", "typo", 10, 2, 60),
    ("EMAIL_ADDRESS", "clean", 20, 0, 95), ("EMAIL_ADDRESS", "uppercase", 10, 1, 90), ("EMAIL_ADDRESS", "spaced_at", 10, 2, 75), ("EMAIL_ADDRESS", "at_written", 15, 4, 60), ("EMAIL_ADDRESS", "dot_written", 10, 4, 55),
    ("EMAIL_ADDRESS", "obfuscated", 10, 4, 50), ("EMAIL_ADDRESS", "typo", 15, 2, 70), ("EMAIL_ADDRESS", "partial_masked", 10, 3, 50),
    ("PHONE_NUMBER", "clean_indian", 15, 0, 95), ("PHONE_NUMBER", "no_country_code", 15, 1, 85), ("PHONE_NUMBER", "dashed", 15, 1, 90), ("PHONE_NUMBER", "parentheses", 10, 1, 85), ("PHONE_NUMBER", "spaced_out", 10, 4, 55),
    ("PHONE_NUMBER", "partial_masked", 15, 3, 55), ("PHONE_NUMBER", "ocr_corrupted", 20, 2, 65),
]
#: Separators, digits as words, and how a number may be masked; fixed values.
SEPARATORS = [" ", "-", ".", "/"]
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def _ways(key: Column, value: Column, d: Column, ten: Column, misread_: Column, mistyped: Column) -> dict[tuple[str, str], Column]:
    """Ways to write a value less plainly, other than as it is; what a way leaves open is drawn by the key. d and ten are the value's digits and the last ten of them; misread_ and mistyped are made of what augment() says."""
    part = lambda x, a, n: F.call_function("substr", x, F.lit(a), F.lit(n))
    groups = lambda x: F.concat_ws(" ", part(x, 1, 4), part(x, 5, 4), part(x, 9, 4))
    spread = lambda x: F.array_join(F.split(x, ""), " ")
    one_of = lambda slot, *xs: F.element_at(F.array(*xs), (below(key, slot, len(xs)) + 1).cast("int"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    written = F.transform(F.split(d, ""), lambda c, i: F.when(_chance(key, "y", i, 30), F.element_at(F.array(*(F.lit(w) for w in DIGIT_WORDS)), c.cast("int") + 1)).otherwise(c))
    return {
        ("IN_AADHAAR", "clean"): groups(d),
        ("IN_AADHAAR", "no_spaces"): d,
        ("IN_AADHAAR", "dashed"): F.concat_ws("-", part(d, 1, 4), part(d, 5, 4), part(d, 9, 4)),
        ("IN_AADHAAR", "mixed_separators"): F.concat(part(d, 1, 4), pick(key, "x1", SEPARATORS), part(d, 5, 4), pick(key, "x2", SEPARATORS), part(d, 9, 4)),
        ("IN_AADHAAR", "ocr_corrupted"): groups(misread_),
        ("IN_AADHAAR", "typo"): F.when(F.length(mistyped) >= 12, groups(mistyped)).otherwise(mistyped),
        ("IN_AADHAAR", "partial_masked"): one_of("x3", F.concat(F.lit("XXXX XXXX "), part(d, 9, 4)), F.concat(F.lit("****-****-"), part(d, 9, 4)), F.concat(part(d, 1, 4), F.lit("-XXXX-"), part(d, 9, 4))),
        ("IN_AADHAAR", "written_out"): F.array_join(written, " "),
        ("IN_AADHAAR", "spaced_out"): spread(d),
        ("IN_AADHAAR", "truncated"): part(d, 1, 8),
        ("IN_PAN", "lowercase"): F.lower(value),
        ("IN_PAN", "mixed_case"): mixed_case(key, value),
        ("IN_PAN", "ocr_corrupted"): misread_,
        ("IN_PAN", "spaced"): F.concat_ws(" ", part(value, 1, 5), part(value, 6, 4), part(value, 10, 1)),
        ("IN_PAN", "partial_masked"): one_of("x3", F.concat(part(value, 1, 5), F.lit("XXXX"), part(value, 10, 1)), F.concat(part(value, 1, 3), F.lit("****"), part(value, 8, 3)), F.concat(F.lit("XXXXX"), part(value, 6, 5))),
        ("IN_PAN", "typo"): F.upper(mistyped),
        ("EMAIL_ADDRESS", "uppercase"): F.upper(value),
        ("EMAIL_ADDRESS", "spaced_at"): F.replace(value, F.lit("@"), F.lit(" @ ")),
        ("EMAIL_ADDRESS", "at_written"): F.replace(value, F.lit("@"), F.lit(" at ")),
        ("EMAIL_ADDRESS", "dot_written"): F.replace(value, F.lit("."), F.lit(" dot ")),
        ("EMAIL_ADDRESS", "obfuscated"): F.replace(F.replace(value, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] ")),
        ("EMAIL_ADDRESS", "typo"): F.concat(mistyped, F.lit("@"), domain),
        ("EMAIL_ADDRESS", "partial_masked"): F.concat(F.when(F.length(local) > 2, F.concat(part(local, 1, 1), F.lit("***"), F.substring(local, -1, 1))).otherwise(F.lit("***")), F.lit("@"), domain),
        ("PHONE_NUMBER", "clean_indian"): F.concat(F.lit("+91 "), part(ten, 1, 5), F.lit(" "), part(ten, 6, 5)),
        ("PHONE_NUMBER", "no_country_code"): ten,
        ("PHONE_NUMBER", "dashed"): F.concat_ws("-", part(ten, 1, 3), part(ten, 4, 3), part(ten, 7, 4)),
        ("PHONE_NUMBER", "parentheses"): F.concat(F.lit("("), part(ten, 1, 3), F.lit(") "), part(ten, 4, 3), F.lit("-"), part(ten, 7, 4)),
        ("PHONE_NUMBER", "spaced_out"): spread(ten),
        ("PHONE_NUMBER", "partial_masked"): F.concat(F.lit("XXXXXX"), part(ten, 7, 4)),
        ("PHONE_NUMBER", "ocr_corrupted"): misread_,
    }


def augment(df: DataFrame) -> DataFrame:
    """df of samples with augmentation, augmented, noise_level and cents: one way by weight for each row; other types pass through."""
    id_, kind = F.col("id"), F.col("entity_type")
    name = F.lit("passthrough")
    for t in dict.fromkeys(a[0] for a in AUGMENTATIONS):
        name = F.when(kind == t, weighted(id_, "augment", [(a[1], a[2]) for a in AUGMENTATIONS if a[0] == t])).otherwise(name)
    digits_of = F.regexp_replace("value", r"\D", "")
    df = fixed(df, augmentation=name, _d=digits_of, _ten=F.substring(digits_of, -10, 10))
    way, value = F.col("augmentation"), F.col("value")
    base = F.when(kind == "IN_AADHAAR", F.col("_d")).when(kind == "IN_PAN", F.upper(value)).when((kind == "EMAIL_ADDRESS") & (way == "typo"), F.substring_index(value, "@", 1)).otherwise(value)
    df = fixed(df, _misread=F.when(way == "ocr_corrupted", misread(id_, base, F.when(kind == "IN_PAN", 20).otherwise(15))), _mistyped=F.when(way == "typo", typos(id_, base, F.lit(1))))
    table = F.create_map(*(x for t, n, _, lv, c in AUGMENTATIONS for x in (F.lit(f"{t} {n}"), F.struct(F.lit(lv).alias("level"), F.lit(c).alias("cents")))))
    out = F.when(F.lit(False), value)
    for (t, n), x in _ways(id_, value, F.col("_d"), F.col("_ten"), F.col("_misread"), F.col("_mistyped")).items():
        out = out.when((kind == t) & (way == n), x)
    df = fixed(df, augmented=out.otherwise(value), _known=table[F.concat_ws(" ", kind, way)])
    known = df.withColumns({"noise_level": F.coalesce("_known.level", F.lit(0)), "cents": F.coalesce("_known.cents", F.lit(95))})
    return known.drop("_d", "_ten", "_misread", "_mistyped", "_known")


#: What scanners misread, and the keys beside a key; fixed values.
CONFUSED = {
    "0": "OoQD", "1": "Iil|L", "2": "Zz", "3": "EB", "4": "AH", "5": "Ss$", "6": "Gb", "7": "TY/", "8": "B&", "9": "gqP", "O": "0", "o": "0", "I": "1l|", "i": "1l", "l": "1I|", "L": "1", "S": "5$", "s": "5", "B": "83", "G": "6", "Z": "2", "z": "2",
    "a": "@α", "A": "4@", "e": "3є", "E": "3", "t": "+7", "T": "7+",
}
KEYS_NEAR = {
    "q": "wa12", "w": "qesa23", "e": "wrds34", "r": "etfd45", "t": "rygf56", "y": "tuhg67", "u": "yijh78", "i": "uokj89", "o": "iplk90", "p": "ol0", "a": "qwsz", "s": "awedzx", "d": "serfxc", "f": "drtgcv", "g": "ftyhvb", "h": "gyujbn", "j": "huiknm",
    "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk", "1": "2q", "2": "13qw", "3": "24we", "4": "35er", "5": "46rt", "6": "57ty", "7": "68yu", "8": "79ui", "9": "80io", "0": "9op",
}


def _chance(key: Column, slot: str, i: Column, percent: int | Column) -> Column:
    return F.pmod(u32(key, F.concat(F.lit(slot), i.cast("string"))), F.lit(100)) < percent


def misread(key: Column, value: Column, percent: int | Column) -> Column:
    """Characters with look-alikes become one of them, each with so many chances in 100."""
    table = F.create_map(*(x for k, v in CONFUSED.items() for x in (F.lit(k), F.lit(v))))

    def one(c: Column, i: Column) -> Column:
        others = table[c]
        chosen = F.call_function("substr", others, (F.pmod(u32(key, F.concat(F.lit("w"), i.cast("string"))), F.length(others)) + 1).cast("int"), F.lit(1))
        return F.when(others.isNotNull() & _chance(key, "o", i, percent), chosen).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def mixed_case(key: Column, value: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.pmod(u32(key, F.concat(F.lit("k"), i.cast("string"))), F.lit(2)) == 0, F.upper(c)).otherwise(F.lower(c))), "")


def case_noise(key: Column, value: Column) -> Column:
    """Upper case, lower case, letter by letter, or unchanged, by the key."""
    way = below(key, "case", 4)
    return F.when(way == 0, F.upper(value)).when(way == 1, F.lower(value)).when(way == 2, mixed_case(key, value)).otherwise(value)


def typos(key: Column, value: Column, edits: Column) -> Column:
    """So many edits, one after another, each at a drawn place: swap with the next character, drop, insert (the character before again, or a key beside), replace by a key beside, or double. Values of fewer than two characters stay."""
    near = F.create_map(*(x for k, v in KEYS_NEAR.items() for x in (F.lit(k), F.lit(v))))

    def edit(v: Column, k: Column) -> Column:
        draw = lambda name: u32(key, F.concat(F.lit(name), k.cast("string")))
        sub = lambda a, n=None: F.call_function("substr", v, a, *([] if n is None else [F.lit(n)]))

        def at(p: Column) -> Column:
            one, beside = sub(p, 1), near[F.lower(sub(p, 1))]
            key_beside = F.call_function("substr", beside, (F.pmod(draw("tk"), F.length(beside)) + 1).cast("int"), F.lit(1))
            left, right = F.call_function("substr", v, F.lit(1), p - 1), sub(p + 1)
            inserted = F.when((F.pmod(draw("ti"), F.lit(2)) == 0) & (p > 1), sub(p - 1, 1)).otherwise(F.coalesce(key_beside, F.lit("")))
            cases = [F.concat(left, sub(p + 1, 1), one, sub(p + 2)), F.concat(left, right), F.concat(left, inserted, one, right), F.concat(left, F.coalesce(key_beside, one), right), F.concat(left, one, one, right)]
            return F.element_at(F.array(*cases), (F.pmod(draw("tw"), F.lit(5)) + 1).cast("int"))

        return F.when(F.length(v) < 2, v).otherwise(bind((F.pmod(draw("ta"), F.length(v)) + 1).cast("int"), at))

    return F.aggregate(F.sequence(F.lit(1), edits), value, edit)


#: What may stand in a separator's place; fixed values.
SEPARATOR_NOISE = [" ", "-", ".", "/", "_", "  ", " - ", ""]


def separator_noise(key: Column, value: Column, separator: str = " ") -> Column:
    """All separators of a value become one other, by the key."""
    return F.replace(value, F.lit(separator), pick(key, "sep", SEPARATOR_NOISE))


def edits_by_share(value: Column, percent: int) -> Column:
    """How many typos a text gets: so many hundredths of its length, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(value) * percent / 100).cast("int"))


def conversation(df: DataFrame, prefix: str = "Analyze for PII") -> DataFrame:
    """df of samples with conversations: system, user and assistant, the last with the label as JSON text."""
    entity = F.struct(F.col("entity_type").alias("type"), "value", "start", "end")
    label = F.to_json(F.struct("flagged", F.when(F.col("flagged"), F.array(entity)).otherwise(F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")).alias("entities")))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.withColumn("conversations", F.array(turn("system", F.lit("You find personal data.")), turn("user", F.concat(F.lit(f'{prefix}: "'), F.col("text"), F.lit('"'))), turn("assistant", label)))


def override_prompt(df: DataFrame, prompt: str) -> DataFrame:
    """The first message with another content."""
    return df.withColumn("conversations", F.transform("conversations", lambda m, i: F.when(i == 0, m.withField("content", F.lit(prompt))).otherwise(m)))


def quotas(total: int) -> dict[str, int]:
    """Samples of each stratum; what rounding leaves goes to the first."""
    out = {k: total * share // 100 for k, share in STRATA.items()}
    first = next(iter(out))
    return out | {first: out[first] + total - sum(out.values())}
