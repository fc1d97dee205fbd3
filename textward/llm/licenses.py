"""License scans: a paragraph classifier over word n-grams, trained here, with templates to confirm it.

Training. Each family has short statements (TEMPLATES) and names (NAMES); their variants (parts, other words around, names in FRAMES)
are one side. The other, the class unknown, are statements and names of licences that are none of the families in the
same frames, sentences that only sound like licences, and all paragraphs of about `sample_rows` whole documents that share an n-gram with any of these
but that no template confirms. Features are the presence of word pairs and triples of the templates and of the unlisted
statements; a multinomial logistic regression of pyspark.ml is fitted on two thirds of the rows. On the last third its scores are
divided by the temperature of least log loss, which calibrates all classes, the unknown one too. A paragraph has the class of largest probability, and is unknown below
`threshold`.

Scoring. A paragraph goes up to a blank line. The text's words, in lower case with single spaces, are searched for any of the
pairs first; then the n-grams of each paragraph meet their weights, a literal of a few hundred entries, within the row: a scan shuffles nothing. Lines that a template
confirms by themselves are reported each, so that two licences in one paragraph are two; a paragraph without any such line is taken whole,
so that a licence may be wrapped over lines. A family is confirmed if the words hold at least half of the n-grams of one of its
templates, and one of those that name the family, if the template has any. DataFrame functions and pyspark.ml alone.

Defined results: a null or empty text has no paragraphs and no families; blank lines alone are no paragraph; repeated rows repeat; a paragraph that the
classifier names and no template confirms is counted as unconfirmed; of equal probabilities the first family by name is taken; an empty table gives no rows, and a model
that is learned from the templates alone; other columns don't matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.rows import fixed
from textward.llm._shared import cut

#: Short statements of the families; fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("licensed under the apache license version 2 0", "distributed under the terms of the apache license version 2 0", "spdx license identifier apache 2 0", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause", "bsd license"),
    "cc": ("licensed under cc by nc 4 0", "licensed under cc by 4 0", "licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution license", "creative commons attribution 4 0 international license"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it under the terms of the gnu general public license", "spdx license identifier gpl 3 0", "licensed under gpl v3", "gpl 3 0 or later", "gnu general public license"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy", "spdx license identifier mit", "mit license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license version 2 0", "licensed under the mozilla public license", "spdx license identifier mpl 2 0", "mozilla public license"),
    "proprietary": ("all rights reserved unauthorized copying of this file is strictly prohibited", "this software is proprietary and confidential", "all rights reserved"),
}
#: Names of the families, and of licences that are none of them, for FRAMES.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("apache license version 2 0", "apache license", "apache 2 0 license"),
    "bsd": ("bsd 3 clause license", "bsd license", "bsd 2 clause license"),
    "cc": ("creative commons attribution license", "cc by 4 0 license", "cc by sa 4 0 license", "cc by nc 4 0 license"),
    "gpl": ("gnu general public license version 3", "gnu general public license", "gpl v3", "gnu gpl version 2"),
    "mit": ("mit license", "mit license terms"),
    "mpl": ("mozilla public license version 2 0", "mozilla public license", "mpl 2 0 license"),
}
UNLISTED_NAMES = (
    "affero general public license version 3", "gnu affero general public license", "gnu lesser general public license version 3", "lesser general public license", "eclipse public license version 2 0", "isc license", "zlib license",
    "boost software license version 1 0", "unlicense", "european union public license", "open font license version 1 1", "artistic license 2 0", "foo license", "academic free license version 3 0", "microsoft public license", "common development and distribution license version 1 0",
)
FRAMES = ("licensed under the {}", "released under the {}", "this software is licensed under the {}", "this work is licensed under the {}", "distributed under the terms of the {}", "this file is subject to the terms of the {}", "the {}", "you can redistribute it under the {}", "copying is permitted by the {}")
#: Statements of licences that are none of the families, and sentences that are no licences.
UNLISTED = ("spdx license identifier isc", "spdx license identifier zlib", "spdx license identifier agpl 3 0", "spdx license identifier epl 2 0", "spdx license identifier unlicense", "spdx license identifier")
NEAR_MISSES = (
    "a driving license must be renewed under the new rules", "the license of the restaurant was withdrawn last year", "terms of the general agreement were published",
    "the public library is open to any person", "version 2 0 of the report was released", "this work is free of charge to the public", "the source of the river is not known",
    "permission to build was granted by the city", "the copy of the letter is subject to change", "the apache helicopter was distributed to the forces", "mit students released the general version",
    "creative people are permitted to use the source", "use of the file is described in the terms", "the gnu lives in the open under the sun", "this software is used in the file and by the public", "this program is free and open to any person",
    "all rights of the city are reserved", "licensed under", "licensed under x", "released under the", "the general public", "the rights reserved to the public were published",
)
#: Words that name a family.
NAMED = frozenset("apache bsd cc creative commons gnu gpl mit mozilla mpl proprietary reserved".split())
#: Pairs of words that say nothing.
COMMON = frozenset(("of the", "to any", "is the", "and use", "in source", "use in", "with or", "you can", "work is", "this work", "subject to", "is subject", "it under", "a copy", "of this", "under a", "is a", "by the", "under the", "to the", "is not", "in the"))
UNKNOWN = "unknown"
TEMPERATURES = tuple(0.25 * 1.25**k for k in range(14))


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """The words of a text in lower case, with one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[^a-z0-9]+", " ")


def grams(statement: str) -> list[str]:
    """The pairs and triples of a statement's consecutive words, with spaces around, but for those that say nothing."""
    w = statement.split()
    return [f" {g} " for k in (2, 3) for i in range(len(w) - k + 1) if (g := " ".join(w[i : i + k])) not in COMMON]


def vocabulary() -> list[str]:
    return sorted({g for t in (*(t for ts in (*TEMPLATES.values(), *NAMES.values()) for t in ts), *UNLISTED, *UNLISTED_NAMES) for g in grams(t)})


def _constant(value, kind: str) -> Column:
    """A value as one literal of a type, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _strings(xs: list[str]) -> Column:
    return _constant(list(xs), "array<string>")


def found(low: Column, vocab: list[str]) -> Column:
    """The n-grams of the vocabulary in words()."""
    return F.filter(_strings(vocab), lambda g: low.contains(g))


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    threshold: float
    #: mean distance of probability and truth in ten classes of probability, on the rows that the temperature is set on
    calibration_error: float


def training_rows(docs: DataFrame, sample_rows: int, vocab: list[str]) -> DataFrame:
    """(family, part, grams); part 2 is for the temperature."""
    spark = docs.sparkSession
    around = ("", "the project is", "note", "copyright 2020 the authors", "files in this folder are", "see the file")
    shown = []
    for family, statements in [*TEMPLATES.items(), (UNKNOWN, (*UNLISTED, *NEAR_MISSES))]:
        for k, t in enumerate(statements):
            w = t.split()
            # up to three words fewer at the end of a longer one, and other words before and after
            shown += [(family, " ".join((around[v // 4 % 6], *w[: max(3, len(w) - v % 4)], around[(v * 5 + k) % 6]))) for v in range(24)]
    for family, names in [*NAMES.items(), (UNKNOWN, UNLISTED_NAMES)]:
        shown += [(family, " ".join((around[k % 6], frame.format(name), around[(k + n) % 6]))) for n, name in enumerate(names) for k, frame in enumerate(FRAMES)]
    part = F.pmod(F.xxhash64("text"), F.lit(3)).alias("part")
    own = spark.createDataFrame(shown, "family string, text string").distinct().select("family", part, _bind(words(F.col("text")), lambda low: found(low, vocab)).alias("grams"))
    total = max(docs.count(), 1)
    sampled = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("licence")), F.lit(1_000_000)) < int(min(1.0, sample_rows / total) * 1_000_000))
    theirs = sampled.select("doc_id", F.explode(_paragraphs(F.col("text").cast("string"))).alias("text"))
    theirs = fixed(theirs, grams=_bind(words(F.col("text")), lambda low: found(low, vocab))).where(F.size("grams") > 0).select("doc_id", part, "grams")
    return own.unionByName(theirs.where(~_confirmed(F.col("grams"))).dropDuplicates(["doc_id", "grams"]).select(F.lit(UNKNOWN).alias("family"), "part", "grams"))


def learn(docs: DataFrame, sample_rows: int = 2_000, threshold: float = 0.5) -> Model:
    """Fit the classifier. The driver gets its weights and sums over the bounded training rows."""
    vocab, families = vocabulary(), [UNKNOWN, *sorted(TEMPLATES)]
    rows = training_rows(docs.select("doc_id", "text"), sample_rows, vocab)
    rows = rows.withColumn("label", F.array_position(_strings(families), F.col("family")).cast("double") - 1)
    # some thousand short rows: a few tasks a step
    rows = cut(rows.coalesce(2), "licence-rows")
    rows = CountVectorizerModel.from_vocabulary(vocab, inputCol="grams", outputCol="features", minTF=1.0, binary=True).transform(rows)
    fitted = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.0).fit(rows.where("part < 2"))
    held = fitted.transform(rows.where("part = 2")).select(vector_to_array("rawPrediction").alias("z"), F.col("label").cast("int").alias("y"))
    loss = lambda t: F.avg(-F.log(_softmax(F.transform("z", lambda x: x / t))[F.col("y")] + 1e-12))
    losses = held.agg(*(loss(t).alias(str(k)) for k, t in enumerate(TEMPERATURES))).first()
    t = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: losses[k])] if losses[0] is not None else 1.0
    p = held.select("y", _softmax(F.transform("z", lambda x: x / t)).alias("p")).select("y", F.array_max("p").alias("top"), (F.col("p")[F.col("y")] == F.array_max("p")).cast("int").alias("right"))
    bins = p.groupBy(F.floor(F.col("top") * 10)).agg(F.count("*").alias("n"), F.abs(F.avg("top") - F.avg("right")).alias("gap"))
    error = bins.agg(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).first()[0]
    coefficients = fitted.coefficientMatrix.toArray() / t
    return Model(families, {g: [float(x) for x in coefficients[:, k]] for k, g in enumerate(vocab)}, [float(x) / t for x in fitted.interceptVector], threshold, float(error or 0.0))


def _softmax(z: Column) -> Column:
    e = lambda zs: F.transform(zs, lambda x: F.exp(x - F.array_max(zs)))
    return _bind(z, lambda zs: _bind(e(zs), lambda es: F.transform(es, lambda x: x / F.aggregate(es, F.lit(0.0), lambda a, b: a + b))))


def _confirmed(held: Column, family: Column | None = None) -> Column:
    """Whether the n-grams held are at least half of those of one of the (family's) templates, and one of them names the family, if any of the template's does."""
    each = [(f, g, [x for x in g if not NAMED.isdisjoint(x.split())]) for f, ts in TEMPLATES.items() for g in map(grams, ts)]
    known = _constant([{"family": f, "all": g, "naming": naming} for f, g, naming in each], "array<struct<family:string,all:array<string>,naming:array<string>>>")
    close = lambda t: (F.size(F.array_intersect(t["all"], held)) * 2 >= F.size(t["all"])) & ((F.size(t["naming"]) == 0) | F.arrays_overlap(t["naming"], held))
    return F.exists(known, close if family is None else lambda t: (t["family"] == family) & close(t))


def _paragraphs(text: Column) -> Column:
    """Texts up to blank lines; blank ones are none."""
    return F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")


_FOUND = "array<struct<paragraph:int,family:string,probability:double,confirmed:boolean,text:string>>"


def scan(text: Column, model: Model) -> Column:
    """An array of (paragraph, family, probability, confirmed, text), one for each line or paragraph that is not unknown."""
    vocab = _constant([{"g": g, "w": w} for g, w in model.weights.items()], "array<struct<g:string,w:array<double>>>")
    # an n-gram that holds another one needs no search of its own
    short = _strings([g[1:-1] for g in model.weights if not any(o != g and o[1:-1] in g for o in model.weights)])
    families, intercepts = _strings(model.families), _constant(model.intercepts, "array<double>")
    any_of = lambda low: F.exists(short, lambda g: low.contains(g))

    def judged(m: Column, t: Column, i: Column) -> Column:
        """From the n-grams held with their weights."""
        z = F.aggregate(m, intercepts, lambda acc, g: F.zip_with(acc, g["w"], lambda a, b: a + b))
        best = lambda p: F.array_position(p, F.array_max(p)).cast("int")
        named = lambda p: F.struct(i.alias("paragraph"), F.element_at(families, best(p)).alias("family"), F.array_max(p).alias("probability"))
        full = lambda x: F.struct(x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), _confirmed(m["g"], x["family"]).alias("confirmed"), t.alias("text"))
        return _bind(_bind(_softmax(z), named), full)

    one = lambda t, i: _bind(_bind(words(t), lambda low: F.filter(vocab, lambda g: low.contains(g["g"]))), lambda m: judged(m, t, i))
    good = lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= model.threshold)
    of_lines = lambda t, i: F.filter(F.transform(F.filter(F.split(t, "\n"), lambda x: _bind(words(x), any_of)), lambda x: one(x, i)), lambda x: good(x) & x["confirmed"])
    both = lambda t, i: _bind(of_lines(t, i), lambda lines: F.when(F.size(lines) > 0, lines).otherwise(F.filter(F.array(one(t, i)), good)))
    numbered = F.filter(F.transform(_paragraphs(text), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: _bind(words(x["t"]), any_of))
    # texts without any pair are told apart first
    return F.when(_bind(words(text), any_of), F.flatten(F.transform(numbered, lambda x: both(x["t"], x["i"])))).otherwise(F.array().cast(_FOUND))


def per_document(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, n_paragraphs, families, n_licences, n_unconfirmed, least_probability) per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = docs.select("doc_id", F.size(_paragraphs(text)).cast("long").alias("n_paragraphs"), scan(text, model).alias("found"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return hits.select(
        "doc_id", "n_paragraphs", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_licences"), (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"), F.array_min(F.transform("found", lambda x: x["probability"])).alias("least_probability"),
    )
