import re

import pytest
from pyspark.sql import functions as F

from textward.operators import generate as g
from textward.operators import sampling

FORMS = {
    "IN_AADHAAR": r"[2-9]\d{3} \d{4} \d{4}", "IN_PAN": r"[A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z]", "EMAIL_ADDRESS": r"[a-z]+\d{1,2}@[a-z.]+", "PHONE_NUMBER": r"\+91 [6-9]\d{4} \d{5}",
    "US_SSN": r"(?!666)[1-8]\d\d-\d\d-\d{4}", "CREDIT_CARD": r"[45]\d{3}( \d{4}){3}", "PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+",
}


@pytest.mark.parametrize("kind", FORMS)
def test_values_have_their_form(spark, kind):
    for r in spark.range(300).select(g.value_of(kind, F.col("id")).alias("v")).collect():
        assert re.fullmatch(FORMS[kind], r.v), r.v


def test_labels_are_places_in_the_text(spark):
    for r in g.samples(spark.range(200), "id").collect():
        assert (r.start is None) == (not r.flagged)
        if r.flagged:
            assert r.text[r.start : r.end] == r.value


def test_samples_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, g.samples(spark.range(100, numPartitions=1), "id").collect()), key=str)
    b = sorted(map(tuple, g.samples(spark.range(100, numPartitions=7), "id").collect()), key=str)
    assert a == b


@pytest.mark.parametrize("n", [0, 1, 9, 1000])
def test_split_sizes_are_exact(spark, n):
    out = {r.split: r["count"] for r in sampling.exact_split(spark.range(n), "id", 80).groupBy("split").count().collect()}
    assert out.get("train", 0) == n * 80 // 100 and sum(out.values()) == n


def test_typos_keep_short_values_and_edit_others(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, "abcdef")], "id int, v string").select("v", g.typos(F.col("id"), F.col("v"), F.lit(2)).alias("t")).collect()
    assert rows[0].t == "a" and rows[1].t == "" and 4 <= len(rows[2].t) <= 8


def test_each_typo_is_one_of_the_edits_by_hand(spark):
    def all_edits(v):
        for p in range(len(v)):
            near = g.KEYS_NEAR.get(v[p].lower(), "")
            yield v[:p] + v[p + 1 : p + 2] + v[p] + v[p + 2 :]
            yield v[:p] + v[p + 1 :]
            yield from (v[:p] + k + v[p:] for k in (*near, v[p - 1] if p else "", ""))
            yield from (v[:p] + k + v[p + 1 :] for k in near or v[p])
            yield v[:p] + v[p] + v[p:]

    for v in ("Ab1-", "zz", "é9 q"):
        got = {r.t for r in spark.range(400).select(g.typos(F.col("id"), F.lit(v), F.lit(1)).alias("t")).collect()}
        assert got <= set(all_edits(v)) and len(got) > 4


def test_quotas_add_up():
    for n in (0, 1, 7, 999):
        assert sum(g.quotas(n).values()) == n


def test_near_misses_of_all_customers(spark):
    from textward.plans import catalog

    sf = "/root/testdata/sf0.001"
    z = catalog.QUERIES["strata_union"](spark, sf).where("stratum = 'dangerous'")
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    assert sorted(r.id for r in z.select("id").collect()) == sorted(r.c_custkey for r in customers.select("c_custkey").collect())
