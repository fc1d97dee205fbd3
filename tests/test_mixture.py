import re

from pyspark.sql import functions as F

from textward.operators import generate as g
from textward.operators import mixture as mx


def test_entities_stand_where_they_are_said_to(spark):
    rows = mx.multi(spark.range(600), "id").collect()
    assert len(rows) == 600 and {r.level for r in rows} == set(mx.LEVELS)
    lost = 0
    for r in rows:
        starts = [e.start for e in r.entities]
        assert starts == sorted(starts) and all(r.text[e.start : e.end] == e.value and r.text.find(e.value) == e.start for e in r.entities)
        assert not re.search(r"\{[A-Z_]+\}", r.text) or r.level == "heavy"
        n = max(len(re.findall("{", t)) for t in mx.MULTI)
        lost += len(r.entities) < n and r.level in ("medium", "heavy")
        assert r.cents == 95 if r.level == "none" and r.entities else 45 <= r.cents <= 95
    assert lost  # noise over the text hides some


def test_the_first_of_equal_placeholders_is_replaced(spark):
    row = spark.range(1).select(mx.replace_first(F.lit("{A} {A}"), F.lit("{A}"), F.lit("x")).alias("a"), mx.replace_first(F.lit("b"), F.lit("{A}"), F.lit("x")).alias("b"), mx.replace_first(F.lit(""), F.lit("{A}"), F.lit("")).alias("c")).first()
    assert tuple(row) == ("x {A}", "b", "")


def test_texts_are_unique_and_all_keys_get_one(spark, tmp_path):
    rows = mx.unique_negatives(spark.range(30_000, numPartitions=5), "id", str(tmp_path / "a")).collect()
    assert sorted(r.id for r in rows) == list(range(30_000)) and len({r.text for r in rows}) == 30_000
    assert max(r.attempt for r in rows) > 3
    assert mx.unique_negatives(spark.range(0), "id", str(tmp_path / "b")).count() == 0


def test_keys_without_a_text_of_their_own_get_a_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mx, "NEGATIVE_ROUNDS", (1, 1))
    rows = mx.unique_negatives(spark.range(2_000), "id", str(tmp_path / "a")).collect()
    assert sorted(r.id for r in rows) == list(range(2_000)) and len({r.text for r in rows}) == 2_000
    late = [r for r in rows if r.attempt >= 2]
    assert late and all(re.search(r" \(Ref: \d{6}\)$", r.text) for r in late)


def test_positives_keep_what_others_have_after_fifty_draws(spark, tmp_path):
    rows = mx.unique_positives(spark.range(8_000), "id", str(tmp_path / "a")).collect()
    own, again = [r for r in rows if not r.repeated], [r for r in rows if r.repeated]
    assert sorted(r.id for r in rows) == list(range(8_000)) and len({r.text for r in own}) == len(own)
    assert all(r.attempt == 49 for r in again) and all(r.value in r.text for r in rows)
    names = lambda tries: tries.select("id", "attempt", F.lit("the only text").alias("text"))
    mx.claim(spark.range(5), names, (1, 2), str(tmp_path / "b"))
    assert [tuple(r)[:3] for r in mx.read_checkpoint(spark, str(tmp_path / "b"), mx.CLAIMS).collect()] == [(0, 0, "the only text")]


def test_a_round_that_is_written_again_claims_the_same(spark, tmp_path):
    keys, draw = spark.range(500), lambda tries: mx.negatives(tries, "id")
    mx.claim(keys, draw, (1,), str(tmp_path / "a"))
    mx.claim(keys, draw, mx.NEGATIVE_ROUNDS, str(tmp_path / "a"))
    mx.claim(keys, draw, mx.NEGATIVE_ROUNDS, str(tmp_path / "b"))
    read = lambda name: sorted(map(tuple, mx.read_checkpoint(spark, str(tmp_path / name), mx.CLAIMS).select("id", "attempt", "text").collect()))
    assert read("a") == read("b")


def test_halves_are_exact(spark):
    for n in (0, 1, 301):
        rows = mx.balanced(spark.range(n), "id").collect()
        assert len(rows) == n and sum(r.flagged for r in rows) == n // 2
    assert all(t.count("{}") == len(s) for t, s in mx.DYNAMIC)


def test_all_ways_of_augmenting_occur(spark):
    seen = {(r.entity_type, r.augmentation) for r in g.augment(g.samples(spark.range(4000), "id")).select("entity_type", "augmentation").distinct().collect()}
    assert {(a[0], a[1]) for a in g.AUGMENTATIONS} <= seen
    for t in dict.fromkeys(a[0] for a in g.AUGMENTATIONS):
        assert sum(a[2] for a in g.AUGMENTATIONS if a[0] == t) == 100


def test_plans_hold_each_draw_once(spark):
    from textward.operators.detect import detect

    plan = detect(g.samples(spark.range(10), "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") < 150
