import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textward.operators import generate as g
from textward.operators import sampling, templates


@pytest.mark.parametrize("n", [0, 1, 7, 200_000])
def test_places_are_1_to_n_in_the_order_of_the_draws(spark, n):
    rows = sampling.places(spark.range(n, numPartitions=7), "id").withColumn("u", sampling.u32(F.col("id"), "shuffle")).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, n + 1))
    assert [(r.u, r.id) for r in rows] == sorted((r.u, r.id) for r in rows)


def test_no_task_sorts_all_rows(spark):
    plan = sampling.places(spark.range(100), "id")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")] + plan[plan.index("Join") :].split("Aggregate", 1)[0]
    assert "Window [row_number()" in plan and "[_cell" in top.split("Window [row_number()", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("n", [0, 1, 3, 99, 50_000])
def test_strata_are_exact_and_follow_the_draws(spark, n):
    rows = sampling.exact_strata(spark.range(n, numPartitions=5), "id", g.STRATA).withColumn("u", sampling.u32(F.col("id"), "stratum")).collect()
    assert Counter(r.stratum for r in rows) == Counter({k: v for k, v in sampling.quotas(n, g.STRATA).items() if v})
    order = [r.stratum for r in sorted(rows, key=lambda r: (r.u, r.id))]
    assert order == sorted(order, key=list(g.STRATA).index)


def test_strata_of_text_keys_and_empty_shares(spark):
    df = spark.range(1_000).selectExpr("concat('k', id) AS key", "id AS u", "id AS stratum_of")
    rows = sampling.exact_strata(df, "key", {"a": 50, "none": 0, "b": 50}).collect()
    assert Counter(r.stratum for r in rows) == {"a": 500, "b": 500} and {r.stratum_of for r in rows} == set(range(1_000))


def test_sketches_of_batches_are_merged(spark, tmp_path):
    df = spark.range(100_000).selectExpr("id % 10 AS batch", "concat('t', id % 40000) AS text")
    sampling.sketch(df, "batch", "text").write.parquet(str(tmp_path / "s"))
    n = sampling.sketched_count(spark.read.parquet(str(tmp_path / "s"))).first().n
    assert abs(n - 40_000) <= 0.03 * 40_000
    assert sampling.sketched_count(sampling.sketch(df.limit(0), "batch", "text")).first().n == 0


def test_templates_are_joined_by_place(spark):
    keyed = spark.range(3_000).withColumn("stratum", F.element_at(F.array(*(F.lit(s) for s in templates.STRATUM_POOLS)), (F.col("id") % 6 + 1).cast("int")))
    drawn = templates.pick_template(keyed, templates.pool_table(spark))
    rows = drawn.collect()
    assert len(rows) == 3_000 and all(r.pool in templates.STRATUM_POOLS[r.stratum] and r.template in templates.POOLS[r.pool] for r in rows)
    assert {(r.pool, r.template) for r in rows} == {(p, t) for pools in templates.STRATUM_POOLS.values() for p in pools for t in templates.POOLS[p]}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_a_data_set_has_its_quotas_and_true_places(spark):
    rows = templates.dataset(spark.range(1_000), "id").collect()
    assert Counter(r.stratum for r in rows) == g.quotas(1_000) and len({r.id for r in rows}) == 1_000
    assert all(r.text[e.start : e.end] == e.value for r in rows for e in r.entities)
    starts = {r.reason.split()[0] for r in rows}
    assert starts == {"No", "Detected", "Likely", "Possibly"}
    half = Counter(r.pool for r in rows if r.stratum == "dangerous")
    assert set(half) == {"generated", "dangerous"} and min(half.values()) > 40
    assert not any(r.flagged for r in rows if r.stratum in ("negative", "dangerous"))


def test_metadata_names_all_strata(spark):
    df = spark.createDataFrame([("a",), ("a",), ("c",)], "s string")
    text = sampling.metadata(df, "s", ["a", "b", "c"], 7).first().metadata
    assert json.loads(text) == {"total_samples": 3, "seed": 7, "difficulty_distribution": {"a": 2, "b": 0, "c": 1}} and "\n  " in text
    assert json.loads(sampling.metadata(df.limit(0), "s", ["a"], 7).first().metadata)["difficulty_distribution"] == {"a": 0}


def test_each_case_of_the_suite_is_drawn(spark):
    rows = templates.suite_cases(spark.range(2_000), "id").collect()
    assert len(rows) == 2_000 and {r.category for r in rows} == {c[0] for c in templates.SUITE} and not any("{" in r.text for r in rows)
    assert {r.expected for r in rows} == {True, False, None}
