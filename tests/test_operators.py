"""Operators: rules, dedup, numbering, look-ups, top-k, also under skew."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.operators.dedup import best_record, keep_first
from tallyhouse.operators.lookup import count_orphans, look_up, look_up_sparse, orphans, small_side
from tallyhouse.operators.numbering import number_rows
from tallyhouse.operators.ranking import few_values, flagged_or_top, top_per_group
from tallyhouse.operators.report import with_share
from tallyhouse.operators.rules import Rule, RuleSet

RULES = RuleSet("t", (Rule("has_a", "a is not null", "missing_a"), Rule("b_known", "b in ('x', 'y')", "invalid_b")))


@settings(max_examples=20, deadline=None)
@given(rows=st.lists(st.tuples(st.none() | st.integers(0, 3), st.none() | st.sampled_from(["x", "y", "z"])), min_size=1, max_size=12))
def test_split_is_total_and_labelled(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string")
    good, bad = RULES.clean(df).collect(), RULES.quarantine(df).collect()
    assert len(good) + len(bad) == len(rows)
    assert all(r.a is not None and r.b in ("x", "y") for r in good)
    assert all(r.issue_type for r in bad)


def test_labels_counts_and_observation(spark):
    df = spark.createDataFrame([(None, None), (1, "z"), (1, "x"), (None, "y")], "a int, b string")
    assert sorted(r.issue_type for r in RULES.quarantine(df).collect()) == ["invalid_b", "missing_a", "missing_a, invalid_b"]
    counts = {r.rule: (r.total_rows, r.violations) for r in RULES.violations(df).collect()}
    assert counts == {"has_a": (4, 2), "b_known": (4, 2)}
    watched, seen = RULES.observe(df)
    assert watched.count() == 4
    assert seen.get == {"total_rows": 4, "has_a": 2, "b_known": 2}
    first = df.select(RULES.first_issue("ok").alias("f")).collect()
    assert [r.f for r in first] == ["missing_a", "invalid_b", "ok", "missing_a"]


def test_best_record_breaks_ties_by_region_then_row(spark):
    rows = [("c", "r2", 3, "z"), ("c", "r1", 3, "b"), ("c", "r1", 3, "a"), ("c", "r0", 1, "q"), ("d", "r9", 0, None)]
    df = spark.createDataFrame(rows, "id string, region string, score int, v string")
    best = {r.id: (r.region, r.v) for r in best_record(df, "id", F.col("score"), ["region"]).collect()}
    assert best == {"c": ("r1", "a"), "d": ("r9", None)}


def test_keep_first_survives_a_hot_key(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    out = {r.k: r.v for r in keep_first(df, ["k"]).collect()}
    assert len(out) == 51 and out["hot"] == 0
    plan = keep_first(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_numbers_equal_a_global_row_number(spark, ranges):
    df = spark.range(500).select(F.concat(F.lit("id-"), (F.col("id") * 7919 % 500).cast("string")).alias("k"))
    found = number_rows(df, ["k"], "n", ranges).orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 501))
    assert [r.k for r in found] == sorted(r.k for r in found)


def test_numbers_with_ties_in_the_leading_column(spark):
    # a third of the rows share the first sort column
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("r"), F.concat(F.lit("v"), F.col("id")).alias("k"))
    found = number_rows(df, [-F.col("r"), "k"], "n", 12).orderBy("n").collect()
    assert [(r.r, r.k) for r in found] == sorted([(r.r, r.k) for r in found], key=lambda x: (-x[0], x[1]))
    assert [r.n for r in found] == list(range(1, 301))


def test_look_up_and_orphans(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "k string")
    dim = spark.createDataFrame([("a", 1)], "k string, key int")
    assert sorted(r.key for r in look_up(facts, dim, "k", ["key"], {"key": -1}).collect()) == [-1, -1, -1, 1]
    assert orphans(facts, "k", dim, "k").count() == 2
    assert orphans(facts, "k", dim, "k", null_is_orphan=True).count() == 3
    assert count_orphans(facts, "k", dim, "k").first().orphaned_count == 2
    assert count_orphans(facts, "k", dim, "k", null_is_orphan=True).first().orphaned_count == 3


def test_broadcast_only_after_a_count(spark):
    hinted = small_side(spark.range(5), 5)._jdf.queryExecution().analyzed().toString()
    plain = small_side(spark.range(6), 5)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 3)
    assert sorted((r.g, r.id) for r in top.collect()) == [(0, 994), (0, 996), (0, 998), (1, 995), (1, 997), (1, 999)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_flagged_or_top(spark):
    df = spark.createDataFrame([(i, i > 7) for i in range(10)], "s int, f boolean")
    assert sorted(r.s for r in flagged_or_top(df, "f", [F.desc("s")]).collect()) == [8, 9]
    none = df.withColumn("f", F.lit(False))
    assert sorted(r.s for r in flagged_or_top(none, "f", [F.desc("s")]).collect()) == [7, 8, 9]


def test_few_values_and_shares(spark):
    df = spark.createDataFrame([("a", "3"), ("a", "1"), ("a", "1"), ("a", "2"), ("a", "9"), ("b", None), ("b", "5")], "g string, v string")
    assert {r.g: r.samples for r in few_values(df, ["g"], "v").collect()} == {"a": "1,2,3", "b": "5"}
    counts = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n bigint")
    assert {r.k: r.pct for r in with_share(counts, "n").collect()} == {"x": 33.33, "y": 66.67}


def test_rows_without_a_key_are_spread_over_the_join(spark):
    facts = spark.range(200_000).select(F.col("id").alias("order_id"), F.when(F.col("id") % 100 < 3, F.concat(F.lit("p"), F.col("id") % 500)).alias("product_id"))
    dim = spark.range(400).select(F.concat(F.lit("p"), "id").alias("product_id"), F.col("id").alias("product_key"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = look_up_sparse(facts, dim, "product_id", ["product_key"], ["order_id"])
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(sizes) == 200_000
        want = facts.join(dim, "product_id", "left").select("order_id", "product_id", "product_key")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stored_tables_run_as_methods_that_are_compiled(spark, tmp_path):
    from tallyhouse.sources.store import COMPILED, compiled, write_files

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with compiled(spark):
        assert spark.conf.get(name) == COMPILED
    assert spark.conf.get(name) == before
    with pytest.raises(Exception):  # noqa: B017
        write_files(spark.range(3).selectExpr("raise_error('no') as x"), str(tmp_path / "t"))
    assert spark.conf.get(name) == before
    assert write_files(spark.range(3), str(tmp_path / "u")).count() == 3
