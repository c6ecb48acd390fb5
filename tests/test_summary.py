"""Cleaning, summary and KPI quirks on literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import clean as C
from tallyframe.operators import kpi as K
from tallyframe.operators import summarize as A


def test_null_keys_dropped_and_sum_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None)], "k string, v double")
    out = {r["k"]: r for r in A.group_summary(df, ["k"], ["v"]).collect()}
    assert set(out) == {"a", "b"}                       # Q1: NULL key dropped
    assert out["b"]["v_sum"] == 0.0                      # Q2: all-null sum is 0
    assert out["b"]["v_mean"] is None
    assert out["a"]["v_std"] is None                     # n = 1 -> NULL std
    assert out["a"]["v_count"] == 1


def test_prefix_counts_keep_null_in_dropped_key(spark):
    df = spark.createDataFrame([("x", "p"), ("x", None), ("y", "q")], "a string, b string")
    counts = {r["n_keys"]: r["groups"] for r in A.prefix_group_counts(df, ["a", "b"]).collect()}
    assert counts[1] == 2          # a NULL only in the dropped key keeps the group
    assert counts[2] == 2          # (x, NULL) is not a group of the 2-key level
    assert A.choose_prefix(counts, 2, 1) == 0
    assert A.choose_prefix(counts, 2, 2) == 2


def test_dedup_before_trim_and_null_literals(spark):
    df = spark.createDataFrame([(" a", 1), ("a ", 1), ("None", 2), ("nan", 3)], "s string, n int")
    out = C.clean(df).collect()
    assert len(out) == 4                                 # Q8: equal only after trimming -> both kept
    assert sorted([r["s"] for r in out], key=str) == ["None", "None", "a", "a"] or \
        sorted([str(r["s"]) for r in out]) == ["None", "None", "a", "a"]
    assert sum(r["s"] is None for r in out) == 2


def test_string_dates_parsed_and_time_parts(spark):
    df = spark.createDataFrame([("2020-03-15", 1.0), ("03/20/2021", 2.0), ("junk", 3.0)], "order_date string, v double")
    s = A.summarize(df)
    assert s.meta["time_col"] == "order_date"
    keys = s.meta["group_keys"]
    assert keys[:3] == ["_year", "_quarter", "_month"]
    years = sorted(r["_year"] for r in s.table.collect())
    assert years == [2020, 2021]


def test_numeric_time_like_name_stays_value(spark):
    df = spark.createDataFrame([(5, "a", 1.0), (7, "b", 2.0)], "tenure_months int, plan string, v double")
    keys, values, _ = A.choose_keys(df, None)
    assert "tenure_months" in values                     # Q5 fixed
    assert keys == ["plan"]


def test_yoy_zero_prior_year(spark):
    t = spark.createDataFrame([(2020, 0.0), (2021, 5.0)], "_year bigint, m_sum double")
    r = K.yoy_growth(t, "m").first()
    assert r["yoy_growth_pct"] == 0.0 and r["latest_year"] == 2021


def test_top_category_tie_breaks_by_name(spark):
    t = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0)], "k string, m_sum double")
    r = K.top_category(t, "k", "m").first()
    assert r["top_category_name"] == "a"
    assert math.isclose(r["top_category_share"], 5 / 11 * 100)


def test_rollup_levels_sum_to_parent(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"),
                                 F.col("id").cast("double").alias("v"))
    s = A.summarize(df, max_rows=5)
    assert s.meta["group_keys"] == ["a"]
    assert s.table.agg(F.sum("v_sum")).first()[0] == float(sum(range(200)))


def test_rollup_reads_distinct_keys(spark):
    """The ROLLUP copies a row for each level: rows are condensed before."""
    df = spark.createDataFrame([(i % 2, "x" if i % 3 else None) for i in range(60)], "a int, b string")
    counts = A.prefix_group_counts(df, ["a", "b"])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")
    assert {r.n_keys: r.groups for r in counts.collect()} == {0: 1, 1: 2, 2: 2}
