"""Registered queries against their DuckDB SQL twins on the smallest tables."""

import os

import pytest

from tests.oracle_check import run

SF = "/root/testdata/sf0.001"

FAST = ["s7_fingerprint", "p1_roles_orders", "p3_describe", "p4_missing", "c3_trim_nullify", "c6_parse_dates",
        "a2_summary_orders", "a4_prefix_levels", "k2_yoy", "k8_performance_gap", "x1_correlation",
        "d_decisions", "t1_chunks", "t4_keyword_topk", "t6_facts_documents", "m4_prepare_impute",
        "m11_classification_metrics", "t8_facts", "t7_structured", "r1_sections_by_supplier", "m7_ridge_by_flag", "m5_split",
        "m6_folds", "m3_label_encoding_names", "s1_exact_ids", "c5_equal_names", "t2_tfidf", "t2_tfidf_topk"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_oracle_fast_subset(spark):
    res = run(SF, FAST, spark=spark, verbose=False)
    bad = {k: v for k, v in res.items() if not v[0]}
    assert not bad, bad


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
