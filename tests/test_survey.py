"""One survey of a table for summaries of several limits, and the short way
of cleaning tidy values."""

import pytest

from tallyframe.functions import fixed
from tallyframe.functions.columns import strip_ws
from tallyframe.operators import clean as C
from tallyframe.operators import summarize as A
from tallyframe.plans import catalog_options


def _rows(spark):
    rows = [(f"a{i % 3}", f" b{i * 7 % 5}" if i % 11 else "None", f"c{i * i % 17}", f"d{i * 13 % 29}\t" if i % 7 else None, float(i)) for i in range(1500)]
    return spark.createDataFrame(rows, "a string, b string, c string, d string, x double")


@pytest.mark.parametrize("large", [0, 1_000_000])
def test_summaries_share_a_survey(spark, monkeypatch, large):
    monkeypatch.setattr(A, "LARGE_KEY_SPACE", large)
    df = _rows(spark)
    seen = A.survey(df, 300)
    for limit in (1, 5, 20, 300):
        alone, shared = A.summarize(df, limit, 2), A.summarize(df, limit, 2, surveyed=seen)
        assert shared.meta == alone.meta and shared.level_counts == alone.level_counts
        assert sorted(map(str, shared.table.collect())) == sorted(map(str, alone.table.collect()))
    assert seen.meta["group_keys"] == []
    with pytest.raises(ValueError):
        A.summarize(df, 301, surveyed=seen)


def test_large_key_space_reads_rows_once(spark, monkeypatch):
    looks, look = [], A.first_look
    monkeypatch.setattr(A, "first_look", lambda df: looks.append(1) or look(df))
    monkeypatch.setattr(catalog_options.TB, "lineitem_many_keys", lambda spark, sf_dir: _rows(spark))
    got = [(r.max_rows, r.n_keys, r.groups) for r in catalog_options.a4_large_key_space(spark, "").collect()]
    assert len(looks) == 1
    assert got == [(m, len(x.meta["group_keys"]), x.meta["agg_rows"]) for m in catalog_options.ROW_LIMITS
                   for x in [A.summarize(_rows(spark), m, 2)]]


def test_cleaned_is_stripped_and_nullified(spark):
    ends = ["", " ", "\t", "\x1c", "\x85", "\xa0", " ", "　", "é", "~", "\x7f", "!", "\x01", "\n\r"]
    values = [(a + m + b,) for a in ends for b in ends for m in ("", "x", "a b", "None", "nan", "ü")] + [(None,)]
    df = spark.createDataFrame(values, "v string")
    rows = df.select("v", C.cleaned(df.v).alias("c"), strip_ws(df.v).alias("s")).collect()
    for r in rows:
        assert r.c == (None if r.v is None or r.v.strip() in fixed.NULL_LITERALS else r.v.strip())
        assert r.s == (r.v and r.v.strip())
    plan = df.select(C.cleaned(df.v).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
