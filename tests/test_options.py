"""Options: keys, large key spaces, breakdowns, targets, approximate retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.operators import kpi as K
from tallyframe.operators import modeling as M
from tallyframe.operators import profile as P
from tallyframe.operators import retrieval as R
from tallyframe.operators import summarize as A
from tallyframe.operators import text as T


def test_numeric_keys(spark):
    rows = [(i % 4, i % 30, i % 3 if i % 7 else None, "ab"[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "region_no int, class_no int, tier int, kind string, amount double")
    assert A.choose_keys(df, None)[0] == ["kind"]
    keys, values, counts = A.choose_keys(df, None, numeric_keys=True)
    assert keys == ["kind", "tier", "region_no"] and values == ["class_no", "amount"]
    assert counts == {"kind": 2, "tier": 3, "region_no": 4}      # class_no has 30 values
    assert A.choose_keys(df, None, numeric_keys=True, target="tier")[0] == ["kind", "region_no"]
    assert A.summarize(df, numeric_keys=True).meta["group_keys"] == keys
    assert A.choose_keys(df.limit(0), None, numeric_keys=True)[0] == []


@pytest.mark.parametrize("max_rows", [1, 5, 40, 300, 5000])
def test_large_key_space_chooses_the_same_prefix(spark, monkeypatch, max_rows):
    rows = [(f"a{i % 3}", f"b{i * 7 % 5}" if i % 11 else None, f"c{i * i % 17}", f"d{i * 13 % 29}", i % 400, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, n int, x double")
    plain = A.summarize(df, max_rows)
    monkeypatch.setattr(A, "LARGE_KEY_SPACE", 0)
    counted = []
    whole = A.prefix_group_counts
    monkeypatch.setattr(A, "prefix_group_counts", lambda d, keys: counted.append(len(keys)) or whole(d, keys))
    sketched = A.summarize(df, max_rows)
    assert sketched.meta == plain.meta
    assert sketched.table.count() == sketched.meta["agg_rows"] <= max(max_rows, 1)
    known = [(x, y) for x, y in zip(sketched.level_counts, plain.level_counts) if x is not None]
    assert all(x == y for x, y in known)
    if max_rows == 5:
        assert counted == [1] and sketched.level_counts[2:] == [None] * 3


def test_breakdowns(spark):
    df = spark.createDataFrame([("x", "p", 5.0, 1), ("x", "q", 1.0, 2), ("y", "p", 2.0, 9), (None, "q", 4.0, 0)],
                               "k string, m string, u_sum double, v_sum int")
    got = {(r.key, r.metric, r["name"]): (r.value, r["rank"], round(r.share_of_total, 2))
           for r in K.breakdowns(df, ["_year", "k", "m", "z"], ["u", "v", "w"]).collect()}
    assert got == {("k", "u", "x"): (6.0, 1, 75.0), ("k", "u", "y"): (2.0, 2, 25.0), ("k", "v", "y"): (9.0, 1, 75.0),
                   ("k", "v", "x"): (3.0, 2, 25.0), ("m", "u", "p"): (7.0, 1, 58.33), ("m", "u", "q"): (5.0, 2, 41.67),
                   ("m", "v", "p"): (10.0, 1, 83.33), ("m", "v", "q"): (2.0, 2, 16.67)}
    assert K.breakdowns(df, ["_year"], ["u"]).count() == 0 and K.breakdowns(df.limit(0), ["k"], ["u"]).count() == 0


def test_rows_without_target(spark):
    rows = [(float(i), float(i % 13) if i % 5 else (None if i % 2 else float("nan"))) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert M.prepare(df, "y").n_rows == 100
    p = M.prepare(df, "y", null_targets="drop")
    assert p.n_rows == 80 and p.data.where(F.isnan("label") | F.col("label").isNull()).count() == 0
    with pytest.raises(ValueError):
        M.prepare(df, "y", null_targets="keep")


def test_wider_lists(spark):
    df = spark.createDataFrame([(1, "Is this RELIABLE?"), (2, "a threat"), (3, "plain")], "i int, t string")
    wide = {r.i: r.intent for r in T.route_intents(df, "t", ["i"], tuple(fixed.WIDE_INTENTS)).collect()}
    assert wide == {1: "model", 2: "risks", 3: fixed.FALLBACK_INTENT}
    names = spark.createDataFrame([(1, "audience"), (2, "x-category")], "i int, t string")
    assert [r.domain for r in P.domain_scores(names, "t", ["i"], tuple(fixed.WIDE_DOMAIN_KEYWORDS)).collect()] == [
        "marketing", "retail/sales"]
    assert {r.i: r.score for r in P.target_scores(names, "t", ["i"], tuple(fixed.WIDE_TARGET_KEYWORDS), "_-").collect()} == {1: 0, 2: 2}


def _recall(got, want):
    return len(got & want) / len(want)


@pytest.mark.parametrize("spread,broadcast", [(0.1, R.BROADCAST_BYTES), (0.1, 0), (5.0, R.BROADCAST_BYTES)])
def test_probed_topk_recall(spark, spread, broadcast):
    """Vectors in clusters, and vectors without any."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + spread * rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>").repartition(6).cache()
    asked = df.where("i % 50 = 0")
    got = R.probed_topk(asked, "i", "v", df, "i", "v", 7, broadcast_bytes=broadcast).collect()
    want = T.cosine_topk(asked, "i", "v", df, "i", "v", 7).collect()
    scores = {(r.q_id, r.c_id): r.score for r in want}
    assert _recall({(r.q_id, r.c_id) for r in got}, set(scores)) >= 0.9
    assert all(r.score == pytest.approx(scores[r.q_id, r.c_id]) for r in got if (r.q_id, r.c_id) in scores)
    assert max(r["rank"] for r in got) == 7 and len({(r.q_id, r.c_id) for r in got}) == len(got)
    if spread < 1:   # clustered: few buckets do
        planes = R.directions(6, 24)
        unit = R._vectors(df, "i", "v")
        assert R.needed_visits(unit.where("id % 50 = 0"), unit, planes, 7, 0.95) <= 24


def test_probed_topk_cases(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]),
                                (7, [1.0, 2.0, 3.0]), (8, []), (9, [-1.0, 0.0])], "i int, v array<double>")
    got = sorted((r.q_id, r["rank"], r.c_id, r.score) for r in R.probed_topk(df, "i", "v", df, "i", "v", 2, recall=1.0).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 2, 1.0), (9, 1, 9, 1.0), (9, 2, 1, -1.0)]
    for a, b in ((df.limit(0), df), (df, df.limit(0)), (df.limit(0), df.limit(0))):
        assert R.probed_topk(a, "i", "v", b, "i", "v", 2).count() == 0


def test_probed_rows_given_back_grow_with_tasks(spark):
    """A task gives back k rows a query, not k for each bucket or block."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "i long, v array<double>").repartition(2)
    unit, planes = R._vectors(df, "i", "v"), R.directions(5, 8)
    asked = unit.where("id % 50 = 0").select("id", "v").toArrow()
    for visits in (1, 32):
        got = R._scored_here(unit, asked, planes, visits, 3).collect()
        assert len(got) <= 12 * 3 * 2 and {r.q for r in got} == set(range(12))
    exact = T.cosine_topk(df.where("i % 50 = 0"), "i", "v", df, "i", "v", 3)
    ids = asked.column("id").to_pylist()
    assert {(ids[r.q], r.c_id) for r in R._first(R._scored_here(unit, asked, planes, 32, 3), "q", 3).collect()} \
        == {(r.q_id, r.c_id) for r in exact.collect()}


def test_one_pass_equals_single_statistics(spark):
    from tallyframe.operators import clean as C
    from tallyframe.operators import one_pass as OP
    from tallyframe.operators import stats as X
    rows = [(i, float(i * i % 37) if i % 4 else None, "ab"[i % 2] if i % 3 else " None ", f"2020-01-{i % 28 + 1:02d}" if i % 5 else "junk",
             1.5 if i == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x double, kind string, day_date string, rare double").repartition(4)
    nums = ["i", "x", "rare"]
    one = OP.measure(df)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert one.count() == 1 and one.first().n_rows == 200
    assert same(P.missing_report(df), P.missing_report(df, measured=one)) and P.missing_report(df, measured=one).count() == 2
    assert same(P.worst_missing(df), P.worst_missing(df, measured=one))
    close = lambda a, b: [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in a.collect()] == b.collect()
    for whole, read in ((X.correlation_pairs(df, nums[:2]), X.correlation_pairs(df, nums, one).where("c2 = 'x'")),
                        (X.skewness(df, nums[:2]), X.skewness(df, nums, measured=one).where("position < 2")),
                        (P.numeric_target_profile(df, "x"), P.numeric_target_profile(df, "x", one))):
        assert close(whole, read)
    look = OP.first_look(df)
    assert look.n_rows == 200 and look.present == {"i": 200, "x": 150, "kind": 200, "day_date": 200, "rare": 1}
    assert look.distinct["kind"] == 2 and look.parsed == {"day_date": 0.8}      # " None " is missing
    assert C.drop_sparse_columns(df, look=look).columns == C.drop_sparse_columns(df).columns == ["i", "x", "kind", "day_date"]
    assert A.summarize(df).meta["time_col"] == "day_date"
    none = OP.measure(df.limit(0)).first()
    assert none.n_rows == 0 and OP.first_look(df.limit(0)).parsed == {"day_date": 0.0}
