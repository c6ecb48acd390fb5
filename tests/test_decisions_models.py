"""Decision rules on literal KPI rows; model preparation and metrics."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators import decisions as D
from tallyframe.operators import modeling as M


def _kpi(spark, **vals):
    cols = ", ".join(f"{n} {t}" for n, t in D.INPUT_SCHEMA)
    row = tuple(vals.get(n) for n, _ in D.INPUT_SCHEMA)
    return spark.createDataFrame([row], cols)


def test_rules_fire(spark):
    k = _kpi(spark, n_rows=500, worst_missing_col="x", worst_missing_pct=35.0, duplicates=10, duplicate_pct=2.0,
             primary_col="sales", yoy_growth_pct=-12.34, latest_year=2021, previous_year=2020, latest_year_val=87.0,
             prev_year_val=100.0, top_category_col="region", top_category_name="North", top_category_value=70.0,
             top_category_share=72.5, best_model="Random Forest", task="regression", overfit_gap=16.0,
             best_score=85.0, top_feature="price", top_feature_share=40.0)
    got = {(r["kind"], r["rule_id"]): r for r in D.decide(k).collect()}
    assert got[("risk", "D1")]["level"] == "High"
    assert got[("risk", "D1")]["title"] == "Data Gap in `x` (35.0% missing)"
    assert got[("risk", "D2")]["level"] == "Medium"
    assert got[("risk", "D3")]["level"] == "Critical"
    assert got[("risk", "D3")]["title"] == "Significant Decline: -12.3% YoY in `sales`"
    assert got[("risk", "D4")]["level"] == "High"
    assert ("risk", "D6") in got and ("recommendation", "D7") in got and ("recommendation", "D8") in got
    assert got[("risk", "D10")]["title"] == "Small Dataset (500 rows)"
    counts = D.decision_counts(D.decide(k)).first()
    assert counts["risks"] == 6 and counts["high_risks"] == 3


def test_no_rules_without_inputs(spark):
    k = _kpi(spark, n_rows=5000, duplicates=0)
    got = [(r["kind"], r["rule_id"]) for r in D.decide(k).collect()]
    assert got == [("optimization", "D2")]


def test_module_low_accuracy_rule(spark):
    k = _kpi(spark, n_rows=5000, duplicates=0, best_model="Logistic Regression", task="classification",
             best_score=60.0, overfit_gap=1.0, top_feature="a", top_feature_share=50.0)
    ids = {r["rule_id"] for r in D.decide(k, module_low_accuracy=True).collect()}
    assert "D9" in ids and "D8" not in ids


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    p = y + rng.normal(scale=0.3, size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    r = M.regression_metrics(df).first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(r["r2_pct"], r2 * 100, rel_tol=1e-9)
    assert math.isclose(r["rmse"], float(np.sqrt(((y - p) ** 2).mean())), rel_tol=1e-9)
    yc = rng.integers(0, 3, size=300)
    pc = np.where(rng.random(300) < 0.7, yc, rng.integers(0, 3, size=300))
    dfc = spark.createDataFrame([(float(a), float(b)) for a, b in zip(yc, pc)], "label double, prediction double")
    c = M.classification_metrics(dfc).first()
    f1s, sup = [], []
    for k in range(3):
        tp = ((yc == k) & (pc == k)).sum()
        prec = tp / max((pc == k).sum(), 1)
        rec = tp / (yc == k).sum()
        f1s.append(0 if prec + rec == 0 else 2 * prec * rec / (prec + rec))
        sup.append((yc == k).sum())
    assert math.isclose(c["accuracy_pct"], (yc == pc).mean() * 100, rel_tol=1e-9)
    assert math.isclose(c["f1_pct"], np.average(f1s, weights=sup) * 100, rel_tol=1e-9)


def test_prepare_encodes_imputes_and_drops_siblings(spark):
    df = spark.createDataFrame([("b", 1.0, 10.0, 2.0, 3), ("a", None, 20.0, 4.0, 4), (None, 3.0, 30.0, 6.0, 5)],
                               "k string, x double, t_sum double, t_mean double, t_count long")
    p = M.prepare(df, "t")
    assert p.target == "t_sum" and p.task == "classification"    # 3 distinct values <= 10
    assert p.features == ["k", "x"]                      # _count and the target's sibling dropped
    rows = sorted((r["k"], r["x"]) for r in p.data.collect())
    assert rows == [(0.0, 2.0), (1.0, 1.0), (2.0, 3.0)]  # codes a=0, b=1, nan=2; median of x = 2


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, label double")
    est, _ = M.estimators("regression", train_rows=80, label_std=float(y.std()))["Ridge Regression"]
    model = M._fit("Ridge Regression", est, False, df, ["a", "b", "c"], "regression")
    coef = model.stages[-1].coefficients.toArray()
    Xc, yc = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(3), Xc.T @ yc)
    assert np.allclose(coef, want, atol=1e-6)


def test_split_and_folds_are_disjoint_and_complete(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("string").alias("y"), F.col("id").cast("double").alias("x"))
    p = M.prepare(df, "y")
    train, test, frac = M.split(p)
    n_tr, n_te = train.count(), test.count()
    assert n_tr + n_te == 300 and n_te == 60
    folds = M.with_folds(p, 5)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 300 and max(sizes) - min(sizes) <= 2


def test_training_rows_are_written_before_partitions_are_joined(spark):
    """One task mustn't hold the memory of all partitions of a join or sort:
    a coalesced plan reads written rows, the same in the same order."""
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(8, "k").sortWithinPartitions("id")
    one = M.in_few(rows, 1)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("InMemoryRelation")[0] and "Exchange" not in plan and "Sort" not in plan
    assert one.rdd.getNumPartitions() == 1 and one.collect() == rows.coalesce(1).collect()


def test_scores_predict_rows_once(spark):
    """Accuracy and F1 read the predictions once, whatever they cost, also
    where labels or predictions are missing."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def guess(x):
        seen.add(1)
        return None if x % 11 == 0 else float(x % 3 == 0)

    rows = spark.createDataFrame([(i, None if i % 13 == 0 else float(i % 2), i % 2) for i in range(200)], "x int, label double, g int")
    got = M.classification_metrics(rows.withColumn("prediction", guess("x"))).first()
    assert seen.value == 200
    pairs = [(None if i % 13 == 0 else i % 2, None if i % 11 == 0 else int(i % 3 == 0)) for i in range(200)]
    tp = sum(y == p and y is not None for y, p in pairs)
    assert got["n"] == 200 and math.isclose(got["accuracy_pct"], tp / 200 * 100)
