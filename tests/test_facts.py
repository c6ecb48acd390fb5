"""Typed facts, Gram matrices, drawn samples and TF-IDF on small frames."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.operators import facts as FT
from tallyframe.operators import gram as G
from tallyframe.operators import modeling as M
from tallyframe.operators import text as T

NAN = float("nan")


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, z = float(rng.normal()), float(rng.normal() + 1e9)
        y = 3 * x + 0.5 * (z - 1e9) + 7 + float(rng.normal()) * 0.1
        rows.append((f"s{i % 3}" if i % 50 else None, ["a", "b", "c", None][i % 4], f"{2019 + i // 3 % 3}-05-01",
                     x if i % 9 else NAN, z if i % 11 else None, y))
    return spark.createDataFrame(rows + rows[:7], "shop string, kind string, day string, x double, z double, y double").withColumn(
        "day", F.col("day").cast("date"))


@pytest.mark.parametrize("by", [[], ["shop"]])
def test_gram_and_ridge(sales, by):
    data = sales.toPandas()
    got = {(*[r[b] for b in by], r.i, r.j): r for r in G.wide_correlation_pairs(sales.repartition(5), ["x", "z", "y"], by).collect()}
    fits = defaultdict(list)
    for r in G.ridge(sales, ["x", "z"], "y", 2.0, by).orderBy("position").collect():
        fits[tuple(r[b] for b in by)].append(r)
    groups = [((), data)] if not by else [((k if isinstance(k, str) else None,), g) for k, g in data.groupby("shop", dropna=False)]
    assert len(fits) == len(groups) and len(got) == 3 * len(groups)
    for key, g in groups:
        c = g[["x", "z", "y"]]
        for i, j in ((0, 1), (0, 2), (1, 2)):
            assert got[*key, i, j].n == len(c.iloc[:, [i, j]].dropna())
            assert got[*key, i, j].r == pytest.approx(c.corr().iloc[i, j], abs=1e-7)
        c = c.dropna()
        a = c[["x", "z"]].to_numpy() - c[["x", "z"]].to_numpy().mean(0)
        w = np.linalg.solve(a.T @ a + 2.0 * np.eye(2), a.T @ (c["y"] - c["y"].mean()))
        assert [r.coefficient for r in fits[key]] == pytest.approx(w, rel=1e-6)
        rest = ((c["y"] - c["y"].mean()) - a @ w) ** 2
        assert fits[key][0].r2_pct == pytest.approx(100 * (1 - rest.sum() / ((c["y"] - c["y"].mean()) ** 2).sum()), abs=1e-6)


def test_gram_edges(spark, sales):
    none = sales.limit(0)
    assert G.gram(none, ["x", "y"]).count() == 0 and G.ridge(none, ["x"], "y").count() == 0
    flat = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert G.wide_correlation_pairs(flat, ["x", "y"]).first().r is None
    assert G.ridge(flat, ["x"], "y").first().r2_pct is None


@pytest.mark.parametrize("by", [[], ["shop"]])
def test_every_intent_is_answered(spark, sales, by):
    facts = FT.fact_table(sales, by, ["kind"], ["y"], "day", ["x", "z"], "y").cache()
    shops = [r.shop for r in sales.select("shop").distinct().collect() if r.shop] if by else [None]
    texts = [*fixed.SUGGESTED_QUESTIONS, "How many rows are there?", "Is there any danger?", "Hello"]
    asked = [(f"{i}:{s}", s, t) for i, t in enumerate(texts) for s in shops]
    out = FT.answer_from_facts(spark.createDataFrame(asked, "q string, shop string, t string"), "q", "t", facts, by).collect()
    assert len(out) == len(asked) and not [r for r in out if r.answer.startswith("No facts")]
    assert {r.intent for r in out} == {n for n, _ in fixed.INTENTS} | {fixed.FALLBACK_INTENT}
    sizes = {r["key"] + r.metric: r.value for r in facts.where("topic in ('size', 'quality')").collect()} if not by else {}
    if sizes:
        assert sizes["tablerows"] == 407 and sizes["tablerepeated_rows"] == 7 and sizes["tablecolumns"] == 6
        assert sizes["kindmissing_pct"] == pytest.approx(100 * sum(i % 4 == 3 for i in [*range(400), *range(7)]) / 407)
    lines = FT.report_sections(facts, by, 3)
    per = Counter((tuple(r[b] for b in by), r.section) for r in lines.where("ord > 0").collect())
    assert max(per.values()) <= 3 and {s for _, s in per} == set(range(1, 10))


def test_small_reports_are_risks(sales):
    facts = FT.fact_table(sales, ["shop"], ["kind"], ["y"], "day")
    found = facts.where("topic = 'risks' and key like 'Small Dataset%'").count()
    assert found == 4   # three shops and the rows without one
    assert FT.fact_table(sales.limit(0), ["shop"], ["kind"], ["y"], "day").count() == 0


def test_drawn_samples(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, c string")
    test = M.drawn_split(df, "k", "c")
    per = {r.c: (r.t, r.n) for r in test.groupBy("c").agg(F.sum(F.col("test").cast("int")).alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == math.ceil(n * 0.2) for t, n in per.values()) and len(per) == 4
    again = M.drawn_split(df.repartition(7), "k", "c")
    assert sorted(map(tuple, test.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    folds = Counter((r.c, r.fold) for r in M.drawn_folds(df, "k", "c").collect())
    for c in ("a", "b", "c", None):
        n = [folds[c, f] for f in range(5)]
        assert max(n) - min(n) <= 1
    assert M.drawn_split(df.limit(0), "k", "c").count() == 0


@pytest.mark.parametrize("name", ["Logistic Regression", "Gradient Boosting"])
def test_more_than_two_classes(spark, name, monkeypatch):
    """Three classes: softmax against a Newton solution, boosting by one
    against the rest; scores by fold."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 2))
    y = np.argmax(x @ np.array([[2.0, -1.0, 0.0], [0.0, 1.0, -2.0]]) + rng.gumbel(size=(240, 3)), 1)
    df = spark.createDataFrame([(float(a), float(b), "xyz"[c]) for (a, b), c in zip(x, y)], "a double, b double, c string")
    p = M.prepare(df, "c")
    if name == "Gradient Boosting":
        from pyspark.ml.classification import GBTClassifier, OneVsRest
        made = M.estimators("classification", 3, 240)[name][0]
        assert isinstance(made, OneVsRest) and isinstance(made.getClassifier(), GBTClassifier)
        assert made.getClassifier().getMaxIter() == 100
        fast = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=1)
        monkeypatch.setattr(M, "estimators", lambda *a, **k: {name: (OneVsRest(classifier=fast), False)})
    scores = M.cross_validate(p, name).collect()
    assert sorted(r.fold for r in scores) == list(range(5)) and sum(r.score for r in scores) / 5 > 0.55
    if name == "Logistic Regression":
        est, weighted = M.estimators("classification", 3, 240)[name]
        last = M._fit(name, est, weighted, p.data, p.features, p.task).stages[-1]
        n = np.bincount(y)
        weight = (240 / (3 * n))[y]
        design = np.hstack([x, np.ones((240, 1))])
        b = np.zeros((3, 3))
        for _ in range(60):   # Newton steps on the penalised weighted softmax
            s = design @ b.T
            q = np.exp(s - s.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            pen = np.array([1.0, 1.0, 0.0])
            grad = (weight[:, None] * (q - np.eye(3)[y])).T @ design + b * pen
            hess = np.zeros((9, 9))
            for i in range(3):
                for j in range(3):
                    d = weight * q[:, i] * ((i == j) - q[:, j])
                    hess[i * 3:i * 3 + 3, j * 3:j * 3 + 3] = design.T @ (d[:, None] * design)
            hess += np.diag(np.tile(pen, 3)) + 1e-9 * np.eye(9)
            b -= np.linalg.solve(hess, grad.ravel()).reshape(3, 3)
        assert np.allclose(last.coefficientMatrix.toArray(), b[:, :2], atol=2e-3)
        assert len(M.model_importances(M._fit(name, est, weighted, p.data, p.features, p.task), p.features)) == 2


def test_tfidf(spark):
    docs = [(1, "the cat sat the"), (2, "The dog"), (3, None), (4, "  "), (5, "dog dog cat x")]
    df = spark.createDataFrame(docs, "id long, t string")
    got = {(r.id, r.term): (r.tf, r.weight) for r in T.tfidf(df, "id", "t").collect()}
    words = {i: Counter((t or "").lower().split()) for i, t in docs}
    n = Counter(w for c in words.values() for w in c)
    for i, c in words.items():
        raw = {w: f * (math.log(6 / (n[w] + 1)) + 1) for w, f in c.items()}
        for w, f in c.items():
            assert got[i, w] == (f, pytest.approx(raw[w] / math.sqrt(sum(v * v for v in raw.values()))))
    assert len(got) == sum(map(len, words.values()))
    top = T.tfidf_topk(spark.createDataFrame([(9, "dog cat unknown"), (8, None)], "q long, t string"), "q", "t", df, "id", "t", 2).collect()
    assert [(r.q_id, r.c_id, r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [(9, 5, 1), (9, 2, 2)] or \
        [r.c_id for r in sorted(top, key=lambda r: r["rank"])][0] == 5
    assert T.tfidf(df.limit(0), "id", "t").count() == 0


def test_dictionary_needs_no_broadcast(spark, monkeypatch):
    values = [None if i % 97 == 0 else f"v{(i * 7919) % 500:03d}" for i in range(3000)]
    df = spark.createDataFrame([(i, v, "nan" if i % 2 else None) for i, v in enumerate(values)], "k long, a string, b string")
    monkeypatch.setattr(M, "DICT_BROADCAST_BYTES", 0)
    names = sorted({v or "nan" for v in values})
    got = {r.k: (r.a, r.b) for r in M.encode_strings(df, ["a", "b"]).collect()}
    assert got == {i: (float(names.index(v or "nan")), 0.0) for i, v in enumerate(values)}
    p = M.prepare(df, "a")
    assert p.n_classes == len(names) and [r.value for r in p.labels.orderBy("code").collect()] == names


def test_csv_loses_no_digit(spark, tmp_path):
    from tallyframe.sources import files as S
    rows = [("12345678901234567890", "007", "1", "9007199254740993", "1.5", "-3", "1e3"),
            ("98765432109876543210", "070", "+2", "0.5", "22.25", "0", "0.30000000000000004")]
    back = S.read_csv(spark, S.write_csv(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string"),
                                         str(tmp_path / "ids")))
    assert [t for _, t in back.dtypes] == ["decimal(38,0)", "string", "string", "string", "double", "bigint", "double"]
    assert sorted(str(r.a) for r in back.collect()) == sorted(r[0] for r in rows)
    assert sorted(r.g for r in back.collect()) == [0.30000000000000004, 1000.0]


@pytest.mark.parametrize("sketch", [40_000, 50])
def test_exact_quantiles(spark, sketch, monkeypatch):
    """Brackets of a sketch lose no rank, with ties, gaps and few values."""
    from tallyframe.operators import profile as P
    monkeypatch.setattr(P, "SKETCH", sketch)
    rng = np.random.default_rng(9)
    cols = {"a": rng.normal(size=3000), "b": rng.integers(0, 3, 3000) * 1.0, "c": np.exp(rng.normal(size=3000) * 5),
            "d": np.where(np.arange(3000) < 7, np.arange(3000) * 1.0, np.nan), "e": np.full(3000, np.nan)}
    rows = [tuple(None if v != v and i % 2 else float(v) for v in r) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {(r.column, r.prob): r.value for r in P.exact_quantiles(df, list(cols), probs).collect()}
    want = {(c, p): np.quantile(x[~np.isnan(x)], p) for c, x in cols.items() for p in probs if (~np.isnan(x)).any()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12)
    assert P.exact_quantiles(df.limit(0), ["a"]).count() == 0


def test_equal_names_get_numbers(spark):
    from tallyframe.operators import clean as C
    df = spark.range(1).selectExpr("1 as `a b`", "2 as `a-b`", "3 as `A_B`", "4 as `a_b_2`", "5 as `#`", "6 as `%`")
    assert C.snake_case_columns(df).columns == ["a_b", "a_b_2", "a_b_3", "a_b_2_2", "column", "column_2"]


def test_tfidf_texts_are_dealt_once(spark, monkeypatch):
    """No shuffle of terms after the texts are dealt by id, and a null id
    has no vector but counts as a text; broadcast or not, the same."""
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (2, "c"), (None, "a"), (3, None)], "id long, t string")
    got = sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in T.tfidf(df, "id", "t").collect())
    plan = T.tfidf(df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [x[:3] for x in got] == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 2)]
    told = T._told
    monkeypatch.setattr(T, "_told", lambda d, size: told(d, size, -1))
    assert got == sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in T.tfidf(df, "id", "t").collect())


@pytest.mark.parametrize("few", [0, 1000])
def test_gram_of_many_segments(spark, monkeypatch, few):
    """Segments one by one or many at once: sums of plain numpy; a task of
    many segments gives back each but once."""
    monkeypatch.setattr(G, "FEW_SEGMENTS", few)
    rng = np.random.default_rng(2)
    rows = [(None if i % 41 == 0 else i % 41, "pq"[i % 2], float(rng.normal()), None if i % 5 == 0 else float(i % 7), NAN if i % 11 == 0 else 2.0 * i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "g int, h string, x double, y double, z double").repartition(6)
    got = {(r.g, r.h, r.i, r.j): r for r in G.gram(df, ["x", "y", "z"], ["g", "h"]).collect()}
    assert len(got) == len({r[:2] for r in rows}) * 6
    for g, h in {r[:2] for r in rows}:
        part = np.array([[NAN if v is None else v for v in r[2:]] for r in rows if r[:2] == (g, h)])
        for i in range(3):
            for j in range(i, 3):
                both = part[~np.isnan(part[:, [i, j]]).any(1)][:, [i, j]]
                r = got[g, h, i, j]
                assert r.n == len(both)
                c = lambda sij, si, sj: sij - si * sj / max(r.n, 1)
                want = ((both - both.mean(0)).prod(1).sum(), ((both - both.mean(0)) ** 2).sum(0)) if len(both) else (0.0, (0.0, 0.0))
                assert c(r.sij, r.si, r.sj) == pytest.approx(want[0], abs=1e-6)
                assert (c(r.sii, r.si, r.si), c(r.sjj, r.sj, r.sj)) == (pytest.approx(want[1][0], abs=1e-6), pytest.approx(want[1][1], abs=1e-6))
