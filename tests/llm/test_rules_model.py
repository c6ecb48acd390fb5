"""Quality rules on a source that one rule errs on; the classifier against a
plain fit."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def prose(rng, words):
    return ". ".join(" ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(90)}"
                              for _ in range(12)) for _ in range(words // 12)) + "."


@pytest.mark.parametrize("share", [0.1, 0.3])
def test_rule_that_errs_on_a_source(spark, share):
    """A clean source with many symbols stays; junk that two rules know goes."""
    from tallyframe.llm import quality_rules as Q
    rng = random.Random(7)
    rows = []
    for i in range(1000):
        text = prose(rng, 120)
        if i < 1000 * share:   # signs beside words: only the rule on symbols speaks
            text = " ".join(w + "#" if n % 5 == 0 else w for n, w in enumerate(text.split(" ")))
        rows.append((i, text))
    rows += [(1000 + i, "BUY NOW!!! " * 40 + "###$$$ " * 30) for i in range(60)]
    out = {r.doc_id: r for r in Q.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i].kept for i in range(1000)) >= 995
    assert not any(out[i].kept for i in range(1000, 1060))


def test_classifier_against_plain_fit(spark, sf):
    """The same shards, rounds and averages, one after another."""
    from tallyframe.llm import quality_classifier as C
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    again = docs.where("doc_id % 7 = 0")   # repeated rows are rows of their own
    docs = docs.unionAll(again)
    got = C.fit(docs.repartition(5), labels)
    rows = (docs.join(labels, "doc_id").where("quality is not null")
            .select(F.coalesce("text", F.lit("")).alias("t"), F.col("quality").cast("double").alias("y"), F.xxhash64("doc_id").alias("h"),
                    *[F.xxhash64(F.xxhash64("doc_id"), F.lit(r)).alias(f"r{r}") for r in range(C.ROUNDS)]).collect())
    z, n = np.zeros(C.DIMENSIONS + 1), np.zeros(C.DIMENSIONS + 1)
    for turn in range(C.ROUNDS):
        total = defaultdict(list)
        for shard in range(C.SHARDS):
            a, b = z.copy(), n.copy()
            mine = sorted((r for r in rows if r.h % C.SHARDS == shard), key=lambda r: r[f"r{turn}"])
            some = [(r.y, *np.unique(C.grams(r.t), return_counts=True)) for r in mine]
            for i in np.flatnonzero(C.follow(a, b, some)):
                total[i].append((a[i], b[i]))
        for i, seen in total.items():
            z[i], n[i] = np.mean([s[0] for s in seen]), np.mean([s[1] for s in seen])
    assert len(rows) > 20 and np.allclose(got, C._weights(z, n), rtol=1e-9, atol=1e-12)
    scores = defaultdict(set)
    for r in C.score(docs, got).collect():
        scores[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in scores.values())   # repeated rows alike


def test_follow_is_ftrl():
    """One step of the update, written out; ties and repeated rows."""
    from tallyframe.llm import quality_classifier as C
    z, n = np.zeros(4), np.zeros(4)
    rows = [(1.0, np.array([0, 2]), np.array([3, 1])), (0.0, np.array([0]), np.array([2])), (0.0, np.array([0]), np.array([2]))]
    met = C.follow(z, n, rows)
    zz, nn = [0.0] * 4, [0.0] * 4
    for y, at, count in rows:
        x = {int(i): c / sum(count) * C.SCALE for i, c in zip(at, count)} | {3: 1.0}
        w = {i: -zz[i] / ((C.BETA + nn[i] ** 0.5) / C.ALPHA + C.L2) for i in x}   # L1 is 0
        p = 1 / (1 + np.exp(-np.clip(sum(w[i] * x[i] for i in x), -35, 35)))
        for i in x:
            g = (p - y) * x[i]
            zz[i] += g - ((nn[i] + g * g) ** 0.5 - nn[i] ** 0.5) / C.ALPHA * w[i]
            nn[i] += g * g
    assert C.L1 == 0 and met.tolist() == [True, False, True, True]
    assert np.allclose(z, zz) and np.allclose(n, nn)
    assert not len(C.grams("")) and (C.grams("a a a") < C.DIMENSIONS).all()
