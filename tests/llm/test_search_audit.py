"""Ranked search, top-k products and the source audit against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import ODD


def got(df):
    return Counter(tuple(r) for r in df.collect())


def corpus(n=400, seed=5):
    """Texts of a skewed vocabulary, with copies, in one hot source."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"Wört{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60])))
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((i, text, rng.choice(["en", "de", None]), source))
    return rows + [(n + i, rows[9][1], "en", "hot") for i in range(n // 3)]


@pytest.mark.parametrize("lot", [None, 40])
def test_search(spark, lot, monkeypatch):
    from tallyframe.llm import lexical_search as L
    docs = corpus()
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(300)] + ["w1", "wört14", "w2"], k=rng.randint(1, 30)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    if lot:   # many blocks of items, many runs of documents
        monkeypatch.setattr(L, "ITEM_BYTES", 2000)
        frame = frame.repartition(12)
    out = L.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got(out) == Counter(brute.lexical_search([d[:2] for d in docs], items))


def test_search_runs_limit_accumulators():
    """Later terms open no accumulators, and scores stay exact."""
    import pyarrow as pa
    from tallyframe.llm import lexical_search as L
    rng = np.random.default_rng(2)
    n = 3000
    at, tf = [], []
    for d in range(n):
        here = sorted({0} | ({1} if d < 15 else set()) | ({2} if rng.random() < 0.6 else set()))
        at.append(here)
        tf.append([int(x) for x in rng.integers(1, 5, len(here))])
    run = pa.table({"id": pa.array(range(n)), "n": pa.array([len(a) + 3 for a in at]), "at": pa.array(at, pa.list_(pa.int32())),
                    "tf": pa.array(tf, pa.list_(pa.int64()))})
    index = L._Index(run, n, 5 * n)
    full = np.zeros(n, np.int64)
    terms = [(1, 9000), (2, 300), (0, 1)]
    for t, w in terms:
        a, b, _ = index.slices[t]
        full[index.doc[a:b]] += index.impact[a:b] * w
    found, values = L.search_run(index, terms, 10, 0)
    assert set(found) <= set(range(15)) and (values == full[found]).all()
    assert set(np.argsort(-full, kind="stable")[:10]) <= set(found)
    assert not len(L.search_run(index, terms, 10, int(full.max()) + 10**12)[0])


def test_search_long_text(spark):
    """A term is cut by no piece of a long text."""
    from tallyframe.llm import lexical_search as L
    text = ("lorem ipsum Dolor " * 90_000) + "needle"
    assert L.term_counts(text.encode()) == Counter(t.encode() for t in brute.terms(text))
    docs = [(1, text), (2, "needle in a stack"), (3, "dolor")]
    out = L.search(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame([(7, "needle dolor dolor")], "item_id long, text string"))
    assert got(out) == Counter(brute.lexical_search(docs, [(7, "needle dolor dolor")]))


def test_search_odd(odd, empty, spark):
    from tallyframe.llm import lexical_search as L
    items = [(1, "the quick alpha"), (1, "the quick alpha"), (2, None), (3, ""), (None, "Fox テスト"), (4, "absent")]
    rows = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    want = Counter(brute.lexical_search([o[:2] for o in ODD], [(i, t or "") for i, t in items]))
    assert got(L.search(odd, rows)) == want
    assert L.search(empty, rows).count() == 0 and L.search(odd, rows.limit(0)).count() == 0


def vectors(n=3000, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) * np.exp(rng.normal(size=(n, 1)))
    v[: n // 3] = v[0]                                   # a third are one vector
    v[n // 3: n // 2] = v[1] + rng.normal(size=(n // 2 - n // 3, dims)) * 0.01   # and close ones
    return [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, small, monkeypatch):
    from tallyframe.llm import vector_topk as V
    rows = vectors(600 if small else 3000)
    if small:   # many buckets, teams and blocks
        for name, n in (("BUCKET_ROWS", 16), ("BLOCK_ROWS", 8), ("GROUP", 2)):
            monkeypatch.setattr(V, name, n)
    every = 5 if small else 50
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = V.top_products(frame, F.col("id") % every == 0)
    assert got(out) == Counter(brute.vector_topk(rows, lambda i: i % every == 0))


@pytest.mark.parametrize("cosine", [0.2, 0.6, 0.95])
def test_coordinates_lose_nothing(cosine):
    from tallyframe.llm import vector_topk as V
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2000, 6)) * rng.uniform(0.5, 2, size=(2000, 1))
    bucket = V.Bucket(v, np.linalg.norm(v, axis=1))
    bucket.sort()
    for q in rng.normal(size=(40, 6)):
        q /= np.linalg.norm(q)
        close = np.flatnonzero(bucket.unit @ q >= cosine)
        assert set(close) <= set(bucket.near(q, cosine).tolist())


def test_topk_ways(spark):
    """Both ways are taken, and buckets below the needed length skipped."""
    from tallyframe.llm import vector_topk as V
    rng = np.random.default_rng(3)
    tight = np.floor(256 * (np.ones((60, 8)) + rng.normal(size=(60, 8)) * 0.02))
    other = rng.normal(size=(500, 8))
    v = np.vstack([tight, np.floor(740 * other / np.linalg.norm(other, axis=1)[:, None])])
    norms = np.linalg.norm(v, axis=1)
    ids = np.arange(len(v))
    block = V._Block(ids[:20], ids[:20], norms[:20], [None] * 20, v[:20], 5)
    block.meet(V.Bucket(v, norms), ids, np.zeros(len(v), np.int64), ids)
    bucket = V.Bucket(v, norms)
    local = block.bar / block.norms / bucket.top
    assert block._cut(bucket, np.arange(20), local, block.bar / block.norms) < np.inf   # coordinates are worth it
    assert block._cut(bucket, np.arange(20), np.full(20, 0.05), np.full(20, 1.0)) == np.inf   # length is
    low = V.Bucket(v / 1000, norms / 1000)
    assert not (low.prefix(block.bar / block.norms) > 0).any()


def test_topk_odd(spark):
    from tallyframe.llm import vector_topk as V
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.0, 0.5]
    rows = [(0, v), (0, v), (50, [0.0, 0.0, 0.0]), (100, [-1.0, -2.0, 1.0]), (150, None), (200, [nan, 1.0, 1.0]),
            (250, [inf, 1.0, 1.0]), (300, [None, 1.0, 1.0]), (350, []), (400, []), (450, [1.0, 2.0]), (1, v), (None, v),
            (None, None), (500, [3e38, 1.0, 2.0]), (550, [-3e38, 1.0, 2.0]), (2, [1e30, 1e30, -1e30])]
    schema = "vec_id long, embedding array<double>, score string"
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema)
    ask = F.col("id") % 50 == 0
    assert got(V.top_products(frame, ask)) == Counter(brute.vector_topk(rows, lambda i: i is not None and i % 50 == 0))
    assert V.top_products(spark.createDataFrame([], schema), ask).count() == 0
    assert V.top_products(frame.where("vec_id = 1"), ask).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, small, monkeypatch):
    from tallyframe.llm import source_audit as A
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    if small:   # many flushes and lots
        for name, n in (("HELD", 50), ("PAIRS", 7), ("CELLS", 5), ("BROADCAST", 0)):
            monkeypatch.setattr(A, name, n)
    rows = A.audit(frame, ranks=20)
    assert got(rows) == Counter(brute.source_audit([d[1:] for d in docs], ranks=20))


def test_audit_odd(odd, empty, spark):
    from tallyframe.llm import source_audit as A
    assert got(A.audit(odd)) == Counter(brute.source_audit([(o[1], o[2], o[3]) for o in ODD]))
    assert got(A.audit(odd, least_docs=1)) == Counter(brute.source_audit([(o[1], o[2], o[3]) for o in ODD], least=1))
    assert A.audit(empty).count() == 0
    large = [(F.lit(n).cast("long"), n) for n in (0, 5, 9 * A.UNIT - 1, 9 * A.UNIT, 10**15)]
    row = spark.range(1).select(*[A._share(c, F.lit(10**16).cast("long"), F.lit(77).cast("long")) for c, _ in large]).first()
    assert list(row) == [1 + A.UNIT * (n + 1) // (10**16 + 77) for _, n in large]
