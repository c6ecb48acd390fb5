"""Line dedup: what its bounds and bitmaps leave out can't matter."""

import random

import numpy as np

from tallyframe.llm import line_dedup as L
from tests.llm import brute


def test_sketches_lose_no_pair():
    rng = random.Random(3)
    near = 0
    for _ in range(2000):
        x = "".join(rng.choice("abcd é日") for _ in range(rng.choice([3, 9, 40, 300, 3000])))
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 60))):
            y[rng.randrange(len(y))] = rng.choice("abxy日")
        if rng.random() < 0.3:
            x, y = (z.replace("日", "b") for z in (x, "".join(y)))
        y = "".join(y)
        real = L.jaccard(L.shingles(x), L.shingles(y)) >= L.SIMILAR
        assert L.similar((x, L.codes(x)), (y, L.codes(y))) == real
        size, s = np.array([[max(1, len(z) - L.SHINGLE + 1)] for z in (x, y)]), L.sketches([x, y])
        assert not real or L.may_be_similar(size[0], size[1], s[:1], s[1:])[0]
        near += real
    assert near > 300


def test_places_of_single_lines_stay_out(spark):
    """Only lines that repeat or have a partner travel; crowds of one component and lots of short lines go through
    the salted join and the blocks."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line = lambda: " ".join(word(6) for _ in range(12))
    base, twice = line(), line()
    rows = [(i, "\n".join(line() for _ in range(20))) for i in range(100)]
    rows += [(200 + i, base + word(1 + i % 3) + "\n" + twice) for i in range(30)]
    rows += [(300, "\n".join(["again and again it stands in one text"] * 3 + ["ab", "", "日本"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places, _ = L.near_lines(docs.selectExpr("doc_id id", "xxhash64(text) mark", "text"))
    assert 30 + 30 + 3 <= places.count() <= 70
    out, name = L.dedup_lines(docs)
    assert {r.doc_id: r.text for r in out.collect()} == dict(brute.line_dedup(rows))
    assert {r.doc_id: r[1] for r in out.select("doc_id", f"{name}.n_lines").collect()} == {
        i: len(t.split("\n")) for i, t in rows}


def test_salted_crowd(spark, monkeypatch):
    monkeypatch.setattr(L, "CROWD", 5)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, base[:i] + "~" + base[i:] + ("\nonce more" if i % 2 else "")) for i in range(0, 120, 3)]
    out, _ = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(brute.line_dedup(rows))
