"""Suffix dedup of passages planted in clean texts, by the contract's length."""

import random

from tallyframe.llm import suffix_dedup as D


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))

    def passage(least, below):
        while True:
            t = words(rng.randint(51, 120))
            if least <= len(t) < below:
                return t

    long, short = [passage(400, 2000) for _ in range(10)], [passage(0, 400) for _ in range(5)]
    kind = {i: ("long", "short", "clean")[i % 3] for i in range(120)}
    texts = {i: "\n".join([words(60), *{"long": [long[i % 10]], "short": [short[i % 5]], "clean": []}[k], words(60)])
             for i, k in kind.items()}
    found = D.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    held = {r.doc_id: len(long[r.doc_id % 10]) for r in found if kind[r.doc_id] == "long"}
    assert all(r.n_removed >= held[r.doc_id] for r in found if r.doc_id in held)   # all caught, whole
    assert all(r.n_removed == 0 for r in found if kind[r.doc_id] == "clean")       # all left alone
    assert all(r.n_removed == 0 for r in found if kind[r.doc_id] == "short")       # below 400 bytes: not to be removed
