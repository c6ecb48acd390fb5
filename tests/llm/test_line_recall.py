"""Share of line pairs at the threshold that a band key of line dedup joins."""

import random

from tallyframe.llm import line_dedup as L


def test_recall_of_short_lines():
    rng, a, b = random.Random(11), [], []
    while len(a) < 3000:
        x = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(10, 40) + 7)]
        y = list(x)
        i = rng.choice([rng.randrange(len(y)), 0, len(y) - 1])
        if rng.random() < 0.5:
            y[i] = rng.choice("0123456789")
        else:
            y.insert(i, rng.choice("0123456789"))
        if i == len(x) - 1:
            y = y[:-rng.randint(1, 3)]
        x, y = "".join(x), "".join(y)
        if 0.8 <= L.jaccard(L.shingles(x), L.shingles(y)) <= 0.85:
            a.append(x)
            b.append(y)
    assert (L.band_keys(a) == L.band_keys(b)).any(1).mean() >= 0.999
