"""Operators against plain versions, libraries, properties and SQL twins."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_edges import vocabulary


def test_sql_twins(spark, sf):
    from tests.oracle_check import run
    from tallyframe.llm.sql import ORACLE
    bad = {k: v for k, v in run(sf, list(ORACLE), spark=spark, verbose=False).items() if not v[0]}
    assert not bad


def test_simhash_query(spark, sf, rows):
    from tallyframe.llm.queries import op5_simhash
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in op5_simhash(spark, sf).collect())
    want = brute.simhash_groups([r[:2] for r in rows])
    assert got == Counter((r[0], f"{f:016x}", c) for r, (f, c, _) in zip(rows, want))


@pytest.mark.parametrize("crowded", [1, 3, 32])
def test_simhash_crowds(spark, crowded):
    """Chains and crowds of fingerprints: pair joins and single flips agree
    with all pairs."""
    from tallyframe.llm import simhash as S
    from tallyframe.llm.components import connected_components
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(60):
            f = b
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded=crowded)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    u = brute.Union()
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                u.join(a, b)
    groups = lambda f: Counter(Counter(map(f, fps)).values())
    sign = dict(zip(fps, signed))
    assert groups(lambda f: roots.get(sign[f], sign[f])) == groups(u.root)


def test_components(spark):
    from tallyframe.llm.components import connected_components
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(7, None), (5, 5)]
    out = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def test_classifier_query(spark, sf):
    from tallyframe.llm.queries import op2_quality_classifier
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = op2_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins > 0.95 * len(good) * len(bad)
    assert sum(r.predicted for r in out if r.quality) > 0.97 * len(good)


def test_flow_is_cheapest():
    """Against all splits of small overlapping patterns."""
    from itertools import product
    from tallyframe.llm.source_mix import cheapest_flow
    rng = random.Random(1)
    for _ in range(30):
        arcs = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in range(2)]
        supply, ask = [rng.randint(0, 3) for _ in arcs], [rng.randint(0, 5) for _ in range(2)]
        cost = lambda x, s: sum(max(0, x - r * s) for r in (1, 2)) if s else 0
        best = max((sum(map(sum, x)), -sum(cost(sum(f), s) for f, s in zip(x, supply)))
                   for x in product(*[[f for f in product(range(6), repeat=len(a)) if sum(f) <= 3 * s]
                                      for a, s in zip(arcs, supply)])
                   if all(sum(f[a.index(j)] for f, a in zip(x, arcs) if j in a) <= ask[j] for j in range(2)))
        got = cheapest_flow(supply, ask, arcs, 3)
        assert all(sum(f.get(j, 0) for f in got) <= ask[j] for j in range(2))
        assert (sum(sum(f.values()) for f in got),
                -sum(cost(sum(f.values()), s) for f, s in zip(got, supply))) == best


def test_overlapping_sources(spark):
    """Documents of two sources fill the quota that single ones can't."""
    from tallyframe.llm import source_mix as X
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(10 + i, "w " * 10, ["a", "b"]) for i in range(20)] \
        + [(30 + i, "w " * 10, ["b"]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out, name, sources = X.mix(docs)
    target = sum(r.target for r in sources.collect())
    got = out.select(F.col(f"{name}.copies"), F.col(f"{name}.size")).collect()
    assert abs(sum(r.copies * r.size for r in got) - target) <= 20 and max(r.copies for r in got) <= 3


def test_mix_query(spark, sf, rows):
    from tallyframe.llm.queries import op4_source_mix
    got = {r.doc_id: (r.size, r.source_size, r.taken) for r in op4_source_mix(spark, sf).collect()}
    want = brute.mix(rows)
    assert got == {r[0]: (n, s, n * c) for r, (n, s, _, c) in zip(rows, want)}


def test_line_dedup_query(spark, sf, rows):
    from tallyframe.llm.queries import op9_line_dedup
    got = {r.doc_id: r.text for r in op9_line_dedup(spark, sf).collect()}
    assert got == dict(brute.line_dedup([r[:2] for r in rows]))


def test_line_families(spark):
    """Variants of one line that are each near it, but not near each other."""
    from tallyframe.llm import line_dedup as L
    rng = random.Random(5)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25))
    words = base.split()
    texts = []
    for i in range(120):
        w = list(words)
        w[i % 25] = "".join(rng.choice("pqrstuvw") for _ in range(6))
        if i % 3 == 0:
            w[(i * 7) % 25] = "".join(rng.choice("pqrstuvw") for _ in range(6))
        texts.append(" ".join(w))
    rows = [(i, f"{t}\n{base if i % 9 == 0 else ''}") for i, t in enumerate(texts)]
    out, _ = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(brute.line_dedup(rows))


def test_difference_cover():
    from tallyframe.llm.suffix_dedup import difference_cover, pack, spans, unpack
    v, cover = difference_cover()
    assert v == 183 and len(cover) == 14 and {(a - b) % v for a in cover for b in cover} == set(range(v))
    numbers = np.array([0, 3, 258, 513, 513 + 255, 10**6])
    assert unpack(pack(numbers)).tolist() == numbers.tolist()
    assert [x.tolist() for x in spans(np.array([5, 10, 405, 900, 1300]))] == [[5, 900], [805, 1700]]


def test_suffix_query(spark, sf, rows):
    from tallyframe.llm.queries import op6_suffix_dedup
    out = op6_suffix_dedup(spark, sf).collect()
    got = Counter(tuple(r)[:5] for r in out)
    assert all(r.kept_bytes == r.n_bytes - r.n_removed for r in out)
    want = brute.suffix_dedup([r[1] for r in rows])
    assert got == Counter((r[0], n, g, s, hashlib.sha256(k).hexdigest()) for r, (n, g, s, k) in zip(rows, want))


def test_suffixes_across_segments(spark, monkeypatch):
    """Passages at all offsets, over segment and run borders."""
    from tallyframe.llm import suffix_dedup as D
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 950)]
    rows = [(i, text(rng.randint(0, 1200)) + rng.choice(passages) + text(rng.randint(0, 900))) for i in range(40)]
    rows.append((99, ("ab" * 700) + text(3000) + passages[3][:500]))
    monkeypatch.setattr(D, "SEGMENT", 1000)
    monkeypatch.setattr(D, "RUN_BYTES", 6000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256)
           for r in D.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.suffix_dedup([t for _, t in rows])
    assert got == {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, want)}


def test_token_queries(spark, sf, rows):
    import sentencepiece
    from tokenizers import Tokenizer
    from tallyframe.llm.queries import op10_bpe, op8_token_count
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = Counter(tuple(r) for r in op8_token_count(spark, sf).collect())
    sizes = [len(x) for x in lib.encode([r[1] for r in rows])]
    assert got == Counter((r[0], len(r[1].encode()), n, n > 4096) for r, n in zip(rows, sizes))
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [x.ids for x in lib.encode_batch([r[1] for r in rows], add_special_tokens=False)]
    got = Counter(tuple(r) for r in op10_bpe(spark, sf).collect())
    assert got == Counter((r[0], len(i), sha(",".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False)))
                          for r, i in zip(rows, ids))


@pytest.fixture(scope="module")
def tokenizers_():
    import sentencepiece
    from tokenizers import Tokenizer
    from tallyframe.llm import bpe, token_count
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return (bpe.ByteEncoder(bpe.ByteVocabulary(a)), Tokenizer.from_file(a),
            token_count.PieceCounter(token_count.PieceVocabulary(b)), sentencepiece.SentencePieceProcessor(model_file=b))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text("ab \n\t▁éß日\U0001F600<|>endoftx0123's!", max_size=600)))
def test_tokenizers_agree(tokenizers_, text):
    encoder, lib, counter, pieces = tokenizers_
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert encoder.encode([text])[0][0] == ",".join(map(str, lib.encode(text, add_special_tokens=False).ids))
    assert counter.count([text])[0] == len(pieces.encode(text))


def test_long_words(tokenizers_):
    encoder, lib, counter, pieces = tokenizers_
    rng = random.Random(4)
    for n in (127, 128, 129, 130, 257, 5000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert encoder.encode([text])[0][0] == ",".join(map(str, lib.encode(text).ids))
        assert counter.count([text])[0] == len(pieces.encode(text))


def test_lattice():
    from tallyframe.llm import embedding_dedup as E
    rng = np.random.default_rng(0)
    near = E.minimal_vectors()
    assert len(np.unique(near, axis=0)) == 240 and np.allclose((near ** 2).sum(1), 2)
    p = rng.normal(size=(500, 8)) * 3
    c = E.nearest(p)
    assert (((p - c) ** 2).sum(1) <= 1 + 1e-9).all()                       # covering radius 1
    assert all((((x - y) ** 2).sum() <= ((x - y - near) ** 2).sum(1) + 1e-9).all() for x, y in zip(p, c))


def test_embedding_recall(spark):
    """Links at the threshold itself, in crowds over several blocks."""
    from tallyframe.llm import embedding_dedup as E
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    x = np.concatenate([c + rng.normal(size=(30, 64)) * s for c, s in zip(centre, np.linspace(0.05, 0.3, 40))]).astype("f4")
    x = np.concatenate([x, centre[:1] + rng.normal(size=(1500, 64)) * 0.1]).astype("f4")
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in E.near_vectors(df).collect()}
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None]
    true = ((d @ d.T) >= 0.93).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum()


def test_pipeline(spark, sf, rows):
    """Rows of the pipeline against the plain stages in turn."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    now = [r for r, k in zip(rows, brute.quality_rules([x[:2] for x in rows])) if k]
    texts = dict(brute.line_dedup([r[:2] for r in now]))
    now = [(i, texts[i], s) for i, _, s in now]
    now = [r for r, (_, c, _) in zip(now, brute.simhash_groups([r[:2] for r in now])) if r[0] == c]
    want = Counter()
    for (i, t, _), (*_, copies) in zip(now, brute.mix(now)):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += copies
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, sf).collect())
    assert got == +want
