"""Every operator and stage on odd rows, on an empty table, on extra columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import ODD

NO_TEXT = hashlib.sha256(b"").hexdigest()


def vocabulary(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_quality_rules(odd, empty):
    from tallyframe.llm import quality_rules as Q
    out = Q.score(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((o[0], brute.base_features(o[1])[0]) for o in ODD)
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 20)
    want = Counter(key(o) for o, k in zip(ODD, brute.quality_rules([o[:2] for o in ODD])) if k)
    assert Counter(key(r) for r in Q.keep_good(odd).collect()) == want
    assert Q.score(empty).count() == 0 and Q.keep_good(empty).columns == empty.columns


def test_classifier(spark, odd, empty):
    from tallyframe.llm import quality_classifier as C
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    w = C.fit(odd, labels)
    out = C.score(odd, w).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({round(r.score, 12) for r, o in zip(out, ODD) if not (o[1] or "").strip()}) == 1
    assert not C.fit(empty, labels).any() and C.score(empty, w).count() == 0


def test_embeddings(spark):
    from tallyframe.llm import embedding_dedup as E
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 0.0, 1.0], 1), (4, v, 2), (5, v, None), (6, None, 1),
            (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1),
            (11, [], 1), (12, [1.0, 0.0, 0.5, 0.0], 1), (None, v, 1), (None, None, None)]
    schema = "vec_id long, embedding array<float>, label int"
    out = E.near_vectors(spark.createDataFrame(rows, schema).withColumn("rep", F.lit(1))).collect()
    links = {1: 4, 2: 4, 3: 4}
    for r in out:
        if r.vec_id is not None:
            assert r.n_links == links.get(r.vec_id, 0)
            assert r.component_id == (1 if r.vec_id in links else r.vec_id) and r.kept == (r.component_id == r.vec_id)
    assert Counter((r.n_links, r.component_id) for r in out if r.vec_id is None) == Counter([(4, 1), (0, None)])
    assert E.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_mix(odd, empty, spark):
    from tallyframe.llm import source_mix as X
    out, name, sources = X.mix(odd)
    want = brute.mix([(o[0], o[1], o[3]) for o in ODD])
    got = out.select(F.col(f"{name}.size"), F.col(f"{name}.copies")).collect()
    assert sum(r.size for r in got) == sum(w[0] for w in want)
    target = {r.source: r.target for r in sources.collect()}
    assert target == {o[3]: w[2] for o, w in zip(ODD, want)}
    assert all(0 <= r.copies <= 3 and (r.size or not r.copies) for r in got)
    rows = X.mixed_documents(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in got)
    assert X.mixed_documents(empty).count() == 0


def test_simhash(odd, empty):
    from tallyframe.llm import simhash as S
    found = Counter((r.id, r.fingerprint % 2**64, r.component) for r in S.near_duplicates(odd).collect())
    want = brute.simhash_groups([o[:2] for o in ODD])
    assert found == Counter((o[0], f, c) for o, (f, c, _) in zip(ODD, want))
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c, _ in {(c, g) for _, c, g in want})
    assert S.drop_near_duplicates(empty).count() == 0


def test_suffixes(odd, empty):
    from tallyframe.llm import suffix_dedup as D
    out = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in D.repeats(odd).collect())
    want = brute.suffix_dedup([o[1] for o in ODD])
    assert out == Counter((o[0], n, g, s, hashlib.sha256(k).hexdigest()) for o, (n, g, s, k) in zip(ODD, want))
    assert D.repeats(empty).count() == 0


def test_licences(odd, empty):
    from tallyframe.llm import license_scan as S
    out = S.scan(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(o[0] for o in ODD)
    assert {r.doc_id: r.licences for r in out if r.licence} == {1: "Apache-2.0", 9: "Apache-2.0"}
    assert all(r.dice == 1.0 and r.n_notices == 1 for r in out if r.licence) and S.scan(empty).count() == 0


def test_tokens(odd, empty):
    from tallyframe.llm import bpe, token_count
    import sentencepiece
    from tokenizers import Tokenizer
    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(odd, path).collect())
    texts = [o[1] or "" for o in ODD]
    assert out == Counter((o[0], len(t.encode()), len(lib.encode(t))) for o, t in zip(ODD, texts))
    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    encoded = bpe.encode_documents(odd, path, with_ids=True)
    ids = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in encoded.collect())
    assert out == Counter((o[0], len(i), sha(",".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False)), tuple(i))
                          for o, i in zip(ODD, ids))
    back = bpe.decode_documents(encoded, path).select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in back) == Counter((o[0], t) for o, t in zip(ODD, texts))
    assert token_count.count_tokens(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert bpe.encode_documents(empty, path).count() == 0


def test_lines(odd, empty):
    from tallyframe.llm import line_dedup as L
    out, name = L.dedup_lines(odd)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    # the two texts of id 5 share no line, so their order doesn't matter
    assert got == Counter(brute.line_dedup([o[:2] for o in ODD]))
    assert out.drop(name).columns == odd.columns and L.dedup_lines(empty)[0].count() == 0


@pytest.mark.parametrize("which", range(5))
def test_stages(spark, odd, empty, which):
    import corpus_pipeline as P
    name, stage = P.STAGES[which]
    for docs in (odd, empty):
        out = stage(spark, docs, "")
        out.collect()
        assert which == 4 or out.columns == docs.columns
