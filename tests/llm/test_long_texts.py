"""Texts of millions of characters, and what stages do to odd rows."""

import random
from collections import Counter

from tests.llm import brute
from tests.llm.conftest import ODD


def long_text(words=330_000, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklmn" for b in "aeiou" for c in ("", "ra", "sil", "von", "wex")]
    lines = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(words // 30)]
    return "\n".join(lines + lines[:5] + ["Released under the MIT License."])


def test_long_texts(spark):
    """One text of about 2 MB beside short ones, in four operators."""
    from tallyframe.llm import lexical_search as S, license_scan as C, line_dedup as L, quality_rules as Q, source_audit as A
    text = long_text()
    assert len(text) > 1_500_000
    rows = [(1, text, "en", "a"), (2, text[:500], "en", "b"), (3, "short", "en", "b"), (4, text[200:900], "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.score(docs).collect()}
    for i, t, *_ in rows:
        r = got[i]
        n, chars, symbols, dups, repeats = brute.base_features(t)[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
    out, name = L.dedup_lines(docs)
    gone = {r.doc_id: r[name].n_gone for r in out.collect()}
    first = text.split("\n")
    assert gone[1] == len(first) - len(set(first)) and gone[2] >= 1 and gone[4] >= 1
    licences = {r.doc_id: r.licence for r in C.scan(docs).collect()}
    assert licences[1] == "MIT" and licences[3] is None
    items = spark.createDataFrame([(1, "license barra short")], "item_id long, text string")
    assert Counter(map(tuple, S.search(docs, items).collect())) == Counter(
        brute.lexical_search([r[:2] for r in rows], [(1, "license barra short")]))
    assert Counter(map(tuple, A.audit(docs).collect())) == Counter(brute.source_audit([r[1:] for r in rows]))


def test_stage_values(spark, odd):
    """What each stage says of nulls, empty texts and repeated rows."""
    import corpus_pipeline as P
    stage = dict(P.STAGES)
    kept = stage["quality rules"](spark, odd, "").collect()
    assert all((r.text or "").strip() for r in kept) and Counter(r.doc_id for r in kept)[1] in (0, 2)
    lines = stage["line dedup"](spark, odd, "").collect()
    assert len(lines) == len(ODD) and Counter(r.text is None for r in lines) == Counter(o[1] is None for o in ODD)
    assert len({r.text for r in lines if r.doc_id == 1}) == 1
    near = stage["SimHash near-dedup"](spark, odd, "").collect()
    assert sum(not (r.text or "").split() for r in near) == 1 and Counter(r.doc_id for r in near)[1] == 1
    mixed = stage["source mix"](spark, odd, "").collect()
    assert all((r.text or "").strip() for r in mixed) and {r.source for r in mixed} >= {"a"}
    ids = stage["BPE encoding"](spark, odd, "").collect()
    assert len(ids) == len(ODD)
    texts = {(o[0], o[1] or "") for o in ODD}
    assert all(r.n_tokens == 0 for r in ids if (r.doc_id, "") in texts and len([t for t in texts if t[0] == r.doc_id]) == 1)
