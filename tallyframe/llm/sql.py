"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from tallyframe.llm import license_scan as _s
from tallyframe.llm import quality_rules as _q
from tallyframe.llm import source_mix as _x

_WORD = r"[^\x20\x09-\x0D]+"

#: Seeded order as one running sum per source; the level that shares rise to
#: in closed form over sources by the ratio of bound and weight.
SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         md5('{_x.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM src),
steps AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         coalesce(sum(3 * source_size) OVER w, 0) AS kept,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS k,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight, sum(source_size) OVER () AS total
  FROM ranked
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(CAST(total - kept AS DOUBLE) / open_weight, k) AS l FROM steps
          WHERE CAST(total - kept AS DOUBLE) / open_weight <= cap / weight),
target AS (SELECT s.*, least(cap, weight * l) AS target FROM steps s CROSS JOIN level),
want AS (SELECT *, CAST(round(target) AS BIGINT) AS ask,
                CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS copies,
                CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS part FROM target),
run AS (SELECT d.*, w.source_size, w.target, w.copies, w.part,
               sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id) AS upto
        FROM d JOIN want w ON d.source IS NOT DISTINCT FROM w.source),
short AS (SELECT source, max(part) - coalesce(max(CASE WHEN upto <= part THEN upto END), 0) AS short FROM run GROUP BY source),
extra AS (SELECT r.source, arg_max(doc_id, (size, draw, doc_id)) AS doc_id
          FROM run r JOIN short s ON r.source IS NOT DISTINCT FROM s.source
          WHERE upto > part AND size > 0 AND size <= short GROUP BY r.source)
SELECT r.doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (copies + CASE WHEN upto <= part OR r.doc_id = e.doc_id THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run r LEFT JOIN extra e ON r.source IS NOT DISTINCT FROM e.source
"""


def _quality_rules() -> str:
    """Features by unnesting, then each round of the estimates as a table."""
    k, sep = len(_q.RULES), ",\n"
    cast = sep.join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}"
                    for j, (_, good, bad) in enumerate(_q.RULES))
    names = ", ".join(f"v{j}" for j in range(k))

    def odds(t: str) -> str:
        each = " + ".join(f"(CASE v{j} WHEN 1 THEN ln({t}.g{j} / (1 - {t}.b{j})) WHEN -1 THEN ln((1 - {t}.g{j}) / {t}.b{j})"
                          f" ELSE 0 END)" for j in range(k))
        return f"(ln({t}.prior / (1 - {t}.prior)) + {each})"

    def within(x: str, span) -> str:
        return f"greatest({span[0]}, least({span[1]}, {x}))"

    start = ", ".join(f"{_q.RIGHT_ON_GOOD}::DOUBLE AS g{j}, {_q.RIGHT_ON_BAD}::DOUBLE AS b{j}" for j in range(k))
    ctes = [f"t0 AS MATERIALIZED (SELECT {_q.PRIOR}::DOUBLE AS prior, {start})"]
    for i in range(_q.ROUNDS):
        ctes.append(f"e{i} AS MATERIALIZED (SELECT p.*, n / (1 + exp(-{odds('t')})) AS g FROM patterns p CROSS JOIN t{i} t)")
        rates = ", ".join(
            within(f"(sum(CASE WHEN v{j} = 1 THEN g ELSE 0 END) + {_q.PSEUDO * _q.RIGHT_ON_GOOD}) / "
                   f"(sum(CASE WHEN v{j} <> 0 THEN g ELSE 0 END) + {_q.PSEUDO})", _q.GOOD_RANGE) + f" AS g{j}, "
            + within(f"(sum(CASE WHEN v{j} = -1 THEN n - g ELSE 0 END) + {_q.PSEUDO * _q.RIGHT_ON_BAD}) / "
                     f"(sum(CASE WHEN v{j} <> 0 THEN n - g ELSE 0 END) + {_q.PSEUDO})", _q.BAD_RANGE) + f" AS b{j}" for j in range(k))
        prior = within(f"(sum(g) + {_q.PSEUDO * _q.PRIOR}) / (sum(n) + {_q.PSEUDO})", _q.PRIOR_RANGE)
        ctes.append(f"t{i + 1} AS MATERIALIZED (SELECT {prior} AS prior, {rates} FROM e{i})")
    last = f"t{_q.ROUNDS}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS words FROM d),
win AS (SELECT r, i, list_slice(words, i, i + 7) AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i
        FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
f AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{_q.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '{_q.LINE_END.replace("'", "''")}'))) AS BIGINT) AS n_ended_lines,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
             length(text) - length(replace(text, '!', '')) AS n_exclaims,
             length(text) - length(regexp_replace(text, '{_q.MARKS}', '', 'g')) AS n_marks
      FROM d JOIN w ON d.r = w.r JOIN lines ON d.r = lines.r LEFT JOIN rep ON d.r = rep.r),
v AS MATERIALIZED (SELECT *, {cast} FROM f),
patterns AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY {names}),
{sep.join(ctes)},
q AS (SELECT v.*, 1 / (1 + exp(-{odds('t')})) AS quality,
             n_words < {_q.MIN_WORDS} OR 100 * n_repeat_words > {_q.REPEAT_PERCENT} * n_words AS base_failed
      FROM v CROSS JOIN {last} t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND quality >= {_q.KEEP_AT} AS kept, round(quality, 4) AS quality FROM q
"""


#: All pairs of one label; the smallest id reachable by widening steps.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM v),
u AS (SELECT vec_id, label, x, norm FROM n WHERE norm > 0 AND isfinite(norm)),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(d.n, 0) AS n_links, c.root AS component_id, m.vec_id = c.root AS kept
FROM embeddings m JOIN c ON c.id = m.vec_id LEFT JOIN d ON d.a = m.vec_id
"""


def _license_scan() -> str:
    """Segments and bigrams by unnesting, templates as rows."""
    known = [(j, *t) for j, t in enumerate(_s.prepared())]
    sizes = ", ".join(f"({j}, '{name}', {m}, {low}, {high})" for j, name, m, low, high, _ in known)
    grams = ", ".join(f"({j}, '{g}', {c})" for j, *_, gs in known for g, c in gs)
    words = f"list_filter(regexp_split_to_array(lower(x), '{_s.NOT_WORD}'), lambda w: w <> '')"
    return rf"""
WITH t(t, name, m, low, high) AS (VALUES {sizes}), g(t, gram, c) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT r, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS x FROM d),
words AS (SELECT r, line, {words} AS w FROM each_line),
segs AS (SELECT r, line, w FROM words
         UNION ALL SELECT r, 0, flatten(list(w ORDER BY line)) FROM words GROUP BY r HAVING count(*) > 1),
fit AS (SELECT r, line, w, len(w) - 1 AS n FROM segs WHERE len(w) > 1 AND len(w) - 1 <= (SELECT max(high) FROM t)),
two AS (SELECT r, line, n, gram, count(*) AS c FROM (
          SELECT r, line, n, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM fit))
        GROUP BY ALL),
score AS (SELECT two.r, two.line, t.name, t.m, 2.0::DOUBLE * sum(least(two.c, g.c)) / (two.n + t.m) AS dice
          FROM two JOIN g ON two.gram = g.gram JOIN t ON t.t = g.t GROUP BY two.r, two.line, two.n, t.t, t.name, t.m),
hit AS (SELECT r, line, name, dice FROM score WHERE dice >= {_s.LEAST}
        QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, m DESC, name) = 1),
best AS (SELECT r, name, dice FROM hit
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, line = 0, line, name DESC) = 1),
total AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names,
                 string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM hit GROUP BY r)
SELECT doc_id, best.name AS licence, round(best.dice, 9) AS dice, coalesce(total.n, 0) AS n_notices,
       coalesce(total.names, '') AS licences, coalesce(total.lines, '') AS lines
FROM d LEFT JOIN best ON best.r = d.r LEFT JOIN total ON total.r = d.r
"""


#: Postings of asked terms, summed by item and document.
LEXICAL_SEARCH = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM t),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY r, term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM d CROSS JOIN c),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // l AS m FROM t CROSS JOIN c WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

#: Every query against every other row.
VECTOR_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id
         ORDER BY list_dot_product(q.x, v.x) DESC, v.vec_id) AS INTEGER) AS rank,
       v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""

#: Every kept term of every two groups.
SOURCE_AUDIT = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(lc) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, k.lc, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM x GROUP BY lang, source),
p AS MATERIALIZED (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000::HUGEINT * (x.n + 1)) // (t.n + l.v) AS p,
             1 + (1000000000::HUGEINT * (x.lc + 1)) // (l.n + l.v) AS q
      FROM x JOIN t ON t.lang = x.lang AND t.source = x.source JOIN l ON l.lang = x.lang),
a AS (SELECT g.lang, g.source, h.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source
      LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term GROUP BY g.lang, g.source, h.source),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM a
      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 200
"""


ORACLE: dict[str, str] = {
    "op1_quality_rules": _quality_rules(),
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op4_source_mix": SOURCE_MIX,
    "op7_license_scan": _license_scan(),
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_vector_topk": VECTOR_TOPK,
    "op13_source_audit": SOURCE_AUDIT,
}
