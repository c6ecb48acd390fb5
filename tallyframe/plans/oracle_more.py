"""DuckDB SQL twins for decisions, text, models and report queries."""

from __future__ import annotations

from tallyframe.plans.oracle import (LINEITEM_COLS, ORDERS_COPIES, ORDERS_KEYS, ORDERS_NOTNULL, ORDERS_SUMMARY_CTE,
                                     _agg_cols, _missing_rows)
from tallyframe.plans.oracle import _union as union

# ---------------------------------------------------------------------------
# decisions
# ---------------------------------------------------------------------------


def _f1(x):
    return f"printf('%.1f', floor(({x}) * 10 + 0.5) / 10)"


def _sf1(x):
    return f"printf('%+.1f', floor(({x}) * 10 + 0.5) / 10)"


def _n0(x):
    return "format('{:,.0f}', floor(CAST(" + x + " AS DOUBLE) + 0.5))"


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def rules_sql(cat, value, lift, share):
    """(kind, rule, order, condition, level, type, title, impact) over a row
    of figures; ``lift`` and ``share`` are expressions for D5."""
    return [
        ("risk", "D1", 0, "worst_missing_pct > 20", "CASE WHEN worst_missing_pct > 30 THEN 'High' ELSE 'Medium' END",
         "NULL", f"'Data Gap in `' || worst_missing_col || '` (' || {_f1('worst_missing_pct')} || '% missing)'", "NULL"),
        ("risk", "D2", 1, "duplicates > 0", "CASE WHEN duplicate_pct > 5 THEN 'High' ELSE 'Medium' END", "NULL",
         f"'Duplicate Records: ' || {_n0('duplicates')} || ' rows (' || {_f1('duplicate_pct')} || '%)'", "NULL"),
        ("optimization", "D2", 2, "duplicates = 0", "NULL", "NULL", "'Dataset Integrity Confirmed'",
         "'Baseline quality maintained.'"),
        ("risk", "D3", 3, "g < -10", "'Critical'", "NULL",
         f"'Significant Decline: ' || {_sf1('g')} || '% YoY in `' || primary_col || '`'", "NULL"),
        ("risk", "D3", 4, "g >= -10 AND g < 0", "'Medium'", "NULL",
         f"'Moderate Decline: ' || {_sf1('g')} || '% YoY in `' || primary_col || '`'", "NULL"),
        ("recommendation", "D3", 5, "g > 20", "'High'", "'Growth Opportunity'",
         f"'Strong Growth Momentum: ' || {_sf1('g')} || '% YoY'", "NULL"),
        ("recommendation", "D3", 6, "g >= 0 AND g <= 20", "'Medium'", "'Maintenance'",
         f"'Stable Growth: ' || {_sf1('g')} || '% YoY'", "NULL"),
        ("risk", "D4", 7, "share > 60", "CASE WHEN share > 70 THEN 'High' ELSE 'Medium' END", "NULL",
         "'Concentration Risk: ' || chr(39) || top_name || chr(39) || ' = ' || " + _f1('share')
         + " || '% of ' || primary_col", "NULL"),
        ("recommendation", "D4", 8, "share <= 60", "'High'", "'Segment Strategy'",
         f"'Leverage `' || top_name || '` — Top Segment at ' || {_f1('share')} || '%'", "NULL"),
        ("optimization", "D5", 9, "bottom3 IS NOT NULL", "NULL", "NULL",
         f"'Close Performance Gap in Bottom {cat} Segments'",
         f"'~' || {_n0(lift)} || ' incremental {value} (+' || {_f1(share)} || '%)'"),
        ("risk", "D10", None, "n_rows < 1000", "'Medium'", "NULL", f"'Small Dataset (' || {_n0('n_rows')} || ' rows)'",
         "NULL"),
    ]


MODEL_RULES = [
    ("risk", "D6", 10, "best IS NOT NULL AND gap > 15", "'Medium'", "NULL",
     f"'Model Overfitting — ' || best || ' (gap ' || {_f1('gap')} || '%)'", "NULL"),
    ("recommendation", "D7", 11, "best IS NOT NULL AND feature IS NOT NULL", "'High'", "'Model-Driven'",
     f"'Prioritize `' || feature || '` — ' || {_f1('feature_share')} || '% of Prediction Power'", "NULL"),
    ("recommendation", "D9", 12, "best IS NOT NULL AND task = 'classification' AND score < 70", "'Medium'",
     "'Model Improvement'", "'Improve Model Accuracy with More Features'", "NULL"),
    ("recommendation", "D8", 13, "best IS NOT NULL AND score >= 80", "'High'", "'Deployment Ready'",
     f"'Deploy ' || best || ' — ' || {_f1('score')} || '% Validated'", "NULL"),
]


def _fired(rules, sel, last):
    return union([f"SELECT {sel}'{k}' AS kind, '{rid}' AS rule_id, {last if o is None else o} AS ord, "
                  f"CAST({lvl} AS VARCHAR) AS level, CAST({typ} AS VARCHAR) AS type, {title} AS title, "
                  f"CAST({imp} AS VARCHAR) AS expected_impact FROM k WHERE {cond}"
                  for k, rid, o, cond, lvl, typ, title, imp in rules])


D_SUPPLIER = f"""WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey, n * 3 AS n_rows, 'l_tax' AS worst_missing_col, CAST(l_suppkey * 7 % 45 AS DOUBLE) AS worst_missing_pct,
  l_suppkey % 3 * n AS duplicates, CAST(l_suppkey * 5 % 11 AS DOUBLE) AS duplicate_pct, 'sales' AS primary_col,
  CAST(l_suppkey * 11 % 71 - 35 AS DOUBLE) AS g, 'R' || l_suppkey AS top_name, CAST(l_suppkey * 13 % 100 AS DOUBLE) AS share,
  CASE WHEN l_suppkey % 2 = 0 THEN 'B' END AS bottom3, CASE WHEN l_suppkey % 5 <> 0 THEN 'Random Forest' END AS best,
  CAST(l_suppkey * 17 % 100 AS DOUBLE) AS score, CASE WHEN l_suppkey % 4 < 2 THEN 'classification' ELSE 'regression' END AS task,
  CASE WHEN l_suppkey % 7 <> 0 THEN 'l_quantity' END AS feature, CAST(l_suppkey % 60 AS DOUBLE) AS feature_share,
  CAST(l_suppkey % 31 AS DOUBLE) AS gap, n FROM n)
{_fired(rules_sql("l_returnflag", "l_tax", "n * 4", "l_suppkey % 10") + MODEL_RULES, "l_suppkey, ", 14)}"""


def decisions_sql(by=None):
    cat = "o_orderpriority" if by else "o_orderstatus"
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    miss = union([f"SELECT {sel}'{c}' AS col, {i} AS position, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 "
                  f"AS pct FROM c {grp}" for i, c in enumerate(_ORDERS_COLS)])
    body = _fired(rules_sql(cat, "o_orderkey", "b3 * 0.1", "b3 * 0.1 / gtotal * 100"), sel, 13)
    return f"""WITH {ORDERS_SUMMARY_CTE},
c AS {ORDERS_COPIES},
q AS (SELECT {sel}count(*) AS n_rows FROM c {grp}),
d AS (SELECT {sel}count(*) AS nd FROM (SELECT DISTINCT * FROM c) x {grp}),
m AS ({miss}),
w AS (SELECT {sel}arg_max(col, pct * 1000 - position) AS worst_missing_col, max(pct) AS worst_missing_pct
      FROM m WHERE pct > 20 {grp}),
yy AS (SELECT {sel}_year, CAST(sum(tp_sum_d) AS DOUBLE) AS value FROM s WHERE _year IS NOT NULL GROUP BY ALL),
yr AS (SELECT *, row_number() OVER ({part} ORDER BY _year DESC) AS rn FROM yy),
y AS (SELECT {sel}max(CASE WHEN rn = 1 THEN _year END) AS latest_year, max(CASE WHEN rn = 2 THEN _year END) AS py,
  max(CASE WHEN rn = 1 THEN value END) AS lv, max(CASE WHEN rn = 2 THEN value END) AS pv FROM yr WHERE rn <= 2 {grp}),
y2 AS (SELECT {sel}CASE WHEN pv <> 0 THEN (lv - pv) / pv * 100 ELSE 0.0 END AS g FROM y WHERE py IS NOT NULL),
tg AS (SELECT {sel}{cat} AS name, CAST(sum(tp_sum_d) AS DOUBLE) AS value FROM s WHERE {cat} IS NOT NULL GROUP BY ALL),
tr AS (SELECT *, sum(value) OVER ({part}) AS total, row_number() OVER ({part} ORDER BY value DESC, name) AS rn FROM tg),
t AS (SELECT {sel}CAST(name AS VARCHAR) AS top_name, value / total * 100 AS share FROM tr WHERE rn = 1),
gg AS (SELECT {sel}{cat} AS name, CAST(sum(ok_sum) AS DOUBLE) AS value FROM s WHERE {cat} IS NOT NULL GROUP BY ALL),
gr AS (SELECT *, row_number() OVER ({part} ORDER BY value, name) AS rn, count(*) OVER ({part}) AS n,
  sum(value) OVER ({part}) AS gtotal FROM gg),
ga AS (SELECT {sel}first(gtotal) AS gtotal, sum(CASE WHEN rn <= 3 THEN value END) AS b3,
  string_agg(CASE WHEN rn <= 3 THEN CAST(name AS VARCHAR) END, ', ' ORDER BY rn) AS bottom3 FROM gr WHERE n >= 3 {grp}),
k AS (SELECT q.*, q.n_rows - d.nd AS duplicates, CAST(q.n_rows - d.nd AS DOUBLE) / q.n_rows * 100 AS duplicate_pct,
  w.worst_missing_col, w.worst_missing_pct, y2.g, t.top_name, t.share, ga.gtotal, ga.b3, ga.bottom3,
  'o_totalprice' AS primary_col
  FROM q LEFT JOIN d {on} LEFT JOIN w {on} LEFT JOIN y2 {on} LEFT JOIN t {on} LEFT JOIN ga {on})
{body}"""


D_DECISIONS = decisions_sql()
D_DECISIONS_BY = decisions_sql("o_orderstatus")
D11 = f"""WITH r AS ({D_DECISIONS_BY})
SELECT o_orderstatus, count(CASE WHEN kind = 'recommendation' THEN 1 END) AS recommendations,
  count(CASE WHEN kind = 'risk' THEN 1 END) AS risks, count(CASE WHEN kind = 'optimization' THEN 1 END) AS optimizations,
  count(CASE WHEN kind = 'risk' AND level IN ('Critical', 'High') THEN 1 END) AS high_risks FROM r GROUP BY 1"""

RAW = {
    "d_decisions": D_DECISIONS,
    "d_decisions_by_status": D_DECISIONS_BY,
    "d_rules_by_supplier": D_SUPPLIER,
    "d11_decision_counts": D11,
}

# ---------------------------------------------------------------------------
# text
# ---------------------------------------------------------------------------

from tallyframe.functions import fixed  # noqa: E402
from tallyframe.functions.columns import WS_CLASS  # noqa: E402

WS = WS_CLASS


def _words(x):
    stripped = f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    return (f"CASE WHEN {stripped} = '' THEN []::VARCHAR[] "
            f"ELSE regexp_split_to_array({stripped}, '{WS}+') END")


DOC_CHUNKS = f"""(WITH d AS (SELECT doc_id, text, {_words('text')} AS w FROM documents),
c AS (SELECT doc_id, text, list_filter(list_transform(range(0, greatest(1, len(w) - {fixed.CHUNK_OVERLAP}),
  {fixed.CHUNK_WORDS - fixed.CHUNK_OVERLAP}), lambda s: array_to_string(w[s + 1:s + {fixed.CHUNK_WORDS}], ' ')),
  lambda x: length(x) > {fixed.CHUNK_MIN_CHARS}) AS ch FROM d),
e AS (SELECT doc_id, CASE WHEN len(ch) > 0 THEN ch ELSE [text] END AS ch FROM c)
SELECT doc_id, CAST(generate_subscripts(ch, 1) - 1 AS INTEGER) AS chunk_no, unnest(ch) AS chunk FROM e)"""

T1 = f"""SELECT doc_id, chunk_no, CAST(len({_words('chunk')}) AS INTEGER) AS n_words,
  CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM {DOC_CHUNKS} t"""

T3 = """WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL),
cv AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label),
qn AS (SELECT label AS q_id, list_transform(v, lambda a: a / sqrt(list_sum(list_transform(v, lambda b: b * b)))) AS v FROM cv),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cn AS (SELECT vec_id AS c_id, list_transform(v, lambda a: a / sqrt(list_sum(list_transform(v, lambda b: b * b)))) AS v FROM e),
s AS (SELECT q_id, c_id, list_dot_product(qn.v, cn.v) AS score FROM qn, cn),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM s)
SELECT q_id, c_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7"""

T4 = f"""WITH q AS (SELECT format('{{}}:{{}}', conv_id, turn) AS q_id, text FROM conversations WHERE role = 'user'),
qw AS (SELECT DISTINCT q_id, unnest(list_distinct({_words('lower(text)')})) AS w FROM q),
ch AS (SELECT * FROM {DOC_CHUNKS} x),
cw AS (SELECT DISTINCT doc_id, chunk_no, unnest({_words('lower(chunk)')}) AS w FROM ch),
hits AS (SELECT q_id, doc_id, chunk_no, count(*) AS score FROM qw JOIN cw USING (w) GROUP BY ALL),
fst AS (SELECT doc_id, chunk_no FROM ch ORDER BY doc_id, chunk_no LIMIT 7),
fill AS (SELECT q_id, doc_id, chunk_no, 0 AS score FROM (SELECT DISTINCT q_id FROM q) a, fst),
b AS (SELECT q_id, doc_id, chunk_no, max(score) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM fill) u
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM b)
SELECT q_id, doc_id, chunk_no, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7"""


def _intent_case(x, intents=fixed.INTENTS):
    out = "CASE"
    for name, words in intents:
        cond = " OR ".join(f"contains(lower({x}), '{w}')" for w in words)
        out += f" WHEN {cond} THEN '{name}'"
    return out + f" ELSE '{fixed.FALLBACK_INTENT}' END"


T5 = f"SELECT conv_id, turn, {_intent_case('text')} AS intent FROM conversations"


def _sql_str(s):
    return "'" + s.replace("'", "''") + "'"


def _facts_sql(src, text, ids):
    import re
    cols = list(ids)
    for name, pat in fixed.FACT_PATTERNS:
        p = _sql_str("(?i)" + pat)
        cols.append(f"CASE WHEN regexp_matches({text}, {p}) THEN regexp_replace(regexp_extract({text}, {p}, 1), "
                    f"'\\.+\\z', '') END AS {name}")
    for name, pat in fixed.FACT_LIST_PATTERNS:
        p = _sql_str(pat)
        cols.append(f"CAST(len(regexp_extract_all({text}, {p}, 1)) AS INTEGER) AS n_{name}")
        cols.append(f"regexp_extract_all({text}, {p}, 1)[1] AS {name}_first")
        assert re.compile(pat).groups >= 1
    return "SELECT " + ",\n  ".join(cols) + f" FROM {src}"


T6 = _facts_sql("documents", "text", ["doc_id"])


def _fact_lines():
    import re
    from tallyframe.plans.tables import FACT_LINES
    value = {"k": "CAST(o_orderkey AS VARCHAR)", "c": "CAST(o_custkey AS VARCHAR)",
             "p": "CAST(o_orderkey % 90 + 10 AS VARCHAR) || '.5'", "s": "o_orderstatus", "r": "o_orderpriority"}
    parts = re.split(r"\{(\w)\}", FACT_LINES)
    return " || ".join(value[x] if i % 2 else _sql_str(x) for i, x in enumerate(parts))


T6_ORDERS = _facts_sql(f"(SELECT o_orderkey, {_fact_lines()} AS text FROM orders)", "text", ["o_orderkey"])
_ASKED = "[" + ", ".join(_sql_str(q) for q in fixed.SUGGESTED_QUESTIONS) + "]"
T5_SUGGESTED = (f"SELECT conv_id, turn, {_intent_case('text')} AS intent FROM (SELECT conv_id, turn, "
                f"{_ASKED}[(conv_id + turn) % {len(fixed.SUGGESTED_QUESTIONS)} + 1] AS text FROM conversations)")

RAW.update({
    "t1_chunks": T1,
    "t3_cosine_topk": T3,
    "t4_keyword_topk": T4,
    "t5_intents": T5,
    "t5_suggested": T5_SUGGESTED,
    "t6_facts_documents": T6,
    "t6_facts_orders": T6_ORDERS,
})

# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------

M1 = """SELECT 'l_extendedprice' AS target, CASE WHEN count(DISTINCT l_extendedprice) <= 10 THEN 'classification'
  ELSE 'regression' END AS task FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'classification'
  ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_returnflag', 'classification'
UNION ALL SELECT 'l_discount', CASE WHEN count(DISTINCT l_discount) <= 10 THEN 'classification'
  ELSE 'regression' END FROM lineitem"""

_PAD = f"""(SELECT o_orderkey,
  CASE WHEN s1 IN ('nan', 'None', '') THEN NULL ELSE s1 END AS o_orderstatus,
  CASE WHEN s2 IN ('nan', 'None', '') THEN NULL ELSE s2 END AS o_orderpriority FROM
  (SELECT o_orderkey, regexp_replace('  ' || o_orderstatus || ' ', '^{WS}+|{WS}+$', '', 'g') AS s1,
    regexp_replace(CASE WHEN o_orderkey % 11 = 0 THEN 'None' WHEN o_orderkey % 13 = 0 THEN 'nan'
       WHEN o_orderkey % 17 = 0 THEN '' ELSE chr(9) || o_orderpriority END, '^{WS}+|{WS}+$', '', 'g') AS s2
   FROM orders) a)"""

M3 = f"""WITH t AS (SELECT o_orderkey, coalesce(o_orderstatus, 'nan') AS s, coalesce(o_orderpriority, 'nan') AS p
  FROM {_PAD} x),
ds AS (SELECT s, CAST(dense_rank() OVER (ORDER BY s) - 1 AS DOUBLE) AS cs FROM (SELECT DISTINCT s FROM t) a),
dp AS (SELECT p, CAST(dense_rank() OVER (ORDER BY p) - 1 AS DOUBLE) AS cp FROM (SELECT DISTINCT p FROM t) b)
SELECT o_orderkey, cs AS o_orderstatus, cp AS o_orderpriority FROM t JOIN ds USING (s) JOIN dp USING (p)"""

_LN = """(SELECT l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"""

M4 = f"""WITH t AS (SELECT * FROM {_LN} x),
m AS (SELECT quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt FROM t),
rf AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS c
  FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM t) a),
ls AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS c
  FROM (SELECT DISTINCT coalesce(l_linestatus, 'nan') AS v FROM t) b)
SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, round(l_quantity, 4) AS l_quantity,
  round(coalesce(l_discount, m.md), 4) AS l_discount, round(coalesce(l_tax, m.mt), 4) AS l_tax,
  rf.c AS l_returnflag, ls.c AS l_linestatus, round(l_extendedprice, 4) AS label
FROM t CROSS JOIN m JOIN rf ON coalesce(t.l_returnflag, 'nan') = rf.v JOIN ls ON coalesce(t.l_linestatus, 'nan') = ls.v"""

_LINES = """(SELECT 'l_quantity' AS model, 0 AS model_order, l_extendedprice AS label,
   (SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
   + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity AS prediction FROM lineitem
 UNION ALL SELECT 'l_discount', 1, l_extendedprice,
   (SELECT regr_intercept(l_extendedprice, l_discount) FROM lineitem)
   + (SELECT regr_slope(l_extendedprice, l_discount) FROM lineitem) * l_discount FROM lineitem
 UNION ALL SELECT 'l_tax', 2, l_extendedprice,
   (SELECT regr_intercept(l_extendedprice, l_tax) FROM lineitem)
   + (SELECT regr_slope(l_extendedprice, l_tax) FROM lineitem) * l_tax FROM lineitem)"""

_REG = """SELECT model, {extra}round(CASE WHEN var_pop(label) * count(*) > 0
    THEN 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))
    WHEN sum((label - prediction) * (label - prediction)) = 0 THEN 1.0 ELSE 0.0 END * 100, 4) AS r2_pct,
  round(sqrt(sum((label - prediction) * (label - prediction)) / count(*)), 4) AS rmse, count(*) AS n
FROM {src} p GROUP BY ALL"""

M11_REG = _REG.format(extra="", src=_LINES)
M12 = f"""SELECT * FROM ({_REG.format(extra="model_order, ", src=_LINES)}) r ORDER BY r2_pct DESC, model_order LIMIT 1"""

M11_CLS = """WITH b AS (SELECT CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS p FROM labels),
a AS (SELECT y AS c, count(*) AS support, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS tp FROM b GROUP BY 1),
pr AS (SELECT p AS c, count(*) AS npred FROM b GROUP BY 1),
per AS (SELECT a.*, coalesce(pr.npred, 0) AS npred FROM a LEFT JOIN pr USING (c)),
f AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS prec, tp / support AS rec FROM per)
SELECT round(sum(tp) / sum(support) * 100, 4) AS accuracy_pct,
  round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support) * 100, 4)
    AS f1_pct, sum(support) AS n FROM f"""

RAW.update({
    "m1_task_detection": M1,
    "m3_label_encoding": M3,
    "m4_prepare_impute": M4,
    "m11_regression_metrics": M11_REG,
    "m11_classification_metrics": M11_CLS,
    "m12_best_model": M12,
})

# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------

S1 = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders"""
S2 = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority,
  CAST(NULL AS VARCHAR) AS note FROM orders"""

S1_DOCUMENTS = "SELECT doc_id, 'say \"hi\", ' || text AS text, lang, source, n_chars FROM documents"
S1_LATE = """WITH m AS (SELECT max(o_orderkey) AS top FROM orders)
SELECT CASE WHEN o_orderkey * 10 > 9 * top THEN o_orderkey + 0.5::DOUBLE ELSE CAST(o_orderkey AS DOUBLE) END AS measure,
  CASE WHEN o_orderkey * 10 > 9 * top THEN 'late' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS code,
  CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, o_orderkey % 2 = 0 AS even FROM orders, m"""

# NaN counts as missing: the same numbers as with NULL in its place
LINEITEM_NAN = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""
P4_NAN = f"""WITH m AS ({_missing_rows(LINEITEM_NAN, LINEITEM_COLS)})
SELECT col AS "column", position, round(missing_pct, 4) AS missing_pct,
  CASE WHEN missing_pct > 30 THEN 'critical' WHEN missing_pct > 10 THEN 'moderate' ELSE 'minor' END AS band
FROM m WHERE missing_pct > 0"""
A2_NAN = f"""SELECT {ORDERS_KEYS},
  {_agg_cols(['o_orderkey', 'o_custkey'], ['o_totalprice'])}
FROM (SELECT DISTINCT * REPLACE (CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders) t
WHERE {ORDERS_NOTNULL} GROUP BY ALL"""
C7_STRAY = f"""SELECT o_orderstatus, o_orderpriority, {_agg_cols(['o_orderkey', 'o_custkey'], ['o_totalprice'])}
FROM (SELECT DISTINCT * FROM orders) t WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL"""

RAW.update({"s1_csv_roundtrip": S1, "s2_read_many": S2, "s1_documents_roundtrip": S1_DOCUMENTS, "s1_late_types": S1_LATE,
            "p4_missing_nan": P4_NAN, "a2_summary_nan": A2_NAN, "c7_stray_date": C7_STRAY})
