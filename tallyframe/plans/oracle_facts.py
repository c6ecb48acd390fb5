"""DuckDB twins of the queries in ``catalog_facts``."""

from __future__ import annotations

from tallyframe.functions import fixed
from tallyframe.operators import facts as FT
from tallyframe.plans import tables as TB
from tallyframe.plans.oracle import LINEITEM_COLS, LINEITEM_NULLS, LINEITEM_NUM, _union
from tallyframe.plans.oracle_more import MODEL_RULES, _fired, _intent_case, _sql_str, _words, rules_sql

_X = ["l_quantity", "l_discount", "l_tax"]


def ridge_sql(src: str, by: str | None, alpha: float) -> str:
    """Three features by Cramer's rule on centred sums."""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    cols = [*_X, "l_extendedprice"]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*)" + (f" + {alpha}" if i == j and i < 3 else "") + f" AS a{i}{j}"
                     for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))

    def a(i, j):
        return f"a{min(i, j)}{max(i, j)}"

    def det(c):   # column c replaced by the right side
        e = lambda i, j: a(i, 3) if j == c else a(i, j)
        return (f"({e(0, 0)} * ({e(1, 1)} * {e(2, 2)} - {e(1, 2)} * {e(2, 1)}) - {e(0, 1)} * ({e(1, 0)} * {e(2, 2)} - "
                f"{e(1, 2)} * {e(2, 0)}) + {e(0, 2)} * ({e(1, 0)} * {e(2, 1)} - {e(1, 1)} * {e(2, 0)}))")
    w = ", ".join(f"{det(c)} / {det(None)} AS w{c}" for c in range(3))
    # b'(A + alpha I) b = b'X'y, so the rest is yy - b'X'y - alpha b'b
    rest = f"a33 - w0 * a03 - w1 * a13 - w2 * a23 - {alpha} * (w0 * w0 + w1 * w1 + w2 * w2)"
    return f"""(WITH s AS (SELECT {sel}count(*) AS n, {sums}, {means} FROM {src} t WHERE {whole} {grp}),
b AS (SELECT *, {w} FROM s WHERE n > 0), r AS (SELECT *, m3 - w0 * m0 - w1 * m1 - w2 * m2 AS intercept,
  100 * (1 - ({rest}) / a33) AS r2_pct FROM b)
{_union([f"SELECT {sel}'{x}' AS feature, CAST({i} AS INTEGER) AS position, w{i} AS coefficient, intercept, r2_pct, n FROM r"
         for i, x in enumerate(_X)])})"""


def _rounded_ridge(src, by, alpha):
    sel = f"{by}, " if by else ""
    return (f"SELECT {sel}feature, position, round(coefficient, 4) AS coefficient, round(intercept, 4) AS intercept, "
            f"round(r2_pct, 4) AS r2_pct, n FROM {ridge_sql(src, by, alpha)} x")


def _pairs(src, by, cols):
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return _union([f"SELECT {sel}{i} AS i, {j} AS j, '{a}' AS c1, '{b}' AS c2, "
                   f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, "
                   f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {src} t {grp}"
                   for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j])


_K = "l_suppkey"
_REST = [c for c in LINEITEM_COLS if c != _K]
_NUM = [c for c in LINEITEM_NUM if c != _K]


def _shares(key):
    return f"""SELECT {_K}, 'segments' AS topic, '{key} ' || CAST({key} AS VARCHAR) AS key, 'share_pct' AS metric,
  sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY {_K}) * 100 AS value
  FROM d WHERE {key} IS NOT NULL GROUP BY {_K}, {key}"""


def _growth(v):
    return f"""SELECT {_K}, '{v}' AS v, CASE WHEN pv <> 0 THEN (lv - pv) / pv * 100 ELSE 0.0 END AS g FROM (
  SELECT {_K}, max(CASE WHEN rn = 1 THEN value END) AS lv, max(CASE WHEN rn = 2 THEN value END) AS pv, max(rn) AS years FROM (
    SELECT {_K}, y, sum({v}) AS value, row_number() OVER (PARTITION BY {_K} ORDER BY y DESC) AS rn FROM (
      SELECT *, year(l_shipdate) AS y FROM d WHERE l_shipdate IS NOT NULL) a GROUP BY {_K}, y) b
    WHERE rn <= 2 GROUP BY {_K}) c WHERE years = 2"""


_MISS = _union([f"SELECT {_K}, '{c}' AS col, {i} AS position, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS pct "
                f"FROM c GROUP BY {_K}" for i, c in enumerate(_REST)])
_LEVEL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FT.LEVELS.items())
FACTS = f"""(WITH c AS {LINEITEM_NULLS}, d AS (SELECT DISTINCT * FROM c),
q AS (SELECT {_K}, count(*) AS n_rows FROM c GROUP BY {_K}), o AS (SELECT {_K}, count(*) AS once FROM d GROUP BY {_K}),
m AS ({_MISS}),
w AS (SELECT {_K}, arg_max(col, pct * 1000 - position) AS worst_missing_col, max(pct) AS worst_missing_pct FROM m
      WHERE pct > 20 GROUP BY {_K}),
g AS ({_growth('l_extendedprice')} UNION ALL {_growth('l_quantity')}),
tg AS (SELECT {_K}, l_returnflag AS name, sum(l_extendedprice) AS value FROM d WHERE l_returnflag IS NOT NULL GROUP BY ALL),
tr AS (SELECT *, sum(value) OVER (PARTITION BY {_K}) AS total, row_number() OVER (PARTITION BY {_K} ORDER BY value DESC, name) AS rn,
  row_number() OVER (PARTITION BY {_K} ORDER BY value, name) AS up, count(*) OVER (PARTITION BY {_K}) AS n FROM tg),
t AS (SELECT {_K}, name AS top_name, value / total * 100 AS share FROM tr WHERE rn = 1),
ga AS (SELECT {_K}, first(total) AS gtotal, sum(CASE WHEN up <= 3 THEN value END) AS b3,
  string_agg(CASE WHEN up <= 3 THEN name END, ', ' ORDER BY up) AS bottom3 FROM tr WHERE n >= 3 GROUP BY {_K}),
f AS (SELECT *, abs(coefficient) / sum(abs(coefficient)) OVER (PARTITION BY {_K}) * 100 AS pct FROM {ridge_sql(LINEITEM_NULLS, _K, 1.0)} x),
mo AS (SELECT {_K}, max(r2_pct) AS score, arg_max(feature, pct) AS feature, max(pct) AS feature_share FROM f GROUP BY {_K}),
k AS (SELECT q.{_K}, q.n_rows, q.n_rows - o.once AS duplicates, CAST(q.n_rows - o.once AS DOUBLE) / q.n_rows * 100 AS duplicate_pct,
  w.worst_missing_col, w.worst_missing_pct, g.g, t.top_name, t.share, ga.gtotal, ga.b3, ga.bottom3, 'l_extendedprice' AS primary_col,
  CASE WHEN mo.feature IS NOT NULL THEN 'Ridge Regression' END AS best, 'regression' AS task, mo.score, mo.feature, mo.feature_share,
  CAST(NULL AS DOUBLE) AS gap
  FROM q JOIN o USING ({_K}) LEFT JOIN w USING ({_K}) LEFT JOIN g ON g.{_K} = q.{_K} AND g.v = 'l_extendedprice'
  LEFT JOIN t ON t.{_K} = q.{_K} LEFT JOIN ga ON ga.{_K} = q.{_K} LEFT JOIN mo ON mo.{_K} = q.{_K}),
ruled AS ({_fired(rules_sql("l_returnflag", "l_extendedprice", "b3 * 0.1", "b3 * 0.1 / gtotal * 100") + MODEL_RULES, f"{_K}, ", 14)}),
a AS (SELECT {_K}, 'size' AS topic, 'table' AS key, 'rows' AS metric, CAST(n_rows AS DOUBLE) AS value FROM q
  UNION ALL SELECT {_K}, 'size', 'table', 'columns', {len(_REST)}.0 FROM q
  UNION ALL SELECT {_K}, 'quality', 'table', 'repeated_rows', CAST(duplicates AS DOUBLE) FROM k
  UNION ALL SELECT {_K}, 'quality', col, 'missing_pct', pct FROM m WHERE pct > 0
  UNION ALL SELECT {_K}, 'growth', v, 'yoy_growth_pct', g FROM g
  UNION ALL {_shares('l_returnflag')} UNION ALL {_shares('l_linestatus')}
  UNION ALL SELECT {_K}, 'correlations', c1 || ' ~ ' || c2, 'correlation', r FROM ({_pairs('c', _K, _NUM)}) p WHERE NOT isnan(r)
  UNION ALL SELECT {_K}, 'features', feature, 'importance_pct', pct FROM f
  UNION ALL SELECT {_K}, 'model', 'ridge for l_extendedprice', 'r2_pct', score FROM mo
  UNION ALL SELECT {_K}, CASE WHEN kind = 'risk' THEN 'risks' ELSE 'recommendations' END, title, 'level',
    CASE level {_LEVEL} ELSE 1 END FROM ruled)
SELECT *, key || ' ' || metric || ' ' || CASE WHEN metric IN ('rows', 'columns', 'repeated_rows', 'level')
  THEN CAST(CAST(round(value, 0) AS DECIMAL(38, 0)) AS VARCHAR) ELSE CAST(CAST(round(value, 2) AS DECIMAL(38, 2)) AS VARCHAR) END
  || CASE WHEN metric LIKE '%\\_pct' ESCAPE '\\' THEN '%' ELSE '' END AS text FROM a WHERE value IS NOT NULL)"""

_LEADING = f"row_number() OVER (PARTITION BY {_K}, topic ORDER BY abs(value) DESC, key, metric)"
_ASKED = "[" + ", ".join(_sql_str(q) for q in [*fixed.SUGGESTED_QUESTIONS, *TB.MORE_QUESTIONS]) + "]"
_OPEN = " ".join(f"WHEN '{k}' THEN {_sql_str(v)}" for k, v in FT.OPENINGS.items())
_NUMBER = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(FT.TOPICS, 1))

T7 = f"""WITH facts AS MATERIALIZED (SELECT * FROM {FACTS} x),
told AS (SELECT {_K}, topic, string_agg(text, '; ' ORDER BY rank) AS told FROM (
  SELECT *, {_LEADING} AS rank FROM facts) y WHERE rank <= 3 GROUP BY {_K}, topic),
q AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS q_id,
  CAST(conv_id % (SELECT count(*) FROM supplier) AS BIGINT) AS {_K}, {_ASKED}[(conv_id + turn) % {len(fixed.SUGGESTED_QUESTIONS) + len(TB.MORE_QUESTIONS)} + 1] AS text
  FROM conversations),
i AS (SELECT q_id, {_K}, {_intent_case('text')} AS intent FROM q),
j AS (SELECT *, CASE WHEN intent = '{fixed.FALLBACK_INTENT}' THEN 'size' ELSE intent END AS topic FROM i)
SELECT q_id, j.{_K}, intent, CASE WHEN told IS NOT NULL THEN CASE intent {_OPEN} END || ': ' || told || '.'
  ELSE 'No facts on ' || j.topic || '.' END AS answer FROM j LEFT JOIN told ON told.{_K} = j.{_K} AND told.topic = j.topic"""

SECTIONS = f"""WITH facts AS MATERIALIZED (SELECT * FROM {FACTS} x)
SELECT {_K}, CAST(CASE topic {_NUMBER} END AS INTEGER) AS section, CAST(rank AS INTEGER) AS ord, '- ' || text AS line,
  round(value, 4) AS value FROM (SELECT *, {_LEADING} AS rank FROM facts) y WHERE rank <= 5
UNION ALL SELECT DISTINCT {_K}, CAST(CASE topic {_NUMBER} END AS INTEGER), 0,
  '## ' || CASE topic {_NUMBER} END || '. ' || upper(topic[1]) || topic[2:], CAST(NULL AS DOUBLE) FROM facts"""

_WIDE = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in TB.WIDE_COLUMNS) + f" FROM {LINEITEM_NULLS} y)"
_WIDE_CORR = ", ".join(f"{{'i': {i}, 'j': {j}, 'c1': '{a}', 'c2': '{b}', 'r': corr({a}, {b})}}"
                       for i, (a, _) in enumerate(TB.WIDE_COLUMNS) for j, (b, _) in enumerate(TB.WIDE_COLUMNS) if i < j)
_WIDE_PAIRS = f"""SELECT CAST(p.i AS INTEGER) AS i, CAST(p.j AS INTEGER) AS j, p.c1 AS c1, p.c2 AS c2,
  CASE WHEN isnan(p.r) THEN NULL ELSE round(p.r, 4) END AS r
FROM (SELECT unnest(l) AS p FROM (SELECT [{_WIDE_CORR}] AS l FROM {_WIDE} z) x) y"""


def _drawn(seed):
    return f"""(SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('{seed}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rank,
  count(*) OVER (PARTITION BY o_orderpriority) AS size, count(*) OVER () AS n FROM orders)"""


_TF = f"""d AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0 AS idf FROM c GROUP BY term),
v AS (SELECT doc_id, term, tf, tf * idf AS weight FROM c JOIN i USING (term)),
u AS (SELECT doc_id, term, tf, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM v)"""

PART_TEXTS = ["p_name", "p_brand", "p_type"]
NAMES = """SELECT p_partkey, """ + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in PART_TEXTS) + " FROM part"

ORACLE = {
    "t8_facts": f"SELECT {_K}, topic, key, metric, round(value, 4) AS value, text FROM {FACTS} x",
    "t7_structured": T7,
    "r1_sections_by_supplier": SECTIONS,
    "m7_ridge_coefficients": _rounded_ridge("lineitem", None, 1.0),
    "m7_ridge_by_flag": _rounded_ridge(LINEITEM_NULLS, "l_returnflag", 10.0),
    "x1_wide": _WIDE_PAIRS,
    "m5_split": f"SELECT o_orderkey, o_orderpriority, rank <= ceil(size * CASE WHEN n >= 50 THEN 20 ELSE 30 END / 100) AS test FROM {_drawn(fixed.MODEL_SEED)} x",
    "m6_folds": f"SELECT o_orderkey, o_orderpriority, CAST((rank - 1) % least(5, greatest(2, n // 10)) AS INTEGER) AS fold FROM {_drawn(fixed.MODEL_SEED + 1)} x",
    "m3_label_encoding_names": NAMES,
    "c5_equal_names": """SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS status,
  round(o_totalprice, 4) AS status_2, o_orderdate AS order_date, o_orderpriority AS "column" FROM orders""",
    "s1_exact_ids": """SELECT CAST(o_orderkey AS VARCHAR) AS id, '12345678901' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS long_id,
  lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS code, '+49' || CAST(o_orderkey AS VARCHAR) AS phone,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 10 AS VARCHAR) || '.5'
       ELSE '9007199254' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS mixed,
  CAST(o_orderkey % 100 AS VARCHAR) || '.25' AS part, 'bigint,decimal(38,0),string,string,string,double' AS kinds FROM orders""",
    "t2_tfidf": f"WITH {_TF} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM u",
    "t2_tfidf_topk": f"""WITH {_TF}, qd AS (SELECT item_id, unnest({_words('lower(text)')}) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) * any_value(idf) AS weight FROM qd JOIN i USING (term) GROUP BY ALL),
qu AS (SELECT item_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS weight FROM qc),
s AS (SELECT item_id AS q_id, doc_id AS c_id, sum(u.weight * qu.weight) AS score FROM qu JOIN u USING (term) GROUP BY ALL)
SELECT q_id, c_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, c_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 7""",
}
