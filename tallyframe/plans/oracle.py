"""DuckDB SQL twins of the registered queries (independent formulations).

Views ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are assumed.
Double outputs are rounded to 4 decimals, exactly like the Spark side.
"""

from __future__ import annotations

from tallyframe.functions import fixed
from tallyframe.functions.columns import WS_CLASS

# ---------------------------------------------------------------------------
# derived inputs (same as plans/tables.py)
# ---------------------------------------------------------------------------

LINEITEM_NULLS = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem)"""

ORDERS_COPIES = "(SELECT * FROM orders UNION ALL SELECT * FROM orders)"

ORDERS_PADDED = """(SELECT o_orderkey, '  ' || o_orderstatus || ' ' AS o_orderstatus,
  CASE WHEN o_orderkey % 11 = 0 THEN 'None' WHEN o_orderkey % 13 = 0 THEN 'nan'
       WHEN o_orderkey % 17 = 0 THEN '' ELSE chr(9) || o_orderpriority END AS o_orderpriority,
  o_totalprice FROM orders)"""

ORDERS_STRDATES = """(SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'junk'
       WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%m/%d/%Y')
       WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y/%m/%d')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  o_orderstatus, o_orderpriority, o_totalprice FROM orders)"""

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUM = LINEITEM_COLS[:8]


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------------------
# summaries
# ---------------------------------------------------------------------------

def _agg_cols(ints, moneys):
    out = []
    for v in ints:
        out += [f"CAST(coalesce(sum({v}), 0) AS BIGINT) AS {v}_sum", f"round(avg({v}), 4) AS {v}_mean",
                f"count({v}) AS {v}_count", f"round(stddev_samp({v}), 4) AS {v}_std"]
    for v in moneys:
        s = f"CAST(sum(CAST({v} AS DECIMAL(38,2))) AS DOUBLE)"
        out += [f"round(coalesce({s}, 0.0), 4) AS {v}_sum", f"round({s} / count({v}), 4) AS {v}_mean",
                f"count({v}) AS {v}_count", f"round(stddev_samp({v}), 4) AS {v}_std"]
    return ",\n  ".join(out)


ORDERS_KEYS = ("CAST(year(o_orderdate) AS BIGINT) AS _year, CAST(quarter(o_orderdate) AS BIGINT) AS _quarter, "
               "CAST(month(o_orderdate) AS BIGINT) AS _month, o_orderstatus, o_orderpriority")
ORDERS_NOTNULL = "o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL"

A2 = f"""SELECT {ORDERS_KEYS},
  {_agg_cols(['o_orderkey', 'o_custkey'], ['o_totalprice'])}
FROM (SELECT DISTINCT * FROM orders) t WHERE {ORDERS_NOTNULL}
GROUP BY ALL"""

# orders summary with exact decimal sums, used by the KPI oracles
ORDERS_SUMMARY_CTE = f"""s AS (SELECT {ORDERS_KEYS},
  sum(o_orderkey) AS ok_sum, count(o_orderkey) AS ok_count, sum(o_custkey) AS ck_sum,
  sum(CAST(o_totalprice AS DECIMAL(38,2))) AS tp_sum_d,
  CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) AS tp_sum,
  CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) / count(o_totalprice) AS tp_mean,
  count(o_totalprice) AS tp_count, avg(o_orderkey) AS ok_mean, avg(o_custkey) AS ck_mean,
  count(o_custkey) AS ck_count
FROM (SELECT DISTINCT * FROM orders) t WHERE {ORDERS_NOTNULL} GROUP BY ALL)"""


# ---------------------------------------------------------------------------
# profiling helpers
# ---------------------------------------------------------------------------

def _stats_rows(src: str, cols):
    """cols: (name, kind) with kind numeric|string|temporal."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        ml = f"avg(length({c}))" if kind == "string" else "NULL::DOUBLE"
        dr = (f"avg(CAST(regexp_matches({c}, '{fixed.DATE_LIKE_PATTERN}') AS DOUBLE))"
              if kind == "string" else "NULL::DOUBLE")
        parts.append(f"SELECT '{c}' AS col, {i} AS position, '{kind}' AS kind, count(*) AS n, count({c}) AS nn, "
                     f"count(DISTINCT {c}) AS nd, {ml} AS mean_len, {dr} AS date_rate FROM {src}")
    return _union(parts)


ROLE_CASE = f"""CASE WHEN nn = 0 THEN NULL
  WHEN kind = 'temporal' THEN 'datetime'
  WHEN kind = 'string' AND date_rate > {fixed.ROLE_DATE_RATE} THEN 'datetime'
  WHEN kind = 'numeric' THEN CASE WHEN CAST(nd AS DOUBLE) / CAST(nn AS DOUBLE) < {fixed.ROLE_CAT_RATIO}
       AND nd <= {fixed.ROLE_CAT_MAX_DISTINCT} THEN 'categorical' ELSE 'numerical' END
  WHEN kind <> 'string' THEN NULL
  WHEN CAST(nd AS DOUBLE) / CAST(nn AS DOUBLE) > {fixed.ROLE_ID_RATIO} AND nd > {fixed.ROLE_ID_MIN_DISTINCT} THEN 'id_like'
  WHEN mean_len > {fixed.ROLE_TEXT_MEAN_LENGTH} THEN 'text'
  ELSE 'categorical' END"""


def _roles_sql(src, cols):
    return f"""WITH st AS ({_stats_rows(src, cols)})
SELECT col AS "column", position, {ROLE_CASE} AS role FROM st"""


ORDERS_TYPED = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
                ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")]

P1_ORDERS = _roles_sql("(SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_str FROM orders)",
                       ORDERS_TYPED + [("o_orderdate_str", "string")])
P1_DOCUMENTS = _roles_sql("documents", [("doc_id", "numeric"), ("text", "string"), ("lang", "string"),
                                        ("source", "string"), ("n_chars", "numeric")])

_CUSTOMER = [("c_custkey", "numeric", "bigint"), ("c_name", "string", "string"),
             ("c_nationkey", "numeric", "int"), ("c_acctbal", "numeric", "double"),
             ("c_mktsegment", "string", "string")]


def _sample_sql(src, c, kind):
    k = f"CAST({c} AS DOUBLE)" if kind == "numeric" else "NULL::DOUBLE"
    return (f"SELECT '{c}' AS col, string_agg(v, ', ' ORDER BY k NULLS LAST, v) AS sample FROM "
            f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v, {k} AS k FROM {src} WHERE {c} IS NOT NULL "
            f"ORDER BY k NULLS LAST, v LIMIT 3)")


P2 = f"""WITH st AS ({_stats_rows('customer', [(c, k) for c, k, _ in _CUSTOMER])}),
sm AS ({_union([_sample_sql('customer', c, k) for c, k, _ in _CUSTOMER])}),
ty AS ({_union([f"SELECT '{c}' AS col, '{t}' AS dtype" for c, _, t in _CUSTOMER])}),
r AS (SELECT st.*, {ROLE_CASE} AS role FROM st)
SELECT r.col AS "column", position,
  CASE role WHEN 'id_like' THEN 'Id Like' WHEN 'numerical' THEN 'Numerical' WHEN 'categorical' THEN 'Categorical'
            WHEN 'datetime' THEN 'Datetime' WHEN 'text' THEN 'Text' ELSE 'Unknown' END AS role,
  ty.dtype, n - nn AS missing, round(CAST(n - nn AS DOUBLE) / CAST(n AS DOUBLE) * 100, 4) AS missing_pct,
  nd AS "unique", coalesce(sm.sample, '') AS sample
FROM r JOIN sm ON r.col = sm.col JOIN ty ON r.col = ty.col"""

P3 = _union([f"""SELECT '{c}' AS "column", {i} AS position, count(x) AS count, round(avg(x), 4) AS mean,
  round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q25,
  round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS max
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)""" for i, c in enumerate(LINEITEM_NUM)])


def _missing_rows(src, cols):
    return _union([f"SELECT '{c}' AS col, {i} AS position, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE "
                   f"ELSE 0.0::DOUBLE END) * 100 AS missing_pct FROM {src}" for i, c in enumerate(cols)])


P4 = f"""WITH m AS ({_missing_rows(LINEITEM_NULLS, LINEITEM_COLS)})
SELECT col AS "column", position, round(missing_pct, 4) AS missing_pct,
  CASE WHEN missing_pct > 30 THEN 'critical' WHEN missing_pct > 10 THEN 'moderate' ELSE 'minor' END AS band
FROM m WHERE missing_pct > 0"""

P5 = f"""WITH t AS {ORDERS_COPIES}, a AS (SELECT count(*) AS n_rows FROM t),
d AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM t))
SELECT a.n_rows, d.n_distinct, a.n_rows - d.n_distinct AS duplicates,
  round(CAST(a.n_rows - d.n_distinct AS DOUBLE) / CAST(a.n_rows AS DOUBLE) * 100, 4) AS duplicate_pct FROM a, d"""

P6 = f"""WITH t AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'x' END AS o_comment FROM {ORDERS_COPIES}),
a AS (SELECT count(*) AS n_rows, CAST(max(CASE WHEN o_comment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS m FROM t),
d AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM t))
SELECT a.n_rows, CAST(7 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_numeric, CAST(3 AS BIGINT) AS n_string,
  a.n_rows - d.n_distinct AS duplicates,
  round(CAST(a.n_rows - d.n_distinct AS DOUBLE) / CAST(a.n_rows AS DOUBLE) * 100, 4) AS duplicate_pct,
  a.m AS columns_with_missing FROM a, d"""

P7 = f"""WITH m AS ({_missing_rows(LINEITEM_NULLS, LINEITEM_COLS)}), h AS (SELECT * FROM m WHERE missing_pct > 20)
SELECT arg_max(col, missing_pct * 1000 - position) AS "column", round(max(missing_pct), 4) AS missing_pct,
  count(*) AS n_columns FROM h HAVING count(*) > 0"""

P8 = """SELECT count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(max(x), 4) AS max, round(skewness(x), 4) AS skew, abs(skewness(x)) > 1 AS skewed
FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)"""

P9 = """WITH c AS (SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS count FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT class, count, round(CAST(count AS DOUBLE) / CAST(sum(count) OVER () AS DOUBLE) * 100, 4) AS pct,
  count(*) OVER () AS n_classes,
  max(CAST(count AS DOUBLE)) OVER () / CAST(sum(count) OVER () AS DOUBLE) * 100 > 70 AS imbalanced FROM c"""


def _hits(text, words):
    return " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words)


def _p10(doms=fixed.DOMAIN_KEYWORDS):
    scores = ",\n  ".join(f"{_hits('lower(text)', kws)} AS d{i}" for i, (_, kws) in enumerate(doms))
    best = "greatest(" + ", ".join(f"d{i}" for i in range(len(doms))) + ")"
    case = "CASE " + " ".join(f"WHEN d{i} = {best} AND {best} > 0 THEN '{name}'" for i, (name, _) in enumerate(doms))
    case += f" ELSE '{fixed.GENERAL_DOMAIN}' END"
    return f"""SELECT doc_id, {case} AS domain, {best} AS score FROM (SELECT doc_id,
  {scores} FROM documents) t"""


P10 = _p10()
P11 = f"""SELECT conv_id, turn, {_hits("replace(lower(text), '_', ' ')", fixed.TARGET_KEYWORDS)} AS score
FROM conversations"""

# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------

C1 = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 4) AS l_quantity,
  round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, l_returnflag, l_linestatus,
  l_shipdate FROM {LINEITEM_NULLS} t"""

C2 = f"""SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate,
  o_orderpriority FROM {ORDERS_COPIES} t"""

C3 = f"""SELECT o_orderkey, CASE WHEN s1 IN ('nan', 'None', '') THEN NULL ELSE s1 END AS o_orderstatus,
  CASE WHEN s2 IN ('nan', 'None', '') THEN NULL ELSE s2 END AS o_orderpriority, round(o_totalprice, 4) AS o_totalprice
FROM (SELECT o_orderkey, {_strip('o_orderstatus')} AS s1, {_strip('o_orderpriority')} AS s2, o_totalprice
      FROM {ORDERS_PADDED} p) t"""

C4 = _union([f"""SELECT '{c}' AS "column", CAST(min({c}) AS BIGINT) AS min_value, CAST(max({c}) AS BIGINT) AS max_value,
  CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
       WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
       WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type
FROM lineitem""" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]])

C5 = """SELECT o_orderkey AS order_key, round(o_totalprice, 4) AS total_price, o_orderstatus AS order__status
FROM orders"""

_DUCK_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%m-%Y", "%Y-%m"]
C6 = f"""SELECT o_orderkey, coalesce({', '.join(f"try_strptime({_strip('order_date')}, '{f}')" for f in _DUCK_FORMATS)})
  AS order_date FROM {ORDERS_STRDATES} t"""

C8 = """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS _year, CAST(quarter(o_orderdate) AS BIGINT) AS _quarter,
  CAST(month(o_orderdate) AS BIGINT) AS _month FROM orders"""

# ---------------------------------------------------------------------------
# summary
# ---------------------------------------------------------------------------

A1 = """WITH c AS (SELECT 'o_orderstatus' AS column_name, 0 AS pos, count(DISTINCT o_orderstatus) AS nd FROM orders
  UNION ALL SELECT 'o_orderpriority', 1, count(DISTINCT o_orderpriority) FROM orders),
k AS (SELECT column_name, nd, row_number() OVER (ORDER BY nd, pos) + 2 AS position FROM c WHERE nd BETWEEN 2 AND 40)
SELECT 'key' AS role, CAST(position AS INTEGER) AS position, column_name, CAST(nd AS BIGINT) AS n_distinct FROM k
UNION ALL SELECT 'key', 0, '_year', NULL UNION ALL SELECT 'key', 1, '_quarter', NULL
UNION ALL SELECT 'key', 2, '_month', NULL UNION ALL SELECT 'value', 0, 'o_orderkey', NULL
UNION ALL SELECT 'value', 1, 'o_custkey', NULL UNION ALL SELECT 'value', 2, 'o_totalprice', NULL"""

A3 = f"""SELECT {_agg_cols(['o_orderkey', 'o_custkey'], ['o_totalprice'])} FROM (SELECT DISTINCT * FROM orders) t"""

A4_LEVELS = f"""WITH t AS (SELECT year(l_shipdate) AS y, quarter(l_shipdate) AS q, month(l_shipdate) AS m,
  l_linestatus, l_returnflag FROM {LINEITEM_NULLS} x),
r AS (SELECT 5 - (grouping(y) + grouping(q) + grouping(m) + grouping(l_linestatus) + grouping(l_returnflag)) AS n_keys,
  (grouping(y) = 0 AND y IS NULL) OR (grouping(q) = 0 AND q IS NULL) OR (grouping(m) = 0 AND m IS NULL)
  OR (grouping(l_linestatus) = 0 AND l_linestatus IS NULL) OR (grouping(l_returnflag) = 0 AND l_returnflag IS NULL) AS bad
  FROM t GROUP BY ROLLUP (y, q, m, l_linestatus, l_returnflag)),
lv AS (SELECT n_keys, count(*) AS groups FROM r WHERE NOT bad GROUP BY n_keys)
SELECT CAST(n_keys AS INTEGER) AS n_keys, CAST(groups AS BIGINT) AS groups,
  n_keys = (SELECT max(n_keys) FROM lv WHERE groups <= 100) AS chosen_100,
  n_keys = (SELECT max(n_keys) FROM lv WHERE groups <= 2000) AS chosen_2000 FROM lv"""

A4_SUMMARY = f"""SELECT CAST(year(l_shipdate) AS BIGINT) AS _year, CAST(quarter(l_shipdate) AS BIGINT) AS _quarter,
  CAST(month(l_shipdate) AS BIGINT) AS _month,
  {_agg_cols(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'], ['l_quantity', 'l_extendedprice', 'l_discount'])}
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
      l_returnflag, l_linestatus, l_shipdate FROM {LINEITEM_NULLS} x) t
WHERE l_shipdate IS NOT NULL GROUP BY ALL"""

A5 = """WITH d AS (SELECT DISTINCT lang, source FROM documents),
v AS (SELECT 'lang' AS col, lang AS value FROM d WHERE lang IS NOT NULL
      UNION ALL SELECT 'source', source FROM d WHERE source IS NOT NULL),
c AS (SELECT col, value, count(*) AS freq FROM v GROUP BY ALL),
r AS (SELECT col, value, freq, row_number() OVER (PARTITION BY col ORDER BY freq DESC, value) AS rn,
  sum(freq) OVER (PARTITION BY col) AS cnt, count(*) OVER (PARTITION BY col) AS uniq FROM c)
SELECT col AS "column", CAST(cnt AS BIGINT) AS count, uniq AS "unique", value AS top, freq FROM r WHERE rn = 1"""

A6 = f"""WITH g AS (SELECT count(*) AS n FROM (SELECT DISTINCT year(o_orderdate), quarter(o_orderdate),
  month(o_orderdate), o_orderstatus, o_orderpriority FROM orders WHERE {ORDERS_NOTNULL})),
o AS (SELECT count(*) AS n FROM orders)
SELECT o.n AS original_rows, CAST(6 AS BIGINT) AS original_cols, g.n AS agg_rows,
  round(round(g.n / o.n, 6), 4) AS reduction_ratio, round(round((1 - round(g.n / o.n, 6)) * 100, 1), 4) AS reduction_pct,
  '_year,_quarter,_month,o_orderstatus,o_orderpriority' AS group_keys, 'o_orderkey,o_custkey,o_totalprice' AS value_cols
FROM o, g"""

A7 = f"""SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE), 4) AS o_totalprice_sum
FROM (SELECT DISTINCT * FROM orders) t WHERE {ORDERS_NOTNULL} GROUP BY 1"""

A8 = "SELECT l_returnflag AS value, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1"

# ---------------------------------------------------------------------------
# KPIs
# ---------------------------------------------------------------------------

K1 = f"""WITH {ORDERS_SUMMARY_CTE}
SELECT round(CAST(sum(tp_sum_d) AS DOUBLE), 4) AS primary_total, round(avg(tp_mean), 4) AS primary_mean,
  round(CAST(sum(tp_sum_d) AS DOUBLE) / CAST(sum(tp_count) AS DOUBLE), 4) AS weighted_mean,
  'o_totalprice' AS primary_col FROM s"""


def _yoy(by=""):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    grp = f"{by}, _year" if by else "_year"
    return f"""WITH {ORDERS_SUMMARY_CTE},
y AS (SELECT {grp}, CAST(sum(tp_sum_d) AS DOUBLE) AS value FROM s WHERE _year IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER ({part} ORDER BY _year DESC) AS rn FROM y),
g AS (SELECT {sel}max(CASE WHEN rn = 1 THEN _year END) AS latest_year, max(CASE WHEN rn = 2 THEN _year END) AS previous_year,
  max(CASE WHEN rn = 1 THEN value END) AS lv, max(CASE WHEN rn = 2 THEN value END) AS pv FROM r WHERE rn <= 2 GROUP BY ALL)
SELECT {sel}latest_year, previous_year, round(lv, 4) AS latest_year_val, round(pv, 4) AS prev_year_val,
  round(CASE WHEN pv <> 0 THEN (lv - pv) / pv * 100 ELSE 0.0 END, 4) AS yoy_growth_pct, 'o_totalprice' AS primary_col
FROM g WHERE previous_year IS NOT NULL"""


K2 = _yoy()
K2_BY = _yoy("o_orderstatus")


def _top_cat(key, by=""):
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""WITH {ORDERS_SUMMARY_CTE},
g AS (SELECT {sel}{key} AS name, CAST(sum(tp_sum_d) AS DOUBLE) AS value FROM s WHERE {key} IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(value) OVER ({part}) AS total, row_number() OVER ({part} ORDER BY value DESC, name) AS rn FROM g)
SELECT {sel}'{key}' AS top_category_col, CAST(name AS VARCHAR) AS top_category_name, round(value, 4) AS top_category_value,
  round(value / total * 100, 4) AS top_category_share FROM r WHERE rn = 1"""


K3 = _top_cat("o_orderstatus")
K3_BY = _top_cat("o_orderpriority", "_year")


def _long_ok(keys):
    return _union([f"SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS name, ok_sum AS v FROM s WHERE {k} IS NOT NULL"
                   for k in keys])


K4 = f"""WITH {ORDERS_SUMMARY_CTE}, l AS ({_long_ok(['o_orderstatus', 'o_orderpriority'])}),
g AS (SELECT key, name, CAST(sum(v) AS DOUBLE) AS value FROM l GROUP BY ALL),
r AS (SELECT *, sum(value) OVER (PARTITION BY key) AS total,
  row_number() OVER (PARTITION BY key ORDER BY value DESC, name) AS rank FROM g),
k AS (SELECT * FROM r WHERE rank <= 5)
SELECT key, name, round(value, 4) AS value, CAST(rank AS INTEGER) AS rank,
  round(value / sum(value) OVER (PARTITION BY key) * 100, 4) AS share_of_shown,
  round(value / total * 100, 4) AS share_of_total FROM k"""

K5 = f"""WITH {ORDERS_SUMMARY_CTE},
l AS (SELECT 'o_orderkey' AS metric, _year AS period, CAST(ok_sum AS DOUBLE) AS v FROM s WHERE _year IS NOT NULL
      UNION ALL SELECT 'o_custkey', _year, CAST(ck_sum AS DOUBLE) FROM s WHERE _year IS NOT NULL),
t AS (SELECT 'o_totalprice' AS metric, _year AS period, CAST(sum(tp_sum_d) AS DOUBLE) AS value FROM s
      WHERE _year IS NOT NULL GROUP BY ALL),
g AS (SELECT metric, period, sum(v) AS value FROM l GROUP BY ALL UNION ALL SELECT * FROM t),
p AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY period) AS prev FROM g)
SELECT metric, period, round(value, 4) AS value,
  round(CASE WHEN prev <> 0 THEN (value - prev) / prev * 100 WHEN prev IS NOT NULL THEN 0.0 END, 4) AS pct_change FROM p"""

K6 = f"""WITH {ORDERS_SUMMARY_CTE}, l AS ({_long_ok(['o_orderstatus', 'o_orderpriority'])}),
g AS (SELECT key, name, CAST(sum(v) AS DOUBLE) AS value FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, name) AS rank FROM g),
k AS (SELECT * FROM r WHERE rank <= 15),
a AS (SELECT key, arg_max(name, value * 1000 - rank) AS top_name, sum(value) AS shown,
  sum(CASE WHEN rank = 1 THEN value END) AS top1, sum(CASE WHEN rank <= 2 THEN value END) AS top2,
  count(*) AS n_shown FROM k GROUP BY key)
SELECT key, top_name, n_shown,
  round(CASE WHEN shown > 0 THEN top1 / shown * 100 ELSE 0.0 END, 4) AS top_share,
  round(CASE WHEN shown > 0 THEN top2 / shown * 100 ELSE 0.0 END, 4) AS top2_share,
  CASE WHEN shown > 0 THEN top1 / shown * 100 ELSE 0.0 END > 50 AS concentrated FROM a"""

K7 = f"""WITH {ORDERS_SUMMARY_CTE},
g AS (SELECT o_orderstatus AS name, CAST(sum(ok_sum) AS DOUBLE) AS value FROM s WHERE o_orderstatus IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rank FROM g),
k AS (SELECT * FROM r WHERE rank <= 10)
SELECT arg_max(name, value) AS best, arg_min(name, value) AS worst, round(max(value), 4) AS best_value,
  round(min(value), 4) AS worst_value,
  round(CASE WHEN min(value) > 0 THEN (max(value) - min(value)) / min(value) * 100 ELSE 0.0 END, 4) AS gap_pct,
  round(max(value) - min(value), 4) AS gap_abs FROM k"""

K8 = f"""WITH {ORDERS_SUMMARY_CTE},
g AS (SELECT o_orderstatus AS name, CAST(sum(ok_sum) AS DOUBLE) AS value FROM s WHERE o_orderstatus IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value, name) AS rn, count(*) OVER () AS n, sum(value) OVER () AS total,
  max(value) OVER () AS top1 FROM g),
a AS (SELECT first(top1) AS top_value, first(total) AS total, sum(CASE WHEN rn <= 3 THEN value END) AS b3,
  string_agg(CASE WHEN rn <= 3 THEN CAST(name AS VARCHAR) END, ', ' ORDER BY rn) AS bottom3 FROM r WHERE n >= 3)
SELECT 'o_orderstatus' AS key, bottom3, round(b3 / 3, 4) AS bottom3_mean, round(top_value, 4) AS top_value,
  round(CASE WHEN b3 / 3 > 0 THEN (top_value - b3 / 3) / (b3 / 3) * 100 ELSE 0.0 END, 4) AS gap_pct,
  round(b3 * 0.1, 4) AS lift_value, round(b3 * 0.1 / total * 100, 4) AS lift_share FROM a WHERE top_value IS NOT NULL"""

# ---------------------------------------------------------------------------
# statistics
# ---------------------------------------------------------------------------


def _pairs_sql(src, cols, cast=True):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a = f"CAST({cols[i]} AS DOUBLE)" if cast else cols[i]
            b = f"CAST({cols[j]} AS DOUBLE)" if cast else cols[j]
            parts.append(f"SELECT '{cols[i]}' AS c1, '{cols[j]}' AS c2, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM {src}")
    return _union(parts)


X1 = f"SELECT c1, c2, i, j, round(r, 4) AS r FROM ({_pairs_sql('lineitem', LINEITEM_NUM)}) p"

_SUMCOLS = ["ok_sum", "ok_mean", "ok_count", "ck_sum", "ck_mean", "ck_count", "tp_sum", "tp_mean", "tp_count"]
_SUMNAMES = ["o_orderkey_sum", "o_orderkey_mean", "o_orderkey_count", "o_custkey_sum", "o_custkey_mean",
             "o_custkey_count", "o_totalprice_sum", "o_totalprice_mean", "o_totalprice_count"]
X1_SUMMARY = f"""WITH {ORDERS_SUMMARY_CTE},
n AS (SELECT {', '.join(f'{a} AS {b}' for a, b in zip(_SUMCOLS, _SUMNAMES))} FROM s)
SELECT c1, c2, i, j, round(r, 4) AS r FROM ({_pairs_sql('n', _SUMNAMES)}) p"""

X2 = f"""SELECT c1, c2, i, j, round(r, 4) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign
FROM ({_pairs_sql('lineitem', LINEITEM_NUM)}) p WHERE abs(r) > 0.5 AND NOT isnan(r)"""

X2_ONE = f"""SELECT c1, c2, i, j, round(r, 4) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign
FROM ({_pairs_sql('lineitem', LINEITEM_NUM)}) p
ORDER BY CASE WHEN isnan(r) THEN NULL ELSE abs(r) END DESC NULLS LAST, i, j LIMIT 1"""

X3 = f"""WITH p AS ({_pairs_sql('lineitem', LINEITEM_NUM)}),
t AS (SELECT CASE WHEN c1 = 'l_extendedprice' THEN c2 ELSE c1 END AS "column",
  CASE WHEN c1 = 'l_extendedprice' THEN j ELSE i END AS position, r FROM p
  WHERE c1 = 'l_extendedprice' OR c2 = 'l_extendedprice'),
k AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, position) AS rank FROM t)
SELECT "column", position, round(r, 4) AS r, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"""

_HIST = LINEITEM_NUM
X4 = f"""WITH l AS ({_union([f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM lineitem WHERE {c} IS NOT NULL" for c in _HIST])}),
g AS (SELECT col, min(x) AS mn, max(x) AS mx FROM l GROUP BY col),
b AS (SELECT l.col, mn, mx, CASE WHEN mx - mn > 0 THEN least(CAST(floor((x - mn) / (mx - mn) * 25) AS INTEGER) + 1, 25)
  ELSE 1 END AS bin FROM l JOIN g ON l.col = g.col),
c AS (SELECT col, bin, mn, mx, count(*) AS count FROM b GROUP BY ALL)
SELECT col AS "column", bin, round(mn + (mx - mn) / 25 * (bin - 1), 4) AS lo, round(mn + (mx - mn) / 25 * bin, 4) AS hi,
  count FROM c"""

X5 = _union([f"""SELECT '{c}' AS "column", {i} AS position, round(skewness(CAST({c} AS DOUBLE)), 4) AS skew,
  abs(skewness(CAST({c} AS DOUBLE))) > 1.5 AS skewed FROM lineitem"""
             for i, c in enumerate(LINEITEM_NUM)])

S6 = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10"""

S7 = ("SELECT left(md5('(' || CAST(count(*) AS VARCHAR) || ', 11)|" + "|".join(LINEITEM_COLS) + "'), 8) AS fingerprint "
      "FROM lineitem")

def _half_up(sql: str, digits: int = 4) -> str:
    """Rewrite ``round(expr, 4)`` into the same floor formula the Spark side uses."""
    out, i, tag = [], 0, "round("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(tag)])
            i = j + len(tag)
            continue
        depth, k = 1, j + len(tag)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(tag):k - 1]
        suffix = f", {digits}"
        if inner.endswith(suffix):
            expr = _half_up(inner[: -len(suffix)], digits)
            out.append(sql[i:j] + f"(floor(({expr}) * {10 ** digits} + 0.5) / {10 ** digits})")
        else:
            out.append(sql[i:j] + tag + _half_up(inner, digits) + ")")
        i = k


_RAW = {
    "s6_preview": S6,
    "s7_fingerprint": S7,
    "p1_roles_orders": P1_ORDERS,
    "p1_roles_documents": P1_DOCUMENTS,
    "p2_column_summary": P2,
    "p3_describe": P3,
    "p4_missing": P4,
    "p5_duplicates": P5,
    "p6_overview": P6,
    "p7_worst_missing": P7,
    "p8_numeric_target": P8,
    "p9_categorical_target": P9,
    "p10_domain_documents": P10,
    "p11_target_keywords": P11,
    "c1_drop_sparse": C1,
    "c2_dedup": C2,
    "c3_trim_nullify": C3,
    "c4_integer_types": C4,
    "c5_snake_case": C5,
    "c6_parse_dates": C6,
    "c8_time_parts": C8,
    "a1_group_keys": A1,
    "a2_summary_orders": A2,
    "a3_global_aggregate": A3,
    "a4_prefix_levels": A4_LEVELS,
    "a4_summary_lineitem_100": A4_SUMMARY,
    "a5_describe_fallback": A5,
    "a6_reduction_meta": A6,
    "a7_reaggregate": A7,
    "a8_value_counts": A8,
    "k1_primary_metric": K1,
    "k2_yoy": K2,
    "k2_yoy_by_status": K2_BY,
    "k3_top_category": K3,
    "k3_top_category_by_year": K3_BY,
    "k4_breakdown": K4,
    "k5_trend": K5,
    "k6_concentration": K6,
    "k7_top_n": K7,
    "k8_performance_gap": K8,
    "x1_correlation": X1,
    "x1_correlation_summary": X1_SUMMARY,
    "x2_strong_pairs": X2,
    "x2_strongest_pair": X2_ONE,
    "x3_top_predictors": X3,
    "x4_histograms": X4,
    "x5_skewness": X5,
}

from tallyframe.plans import oracle_more  # noqa: E402  (uses the names above)

_RAW.update(oracle_more.RAW)
ORACLE = {k: _half_up(v) for k, v in _RAW.items()}
