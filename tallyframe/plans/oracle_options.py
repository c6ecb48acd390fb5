"""DuckDB twins of the queries in ``catalog_options``."""

from __future__ import annotations

from tallyframe.functions import fixed
from tallyframe.plans import tables as TB
from tallyframe.plans.catalog_options import ROW_LIMITS
from tallyframe.plans.oracle import _agg_cols, _hits, _p10, _union
from tallyframe.plans.oracle_more import _intent_case

_REGIONS = """(SELECT c_custkey, c_acctbal, c_mktsegment, n_regionkey AS region_no, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

NUMERIC_KEYS = f"""WITH t AS {_REGIONS},
c AS (SELECT 'c_mktsegment' AS column_name, 0 AS pos, count(DISTINCT c_mktsegment) AS nd, 40 AS most FROM t
  UNION ALL SELECT 'n_name', 1, count(DISTINCT n_name), 40 FROM t
  UNION ALL SELECT 'region_no', 2, count(DISTINCT region_no), 15 FROM t)
SELECT 'key' AS role, CAST(row_number() OVER (ORDER BY nd, pos) - 1 AS INTEGER) AS position, column_name,
  CAST(nd AS BIGINT) AS n_distinct FROM c WHERE nd BETWEEN 2 AND most
UNION ALL SELECT 'value', 0, 'c_custkey', NULL UNION ALL SELECT 'value', 1, 'c_acctbal', NULL"""

_KEYS = ["c_mktsegment", "region_no", "n_name"]
_SUMS = {"c_custkey": "CAST(sum(c_custkey) AS DOUBLE)", "c_acctbal": "CAST(sum(CAST(c_acctbal AS DECIMAL(38, 2))) AS DOUBLE)"}
_WHOLE = " AND ".join(f"{k} IS NOT NULL" for k in _KEYS)
_PAIRS = _union([f"SELECT '{k}' AS key, '{v}' AS metric, CAST({k} AS VARCHAR) AS name, {s} AS value FROM {_REGIONS} t WHERE {_WHOLE} GROUP BY {k}"
                 for k in _KEYS for v, s in _SUMS.items()])
BREAKDOWNS = f"""SELECT key, metric, name, round(value, 4) AS value,
  CAST(row_number() OVER (PARTITION BY key, metric ORDER BY value DESC, name) AS INTEGER) AS rank,
  round(value / sum(value) OVER (PARTITION BY key, metric) * 100, 4) AS share_of_total FROM ({_PAIRS}) p QUALIFY rank <= 5"""

_CLASSES = [f"c{m:02d}" for m in TB.CLASS_SIZES]
_ALL = ["_year", "_quarter", "_month", *_CLASSES]
_MANY = "(SELECT year(l_shipdate) AS _year, quarter(l_shipdate) AS _quarter, month(l_shipdate) AS _month, " + ", ".join(
    f"CASE WHEN l_partkey % 29 <> 0 OR {m} <> 7 THEN l_partkey % {m} END AS {c}" for m, c in zip(TB.CLASS_SIZES, _CLASSES)) + " FROM lineitem)"
_LEVELS = _union([f"SELECT {j} AS n_keys, count(*) AS groups, '{','.join(_ALL[:j])}' AS group_keys FROM (SELECT DISTINCT "
                  f"{', '.join(_ALL[:j])} FROM t WHERE {' AND '.join(k + ' IS NOT NULL' for k in _ALL[:j])}) d"
                  for j in range(1, len(_ALL) + 1)])
LARGE = f"""WITH t AS {_MANY}, lv AS (SELECT 0 AS n_keys, 1 AS groups, '' AS group_keys UNION ALL {_LEVELS}),
m AS (SELECT unnest([{', '.join(map(str, ROW_LIMITS))}]) AS max_rows)
SELECT CAST(max_rows AS INTEGER) AS max_rows, CAST(n_keys AS INTEGER) AS n_keys, CAST(groups AS BIGINT) AS groups, group_keys
FROM m JOIN lv ON groups <= max_rows QUALIFY row_number() OVER (PARTITION BY max_rows ORDER BY n_keys DESC) = 1"""

ORACLE = {
    "a1_numeric_keys": NUMERIC_KEYS,
    "a2_numeric_keys": f"SELECT {', '.join(_KEYS)}, {_agg_cols(['c_custkey'], ['c_acctbal'])} FROM {_REGIONS} t WHERE {_WHOLE} GROUP BY ALL",
    "a4_large_key_space": LARGE,
    "k4_breakdowns": BREAKDOWNS,
    "p10_wide": _p10(fixed.WIDE_DOMAIN_KEYWORDS),
    "p11_wide": "SELECT conv_id, turn, " + _hits("translate(lower(text), '_-', '  ')", fixed.WIDE_TARGET_KEYWORDS)
                + " AS score FROM conversations",
    "t5_wide": f"SELECT conv_id, turn, {_intent_case('text', fixed.WIDE_INTENTS)} AS intent FROM conversations",
}
