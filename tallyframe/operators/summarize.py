"""Summary table (A1-A8): key choice, progressive key dropping, group-by.

Jobs for one summary, whatever the input size:
  1. one look at all rows: their count, non-null counts (C1), sketches of the
     string columns' distinct values, shares of texts that are dates (C7),
  2. exact distinct counts of the string columns near the 2..40 band,
  3. group counts of every key prefix in one ROLLUP over the key columns;
     where the keys could have very many combinations, sketches of all
     prefixes first tell how deep the ROLLUP must go,
  4. the final GROUP BY at the chosen prefix (hash aggregate, map-side combine).
Duplicate rows do not change distinct values or group counts, so only step 4
reads the de-duplicated rows; the de-duplicating shuffle runs once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed
from tallyframe.functions.columns import (is_numeric, is_string, is_temporal,
                                          money_sum, nan_to_null)
from tallyframe.operators import clean as C
from tallyframe.operators.one_pass import FirstLook, first_look
from tallyframe.operators.profile import exact_distinct_counts


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class Summary:
    table: DataFrame
    meta: dict
    rows: DataFrame                      # cleaned rows with time parts (input of the group-by)
    level_counts: list = field(default_factory=list)


# ---------------------------------------------------------------------------
# A1 key choice
# ---------------------------------------------------------------------------

def string_distinct_counts(df: DataFrame, cols: list[str], exact_below: int = 100, look: FirstLook | None = None) -> dict:
    """Distinct counts of string columns, exact wherever the 2..40 rule can
    depend on them (HLL estimate <= ``exact_below``), else the estimate."""
    if not cols:
        return {}
    if look is None:
        row = df.agg(*[F.approx_count_distinct(_q(c), 0.05).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        approx = {c: row[f"a{i}"] for i, c in enumerate(cols)}
    else:
        approx = look.distinct
    small = [c for c in cols if approx[c] <= exact_below]
    texts = [c for c in small if is_string(df.schema[c].dataType)]
    others = [c for c in small if c not in texts]
    exact = {r["column"]: r["n_distinct"] for r in exact_distinct_counts(df, others).collect()} if others else {}
    if texts:   # few values: a task holds two hashes of each, where long form would copy the rows
        pairs = [F.when(_q(c).isNotNull(), F.struct(F.xxhash64(_q(c)).alias("a"), F.xxhash64(F.lit("b"), _q(c)).alias("b"))) for c in texts]
        pairs = df.select(*[p.alias(f"p{i}") for i, p in enumerate(pairs)])
        exact |= zip(texts, pairs.agg(*[F.size(F.collect_set(p)).alias(p) for p in pairs.columns]).first())
    return {c: exact.get(c, 0 if c in small else approx[c]) for c in cols}


def choose_time_column(df: DataFrame, look: FirstLook | None = None) -> tuple[str | None, bool]:
    """First time column that holds timestamps, or strings most of which
    parse (over the whole column), so a few stray dates make none.

    Returns (name, needs_parsing)."""
    for c in C.time_column_candidates(df):
        dt = df.schema[c].dataType
        if is_temporal(dt):
            return c, False
        if look is not None:
            rate = look.parsed[c]
        else:
            rate = df.agg(F.avg(F.when(_q(c).isNotNull(), C.parse_timestamp(_q(c)).isNotNull().cast("double")))).first()[0]
        if rate is not None and rate > fixed.TIME_PARSE_RATE:
            return c, True
    return None, False


def numeric_key_candidates(df: DataFrame, target: str | None = None, skip: set | None = None,
                           look: FirstLook | None = None) -> list[tuple[str, int]]:
    """A1 option: numeric columns with 2 to 15 distinct values whose name has
    a hint of a class (region, type, ...); the target is none."""
    named = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != target and f.name not in (skip or ())
             and any(h in f.name.lower() for h in fixed.NUMERIC_KEY_HINTS)]
    counts = string_distinct_counts(df, named, look=look)
    return [(c, counts[c]) for c in named if fixed.KEY_MIN_DISTINCT <= counts[c] <= fixed.NUMERIC_KEY_MAX_DISTINCT]


def choose_keys(df: DataFrame, time_col: str | None, id_pattern: str = fixed.ID_NAME_PATTERN,
                min_distinct: int = fixed.KEY_MIN_DISTINCT, max_distinct: int = fixed.KEY_MAX_DISTINCT,
                numeric_keys: bool = False, target: str | None = None, look: FirstLook | None = None):
    """A1: (group_keys, value_cols, key_distinct) for a cleaned frame.

    Keys: time parts, then string columns with min..max distinct values whose
    name does not match the id pattern, by rising distinct count (stable).
    Values: numeric columns other than keys, time column and time parts.
    With ``numeric_keys`` numbers that name a class are candidates too, after
    the strings of equally many values.
    """
    id_re = re.compile(id_pattern, re.I)
    strs = [f.name for f in df.schema.fields if is_string(f.dataType) and f.name != time_col]
    eligible = [c for c in strs if not id_re.search(c)]
    counts = string_distinct_counts(df, eligible, look=look)
    cands = [(c, counts[c]) for c in eligible if min_distinct <= counts[c] <= max_distinct]
    if numeric_keys:
        cands += numeric_key_candidates(df, target, {time_col, "_year", "_quarter", "_month"}, look)
    time_parts = ["_year", "_quarter", "_month"] if time_col else []
    keys = C.dedupe_keep_order(time_parts + [c for c, _ in sorted(cands, key=lambda x: x[1])])
    exclude = set(keys) | {time_col} | {c for c, _ in cands} | {"_year", "_quarter", "_month"}
    values = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]
    return keys, values, dict(cands)


# ---------------------------------------------------------------------------
# A2/A3 group-by, A4 progressive key dropping
# ---------------------------------------------------------------------------

def summary_aggs(value_cols: list[str], money_scale: int | None = None, types: dict | None = None) -> list[Column]:
    """``{v}_sum, {v}_mean, {v}_count, {v}_std`` for every value column.

    Sum of an all-null group is 0; mean/std NULL; std is the sample std.
    With ``money_scale`` the non-integer sums are exact decimals and the
    mean is sum / count, so results do not depend on partitioning.
    """
    out = []
    for v in value_cols:
        x = _q(v)
        integral = types is not None and isinstance(types.get(v), (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if money_scale is not None and not integral:
            s = money_sum(x, money_scale)
            mean = F.try_divide(s, F.count(x).cast("double"))
        else:
            s = F.sum(x)
            mean = F.avg(x)
        out += [F.coalesce(s, F.lit(0).cast("bigint" if integral else "double")).alias(f"{v}_sum"),
                mean.alias(f"{v}_mean"),
                F.count(x).alias(f"{v}_count"),
                F.stddev_samp(x).alias(f"{v}_std")]
    return out


def group_summary(df: DataFrame, keys: list[str], value_cols: list[str],
                  money_scale: int | None = None) -> DataFrame:
    """A2 (keys) / A3 (no keys): rows with a NULL in any used key are dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = summary_aggs(value_cols, money_scale, types)
    if not keys:
        return df.agg(*aggs)
    cond = None
    for k in keys:
        cond = _q(k).isNotNull() if cond is None else cond & _q(k).isNotNull()
    return df.where(cond).groupBy(*[_q(k) for k in keys]).agg(*aggs)


def prefix_group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: (n_keys, groups) for every key prefix, from one ROLLUP.

    A group of prefix level j counts only when none of its j kept keys is a
    real NULL (``grouping(k)=0 and k is null`` marks a real NULL); NULLs in
    dropped keys are rollup placeholders and keep the group.  The ROLLUP
    copies a row for every level, so only distinct combinations go in.
    """
    k = len(keys)
    if k == 0:
        return df.sparkSession.createDataFrame([(0, 1)], "n_keys int, groups bigint")
    cols = [_q(c) for c in keys]
    rolled = df.select(*cols).distinct().rollup(*cols).agg(*[F.grouping(c).alias(f"__g{i}") for i, c in enumerate(cols)])
    level = sum((F.lit(1) - F.col(f"__g{i}")) for i in range(k))
    bad = None
    for i, c in enumerate(keys):
        term = (F.col(f"__g{i}") == 0) & _q(c).isNull()
        bad = term if bad is None else bad | term
    return (rolled.withColumn("n_keys", level.cast("int")).where(~bad)
                  .groupBy("n_keys").agg(F.count(F.lit(1)).alias("groups")))


#: Key combinations from which the prefixes are sketched before the ROLLUP.
LARGE_KEY_SPACE = 1_000_000
#: Relative error of the sketches, and how far beyond ``max_rows`` an
#: estimate still counts as near (more than ten standard errors).
SKETCH_ERROR, NEAR = 0.02, 1.25


def prefix_estimates(df: DataFrame, keys: list[str]) -> list[int]:
    """Estimated groups of every prefix of ``keys``: one aggregate with a
    sketch a prefix, no shuffle of rows.  A prefix's hash is made of the
    shorter one's, null from the first null key on."""
    last = F.lit(0).cast("long")
    for j, c in enumerate(keys):
        df = df.withColumn(f"__p{j}", F.when(last.isNotNull() & _q(c).isNotNull(), F.xxhash64(last, _q(c))))
        last = F.col(f"__p{j}")
    return list(df.agg(*[F.approx_count_distinct(f"__p{j}", SKETCH_ERROR).alias(f"p{j}") for j in range(len(keys))]).first())


def deepest_level(estimates: list[int], max_rows: int) -> int:
    """The longest prefix whose estimated groups may be within ``max_rows``.
    Longer prefixes needn't be counted; the others are counted exactly."""
    return max((j for j, n in enumerate(estimates, 1) if n <= NEAR * max_rows), default=0)


def key_space(keys: list[str], key_distinct: dict) -> float:
    """An upper bound of the combinations: distinct values multiplied, a
    century of time parts."""
    size = 1.0
    for k in keys:
        size *= {"_year": 100, "_quarter": 4, "_month": 3}.get(k) or key_distinct[k]
    return size


def choose_prefix(level_counts: dict, n_keys: int, max_rows: int) -> int:
    """Longest prefix whose summary has at most ``max_rows`` rows; 0 always fits."""
    for j in range(n_keys, 0, -1):
        if level_counts.get(j, 0) <= max_rows:
            return j
    return 0


@dataclass
class Survey:
    """What the summaries of a table ask of its rows, whatever their limits
    up to ``max_rows``."""
    max_rows: int
    rows: DataFrame
    meta: dict
    estimates: list | None               # groups of every prefix, of a large key space
    counts: dict                         # groups of the prefixes that may fit


def survey(df: DataFrame, max_rows: int = fixed.MAX_SUMMARY_ROWS, drop_duplicates: bool = True, numeric_keys: bool = False,
           target: str | None = None) -> Survey:
    """C1-C3, C6-C8, A1 and A4's counts, read once for several limits."""
    df = nan_to_null(df)
    look = first_look(df)
    base = C.drop_sparse_columns(df, look=look)
    stats_view = C.trim_and_nullify(base)          # values as analysed; duplicates do not matter here
    time_col, needs_parse = choose_time_column(stats_view, look)
    rows = C.trim_and_nullify(C.drop_duplicate_rows(base) if drop_duplicates else base)
    if time_col:
        if needs_parse:
            stats_view = C.coerce_dates(stats_view, [time_col])
            rows = C.coerce_dates(rows, [time_col])
        stats_view = C.add_time_parts(stats_view, time_col)
        rows = C.add_time_parts(rows, time_col)
    keys, values, key_distinct = choose_keys(stats_view, time_col, numeric_keys=numeric_keys, target=target, look=look)
    meta = {"original_rows": look.n_rows, "original_cols": len(df.columns), "group_keys": [],
            "value_cols": values, "time_col": time_col, "agg_rows": 0, "reduction_ratio": 0.0,
            "candidate_keys": keys, "key_distinct": key_distinct}
    estimates, counts = None, {0: 1}
    if values:
        if key_space(keys, key_distinct) > LARGE_KEY_SPACE:
            estimates = prefix_estimates(stats_view, keys)
        deep = len(keys) if estimates is None else deepest_level(estimates, max_rows)
        if deep:
            counts = {r["n_keys"]: r["groups"] for r in prefix_group_counts(stats_view, keys[:deep]).collect()} | counts
    return Survey(max_rows, rows, meta, estimates, counts)


def summarize(df: DataFrame, max_rows: int = fixed.MAX_SUMMARY_ROWS, money_scale: int | None = None,
              drop_duplicates: bool = True, numeric_keys: bool = False, target: str | None = None,
              surveyed: Survey | None = None) -> Summary:
    """Condense any table into at most ``max_rows`` rows.

    ``level_counts`` holds the groups of every prefix; of a large key space
    those of the prefixes that may fit, None for longer ones.  Summaries of
    one table may share a survey of the same options."""
    if surveyed is None:
        surveyed = survey(df, max_rows, drop_duplicates, numeric_keys, target)
    elif max_rows > surveyed.max_rows:
        raise ValueError("the survey is of fewer rows")
    rows, meta = surveyed.rows, dict(surveyed.meta)
    keys, values, original_rows = meta["candidate_keys"], meta["value_cols"], meta["original_rows"]
    if not values:
        table = describe_fallback(rows)
        meta["agg_rows"] = table.count()
        meta["reduction_ratio"] = round(meta["agg_rows"] / original_rows, 6) if original_rows else 0.0
        return Summary(table, meta, rows, [])
    deep = len(keys) if surveyed.estimates is None else deepest_level(surveyed.estimates, max_rows)
    counts = surveyed.counts
    j = choose_prefix(counts, deep, max_rows)
    used = keys[:j]
    table = group_summary(rows, used, values, money_scale)
    meta["group_keys"] = used
    meta["agg_rows"] = counts.get(j, 0)
    meta["reduction_ratio"] = round(meta["agg_rows"] / original_rows, 6) if original_rows else 0.0
    return Summary(table, meta, rows, [counts.get(i, 0) if i <= deep else None for i in range(len(keys) + 1)])


def describe_fallback(df: DataFrame) -> DataFrame:
    """A5: numeric describe when numbers exist, else count/unique/top/freq of
    the string columns (ties of the top value go to the smallest value)."""
    from tallyframe.operators.profile import describe
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if nums:
        return describe(df, nums)
    strs = [f.name for f in df.schema.fields if is_string(f.dataType)]
    return string_describe(df, strs)


def string_describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, count, unique, top, freq) for string columns."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("value")) for c in cols])
    long = df.select(F.explode(arr).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy("column")
    return (vc.groupBy("column").agg(F.sum("freq").cast("bigint").alias("count"),
                                     F.count(F.lit(1)).alias("unique"),
                                     F.min_by(F.struct(F.col("freq"), F.col("value")),
                                              F.struct(-F.col("freq"), F.col("value"))).alias("t"))
              .select("column", "count", "unique", F.col("t.value").alias("top"), F.col("t.freq").alias("freq")))


# ---------------------------------------------------------------------------
# A6-A8
# ---------------------------------------------------------------------------

def reduction_meta(spark, meta: dict) -> DataFrame:
    """A6 as a one-row DataFrame."""
    ratio = meta["reduction_ratio"]
    return spark.createDataFrame(
        [(int(meta["original_rows"]), int(meta["original_cols"]), int(meta["agg_rows"]), float(ratio),
          float(round((1 - ratio) * 100, 1)), ",".join(meta["group_keys"]), ",".join(meta["value_cols"]))],
        "original_rows bigint, original_cols bigint, agg_rows bigint, reduction_ratio double, "
        "reduction_pct double, group_keys string, value_cols string")


def reaggregate(summary: DataFrame, key: str, value: str) -> DataFrame:
    """Re-aggregate the summary by one key (sum of ``{value}_sum``)."""
    return summary.where(_q(key).isNotNull()).groupBy(_q(key)).agg(F.sum(f"{value}_sum").alias(f"{value}_sum"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of one column, NULLs excluded."""
    return df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
