"""Cleaning (C1-C10): projections and one de-duplicating shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed
from tallyframe.functions.columns import (is_integral, is_string, is_temporal,
                                          strip_ws)


def drop_sparse_columns(df: DataFrame, min_fraction: float = fixed.SPARSE_MIN_FRACTION, look=None) -> DataFrame:
    """Keep columns with ``non-null count >= min_fraction * rows``.

    One aggregate (a row of counts, one value per column) reaches the driver;
    the result is a pure projection, so the scan prunes dropped columns.
    ``look`` (``one_pass.first_look``) has the counts already.
    """
    cols = df.columns
    if look is not None:
        return df.select(*[F.col(f"`{c}`") for c in cols if look.present[c] >= look.n_rows * min_fraction])
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    n = row["__n"]
    keep = [c for i, c in enumerate(cols) if row[f"c{i}"] >= n * min_fraction]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates removed; NULLs compare equal.

    Planned as a hash aggregate on all columns: duplicates collapse map-side
    before the shuffle, so a hot group of copies costs one row per task.
    """
    return df.dropDuplicates()


def cleaned(c: Column, literals=tuple(fixed.NULL_LITERALS)) -> Column:
    """The value without white space around it, null literals as NULL.  A
    value that begins and ends with visible ASCII has none, so no pattern
    is sought in it."""
    def known(s):
        return F.when(s.isin(*literals), F.lit(None).cast("string")).otherwise(s)

    tidy = (c >= "!") & (c < "\x7f") & F.substring(c, -1, 1).between("!", "~")
    # named twice, the pattern would be a common part, sought for every value
    return F.when(tidy, known(c)).otherwise(F.transform(F.array(strip_ws(c)), known)[0])


def trim_and_nullify(df: DataFrame, literals=tuple(fixed.NULL_LITERALS)) -> DataFrame:
    """Strip white space of string columns, then map null literals to NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_string(f.dataType):
            c = cleaned(c, literals)
        out.append(c.alias(f.name))
    return df.select(*out)


_INT_TYPES = [(T.ByteType(), -(2 ** 7), 2 ** 7 - 1), (T.ShortType(), -(2 ** 15), 2 ** 15 - 1),
              (T.IntegerType(), -(2 ** 31), 2 ** 31 - 1), (T.LongType(), -(2 ** 63), 2 ** 63 - 1)]


def integer_ranges(df: DataFrame) -> DataFrame:
    """C4 inputs: (column, min, max, narrowest type) for integer columns."""
    ints = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    if not ints:
        return df.sparkSession.createDataFrame([], "column string, min_value bigint, max_value bigint, type string")
    stats = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(F.col(f"`{c}`")).cast("bigint").alias("min_value"),
                              F.max(F.col(f"`{c}`")).cast("bigint").alias("max_value")).alias(f"s{i}")
                     for i, c in enumerate(ints)])
    long = stats.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(ints))])).alias("s")).select("s.*")
    typ = F.lit("bigint")
    for t, lo, hi in reversed(_INT_TYPES[:-1]):
        typ = F.when((F.col("min_value") >= lo) & (F.col("max_value") <= hi), F.lit(t.simpleString())).otherwise(typ)
    return long.withColumn("type", F.when(F.col("min_value").isNull(), F.lit("tinyint")).otherwise(typ))


def tighten_integer_types(df: DataFrame) -> DataFrame:
    """C4: cast each integer column to the narrowest type holding its range."""
    ranges = {r["column"]: r["type"] for r in integer_ranges(df).collect()}
    return df.select(*[(F.col(f"`{c}`").cast(ranges[c]) if c in ranges else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


def snake_name(name: str) -> str:
    """``\\W+`` -> ``_``, trimmed of ``_``, lower case."""
    return re.sub(r"\W+", "_", name).strip("_").lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    """C5 over all columns.  A name that an earlier column got already, or
    that has no letter left, takes the next free number: ``a b``, ``a-b`` and
    ``A_B`` become ``a_b``, ``a_b_2`` and ``a_b_3``."""
    names: list[str] = []
    for c in df.columns:
        base = name = snake_name(c) or "column"
        turn = 1
        while name in names:
            turn += 1
            name = f"{base}_{turn}"
        names.append(name)
    return df.toDF(*names)


def parse_timestamp(c, formats=tuple(fixed.DATE_FORMATS)):
    """First format that parses wins; unparseable values become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = strip_ws(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def coerce_dates(df: DataFrame, cols, formats=tuple(fixed.DATE_FORMATS)) -> DataFrame:
    cols = set(cols)
    return df.select(*[(parse_timestamp(F.col(f"`{c}`"), formats).alias(c) if c in cols else F.col(f"`{c}`"))
                       for c in df.columns])


def time_column_candidates(df: DataFrame) -> list[str]:
    """Temporal columns, plus string columns whose name hints at time.

    Numeric columns are never time columns even with a time-like name
    (``tenure_months`` stays a value column).
    """
    out = []
    for f in df.schema.fields:
        if is_temporal(f.dataType):
            out.append(f.name)
        elif is_string(f.dataType) and any(h in f.name.lower() for h in fixed.TIME_NAME_HINTS):
            out.append(f.name)
    return out


def add_time_parts(df: DataFrame, time_col: str) -> DataFrame:
    """``_year``, ``_quarter``, ``_month`` of the time column."""
    t = F.col(f"`{time_col}`")
    return (df.withColumn("_year", F.year(t).cast("bigint"))
              .withColumn("_quarter", F.quarter(t).cast("bigint"))
              .withColumn("_month", F.month(t).cast("bigint")))


def dedupe_keep_order(items):
    """Order-preserving de-duplication of a key list."""
    return list(dict.fromkeys(items))


def clean(df: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """C1 -> C2 -> C3 (dedup before trimming, like the original order).

    Integer narrowing (C4) is a storage optimisation and is left out of the
    analysis path: sums are taken in 64-bit/decimal anyway.
    """
    out = drop_sparse_columns(df)
    if drop_duplicates:
        out = drop_duplicate_rows(out)
    return trim_and_nullify(out)
