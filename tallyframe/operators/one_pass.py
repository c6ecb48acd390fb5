"""Statistics of a table that one scan gives: the row count, missing values
(P4, P7), moments of the numeric columns (P8, X5) and their correlations
(X1), and what the summary must know before it groups (C1, C7, A1, A6).

``measure`` returns one row that the reports read in place of the table;
``first_look`` brings the few figures that choose columns to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.functions.columns import is_numeric, is_string
from tallyframe.operators import clean as C
from tallyframe.operators import profile as P
from tallyframe.operators import stats as X
from tallyframe.session import ensure_checkpoint_dir


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def measure(df: DataFrame) -> DataFrame:
    """One checkpointed row: n_rows, missing, skews, profiles, pairs (the
    pairs of at most ``stats.WIDE`` columns; those of more take a scan of
    their own).  An empty table gives a row of nulls and zeros."""
    ensure_checkpoint_dir(df.sparkSession)
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("n_rows"), P.missing_array(df.columns).alias("missing")]
    if nums:
        aggs.append(X.skew_array(nums).alias("skews"))
        aggs.append(F.array(*[F.struct(F.lit(c).alias("column"), *P.profile_aggs(c)) for c in nums]).alias("profiles"))
    if 1 < len(nums) <= X.WIDE:
        aggs.append(X.pair_array(nums).alias("pairs"))
    return df.agg(*aggs).checkpoint()


@dataclass
class FirstLook:
    n_rows: int
    present: dict[str, int]        # values of every column that are not null
    distinct: dict[str, int]       # estimated distinct values of the key candidates, cleaned
    parsed: dict[str, float]       # share of a text column's values that are dates (columns named like times)


def first_look(df: DataFrame) -> FirstLook:
    """What the choice of columns, time column and keys asks of the rows, as
    one aggregate: a count and a sketch a column."""
    aggs = {"n": F.count(F.lit(1))}
    times = set(C.time_column_candidates(df))
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType) and
               any(h in f.name.lower() for h in fixed.NUMERIC_KEY_HINTS)]
    view, hashes = df, {f"__d{i}": C.cleaned(_q(c)) for i, c in enumerate(df.columns) if c in strings}
    if hashes:   # columns of their own: a sketch evaluates what it is given value by value, without compiled code
        view = df.select("*", *[x.alias(h) for h, x in hashes.items()])
        view = view.select(*[_q(c) for c in df.columns], *[F.when(F.col(h).isNotNull(), F.xxhash64(h)).alias(h) for h in hashes])
    for i, c in enumerate(df.columns):
        aggs[f"c{i}"] = F.count(_q(c))
        if c in strings:
            clean = C.cleaned(_q(c))
            aggs[f"d{i}"] = F.approx_count_distinct(f"__d{i}", 0.05)
            if c in times:
                aggs[f"t{i}"] = F.avg(F.when(clean.isNotNull(), C.parse_timestamp(clean).isNotNull().cast("double")))
        elif c in numbers:
            aggs[f"d{i}"] = F.approx_count_distinct(_q(c), 0.05)
    row = view.agg(*[e.alias(k) for k, e in aggs.items()]).first().asDict()
    of = lambda kind: {c: row[f"{kind}{i}"] for i, c in enumerate(df.columns) if f"{kind}{i}" in row}
    return FirstLook(row["n"], of("c"), of("d"), {c: r or 0.0 for c, r in of("t").items()})
