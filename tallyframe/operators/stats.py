"""Statistics (X1-X5): correlations, histograms, skewness.

Each is a single aggregate over the input (pairwise ``corr`` expressions,
min/max, per-column moments) followed by work on a result the size of the
column list; histogram counts are a (column, bin) hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import is_numeric, unbiased_skew


#: Columns whose pairs are expressions of one aggregate.
WIDE = 50


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _num(c: str) -> Column:
    x = _q(c).cast("double")
    return F.when(~F.isnan(x), x)


def summary_value_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    """X1 column choice on a summary: numeric columns ending in
    ``_sum/_mean/_count`` (else all numeric), all of them unless limited."""
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    useful = [c for c in nums if c.endswith(("_sum", "_mean", "_count"))] or nums
    return useful[:limit]


def pair_array(cols: list[str]) -> Column:
    """An aggregate: (c1, c2, i, j, r) of every pair i < j."""
    return F.array(*[F.struct(F.lit(cols[i]).alias("c1"), F.lit(cols[j]).alias("c2"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                              F.corr(_num(cols[i]), _num(cols[j])).alias("r"))
                     for i in range(len(cols)) for j in range(i + 1, len(cols))])


def skew_array(cols: list[str]) -> Column:
    """An aggregate: (column, position, skew) of every column."""
    return F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), unbiased_skew(_num(c)).alias("skew"))
                     for i, c in enumerate(cols)])


def correlation_pairs(df: DataFrame, cols: list[str], measured: DataFrame | None = None) -> DataFrame:
    """Pearson r for every pair i < j, pairwise complete rows.

    One aggregate with n(n-1)/2 ``corr`` expressions up to WIDE columns;
    beyond, sums of products from blocks of rows (``gram``), also one scan.
    ``measured`` (``one_pass``, where ``cols`` are all numeric columns) has
    the pairs up to WIDE columns already."""
    if len(cols) > WIDE:
        from tallyframe.operators.gram import wide_correlation_pairs
        return wide_correlation_pairs(df, cols).select("c1", "c2", "i", "j", "r")
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "c1 string, c2 string, i int, j int, r double")
    one = df.agg(pair_array(cols).alias("pairs")) if measured is None else measured
    return one.select(F.inline("pairs"))


def strong_pairs(pairs: DataFrame, threshold: float = 0.5, inclusive: bool = False,
                 limit: int | None = None) -> DataFrame:
    """Pairs with |r| above the threshold, strongest first, sign label."""
    a = F.abs(F.col("r"))
    cond = (a >= threshold) if inclusive else (a > threshold)
    out = (pairs.where(cond & ~F.isnan("r"))
                .withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))
                .orderBy(a.desc(), F.col("i"), F.col("j")))
    return out.limit(limit) if limit else out


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """The single strongest pair (NaN r last)."""
    a = F.when(F.isnan("r"), None).otherwise(F.abs(F.col("r")))
    w = Window.orderBy(a.desc_nulls_last(), F.col("i"), F.col("j"))
    return (pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")
                 .withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative")))


def top_predictors(pairs: DataFrame, target: str, k: int = 3) -> DataFrame:
    """The k columns most correlated (|r|) with ``target``."""
    other = F.when(F.col("c1") == target, F.col("c2")).otherwise(F.col("c1"))
    pos = F.when(F.col("c1") == target, F.col("j")).otherwise(F.col("i"))
    t = pairs.where((F.col("c1") == target) | (F.col("c2") == target)) \
             .select(other.alias("column"), pos.alias("position"), "r")
    w = Window.orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("position"))
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def histogram_columns(df: DataFrame, cols: list[str], limit: int | None = None, min_values: int = 5) -> list[str]:
    """X4 column choice: the columns (all unless limited) with more than
    ``min_values`` non-null values (one count aggregate)."""
    row = df.agg(*[F.count(_num(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] > min_values][:limit]


def histograms(df: DataFrame, cols: list[str], bins: int = 25) -> DataFrame:
    """Equal-width histograms, (column, bin 1..bins, lo, hi, count).

    Bin = floor((x - min) / (max - min) * bins) + 1, the maximum folded into
    the last bin; a constant column has everything in bin 1."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    arr = F.array(*[F.struct(F.lit(c).alias("column"), _num(c).alias("x")) for c in cols])
    long = df.select(F.explode(arr).alias("kv")).select("kv.*").where(F.col("x").isNotNull())
    rng = long.groupBy("column").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    width = F.col("mx") - F.col("mn")
    b = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("mn")) / width * bins).cast("int") + 1, F.lit(bins))) \
         .otherwise(F.lit(1))
    counted = (long.join(F.broadcast(rng), "column").withColumn("bin", b)
                   .groupBy("column", "bin", "mn", "mx").agg(F.count(F.lit(1)).alias("count")))
    step = (F.col("mx") - F.col("mn")) / bins
    return counted.select("column", "bin", (F.col("mn") + step * (F.col("bin") - 1)).alias("lo"),
                          (F.col("mn") + step * F.col("bin")).alias("hi"), "count")


def skewness(df: DataFrame, cols: list[str], flag_above: float = 1.5, measured: DataFrame | None = None) -> DataFrame:
    """Bias-corrected skewness per column and the |skew| > 1.5 flag; from
    ``measured`` (``one_pass``, all numeric columns) without a scan."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, position int, skew double, skewed boolean")
    one = df.agg(skew_array(cols).alias("skews")) if measured is None else measured
    return one.select(F.inline("skews")).withColumn("skewed", F.abs(F.col("skew")) > flag_above)
