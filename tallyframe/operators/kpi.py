"""KPIs, time comparison and top-k reports over a summary (K1-K8, R2 text).

Every function takes a summary-shaped DataFrame (group keys + ``{v}_sum``
columns) and returns a DataFrame.  ``by`` adds segment columns: the same
report is computed for every segment in one job (windows partitioned by the
segment, never one global window over raw rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.functions.columns import pct

TIME_PARTS = ["_year", "_quarter", "_month"]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def primary_metric(summary: DataFrame, value_cols: list[str], target: str | None = None) -> str | None:
    """K1: the target when ``{target}_sum`` exists, else the first value column."""
    if target and f"{target}_sum" in summary.columns:
        return target
    return value_cols[0] if value_cols else None


def category_keys(group_keys: list[str]) -> list[str]:
    return [k for k in group_keys if not k.startswith("_")]


def primary_totals(summary: DataFrame, primary: str, by: list[str] = ()) -> DataFrame:
    """K1: total of ``{p}_sum``, mean of the group means, and the row-weighted mean."""
    aggs = [F.sum(f"{primary}_sum").alias("primary_total"),
            F.avg(f"{primary}_mean").alias("primary_mean"),
            F.try_divide(F.sum(f"{primary}_sum").cast("double"),
                         F.sum(f"{primary}_count").cast("double")).alias("weighted_mean")]
    g = summary.groupBy(*by) if by else summary
    return g.agg(*aggs).withColumn("primary_col", F.lit(primary))


def yoy_growth(summary: DataFrame, primary: str, by: list[str] = ()) -> DataFrame:
    """K2: the two latest present years; growth % (0 when the prior year is 0).

    Empty when fewer than two years exist."""
    sc = f"{primary}_sum"
    yearly = (summary.where(F.col("_year").isNotNull()).groupBy(*by, "_year")
                     .agg(F.sum(sc).cast("double").alias("value")))
    w = Window.partitionBy(*by).orderBy(F.col("_year").desc())
    top2 = yearly.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    g = top2.groupBy(*by).agg(
        F.max(F.when(F.col("rn") == 1, F.col("_year"))).alias("latest_year"),
        F.max(F.when(F.col("rn") == 2, F.col("_year"))).alias("previous_year"),
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("latest_year_val"),
        F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("prev_year_val"))
    growth = F.when(F.col("prev_year_val") != 0,
                    (F.col("latest_year_val") - F.col("prev_year_val")) / F.col("prev_year_val") * 100) \
              .otherwise(F.lit(0.0))
    return (g.where(F.col("previous_year").isNotNull())
             .withColumn("yoy_growth_pct", growth).withColumn("primary_col", F.lit(primary)))


def _grouped(summary: DataFrame, key: str, value: str, by=()) -> DataFrame:
    return (summary.where(_q(key).isNotNull()).groupBy(*by, _q(key).alias("name"))
                   .agg(F.sum(f"{value}_sum").cast("double").alias("value")))


def top_category(summary: DataFrame, key: str, primary: str, by: list[str] = ()) -> DataFrame:
    """K3: largest group of ``key`` by ``{primary}_sum`` and its share of the
    grand total (ties: smallest name)."""
    g = _grouped(summary, key, primary, by)
    w_all = Window.partitionBy(*by)
    w = Window.partitionBy(*by).orderBy(F.col("value").desc(), F.col("name"))
    return (g.withColumn("total", F.sum("value").over(w_all)).withColumn("rn", F.row_number().over(w))
             .where(F.col("rn") == 1)
             .select(*by, F.lit(key).alias("top_category_col"),
                     F.col("name").cast("string").alias("top_category_name"),
                     F.col("value").alias("top_category_value"),
                     pct(F.col("value"), F.col("total")).alias("top_category_share")))


def breakdown(summary: DataFrame, keys: list[str], value: str, k: int = 5, ascending: bool = False) -> DataFrame:
    """K4/K6: top-k groups per key, share of the shown rows and of the total.

    All keys in one pass: the summary is turned into (key, name, value) rows
    and aggregated once."""
    if not keys:
        return summary.sparkSession.createDataFrame(
            [], "key string, name string, value double, rank int, share_of_shown double, share_of_total double")
    arr = F.array(*[F.struct(F.lit(c).alias("key"), _q(c).cast("string").alias("name")) for c in keys])
    long = summary.select(F.explode(arr).alias("kv"), F.col(f"{value}_sum").alias("v")).select("kv.*", "v") \
                  .where(F.col("name").isNotNull())
    g = long.groupBy("key", "name").agg(F.sum("v").cast("double").alias("value"))
    order = F.col("value").asc() if ascending else F.col("value").desc()
    w = Window.partitionBy("key").orderBy(order, F.col("name"))
    ranked = g.withColumn("total", F.sum("value").over(Window.partitionBy("key"))) \
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shown = F.sum("value").over(Window.partitionBy("key"))
    return ranked.select("key", "name", "value", "rank",
                         pct(F.col("value"), shown).alias("share_of_shown"),
                         pct(F.col("value"), F.col("total")).alias("share_of_total"))


def breakdowns(summary: DataFrame, keys: list[str], values: list[str], k: int = 5) -> DataFrame:
    """K4 for the first three keys that are no time parts by the first two
    values: (key, metric, name, value, rank, share_of_total), the ``k``
    largest groups of each pair.  All pairs come from one aggregate over
    (key, name) with a column a value; NULL names are no group."""
    keys = [c for c in keys[:fixed.BREAKDOWN_KEYS] if not c.startswith("_")]
    values = [v for v in values if f"{v}_sum" in summary.columns][:fixed.BREAKDOWN_VALUES]
    if not keys or not values:
        return summary.sparkSession.createDataFrame(
            [], "key string, metric string, name string, value double, rank int, share_of_total double")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), _q(c).cast("string").alias("name")) for c in keys]))
    sums = (summary.select(named.alias("kv"), *[_q(f"{v}_sum") for v in values]).select("kv.*", *[_q(f"{v}_sum") for v in values])
            .where(F.col("name").isNotNull()).groupBy("key", "name")
            .agg(F.array(*[F.struct(F.lit(v).alias("metric"), F.sum(_q(f"{v}_sum")).cast("double").alias("value")) for v in values])
                 .alias("all")))
    one = sums.select("key", "name", F.inline("all"))
    pair = Window.partitionBy("key", "metric")
    return (one.withColumn("total", F.sum("value").over(pair))
            .withColumn("rank", F.row_number().over(pair.orderBy(F.col("value").desc(), "name"))).where(F.col("rank") <= k)
            .select("key", "metric", "name", "value", "rank", pct(F.col("value"), F.col("total")).alias("share_of_total")))


def concentration(summary: DataFrame, keys: list[str], value: str, k: int = 15) -> DataFrame:
    """K6: per key, top-1 and top-2 share of the shown top-k and the >50 % flag."""
    b = breakdown(summary, keys, value, k)
    return (b.groupBy("key").agg(
        F.max_by("name", F.struct(F.col("value"), -F.col("rank"))).alias("top_name"),
        F.sum("value").alias("shown_total"),
        F.sum(F.when(F.col("rank") == 1, F.col("value"))).alias("top1"),
        F.sum(F.when(F.col("rank") <= 2, F.col("value"))).alias("top2"),
        F.count(F.lit(1)).alias("n_shown"))
        .select("key", "top_name", "n_shown",
                F.when(F.col("shown_total") > 0, F.col("top1") / F.col("shown_total") * 100).otherwise(0.0)
                 .alias("top_share"),
                F.when(F.col("shown_total") > 0, F.col("top2") / F.col("shown_total") * 100).otherwise(0.0)
                 .alias("top2_share"))
        .withColumn("concentrated", F.col("top_share") > 50))


def trend(summary: DataFrame, value_cols: list[str]) -> DataFrame:
    """K5: sum per period of the coarsest time part for the given value
    columns; each row carries the change vs the previous period."""
    tparts = [t for t in TIME_PARTS if t in summary.columns]
    if not tparts:
        return summary.sparkSession.createDataFrame([], "metric string, period bigint, value double, pct_change double")
    tc = tparts[0]
    vals = [v for v in value_cols if f"{v}_sum" in summary.columns]
    arr = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}_sum").cast("double").alias("v")) for v in vals])
    long = summary.where(_q(tc).isNotNull()).select(_q(tc).alias("period"), F.explode(arr).alias("kv")) \
                  .select("period", "kv.*")
    series = long.groupBy("metric", "period").agg(F.sum("v").alias("value"))
    prev = F.lag("value").over(Window.partitionBy("metric").orderBy("period"))
    return series.withColumn("pct_change", F.when(prev != 0, (F.col("value") - prev) / prev * 100)
                             .when(prev.isNotNull(), F.lit(0.0)))


def top_n(summary: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """K7: the n largest groups (shown ascending) with shares of the shown rows."""
    g = _grouped(summary, key, value)
    w = Window.orderBy(F.col("value").desc(), F.col("name"))
    shown = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    tot = F.sum("value").over(Window.partitionBy())
    return shown.select(F.col("name").cast("string").alias("name"), "value", "rank",
                        pct(F.col("value"), tot).alias("share_of_shown"))


def top_n_gap(top: DataFrame) -> DataFrame:
    """K7: best vs worst shown group, gap % (0 when the worst is not > 0)."""
    g = top.agg(F.max_by("name", F.struct(F.col("value"), -F.col("rank"))).alias("best"),
                F.min_by("name", F.struct(F.col("value"), -F.col("rank"))).alias("worst"),
                F.max("value").alias("best_value"), F.min("value").alias("worst_value"))
    return g.select("best", "worst", "best_value", "worst_value",
                    F.when(F.col("worst_value") > 0,
                           (F.col("best_value") - F.col("worst_value")) / F.col("worst_value") * 100)
                     .otherwise(0.0).alias("gap_pct"),
                    (F.col("best_value") - F.col("worst_value")).alias("gap_abs"))


def performance_gap(summary: DataFrame, key: str, value: str, by: list[str] = ()) -> DataFrame:
    """K8: bottom-3 mean vs the top group, gap %, and a 10 % lift of the
    bottom three with its share of the total.  Needs at least 3 groups."""
    g = _grouped(summary, key, value, by)
    w_up = Window.partitionBy(*by).orderBy(F.col("value").asc(), F.col("name"))
    w_all = Window.partitionBy(*by)
    r = (g.withColumn("rn", F.row_number().over(w_up)).withColumn("n", F.count(F.lit(1)).over(w_all))
          .withColumn("total", F.sum("value").over(w_all)).withColumn("top1", F.max("value").over(w_all)))
    agg = r.where(F.col("n") >= 3).groupBy(*by).agg(
        F.first("top1").alias("top_value"), F.first("total").alias("total"),
        F.sum(F.when(F.col("rn") <= 3, F.col("value"))).alias("bottom3_sum"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", F.col("name").cast("string").alias("name"))))),
                                 lambda s: s["name"]), ", ").alias("bottom3"))
    mean3 = F.col("bottom3_sum") / 3
    return agg.select(*by, F.lit(key).alias("key"), "bottom3", mean3.alias("bottom3_mean"), "top_value",
                      F.when(mean3 > 0, (F.col("top_value") - mean3) / mean3 * 100).otherwise(0.0).alias("gap_pct"),
                      (F.col("bottom3_sum") * 0.1).alias("lift_value"),
                      pct(F.col("bottom3_sum") * 0.1, F.col("total")).alias("lift_share"))
