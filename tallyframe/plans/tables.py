"""Driver tables and the derived test inputs shared by the query catalog.

Each derived input has a Spark builder here and the identical SQL text in
``oracle.py``; they inject NULLs, duplicates, padded strings and string
dates into the given tables (all of them keep every row).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a task that looks for every fact pattern (some 0.7 ms each).
FACT_ROWS = 20_000


def load(spark: SparkSession, sf_dir: str, name: str, rows_a_task: int | None = None) -> DataFrame:
    from tallyframe.sources.files import read_table
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"), rows_a_task=rows_a_task)


def lineitem_with_nulls(spark, sf_dir) -> DataFrame:
    """lineitem with NULLs: discount every 7th order, return flag every 3rd,
    tax kept only every 10th order (a sparse column)."""
    li = load(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(k % 7 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(k % 10 == 0, F.col("l_tax")).alias("l_tax"),
        F.when(k % 3 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


def orders_with_copies(spark, sf_dir) -> DataFrame:
    """orders stacked twice: every row has one exact copy."""
    o = load(spark, sf_dir, "orders")
    return o.unionAll(o)


def orders_late_types(spark, sf_dir) -> DataFrame:
    """orders as strings, sorted by key: in the last tenth the key becomes
    fractional and the status code a word."""
    o = load(spark, sf_dir, "orders")
    top = o.agg(F.max("o_orderkey")).first()[0] or 0
    k, late = F.col("o_orderkey"), F.col("o_orderkey") * 10 > 9 * top
    return (o.orderBy("o_orderkey")
            .select(F.when(late, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")).alias("measure"),
                    F.when(late, F.lit("late")).otherwise((k % 7).cast("string")).alias("code"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
                    F.when(k % 2 == 0, F.lit("TRUE")).otherwise(F.lit("false")).alias("even")))


def lineitem_with_nan(spark, sf_dir) -> DataFrame:
    """lineitem with NaN: discount every 7th order, tax but every 10th."""
    li = load(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    return (li.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 == 0, nan).otherwise(F.col("l_discount")))
              .withColumn("l_tax", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax")).otherwise(nan)))


def asked_turns(spark, sf_dir) -> DataFrame:
    """conversations with a suggested question in place of each text."""
    from tallyframe.functions import fixed
    asked = F.array(*[F.lit(q) for q in fixed.SUGGESTED_QUESTIONS])
    n = (F.col("conv_id") + F.col("turn")) % len(fixed.SUGGESTED_QUESTIONS) + 1
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(asked, n.cast("int")).alias("text"))


#: Fact lines of an order: texts, and in braces k (order), c (customer), p (a
#: share), s (status), r (priority).
FACT_LINES = """Original dataset: {k} rows × {c} columns.
After aggregation: {c} summary rows (reduction: {p}%).
Best model: Model {s}. Task: regression.
Model 'm': Accuracy (%)={p}, F1-Score (%)={p}, R² (%)={p}, Overfit Gap=-{p}
Top 3 predictive features: {r}, two, three
Year-over-year performance: -{p}% change in '{s}' from 2020 to 2021.
Top segment: '{r}' in 'o_orderpriority' = {p}% of total sales.
{k} duplicate rows.
  'feature {c}': 0.5000 ({p}%)
Underperforming segments: {r} and {s}
Column '{s}' has {p}% missing values.
  [High] Order {k}: the body of this line has more than forty characters for {r}
'first {c}' and 'second' have correlation -0.{k}
"""


def order_fact_lines(spark, sf_dir) -> DataFrame:
    import re
    value = {"k": F.col("o_orderkey").cast("string"), "c": F.col("o_custkey").cast("string"),
             "p": F.concat((F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(".5")),
             "s": F.col("o_orderstatus"), "r": F.col("o_orderpriority")}
    parts = re.split(r"\{(\w)\}", FACT_LINES)
    text = F.concat(*[value[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])
    return load(spark, sf_dir, "orders", FACT_ROWS).select("o_orderkey", text.alias("text"))


def supplier_kpis(spark, sf_dir) -> DataFrame:
    """One KPI row for each supplier in lineitem; its key spreads the figures
    over all branches of the rules."""
    g, n = F.col("l_suppkey"), F.col("n")
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    d = lambda c: c.cast("double")
    return rows.select(
        "l_suppkey", (n * 3).alias("n_rows"), F.lit("l_tax").alias("worst_missing_col"), d(g * 7 % 45).alias("worst_missing_pct"),
        (g % 3 * n).alias("duplicates"), d(g * 5 % 11).alias("duplicate_pct"), F.lit("sales").alias("primary_col"),
        F.lit(2001).cast("bigint").alias("latest_year"), F.lit(2000).cast("bigint").alias("previous_year"),
        d(n + 100).alias("latest_year_val"), d(n + 50).alias("prev_year_val"), d(g * 11 % 71 - 35).alias("yoy_growth_pct"),
        F.lit("region").alias("top_category_col"), F.concat(F.lit("R"), g).alias("top_category_name"),
        d(g * 13 % 100).alias("top_category_share"), d(n).alias("top_category_value"),
        F.when(g % 2 == 0, F.concat(F.lit("B"), g)).alias("bottom3"), F.lit("l_returnflag").alias("gap_key"),
        F.lit("l_tax").alias("gap_value_col"), d(n).alias("bottom3_mean"), d(n * 2).alias("top_value"), d(g % 90).alias("gap_pct"),
        d(n * 4).alias("lift_value"), d(g % 10).alias("lift_share"),
        F.when(g % 5 != 0, F.lit("Random Forest")).alias("best_model"), d(g * 17 % 100).alias("best_score"),
        F.when(g % 4 < 2, "classification").otherwise("regression").alias("task"),
        F.when(g % 7 != 0, F.lit("l_quantity")).alias("top_feature"), d(g % 60).alias("top_feature_share"),
        d(g % 31).alias("overfit_gap"))


def orders_padded(spark, sf_dir) -> DataFrame:
    """orders with padded status strings and 'None'/'nan'/'' literals."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "))
    prio = (F.when(k % 11 == 0, F.lit("None")).when(k % 13 == 0, F.lit("nan"))
             .when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("\t"), F.col("o_orderpriority"))))
    return o.select("o_orderkey", status.alias("o_orderstatus"), prio.alias("o_orderpriority"), "o_totalprice")


def orders_string_dates(spark, sf_dir) -> DataFrame:
    """orders with the date as text in several formats and some junk."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    s = (F.when(k % 13 == 0, F.lit("junk"))
          .when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy"))
          .when(k % 5 == 2, F.date_format(d, "yyyy/MM/dd"))
          .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return o.select("o_orderkey", s.alias("order_date"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def asked_of_suppliers(spark, sf_dir) -> DataFrame:
    """conversations as questions (q_id, l_suppkey, text): the suggested
    ones, one on size and one on risks, each of the report of a supplier."""
    from tallyframe.functions import fixed
    texts = [*fixed.SUGGESTED_QUESTIONS, *MORE_QUESTIONS]
    asked = F.array(*[F.lit(q) for q in texts])
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(texts))) + 1
    keys = load(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("suppliers"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn").join(F.broadcast(keys))   # one row
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("q_id"),
                        F.pmod(F.col("conv_id"), F.col("suppliers")).cast("long").alias("l_suppkey"),
                        F.element_at(asked, n.cast("int")).alias("text"))


#: Questions on size and risks, which no suggested question reaches.
MORE_QUESTIONS = ["How many rows are there?", "Is there any danger?"]

#: 100 columns of lineitem with NULLs: the numbers, and multiples with waves.
WIDE_COLUMNS = [(f"w{i:02d}", f"{base} * {1 + i % 5} + {(i * 7) % 13} * ((l_orderkey + {i} * l_linenumber) % {11 + i})")
                for i, base in enumerate(["l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_partkey"] * 20)]


def customer_regions(spark, sf_dir) -> DataFrame:
    """customer with the name of the nation and the number of its region."""
    nation = load(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region_no")
    return (load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_acctbal", "c_mktsegment", "region_no", "n_name"))


#: Classes of eight string columns of a line's part.
CLASS_SIZES = [3, 5, 7, 11, 13, 17, 19, 23]


def lineitem_many_keys(spark, sf_dir) -> DataFrame:
    """lineitem with eight columns of classes; every 29th part has none of
    the third."""
    part = F.col("l_partkey")
    classes = [F.when((part % 29 != 0) | F.lit(m != 7), F.concat(F.lit("v"), (part % m).cast("string"))).alias(f"c{m:02d}")
               for m in CLASS_SIZES]
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", *classes)


def orders_ids(spark, sf_dir) -> DataFrame:
    """orders as text: a key, one of twenty digits, one of three with
    zeros, a signed number, and whole numbers beyond 2^53 beside fractions."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("12345678901"), F.lpad(k.cast("string"), 9, "0")).alias("long_id"),
        F.lpad((k % 1000).cast("string"), 3, "0").alias("code"), F.concat(F.lit("+49"), k.cast("string")).alias("phone"),
        F.when(k % 2 == 0, F.concat((k % 10).cast("string"), F.lit(".5"))).otherwise(
            F.concat(F.lit("9007199254"), F.lpad(k.cast("string"), 9, "0"))).alias("mixed"),
        F.concat((k % 100).cast("string"), F.lit(".25")).alias("part"))
