"""Registered queries of typed facts, wide statistics and drawn samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import round_doubles
from tallyframe.operators import clean as C
from tallyframe.operators import facts as FT
from tallyframe.operators import gram as G
from tallyframe.operators import modeling as M
from tallyframe.operators import stats as X
from tallyframe.operators import text as T
from tallyframe.plans import tables as TB

BY = ["l_suppkey"]


def _supplier_facts(spark, sf_dir) -> DataFrame:
    """Facts of lineitem, a report for each supplier."""
    return FT.fact_table(TB.lineitem_with_nulls(spark, sf_dir), BY, ["l_returnflag", "l_linestatus"],
                         ["l_extendedprice", "l_quantity"], "l_shipdate", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


def t8_facts(spark, sf_dir):
    return round_doubles(_supplier_facts(spark, sf_dir), 4)


def t7_structured(spark, sf_dir):
    """Every turn asks a suggested question, or one on size or risks, of a
    supplier's report; the answer comes from the facts of that report."""
    turns = TB.asked_of_suppliers(spark, sf_dir)
    return FT.answer_from_facts(turns, "q_id", "text", _supplier_facts(spark, sf_dir), BY)


def r1_sections_by_supplier(spark, sf_dir):
    """Sections of the reports of all suppliers."""
    return round_doubles(FT.report_sections(_supplier_facts(spark, sf_dir), BY, 5), 4)


def m7_ridge_coefficients(spark, sf_dir):
    """Ridge of l_extendedprice on three columns of all of lineitem."""
    li = TB.load(spark, sf_dir, "lineitem")
    return round_doubles(G.ridge(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 4)


def m7_ridge_by_flag(spark, sf_dir):
    li = TB.lineitem_with_nulls(spark, sf_dir)
    return round_doubles(G.ridge(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 10.0, ["l_returnflag"]), 4)


def x1_wide(spark, sf_dir):
    """Correlations of 100 columns derived from lineitem, in one scan."""
    li = TB.lineitem_with_nulls(spark, sf_dir)
    wide = li.select(*[F.expr(e).alias(n) for n, e in TB.WIDE_COLUMNS])
    return round_doubles(X.correlation_pairs(wide, wide.columns), 4)


def m5_split(spark, sf_dir):
    o = TB.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return M.drawn_split(o, "o_orderkey", "o_orderpriority")


def m6_folds(spark, sf_dir):
    o = TB.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return M.drawn_folds(o, "o_orderkey", "o_orderpriority")


def m3_label_encoding_names(spark, sf_dir):
    """Codes of a column of many values, and of one of few."""
    part = TB.load(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type"]
    coded = M.encode_strings(part, names)
    return coded.select("p_partkey", *[F.col(n).cast("long").alias(n) for n in names])


def c5_equal_names(spark, sf_dir):
    """All columns of orders under names that become equal in pairs."""
    o = TB.load(spark, sf_dir, "orders")
    odd = o.toDF("Order Key", "order-key", "Status!", "(status)", "Order  Date", "%%")
    return round_doubles(C.snake_case_columns(odd), 4)


def s1_exact_ids(spark, sf_dir):
    """Long ids, codes with leading zeros and numbers with a sign, from CSV:
    every value as it was written, and the type that each column got."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_csv, write_csv
    back = read_csv(spark, write_csv(TB.orders_ids(spark, sf_dir), shared_path(spark, "ids-csv")))
    kinds = F.lit(",".join(t for _, t in back.dtypes)).alias("kinds")
    return back.select(*[F.col(c).cast("string").alias(c) for c in back.columns], kinds)


def t2_tfidf(spark, sf_dir):
    return T.tfidf(TB.load(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def t2_tfidf_topk(spark, sf_dir):
    """The seven documents nearest to each benchmark item by TF-IDF cosine."""
    top = T.tfidf_topk(TB.load(spark, sf_dir, "benchmark"), "item_id", "text", TB.load(spark, sf_dir, "documents"), "doc_id", "text")
    return top.select("q_id", "c_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    "t8_facts": t8_facts,
    "t7_structured": t7_structured,
    "r1_sections_by_supplier": r1_sections_by_supplier,
    "m7_ridge_coefficients": m7_ridge_coefficients,
    "m7_ridge_by_flag": m7_ridge_by_flag,
    "x1_wide": x1_wide,
    "m5_split": m5_split,
    "m6_folds": m6_folds,
    "m3_label_encoding_names": m3_label_encoding_names,
    "c5_equal_names": c5_equal_names,
    "s1_exact_ids": s1_exact_ids,
    "t2_tfidf": t2_tfidf,
    "t2_tfidf_topk": t2_tfidf_topk,
}
