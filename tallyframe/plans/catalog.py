"""Registered queries: one per operator of the inventory, on the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables.  Double columns are rounded to 4 decimals at the very end so that
results compare across engines (summation order); nothing else is rounded.
Money values (two decimals in the tables) are summed as exact decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import numeric_columns, round_doubles
from tallyframe.operators import clean as C
from tallyframe.operators import decisions as D
from tallyframe.operators import kpi as K
from tallyframe.operators import modeling as M
from tallyframe.operators import profile as P
from tallyframe.operators import stats as X
from tallyframe.operators import text as T
from tallyframe.operators import summarize as A
from tallyframe.plans import tables as TB

MONEY = 2


def _r(df: DataFrame) -> DataFrame:
    return round_doubles(df, 4)


def _orders_summary(spark, sf_dir):
    return A.summarize(TB.load(spark, sf_dir, "orders"), money_scale=MONEY)


# ---------------------------------------------------------------------------
# Sources
# ---------------------------------------------------------------------------

def s1_csv_roundtrip(spark, sf_dir):
    """orders written as CSV to the shared folder, read back with the null
    tokens and the sample-based type inference."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_csv, write_csv
    o = TB.load(spark, sf_dir, "orders")
    path = write_csv(o, shared_path(spark, "orders-csv"))
    return _r(read_csv(spark, path))


def s2_read_many(spark, sf_dir):
    """Two CSV inputs with different columns stacked by name."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_csv, read_many, write_csv
    o = TB.load(spark, sf_dir, "orders")
    first = write_csv(o.where(F.col("o_orderstatus") == "F"), shared_path(spark, "orders-f"))
    rest = write_csv(o.where(F.col("o_orderstatus") != "F").withColumn("note", F.lit("NA")),
                     shared_path(spark, "orders-rest"))
    return _r(read_many([read_csv(spark, first), read_csv(spark, rest)]))


def s1_documents_roundtrip(spark, sf_dir):
    """documents as CSV and back: quotes, commas and line ends in cells."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_csv, write_csv
    docs = TB.load(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit('say "hi", '), F.col("text")))
    return read_csv(spark, write_csv(docs, shared_path(spark, "documents-csv")), multi_line=True)


def s1_late_types(spark, sf_dir):
    """orders as CSV whose key turns fractional in the last tenth of the
    rows, and whose last column stops being a number there."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_csv, write_csv
    return read_csv(spark, write_csv(TB.orders_late_types(spark, sf_dir), shared_path(spark, "late-csv")))


def p4_missing_nan(spark, sf_dir):
    """Missing values of a stored lineitem that holds NaN for NULL."""
    from tallyframe.session import shared_path
    from tallyframe.sources.files import read_table
    path = shared_path(spark, "lineitem-nan")
    TB.lineitem_with_nan(spark, sf_dir).write.parquet(path)
    return _r(P.missing_report(read_table(spark, path)))


def a2_summary_nan(spark, sf_dir):
    """Summary of orders whose price is NaN in every sixth row."""
    price = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    rows = TB.load(spark, sf_dir, "orders").withColumn("o_totalprice", price)
    return _r(A.summarize(rows, money_scale=MONEY).table)


def c7_stray_date(spark, sf_dir):
    """Summary of orders with a string column of which one value in a
    hundred is a date: it isn't the time column, and no row is lost."""
    stray = F.when(F.col("o_orderkey") % 100 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")) \
        .otherwise(F.concat(F.lit("d"), F.col("o_orderkey")))
    rows = TB.load(spark, sf_dir, "orders").withColumn("note_date", stray).drop("o_orderdate")
    return _r(A.summarize(rows, money_scale=MONEY).table)


def s6_preview(spark, sf_dir):
    return _r(TB.load(spark, sf_dir, "orders").orderBy("o_orderkey").limit(10))


def s7_fingerprint(spark, sf_dir):
    from tallyframe.sources.files import fingerprint
    return fingerprint(TB.load(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------

def p1_roles_orders(spark, sf_dir):
    o = TB.load(spark, sf_dir, "orders")
    o = o.withColumn("o_orderdate_str", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.classify_columns(o)


def p1_roles_documents(spark, sf_dir):
    return P.classify_columns(TB.load(spark, sf_dir, "documents"))


def p2_column_summary(spark, sf_dir):
    return _r(P.column_summary(TB.load(spark, sf_dir, "customer")))


def p3_describe(spark, sf_dir):
    return _r(P.describe(TB.load(spark, sf_dir, "lineitem")))


def p4_missing(spark, sf_dir):
    return _r(P.missing_report(TB.lineitem_with_nulls(spark, sf_dir)))


def p5_duplicates(spark, sf_dir):
    return _r(P.duplicate_stats(TB.orders_with_copies(spark, sf_dir)))


def p6_overview(spark, sf_dir):
    df = TB.orders_with_copies(spark, sf_dir).withColumn(
        "o_comment", F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")))
    return _r(P.overview(df))


def p7_worst_missing(spark, sf_dir):
    return _r(P.worst_missing(TB.lineitem_with_nulls(spark, sf_dir), 20.0))


def p8_numeric_target(spark, sf_dir):
    return _r(P.numeric_target_profile(TB.load(spark, sf_dir, "lineitem"), "l_extendedprice"))


def p9_categorical_target(spark, sf_dir):
    return _r(P.categorical_target_profile(TB.load(spark, sf_dir, "orders"), "o_orderpriority"))


def p10_domain_documents(spark, sf_dir):
    return P.domain_scores(TB.load(spark, sf_dir, "documents"), "text", ["doc_id"])


def p11_target_keywords(spark, sf_dir):
    return P.target_scores(TB.load(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------

def c1_drop_sparse(spark, sf_dir):
    return _r(C.drop_sparse_columns(TB.lineitem_with_nulls(spark, sf_dir)))


def c2_dedup(spark, sf_dir):
    return _r(C.drop_duplicate_rows(TB.orders_with_copies(spark, sf_dir)))


def c3_trim_nullify(spark, sf_dir):
    return _r(C.trim_and_nullify(TB.orders_padded(spark, sf_dir)))


def c4_integer_types(spark, sf_dir):
    return C.integer_ranges(TB.load(spark, sf_dir, "lineitem"))


def c5_snake_case(spark, sf_dir):
    o = TB.load(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total-Price ($)"),
                 F.col("o_orderstatus").alias(" Order__Status "))
    return _r(C.snake_case_columns(o))


def c6_parse_dates(spark, sf_dir):
    df = TB.orders_string_dates(spark, sf_dir)
    return C.coerce_dates(df, ["order_date"]).select("o_orderkey", "order_date")


def c8_time_parts(spark, sf_dir):
    o = TB.load(spark, sf_dir, "orders")
    return C.add_time_parts(o, "o_orderdate").select("o_orderkey", "_year", "_quarter", "_month")


# ---------------------------------------------------------------------------
# Summary
# ---------------------------------------------------------------------------

def a1_group_keys(spark, sf_dir):
    s = A.summarize(TB.load(spark, sf_dir, "orders"), money_scale=MONEY)
    rows = [("key", i, k, s.meta["key_distinct"].get(k)) for i, k in enumerate(s.meta["candidate_keys"])]
    rows += [("value", i, v, None) for i, v in enumerate(s.meta["value_cols"])]
    return spark.createDataFrame(rows, "role string, position int, column_name string, n_distinct bigint")


def a2_summary_orders(spark, sf_dir):
    return _r(_orders_summary(spark, sf_dir).table)


def a3_global_aggregate(spark, sf_dir):
    rows = C.clean(TB.load(spark, sf_dir, "orders"))
    return _r(A.group_summary(rows, [], ["o_orderkey", "o_custkey", "o_totalprice"], MONEY))


def a4_prefix_levels(spark, sf_dir):
    li = TB.lineitem_with_nulls(spark, sf_dir)
    s = A.summarize(li, max_rows=100, money_scale=MONEY)
    keys = s.meta["candidate_keys"]
    counts = s.level_counts
    rows = [(j, int(counts[j]), A.choose_prefix(dict(enumerate(counts)), len(keys), 100) == j,
             A.choose_prefix(dict(enumerate(counts)), len(keys), 2000) == j) for j in range(len(keys) + 1)]
    return spark.createDataFrame(rows, "n_keys int, groups bigint, chosen_100 boolean, chosen_2000 boolean")


def a4_summary_lineitem_100(spark, sf_dir):
    s = A.summarize(TB.lineitem_with_nulls(spark, sf_dir), max_rows=100, money_scale=MONEY)
    return _r(s.table)


def a5_describe_fallback(spark, sf_dir):
    docs = TB.load(spark, sf_dir, "documents").select("lang", "source")
    return _r(A.summarize(docs).table)


def a6_reduction_meta(spark, sf_dir):
    return _r(A.reduction_meta(spark, _orders_summary(spark, sf_dir).meta))


def a7_reaggregate(spark, sf_dir):
    return _r(A.reaggregate(_orders_summary(spark, sf_dir).table, "o_orderpriority", "o_totalprice"))


def a8_value_counts(spark, sf_dir):
    return A.value_counts(TB.load(spark, sf_dir, "lineitem"), "l_returnflag")


# ---------------------------------------------------------------------------
# KPIs (orders summary, target o_totalprice)
# ---------------------------------------------------------------------------

def _kpi_inputs(spark, sf_dir):
    s = _orders_summary(spark, sf_dir)
    primary = K.primary_metric(s.table, s.meta["value_cols"], "o_totalprice")
    return s, primary, K.category_keys(s.meta["group_keys"])


def k1_primary_metric(spark, sf_dir):
    s, p, _ = _kpi_inputs(spark, sf_dir)
    return _r(K.primary_totals(s.table, p))


def k2_yoy(spark, sf_dir):
    s, p, _ = _kpi_inputs(spark, sf_dir)
    return _r(K.yoy_growth(s.table, p))


def k2_yoy_by_status(spark, sf_dir):
    s, p, _ = _kpi_inputs(spark, sf_dir)
    return _r(K.yoy_growth(s.table, p, by=["o_orderstatus"]))


def k3_top_category(spark, sf_dir):
    s, p, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.top_category(s.table, cats[0], p))


def k3_top_category_by_year(spark, sf_dir):
    s, p, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.top_category(s.table, cats[1], p, by=["_year"]))


def k4_breakdown(spark, sf_dir):
    s, _, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.breakdown(s.table, cats, s.meta["value_cols"][0], 5))


def k5_trend(spark, sf_dir):
    s, _, _ = _kpi_inputs(spark, sf_dir)
    return _r(K.trend(s.table, s.meta["value_cols"]))


def k6_concentration(spark, sf_dir):
    s, p, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.concentration(s.table, cats, s.meta["value_cols"][0], 15))


def k7_top_n(spark, sf_dir):
    s, p, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.top_n_gap(K.top_n(s.table, cats[0], s.meta["value_cols"][0], 10)))


def k8_performance_gap(spark, sf_dir):
    s, _, cats = _kpi_inputs(spark, sf_dir)
    return _r(K.performance_gap(s.table, cats[0], s.meta["value_cols"][0]))


# ---------------------------------------------------------------------------
# Statistics (raw lineitem, first 10 numeric columns)
# ---------------------------------------------------------------------------

def _li_pairs(spark, sf_dir):
    li = TB.load(spark, sf_dir, "lineitem")
    cols = [f.name for f in li.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
    return X.correlation_pairs(li, cols)


def x1_correlation(spark, sf_dir):
    return _r(_li_pairs(spark, sf_dir))


def x1_correlation_summary(spark, sf_dir):
    t = _orders_summary(spark, sf_dir).table
    return _r(X.correlation_pairs(t, X.summary_value_columns(t)))


def x2_strong_pairs(spark, sf_dir):
    return _r(X.strong_pairs(_li_pairs(spark, sf_dir), 0.5))


def x2_strongest_pair(spark, sf_dir):
    return _r(X.strongest_pair(_li_pairs(spark, sf_dir)))


def x3_top_predictors(spark, sf_dir):
    return _r(X.top_predictors(_li_pairs(spark, sf_dir), "l_extendedprice", 3))


def x4_histograms(spark, sf_dir):
    li = TB.load(spark, sf_dir, "lineitem")
    cols = X.histogram_columns(li, numeric_columns(li))
    return _r(X.histograms(li, cols, 25))


def x5_skewness(spark, sf_dir):
    li = TB.load(spark, sf_dir, "lineitem")
    return _r(X.skewness(li, numeric_columns(li)))


# ---------------------------------------------------------------------------
# Decisions (orders plus a duplicated slice; no model results, like the
# first decision pass of the pipeline)
# ---------------------------------------------------------------------------

DECISION_COLS = ["kind", "rule_id", "ord", "level", "type", "title", "expected_impact"]


def _decision_inputs(spark, sf_dir, by=()):
    rows = TB.orders_with_copies(spark, sf_dir)
    s = A.summarize(rows, money_scale=MONEY)
    primary = K.primary_metric(s.table, s.meta["value_cols"], "o_totalprice")
    return D.decision_inputs(rows, s.table, s.meta, primary, by=by)


def d_decisions(spark, sf_dir):
    return D.decide(_decision_inputs(spark, sf_dir)).select(*DECISION_COLS)


def d_decisions_by_status(spark, sf_dir):
    by = ["o_orderstatus"]
    return D.decide(_decision_inputs(spark, sf_dir, by), by).select(*by, *DECISION_COLS)


def d_rules_by_supplier(spark, sf_dir):
    """Every branch of every rule, on KPI rows of suppliers."""
    rules = D.decide(TB.supplier_kpis(spark, sf_dir), ["l_suppkey"], module_low_accuracy=True)
    return rules.select("l_suppkey", *DECISION_COLS)


def d11_decision_counts(spark, sf_dir):
    by = ["o_orderstatus"]
    return D.decision_counts(D.decide(_decision_inputs(spark, sf_dir, by), by), by)


# ---------------------------------------------------------------------------
# Text (whole documents and conversation tables)
# ---------------------------------------------------------------------------

def _doc_chunks(spark, sf_dir):
    return T.chunk_text(TB.load(spark, sf_dir, "documents"), "text", ["doc_id"])


def t1_chunks(spark, sf_dir):
    from tallyframe.functions.columns import split_words
    c = F.col("chunk")
    return _doc_chunks(spark, sf_dir).select("doc_id", "chunk_no", F.size(split_words(c)).alias("n_words"),
                                             F.length(c).alias("n_chars"), F.md5(c).alias("chunk_md5"))


def t3_cosine_topk(spark, sf_dir):
    emb = TB.load(spark, sf_dir, "embeddings")
    queries = T.label_centroids(emb, "label", "embedding")
    return _r(T.cosine_topk(queries, "label", "centroid", emb, "vec_id", "embedding", 7))


def _user_turns(spark, sf_dir):
    conv = TB.load(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "user").select(
        F.format_string("%d:%d", "conv_id", "turn").alias("q_id"), "text")


def t4_keyword_topk(spark, sf_dir):
    return T.keyword_topk(_user_turns(spark, sf_dir), "q_id", "text", _doc_chunks(spark, sf_dir),
                          ["doc_id", "chunk_no"], "chunk", 7)


def t5_intents(spark, sf_dir):
    return T.route_intents(TB.load(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


def _flat_facts(df: DataFrame, text_col: str, ids: list[str]) -> DataFrame:
    from tallyframe.functions import fixed
    f = T.extract_facts(df, text_col, ids)
    cols = [F.col(c) for c in ids] + [F.col(n) for n, _ in fixed.FACT_PATTERNS]
    for name, pat in fixed.FACT_LIST_PATTERNS:
        arr = F.col(name)
        first = F.try_element_at(arr, F.lit(1))
        if T._group_count(pat) > 1:
            first = first["g1"]
        cols += [F.size(arr).alias(f"n_{name}"), first.alias(f"{name}_first")]
    return f.select(*cols)


def t5_suggested(spark, sf_dir):
    """Intents of the suggested questions, one for each turn."""
    return T.route_intents(TB.asked_turns(spark, sf_dir), "text", ["conv_id", "turn"])


def t6_facts_orders(spark, sf_dir):
    """Facts read back from fact lines written for every order."""
    return _flat_facts(TB.order_fact_lines(spark, sf_dir), "text", ["o_orderkey"])


def t6_facts_documents(spark, sf_dir):
    return _flat_facts(TB.load(spark, sf_dir, "documents", TB.FACT_ROWS), "text", ["doc_id"])


# ---------------------------------------------------------------------------
# Models
# ---------------------------------------------------------------------------

def m1_task_detection(spark, sf_dir):
    li = TB.load(spark, sf_dir, "lineitem")
    rows = [(t, M.detect_task(li, t)) for t in ["l_extendedprice", "l_linenumber", "l_returnflag", "l_discount"]]
    return spark.createDataFrame(rows, "target string, task string")


def m3_label_encoding(spark, sf_dir):
    o = TB.orders_padded(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return M.encode_strings(C.trim_and_nullify(o), ["o_orderstatus", "o_orderpriority"])


def m4_prepare_impute(spark, sf_dir):
    li = TB.lineitem_with_nulls(spark, sf_dir).drop("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey")
    return _r(M.prepare(li, "l_extendedprice").data.drop("__h"))


def _fitted_lines(spark, sf_dir):
    """l_extendedprice predicted by a least-squares line on each of three
    columns (fitted over the whole table) - a prediction table for M11/M12."""
    li = TB.load(spark, sf_dir, "lineitem")
    xs = ["l_quantity", "l_discount", "l_tax"]
    y = F.col("l_extendedprice")
    fit = li.agg(*[F.struct(F.regr_slope(y, F.col(x)).alias("b"), F.regr_intercept(y, F.col(x)).alias("a"))
                   .alias(x) for x in xs])
    arr = F.array(*[F.struct(F.lit(x).alias("model"), F.lit(i).alias("model_order"),
                             (F.col(f"f.{x}.a") + F.col(f"f.{x}.b") * F.col(x)).alias("prediction"))
                    for i, x in enumerate(xs)])
    joined = li.select("l_extendedprice", *xs, F.lit(1).alias("__k")).join(
        F.broadcast(fit.select(F.struct(*xs).alias("f"), F.lit(1).alias("__k"))), "__k")
    return joined.select(y.alias("label"), F.explode(arr).alias("p")).select("label", "p.*")


def m11_regression_metrics(spark, sf_dir):
    return _r(M.regression_metrics(_fitted_lines(spark, sf_dir), by=["model"]))


def m11_classification_metrics(spark, sf_dir):
    lab = TB.load(spark, sf_dir, "labels")
    return _r(M.classification_metrics(lab, "quality", "toxic"))


def m12_best_model(spark, sf_dir):
    met = M.regression_metrics(_fitted_lines(spark, sf_dir), by=["model", "model_order"])
    return _r(M.best_model(met.withColumn("primary_score", F.col("r2_pct"))).drop("primary_score"))


def _orders_training(spark, sf_dir, cv=True):
    return M.train_models(_orders_summary(spark, sf_dir).table, "o_totalprice", cv=cv)


def _quality_training(spark, sf_dir, cv=True):
    docs = TB.load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    df = TB.load(spark, sf_dir, "labels").join(docs, "doc_id").drop("doc_id")
    return M.train_models(df, "quality", cv=cv)


def m_train_regression(spark, sf_dir):
    return _orders_training(spark, sf_dir).results


def m_train_classification(spark, sf_dir):
    return _quality_training(spark, sf_dir).results


def m13_importance(spark, sf_dir):
    return _quality_training(spark, sf_dir, cv=False).importance


def m14_permutation(spark, sf_dir):
    return _orders_training(spark, sf_dir, cv=False).permutation


def m15_predictions(spark, sf_dir):
    return _orders_training(spark, sf_dir, cv=False).predictions


def r2_insights(spark, sf_dir):
    """R2: sentences on missing values, trend, concentration, shape, gap."""
    from tallyframe.operators import report as R
    return R.insight_lines(R.analyze(TB.load(spark, sf_dir, "orders"), target="o_totalprice", money_scale=MONEY))


def r2_model_insight(spark, sf_dir):
    return M.model_insight(_quality_training(spark, sf_dir, cv=False))


def m16_comparison(spark, sf_dir):
    return M.comparison_table(_quality_training(spark, sf_dir).results)


# ---------------------------------------------------------------------------
# Facts, answers, report (orders, target o_totalprice)
# ---------------------------------------------------------------------------

def _orders_analysis(spark, sf_dir, train=False):
    from tallyframe.operators import report as R
    return R.analyze(TB.load(spark, sf_dir, "orders"), "o_totalprice", train=train, money_scale=MONEY)


def t8_context_lines(spark, sf_dir):
    from tallyframe.operators import report as R
    return R.context_lines(_orders_analysis(spark, sf_dir))


def t7_answers(spark, sf_dir):
    from tallyframe.operators import answers as Q
    from tallyframe.operators import report as R
    lines = R.context_lines(_orders_analysis(spark, sf_dir))
    return Q.answer_questions(_user_turns(spark, sf_dir), "q_id", "text", lines)


def r1_report(spark, sf_dir):
    from tallyframe.operators import report as R
    return R.report_lines(_orders_analysis(spark, sf_dir))


def r1_report_models(spark, sf_dir):
    from tallyframe.operators import report as R
    return R.report_lines(_orders_analysis(spark, sf_dir, train=True))


def s4_report_plain(spark, sf_dir):
    from tallyframe.operators import report as R
    from tallyframe.sources.files import plain_text
    lines = R.report_lines(_orders_analysis(spark, sf_dir))
    return lines.select("section", "ord", "sub", plain_text(F.col("line")).alias("line"))


QUERIES = {
    "s1_csv_roundtrip": s1_csv_roundtrip,
    "s1_documents_roundtrip": s1_documents_roundtrip,
    "s1_late_types": s1_late_types,
    "s2_read_many": s2_read_many,
    "s6_preview": s6_preview,
    "s7_fingerprint": s7_fingerprint,
    "p1_roles_orders": p1_roles_orders,
    "p1_roles_documents": p1_roles_documents,
    "p2_column_summary": p2_column_summary,
    "p3_describe": p3_describe,
    "p4_missing": p4_missing,
    "p4_missing_nan": p4_missing_nan,
    "p5_duplicates": p5_duplicates,
    "p6_overview": p6_overview,
    "p7_worst_missing": p7_worst_missing,
    "p8_numeric_target": p8_numeric_target,
    "p9_categorical_target": p9_categorical_target,
    "p10_domain_documents": p10_domain_documents,
    "p11_target_keywords": p11_target_keywords,
    "c1_drop_sparse": c1_drop_sparse,
    "c2_dedup": c2_dedup,
    "c3_trim_nullify": c3_trim_nullify,
    "c4_integer_types": c4_integer_types,
    "c5_snake_case": c5_snake_case,
    "c6_parse_dates": c6_parse_dates,
    "c8_time_parts": c8_time_parts,
    "a1_group_keys": a1_group_keys,
    "a2_summary_orders": a2_summary_orders,
    "a2_summary_nan": a2_summary_nan,
    "c7_stray_date": c7_stray_date,
    "a3_global_aggregate": a3_global_aggregate,
    "a4_prefix_levels": a4_prefix_levels,
    "a4_summary_lineitem_100": a4_summary_lineitem_100,
    "a5_describe_fallback": a5_describe_fallback,
    "a6_reduction_meta": a6_reduction_meta,
    "a7_reaggregate": a7_reaggregate,
    "a8_value_counts": a8_value_counts,
    "k1_primary_metric": k1_primary_metric,
    "k2_yoy": k2_yoy,
    "k2_yoy_by_status": k2_yoy_by_status,
    "k3_top_category": k3_top_category,
    "k3_top_category_by_year": k3_top_category_by_year,
    "k4_breakdown": k4_breakdown,
    "k5_trend": k5_trend,
    "k6_concentration": k6_concentration,
    "k7_top_n": k7_top_n,
    "k8_performance_gap": k8_performance_gap,
    "x1_correlation": x1_correlation,
    "x1_correlation_summary": x1_correlation_summary,
    "x2_strong_pairs": x2_strong_pairs,
    "x2_strongest_pair": x2_strongest_pair,
    "x3_top_predictors": x3_top_predictors,
    "x4_histograms": x4_histograms,
    "x5_skewness": x5_skewness,
    "d_decisions": d_decisions,
    "d_decisions_by_status": d_decisions_by_status,
    "d_rules_by_supplier": d_rules_by_supplier,
    "d11_decision_counts": d11_decision_counts,
    "t1_chunks": t1_chunks,
    "t3_cosine_topk": t3_cosine_topk,
    "t4_keyword_topk": t4_keyword_topk,
    "t5_intents": t5_intents,
    "t5_suggested": t5_suggested,
    "t6_facts_documents": t6_facts_documents,
    "t6_facts_orders": t6_facts_orders,
    "m1_task_detection": m1_task_detection,
    "m3_label_encoding": m3_label_encoding,
    "m4_prepare_impute": m4_prepare_impute,
    "m11_regression_metrics": m11_regression_metrics,
    "m11_classification_metrics": m11_classification_metrics,
    "m12_best_model": m12_best_model,
    "m_train_regression": m_train_regression,
    "m_train_classification": m_train_classification,
    "m13_importance": m13_importance,
    "m14_permutation": m14_permutation,
    "m15_predictions": m15_predictions,
    "m16_comparison": m16_comparison,
    "r2_insights": r2_insights,
    "r2_model_insight": r2_model_insight,
    "t8_context_lines": t8_context_lines,
    "t7_answers": t7_answers,
    "r1_report": r1_report,
    "r1_report_models": r1_report_models,
    "s4_report_plain": s4_report_plain,
}
