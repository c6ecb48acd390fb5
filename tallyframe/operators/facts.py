"""Typed facts of many reports in one job (T8), answers from them (T7) and
report sections (R1).

``fact_table`` gives (by..., topic, key, metric, value, text), the same for
one table and for thousands of segments: every fact is an aggregate grouped
by the segment, from one pass that drops repeated rows into a small cube and
one pass over all rows for missing values and Gram sums.  Answers join
questions to facts on the topic that the question asks for; sections rank
the facts of a topic within their report.  Nothing is read back from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.functions.columns import is_numeric, nan_to_null
from tallyframe.operators import decisions as D
from tallyframe.operators import gram as G
from tallyframe.operators import kpi as K
from tallyframe.operators import text as T
from tallyframe.session import ensure_checkpoint_dir

#: Topics in the order of a report's sections.
TOPICS = ["size", "quality", "growth", "segments", "correlations", "model", "features", "risks", "recommendations"]
#: What an answer starts with.
OPENINGS = {"size": "The table", "quality": "Gaps", "growth": "From one year to the next", "segments": "Shares",
            "correlations": "Moving together", "model": "The model", "features": "Most weight", "risks": "Raised",
            "recommendations": "Advised", fixed.FALLBACK_INTENT: "The table"}
LEVELS = {"Critical": 4, "High": 3, "Medium": 2}


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def number_text(value: Column, metric: Column) -> Column:
    """Two digits, none for counts, and the unit that the metric's name has."""
    whole = metric.isin("rows", "columns", "repeated_rows", "level")
    return F.concat(F.when(whole, F.round(value, 0).cast("decimal(38,0)").cast("string"))
                    .otherwise(F.round(value, 2).cast("decimal(38,2)").cast("string")),
                    F.when(metric.endswith("_pct"), "%").otherwise(""))


def _facts(df: DataFrame, by: list[str], topic, key, metric, value: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(*[_q(b) for b in by], lit(topic).alias("topic"), lit(key).alias("key"), lit(metric).alias("metric"),
                     value.cast("double").alias("value")).where(F.col("value").isNotNull())


def fact_table(rows: DataFrame, by: list[str], keys: list[str], values: list[str], date: str | None = None,
               features: list[str] = (), target: str | None = None) -> DataFrame:
    """(by..., topic, key, metric, value, text).

    ``keys`` are the columns to break ``values[0]`` down by (their values
    and the years of ``date`` must be few: the cube of a segment holds a row
    for each combination); ``features`` and ``target`` add a ridge model
    (M7).  NULL and NaN are missing; sums leave repeated rows out, as the
    summary does; a segment's NULL is a segment; a fact without a value
    (one year only, a constant column) is no row; an empty table has none."""
    by = list(by)
    rows = nan_to_null(rows)
    ensure_checkpoint_dir(rows.sparkSession)
    columns = [c for c in rows.columns if c not in by]
    year = F.year(_q(date)).cast("long") if date else F.lit(None).cast("long")
    whole = rows.groupBy(*[_q(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    cube = (whole.withColumn("_year", year).groupBy(*[_q(c) for c in dict.fromkeys([*by, *keys])], "_year")
            .agg(F.sum("__copies").alias("__all"), F.count(F.lit(1)).alias("__once"),
                 *[F.sum(_q(v)).alias(f"{v}_sum") for v in values])).checkpoint()   # read by every section below
    gaps = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                     (F.avg(_q(c).isNull().cast("double")) * 100).alias("pct")) for i, c in enumerate(columns)]
    missing = rows.groupBy(*[_q(b) for b in by]).agg(F.array(*gaps).alias("m")).select(*by, F.explode("m").alias("m")).select(*by, "m.*")
    sizes = cube.groupBy(*by).agg(F.sum("__all").alias("n_rows"), F.sum("__once").alias("once"))
    out = [
        _facts(sizes, by, "size", "table", "rows", F.col("n_rows")),
        _facts(sizes, by, "size", "table", "columns", F.lit(len(columns))),
        _facts(sizes, by, "quality", "table", "repeated_rows", F.col("n_rows") - F.col("once")),
        _facts(missing.where("pct > 0"), by, "quality", F.col("column"), "missing_pct", F.col("pct")),
    ]
    worst = missing.where(F.col("pct") > 20).groupBy(*by).agg(
        F.max_by("column", F.struct(F.col("pct"), -F.col("position"))).alias("worst_missing_col"), F.max("pct").alias("worst_missing_pct"))
    copies = F.col("n_rows") - F.col("once")
    inputs = [sizes.select(*by, "n_rows", copies.alias("duplicates"), (copies / F.col("n_rows") * 100).alias("duplicate_pct")), worst]
    for i, v in enumerate(values if date else []):
        moved = K.yoy_growth(cube, v, by)
        out.append(_facts(moved, by, "growth", v, "yoy_growth_pct", F.col("yoy_growth_pct")))
        if i == 0:
            inputs.append(moved)
    for i, key in enumerate(keys if values else []):
        groups = cube.where(_q(key).isNotNull()).groupBy(*by, _q(key).cast("string").alias("name")).agg(
            F.sum(f"{values[0]}_sum").cast("double").alias("value"))
        total = F.sum("value").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))   # values of a key: few
        out.append(_facts(groups.withColumn("t", total), by, "segments", F.concat(F.lit(f"{key} "), F.col("name")), "share_pct",
                          F.when(F.col("t") != 0, F.col("value") / F.col("t") * 100)))
        if i == 0:
            inputs.append(K.top_category(cube, key, values[0], by))
            gap = K.performance_gap(cube, key, values[0], by)
            inputs.append(gap.select(*by, F.col("key").alias("gap_key"), F.lit(values[0]).alias("gap_value_col"), "bottom3",
                                     "bottom3_mean", "top_value", "gap_pct", "lift_value", "lift_share"))
    numbers = [c for c in columns if is_numeric(rows.schema[c].dataType)]
    if len(numbers) > 1:
        pairs = G.wide_correlation_pairs(rows, numbers, by)
        out.append(_facts(pairs, by, "correlations", F.concat_ws(" ~ ", "c1", "c2"), "correlation", F.col("r")))
    if features and target:
        fit = G.ridge(rows, list(features), target, 1.0, by)
        size = F.sum(F.abs("coefficient")).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))   # a row a feature
        fit = fit.withColumn("pct", F.abs("coefficient") / size * 100).checkpoint()
        out.append(_facts(fit, by, "features", F.col("feature"), "importance_pct", F.col("pct")))
        best = fit.groupBy(*by).agg(F.max("r2_pct").alias("best_score"),
                                    F.max_by("feature", F.struct("pct", -F.col("position"))).alias("top_feature"),
                                    F.max("pct").alias("top_feature_share"))
        out.append(_facts(best, by, "model", f"ridge for {target}", "r2_pct", F.col("best_score")))
        inputs.append(best.select(*by, F.lit("Ridge Regression").alias("best_model"), F.lit("regression").alias("task"),
                                  "best_score", "top_feature", "top_feature_share"))
    ruled = D.decide(D.collapse(inputs, by), by)
    level = F.coalesce(*[F.when(F.col("level") == name, n) for name, n in LEVELS.items()], F.lit(1))
    out.append(_facts(ruled, by, F.when(F.col("kind") == "risk", "risks").otherwise("recommendations"), F.col("title"), "level", level))
    facts = out[0]
    for more in out[1:]:
        facts = facts.unionByName(more)
    return facts.withColumn("text", F.concat_ws(" ", "key", "metric", number_text(F.col("value"), F.col("metric"))))


def leading(facts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` facts of each topic and report that weigh most: largest
    value without its sign, then by key and metric, with their ``rank``."""
    place = Window.partitionBy(*by, "topic").orderBy(F.abs("value").desc(), "key", "metric")
    return facts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def answer_from_facts(questions: DataFrame, q_id: str, q_text: str, facts: DataFrame, by: list[str] = (), k: int = 3) -> DataFrame:
    """(q_id, by..., intent, answer) for every question.

    The intent (T5) names the topic; the answer lists the ``k`` leading
    facts of the question's report, or says that there is none.  Questions
    carry the ``by`` columns; a general question gets the size."""
    by = list(by)
    asked = questions.select(_q(q_id).alias("q_id"), *[_q(b) for b in by], T.intent(_q(q_text)).alias("intent"))
    topic = F.when(F.col("intent") == fixed.FALLBACK_INTENT, "size").otherwise(F.col("intent"))
    told = leading(facts, by, k).groupBy(*by, "topic").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "; ").alias("told"))   # at most k
    both = asked.withColumn("topic", topic).join(told, [*by, "topic"], "left")
    opening = F.coalesce(*[F.when(F.col("intent") == name, F.lit(x)) for name, x in OPENINGS.items()])
    answer = F.when(F.col("told").isNotNull(), F.concat(opening, F.lit(": "), F.col("told"), F.lit("."))).otherwise(
        F.concat(F.lit("No facts on "), F.col("topic"), F.lit(".")))
    return both.select("q_id", *by, "intent", answer.alias("answer"))


def report_sections(facts: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """R1 for many reports: (by..., section, ord, line, value): a heading
    and the ``k`` leading facts of every topic that a report has."""
    number = F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("topic")).cast("int")
    lines = leading(facts, by, k).select(*by, number.alias("section"), F.col("rank").alias("ord"),
                                         F.concat(F.lit("- "), F.col("text")).alias("line"), "value")
    title = F.concat(F.lit("## "), number.cast("string"), F.lit(". "), F.initcap("topic"))
    heads = facts.select(*by, "topic").distinct().select(*by, number.alias("section"), F.lit(0).alias("ord"), title.alias("line"),
                                                         F.lit(None).cast("double").alias("value"))
    return heads.unionByName(lines)
