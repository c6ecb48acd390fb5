"""Decision rules (D1-D11) as a rule table over KPI rows.

``decision_inputs`` gathers the facts the rules read into one row per
segment (one row overall when ``by`` is empty): data quality, year-over-year
change, top segment, performance gap and, optionally, model results.  Every
piece is a small aggregate; they are stacked with ``unionByName`` and
collapsed per segment, so no join is needed.

``decide`` is a pure projection: each rule is a ``when(condition, struct)``
column, the array of rules is exploded and the rules that did not fire are
dropped.  One output row per fired rule, for any number of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import round_half_up
from tallyframe.operators import kpi as K
from tallyframe.operators import profile as P

# Columns a KPI row may carry; missing ones are NULL (the rule does not fire).
INPUT_SCHEMA = [
    ("n_rows", "bigint"), ("worst_missing_col", "string"), ("worst_missing_pct", "double"),
    ("duplicates", "bigint"), ("duplicate_pct", "double"),
    ("primary_col", "string"), ("yoy_growth_pct", "double"), ("latest_year", "bigint"),
    ("previous_year", "bigint"), ("latest_year_val", "double"), ("prev_year_val", "double"),
    ("top_category_col", "string"), ("top_category_name", "string"), ("top_category_value", "double"),
    ("top_category_share", "double"),
    ("gap_key", "string"), ("gap_value_col", "string"), ("bottom3", "string"), ("bottom3_mean", "double"),
    ("top_value", "double"), ("gap_pct", "double"), ("lift_value", "double"), ("lift_share", "double"),
    ("best_model", "string"), ("task", "string"), ("overfit_gap", "double"), ("best_score", "double"),
    ("top_feature", "string"), ("top_feature_share", "double"),
    ("primary_total", "double"), ("primary_mean", "double"),
]


# Numbers are rounded half-up in plain IEEE arithmetic before formatting, so
# every formatter prints the same digits (formatters disagree on ties).

def _f1(c: Column) -> Column:
    return F.format_string("%.1f", round_half_up(c, 1))


def _sf1(c: Column) -> Column:
    return F.format_string("%+.1f", round_half_up(c, 1))


def _n0(c: Column) -> Column:
    return F.format_number(round_half_up(c, 0), 0)


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _with_schema(df: DataFrame, by: list[str]) -> DataFrame:
    have = set(df.columns)
    cols = [F.col(f"`{b}`") for b in by]
    for name, typ in INPUT_SCHEMA:
        cols.append((F.col(name) if name in have else F.lit(None)).cast(typ).alias(name))
    return df.select(*cols)


def collapse(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """Stack partial KPI rows and keep, per segment, the first non-null of
    every column (each column comes from exactly one frame)."""
    stacked = None
    for f in frames:
        f = _with_schema(f, by)
        stacked = f if stacked is None else stacked.unionByName(f)
    aggs = [F.first(name, ignorenulls=True).alias(name) for name, _ in INPUT_SCHEMA]
    return stacked.groupBy(*by).agg(*aggs) if by else stacked.agg(*aggs)


def quality_inputs(rows: DataFrame, by: list[str] = (), min_missing_pct: float = 20.0,
                   measured: DataFrame | None = None) -> list[DataFrame]:
    """n_rows, worst column above ``min_missing_pct`` and duplicates, per segment."""
    by = list(by)
    cols = [c for c in rows.columns if c not in by]
    if by:
        one = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                       (F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100.0).alias("pct")).alias(f"m{i}")
              for i, c in enumerate(cols)])
        long = one.select(*by, "n_rows", F.explode(F.array(*[F.col(f"m{i}") for i in range(len(cols))])).alias("m"))
        miss = (long.where(F.col("m.pct") > min_missing_pct).groupBy(*by).agg(
            F.max_by("m.column", F.struct(F.col("m.pct"), -F.col("m.position"))).alias("worst_missing_col"),
            F.max("m.pct").alias("worst_missing_pct")))
        sizes = one.select(*by, "n_rows")
        dup = (rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).count()
               .groupBy(*by).agg((F.sum("count") - F.count(F.lit(1))).alias("duplicates"),
                                 F.sum("count").alias("__n"))
               .select(*by, "duplicates", (F.col("duplicates") / F.col("__n") * 100.0).alias("duplicate_pct")))
        return [sizes, miss, dup]
    worst = P.worst_missing(rows, min_missing_pct, measured).select(
        F.col("column").alias("worst_missing_col"), F.col("missing_pct").alias("worst_missing_pct"))
    dup = P.duplicate_stats(rows).select("n_rows", "duplicates", "duplicate_pct")
    return [worst, dup]


def decision_inputs(rows: DataFrame, summary: DataFrame, meta: dict, primary: str | None,
                    by: list[str] = (), models: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """One KPI row per segment from the cleaned rows, the summary and,
    optionally, a one-row model result (columns of INPUT_SCHEMA).

    With ``by`` the summary must contain the segment columns (they are group
    keys of the summary)."""
    by = list(by)
    frames = quality_inputs(rows, by, measured=measured)
    cats = [k for k in K.category_keys(meta["group_keys"]) if k not in by]
    if primary:
        if "_year" in summary.columns:
            frames.append(K.yoy_growth(summary, primary, by))
        if cats:
            frames.append(K.top_category(summary, cats[0], primary, by))
    values = meta.get("value_cols", [])
    if cats and values:
        gap = K.performance_gap(summary, cats[0], values[0], by)
        frames.append(gap.select(*by, F.col("key").alias("gap_key"), F.lit(values[0]).alias("gap_value_col"),
                                 "bottom3", "bottom3_mean", "top_value", "gap_pct", "lift_value", "lift_share"))
    if models is not None:
        frames.append(models)
    return collapse(frames, by)


# ---------------------------------------------------------------------------
# FIXED VALUES — rule texts (titles, bodies, levels, types)
# ---------------------------------------------------------------------------

def _rules(module_low_accuracy: bool = False):
    c = F.col
    g = c("yoy_growth_pct")
    pc = F.coalesce(c("primary_col"), F.lit("metric"))
    ly = F.coalesce(c("latest_year").cast("string"), F.lit("latest"))
    py = F.coalesce(c("previous_year").cast("string"), F.lit("prior"))
    lv = F.coalesce(c("latest_year_val"), F.lit(0.0))
    pv = F.coalesce(c("prev_year_val"), F.lit(0.0))
    wm = c("worst_missing_pct")
    dup = c("duplicates")
    share = c("top_category_share")
    name = c("top_category_name")
    gap = c("overfit_gap")
    best = c("best_model")
    score = c("best_score")
    tf = c("top_feature")
    tshare = c("top_feature_share")
    bottom_list = F.array_join(F.transform(F.split(c("bottom3"), ", "), lambda x: F.concat(F.lit("`"), x, F.lit("`"))),
                               ", ")
    rules = [
        # (kind, rule_id, condition, level, type, title, body, expected_impact)
        ("risk", "D1", wm > 20, F.when(wm > 30, "High").otherwise("Medium"), None,
         _cat("Data Gap in `", c("worst_missing_col"), "` (", _f1(wm), "% missing)"),
         _cat(_f1(wm), "% of the rows have no `", c("worst_missing_col"), "`, so any figure built on it speaks for the rest "
              "only. Make the field required where the data are entered."), None),
        ("risk", "D2", dup > 0, F.when(c("duplicate_pct") > 5, "High").otherwise("Medium"), None,
         _cat("Duplicate Records: ", _n0(dup), " rows (", _f1(c("duplicate_pct")), "%)"),
         _cat("Sums and counts include ", _n0(dup), " repeated rows. Find the step that writes them twice."), None),
        ("optimization", "D2", dup == 0, None, None, F.lit("Dataset Integrity Confirmed"),
         F.lit("Every row occurs once."), F.lit("Baseline quality maintained.")),
        ("risk", "D3", g < -10, F.lit("Critical"), None,
         _cat("Significant Decline: ", _sf1(g), "% YoY in `", pc, "`"),
         _cat(ly, " brought ", _n0(lv), " of `", pc, "` after ", _n0(pv), " in ", py, ", ", _f1(F.abs(g)), "% less. Look "
              "first for the segments that lost most."), None),
        ("risk", "D3", (g >= -10) & (g < 0), F.lit("Medium"), None,
         _cat("Moderate Decline: ", _sf1(g), "% YoY in `", pc, "`"),
         _cat("`", pc, "` was ", _f1(F.abs(g)), "% lower in ", ly, "; see whether the next period repeats it."), None),
        ("recommendation", "D3", g > 20, F.lit("High"), F.lit("Growth Opportunity"),
         _cat("Strong Growth Momentum: ", _sf1(g), "% YoY"),
         _cat(ly, " reached ", _n0(lv), " of `", pc, "`, ", _f1(g), "% more than before. Check that supply can follow."), None),
        ("recommendation", "D3", (g >= 0) & (g <= 20), F.lit("Medium"), F.lit("Maintenance"),
         _cat("Stable Growth: ", _sf1(g), "% YoY"),
         _cat("`", pc, "` rose by ", _f1(g), "%, within its usual range."), None),
        ("risk", "D4", share > 60, F.when(share > 70, "High").otherwise("Medium"), None,
         _cat("Concentration Risk: '", name, "' = ", _f1(share), "% of ", pc),
         _cat(_n0(c("top_category_value")), " of ", pc, " come from `", name, "` alone (", _f1(share), "%). The total hangs on "
              "one value of ", c("top_category_col"), "; build up others."), None),
        ("recommendation", "D4", share <= 60, F.lit("High"), F.lit("Segment Strategy"),
         _cat("Leverage `", name, "` — Top Segment at ", _f1(share), "%"),
         _cat("No segment is larger than '", name, "' (", _f1(share), "%). Compare what it does with the smallest ones."), None),
        ("optimization", "D5", c("bottom3").isNotNull(), None, None,
         _cat("Close Performance Gap in Bottom ", c("gap_key"), " Segments"),
         _cat("The last three, ", bottom_list, ", average ", _n0(c("bottom3_mean")), " where the first has ",
              _n0(c("top_value")), ", a gap of ", _n0(c("gap_pct")), "%. One tenth more from them would add ",
              _n0(c("lift_value")), " ", c("gap_value_col"), "."),
         _cat("~", _n0(c("lift_value")), " incremental ", c("gap_value_col"), " (+", _f1(c("lift_share")), "%)")),
        ("risk", "D6", best.isNotNull() & (gap > 15), F.lit("Medium"), None,
         _cat("Model Overfitting — ", best, " (gap ", _f1(gap), "%)"),
         _cat("On rows it has not seen, the model loses ", _f1(gap), " points. Restrain it, or train on more varied rows."), None),
        ("recommendation", "D7", best.isNotNull() & tf.isNotNull(), F.lit("High"), F.lit("Model-Driven"),
         _cat("Prioritize `", tf, "` — ", _f1(tshare), "% of Prediction Power"),
         _cat("Of all features, `", tf, "` carries most of the prediction (", _f1(tshare), "%)."), None),
    ]
    if module_low_accuracy:
        rules.append(
            ("recommendation", "D9", best.isNotNull() & (c("task") == "classification") & (score < 70),
             F.lit("Medium"), F.lit("Model Improvement"), F.lit("Improve Model Accuracy with More Features"),
             _cat("The best model is right on ", _f1(score), "% of the test rows. More labelled rows or further columns "
                  "may help."), None))
    rules += [
        ("recommendation", "D8", best.isNotNull() & (score >= 80), F.lit("High"), F.lit("Deployment Ready"),
         _cat("Deploy ", best, " — ", _f1(score), "% Validated"),
         _cat(best, " scores ", _f1(score), "% on held-out rows. Keep measuring it and fit it again when the score falls."), None),
        ("risk", "D10", c("n_rows") < 1000, F.lit("Medium"), None,
         _cat("Small Dataset (", _n0(c("n_rows")), " rows)"),
         F.lit("With so few rows, scores change much from one split to the next."), None),
    ]
    return rules


def decide(inputs: DataFrame, by: list[str] = (), module_low_accuracy: bool = False) -> DataFrame:
    """(segment..., kind, rule_id, ord, level, type, title, body,
    expected_impact), one row per fired rule; ``ord`` is the rule order,
    which is also the order inside each kind."""
    by = list(by)
    items = []
    for i, (kind, rid, cond, level, typ, title, body, impact) in enumerate(_rules(module_low_accuracy)):
        s = F.struct(F.lit(kind).alias("kind"), F.lit(rid).alias("rule_id"), F.lit(i).alias("ord"),
                     (level if level is not None else F.lit(None)).cast("string").alias("level"),
                     (typ if typ is not None else F.lit(None)).cast("string").alias("type"),
                     title.alias("title"), body.alias("body"),
                     (impact if impact is not None else F.lit(None)).cast("string").alias("expected_impact"))
        items.append(F.when(F.coalesce(cond, F.lit(False)), s))
    return (inputs.select(*[F.col(f"`{b}`") for b in by], F.explode(F.array(*items)).alias("d"))
                  .where(F.col("d").isNotNull()).select(*by, "d.*"))


def decision_counts(decisions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recommendations, risks, optimisations and High/Critical risks."""
    by = list(by)
    k = F.col("kind")
    aggs = [F.count(F.when(k == "recommendation", 1)).alias("recommendations"),
            F.count(F.when(k == "risk", 1)).alias("risks"),
            F.count(F.when(k == "optimization", 1)).alias("optimizations"),
            F.count(F.when((k == "risk") & F.col("level").isin("Critical", "High"), 1)).alias("high_risks")]
    return decisions.groupBy(*by).agg(*aggs) if by else decisions.agg(*aggs)
