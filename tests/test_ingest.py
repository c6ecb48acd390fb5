"""Sources, missing values and splits on injected cases."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import modeling as M
from tallyframe.operators import summarize as A
from tallyframe.sources import files as S


def test_csv_keeps_late_and_quoted_values(spark, tmp_path):
    rows = [(str(i), "x") for i in range(6000)] + [(f"{i}.5", 'say "hi", ok') for i in range(3000)]
    df = spark.createDataFrame(rows, "n string, t string")
    back = S.read_csv(spark, S.write_csv(df, str(tmp_path / "a")))
    assert dict(back.dtypes) == {"n": "double", "t": "string"}
    assert back.where("n is null").count() == 0
    assert back.where(F.col("t") == 'say "hi", ok').count() == 3000


def test_csv_types(spark, tmp_path):
    rows = [("1", "true", "2020-01-02", "2020-01-02 03:04:05", " a\nb ", "NaN"), ("", "FALSE", "", "", "x", "1")]
    df = spark.createDataFrame(rows, "i string, b string, d string, t string, s string, f string")
    back = S.read_csv(spark, S.write_csv(df, str(tmp_path / "b")), multi_line=True)
    assert [t for _, t in back.dtypes] == ["bigint", "boolean", "timestamp_ntz", "timestamp_ntz", "string", "double"]
    got = {r.s: r for r in back.collect()}
    assert got[" a\nb "].t == dt.datetime(2020, 1, 2, 3, 4, 5) and got[" a\nb "].f is None and got["x"].b is False


def test_nan_is_missing_in_summaries(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 1), ("a", nan, 2), ("b", None, 3), ("b", 2.0, 4)], "k string, v double, n long")
    got = {r.k: (r.v_sum, r.v_mean, r.v_count) for r in A.summarize(df).table.collect()}
    assert got == {"a": (1.0, 1.0, 1), "b": (2.0, 2.0, 1)}


def test_stray_date_is_no_time_column(spark):
    df = spark.createDataFrame([("g", f"note {i}" if i else "2020-05-01", i) for i in range(100)],
                               "g string, time_note string, v long")
    s = A.summarize(df)
    assert s.meta["time_col"] is None


def test_split_and_ranks_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("double").alias("label"), F.xxhash64("id").alias("__h"))
    p = M.Prepared(df, [], "label", "classification", ["a", "b", "c"], 5000)
    train, test, frac = M.split(p)
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    got = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert got == {k: -(-n // 5) for k, n in sizes.items()} and frac == 0.2
    assert train.count() + test.count() == 5000 and train.join(test, "__h").count() == 0
    folds = {(r.label, r.fold): r["count"] for r in M.with_folds(p, 5).groupBy("label", "fold").count().collect()}
    assert len(folds) == 15 and all(abs(n - sizes[k] / 5) < 1 for (k, _), n in folds.items())
    ranks = sorted(r[0] for r in M.hash_rank(df, 1, []).select("__rank").collect())
    assert ranks == list(range(1, 5001))


def test_report_files_keep_their_order(spark, tmp_path):
    lines = spark.createDataFrame([(2, 0, 0, "c"), (1, 5, 1, "b"), (1, 5, 0, "**a**")],
                                  "section int, ord int, sub int, line string")
    path = S.write_report(lines, str(tmp_path / "r"), plain=True)
    files = list((tmp_path / "r" / "report_id=report").glob("part-*"))
    assert path and "".join(f.read_text() for f in files).split() == ["a", "b", "c"]


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()]).fit(df)
    first = S.save_model(model, str(tmp_path), "My Model")
    second = S.save_model(model, str(tmp_path), "My Model")
    assert first.endswith("my_model") and second.endswith("my_model_1")
    back = S.load_model(second).transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert back < 1e-6


def test_rows_of_fact_scans_are_spread(spark, tmp_path, monkeypatch):
    """A file of one row group lies in one task however many splits it has;
    fact scans get tasks of a bounded number of rows, and all rows."""
    from tallyframe.plans import catalog
    from tallyframe.plans import tables as TB
    rows = [(k, k % 50, "OFP"[k % 3], f"{k % 5 + 1}-URGENT") for k in range(1000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(TB, "FACT_ROWS", 50, raising=False)
    out = catalog.t6_facts_orders(spark, str(tmp_path))
    held = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count("p")).first()
    assert held[0] <= 100 and held[1] >= 15
    assert sorted(r["o_orderkey"] for r in out.select("o_orderkey").collect()) == list(range(1000))
