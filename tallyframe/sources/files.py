"""Sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.functions.columns import nan_to_null

#: Types in the order they are tried; the last resort is string.
_INFER_ORDER = ["bigint", "decimal(38,0)", "double", "boolean", "timestamp_ntz"]
#: Whole numbers as they are printed; codes: a leading zero, a plus sign.
_WHOLE = r"^-?(0|[1-9]\d*)$"
_CODE = r"^[+-]?0\d|^\+\d+$"
#: Whole numbers of more digits than this aren't exact as doubles.
_DOUBLE_DIGITS = 15
_ISO = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _as_type(c: Column, t: str) -> Column:
    """The value as a type, NULL where it isn't one."""
    if t == "boolean":   # only true/false literals, not Spark's wider set (t, f, y, n, 1, 0)
        return F.when(F.lower(F.trim(c)).isin("true", "false"), c.try_cast("boolean"))
    if t == "timestamp_ntz":
        return F.when(c.rlike(_ISO), c.try_cast(t))
    text = F.trim(c)
    if t in ("bigint", "decimal(38,0)"):   # 007 and +49 are codes, not numbers
        return F.when(text.rlike(_WHOLE), c.try_cast(t))
    if t == "double":
        exact = ~text.rlike(r"^[+-]?\d+$") | (F.length(F.regexp_replace(text, "^[+-]", "")) <= _DOUBLE_DIGITS)
        return F.when(exact & ~text.rlike(_CODE), c.try_cast(t))
    return c.try_cast(t)


def infer_types(raw: DataFrame) -> dict:
    """For each column the first of bigint, decimal(38,0), double, boolean
    and timestamp that all of its non-null values are, else string: one
    aggregate over the whole input, so no later value can be lost.

    No digit is lost either: whole numbers beyond 64 bits become decimals,
    and where they stand beside fractions, or numbers begin with a zero or a
    plus sign (codes, telephone numbers), the column stays text."""
    aggs = []
    for i, c in enumerate(raw.columns):
        aggs.append(F.count(_q(c)).alias(f"n{i}"))
        aggs += [F.count(_as_type(_q(c), t)).alias(f"{t}{i}") for t in _INFER_ORDER]
    row = raw.agg(*aggs).first()
    return {c: next((t for t in _INFER_ORDER if row[f"n{i}"] and row[f"{t}{i}"] == row[f"n{i}"]), "string")
            for i, c in enumerate(raw.columns)}


def read_csv(spark: SparkSession, path, null_tokens=tuple(fixed.CSV_NULL_TOKENS), encoding: str = "UTF-8",
             types: dict | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV with quotes doubled inside quoted cells, null tokens
    -> NULL, types from all values.  With ``types`` given nothing is read
    ahead and values that don't fit become NULL.

    Files are split across tasks by the reader (S2's chunks are file
    splits); ``multi_line`` is for cells that hold line ends and reads each
    file in one task."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    raw = raw.select(*[F.when(~_q(c).isin(*null_tokens), _q(c)).alias(c) for c in raw.columns])
    types = types or infer_types(raw)
    typed = raw.select(*[_as_type(_q(c), types[c]).alias(c) if types[c] != "string" else _q(c) for c in raw.columns])
    return nan_to_null(typed)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", rows_a_task: int | None = None) -> DataFrame:
    """A table scan that is at least as wide as the cluster.

    A large table arrives in many splits and is returned as is.  A file
    with a single row group scans in one task, and everything before the
    first shuffle would run there; such a scan is spread round-robin over
    the default parallelism (a shuffle of a small input, none at scale).
    Filters and column pruning still reach the scan below the exchange.
    Row groups aren't split, so a file of many splits may still lie in a few
    tasks: with ``rows_a_task``, for work that is long for every row, rows
    are counted (of parquet only the footers are read) and spread evenly
    where a task would get more of them.
    """
    df = spark.read.format(fmt).load(path)
    width = spark.sparkContext.defaultParallelism
    if rows_a_task:
        held = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
        held = held.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if (held["most"] or 0) > rows_a_task:
            return nan_to_null(df.repartition(max(width, -(-held["n"] // rows_a_task))))
    if df.rdd.getNumPartitions() < width:
        df = df.repartition(width)
    return nan_to_null(df)


def read_many(frames: list[DataFrame]) -> DataFrame:
    """Stack inputs by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> str:
    """S3: CSV with a header, one file per task; quotes are doubled."""
    (df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").option("emptyValue", "").csv(path))
    return path


def plain_text(line: Column) -> Column:
    """Markdown line to plain text (drop ``*``, backtick and ``#``)."""
    return F.regexp_replace(line, r"[*`#]", "")


def write_report(lines: DataFrame, path: str, plain: bool = False) -> str:
    """Report lines as text files, one folder per report.

    ``lines`` has ``line`` and its place (section, ord, sub; each may be
    missing), and ``report_id`` if it holds several reports.  A report is a
    few hundred lines; ``partitionBy`` writes many of them in one job."""
    col = plain_text(F.col("line")) if plain else F.col("line")
    if "report_id" not in lines.columns:
        lines = lines.withColumn("report_id", F.lit("report"))
    place = [c for c in ("section", "ord", "sub") if c in lines.columns]
    (lines.repartition("report_id").sortWithinPartitions("report_id", *place)
          .select("report_id", col.alias("value"))
          .write.mode("errorifexists").partitionBy("report_id").text(path))
    return path


def next_free_path(base_dir: str, name: str, exists) -> str:
    """``name``, else ``name_1``, ``name_2``, ... (never overwrite)."""
    safe = name.replace(" ", "_").lower()
    p = os.path.join(base_dir, safe)
    i = 1
    while exists(p):
        p = os.path.join(base_dir, f"{safe}_{i}")
        i += 1
    return p


def save_model(model, base_dir: str, name: str, overwrite: bool = False) -> str:
    """Save a fitted Spark ML model under a numbered, non-overwriting name."""
    from tallyframe.sources.storage import path_exists
    spark = SparkSession.getActiveSession()
    path = os.path.join(base_dir, name.replace(" ", "_").lower()) if overwrite else \
        next_free_path(base_dir, name, lambda p: path_exists(spark, p))
    w = model.write()
    if overwrite:
        w = w.overwrite()
    w.save(path)
    return path


def load_model(path: str):
    """Load a model saved by ``save_model`` (pipeline or single stage)."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """First 8 hex digits of md5 of ``(rows, cols)|c1|c2...`` - one count."""
    tail = f", {len(df.columns)})|" + "|".join(df.columns)
    sig = F.concat(F.lit("("), F.count(F.lit(1)).cast("string"), F.lit(tail))
    return df.agg(F.substring(F.md5(sig), 1, 8).alias("fingerprint"))
