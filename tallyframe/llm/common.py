"""Helpers shared by the operators: tables in the shared folder, names that
cannot clash, expressions evaluated once, and batch iteration in tasks."""

from __future__ import annotations

import gc
import os
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import shared_path

#: Words are runs of anything but these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Make the package's functions usable in tasks.

    Where executors import the library themselves (it is on PYTHONPATH, or
    the driver runs in its folder), functions travel by name; elsewhere
    they travel by value."""
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    package = sys.modules["tallyframe.llm"]
    if not (_ROOT in known or local and os.getcwd() == _ROOT):
        cloudpickle.register_pickle_by_value(package)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps
    neither repeat its work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans no longer referenced
    (it acts when the driver's JVM collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the
    body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def word_array(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def chunks(values: list, limit: int, size: Callable) -> Iterator[list]:
    """Runs of ``values`` whose sizes add up to at most ``limit`` (single
    larger values stand alone)."""
    run, total = [], 0
    for v in values:
        n = size(v)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(v)
        total += n
    if run:
        yield run


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int, spread: str, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``: ranked by shares
    of a key (by the hash of column ``spread``) first, so that no task sorts
    all rows of one."""
    salt, = fresh(rows, "salt")
    first = Window.partitionBy(*keys, salt).orderBy(*order)
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("rank") <= k).drop(salt))
