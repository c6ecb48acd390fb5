"""Source divergence audit: terms ranked and summed by cells of counts.

Tasks count the terms of their documents by (lang, source) and send each
term once for a run of texts.  A language keeps the terms that enough of its
documents hold.  What a term contributes depends only on its counts, so
terms are grouped into cells:

* ``term``: cells (count in the group, count in the language); the value is
  worked out once a cell, cells of equal value are merged, ranked by their
  cumulative number of terms, and only the cells that reach the wanted ranks
  are expanded into terms, in UTF-8 order.
* ``pair``: cells (count in one source, count in the other).  A sum over all
  kept terms is, by inclusion and exclusion, the value of the cell (0, 0)
  for every term, plus corrections by the cells of each source alone, plus
  corrections by cells of terms that both sources hold.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import free_shuffles, materialize, prepare, ranked
from tallyframe.llm.lexical_search import pieces

UNIT = 1_000_000_000
LEAST_DOCS, RANKS = 3, 200
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Distinct (group, term) counts that a task holds at a time, pairs of
#: sources that it makes at a time, cells that it holds.
HELD, PAIRS, CELLS = 800_000, 1 << 20, 1 << 20
#: Cells to expand are broadcast below so many bytes (64 a cell and names).
BROADCAST = 8 << 20
_DOC = 1 << 40   # a document in a task's counts; occurrences stand below


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of runs of documents: occurrences and
    documents of each term of a group."""
    def run(batches):
        total: dict = defaultdict(Counter)

        def flush():
            for (lang, source), found in total.items():
                names, values = list(found), list(found.values())
                for a in range(0, len(names), 50_000):
                    part = np.array(values[a:a + 50_000], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                         pa.array(names[a:a + 50_000], pa.binary()).cast(pa.string()),
                         pa.array(part & (_DOC - 1)), pa.array(part >> 40)], names=["lang", "source", "term", "n", "docs"])
            total.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                here: Counter = Counter()
                for part in pieces(text.as_buffer().to_pybytes()):
                    here.update(TERM.findall(part.lower()))
                group = total[lang, source]
                held -= len(group)
                for t, n in here.items():
                    group[t] += n + _DOC
                held += len(group)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _cells(kept: DataFrame) -> DataFrame:
    """(lang, one, two, a, b, terms): for pairs of sources one < two, how
    many terms one holds a times and two b times.  Tasks make pairs in
    bounded lots and send cells."""
    def run(batches):
        number: dict[tuple, int] = {}
        cells: Counter = Counter()

        def count(g, n, first, size):
            """All pairs of rows of the same term; ``first`` and ``size``
            give each row the rows after it."""
            left = np.repeat(np.arange(len(g)), size)
            right = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            swap = g[left] > g[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            values, code = np.unique(n, return_inverse=True)
            wide = len(values)
            pair, both = g[left] * len(number) + g[right], code[left] * wide + code[right]
            some, place = np.unique(pair, return_inverse=True)
            key, times = np.unique(place * (wide * wide) + both, return_counts=True)
            where, both = key // (wide * wide), key % (wide * wide)
            for p, a, b, t in zip(some[where].tolist(), values[both // wide].tolist(), values[both % wide].tolist(), times.tolist()):
                cells[p // len(number), p % len(number), a, b] += t

        def flush():
            names = list(number)
            rows = [(*names[g], names[h][1], a, b, t) if names[g] < names[h] else (*names[h], names[g][1], b, a, t)
                    for (g, h, a, b), t in cells.items()]   # numbers follow no order, names do
            cells.clear()
            for a in range(0, len(rows), 100_000):
                cols = list(zip(*rows[a:a + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["lang", "one", "two", "a", "b", "terms"])

        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            size = np.diff(ends)
            langs = np.repeat(np.array(batch.column(0).to_pylist(), object), size)
            g = np.array([number.setdefault(x, len(number)) for x in zip(langs.tolist(), flat.field("source").to_pylist())], np.int64)
            n = flat.field("n").to_numpy().astype(np.int64)
            after = np.repeat(np.cumsum(size), size) - np.arange(len(g)) - 1   # rows of the term behind each
            if not len(g):
                continue
            lot = (np.cumsum(after) - after) // PAIRS   # a row's pairs are at most the sources of its language
            for a, z in zip(*_edges(lot)):
                up = min(len(g), z + int(after[z - 1]))   # the last row's partners
                most = after[a:z]
                count(g[a:up], n[a:up], np.arange(1, up - a + 1), np.append(most, np.zeros(up - z, np.int64)))
                if len(cells) > CELLS:
                    yield from flush()
        yield from flush()

    return kept.select("lang", "held").mapInArrow(run, "lang string, one string, two string, a long, b long, terms long")


def _edges(lot: np.ndarray) -> tuple[list[int], list[int]]:
    cut = (np.flatnonzero(np.diff(lot)) + 1).tolist()
    return [0, *cut], [*cut, len(lot)]


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact at any size."""
    div = lambda up, down: F.call_function("div", up, down)
    small = div(F.lit(UNIT).cast("long") * (count + 1), total + terms)
    large = div(F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(count < 9 * UNIT, small).otherwise(large) + 1


def _value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), at most about 10^18."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sum(terms: Column, value: Column) -> Column:
    return F.sum(terms.cast("decimal(18,0)") * value.cast("decimal(20,0)"))


def _pairs(cells: DataFrame, totals: DataFrame, joint: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    me = totals.select("lang", F.col("source").alias("one"), F.col("total").alias("n1"), F.col("terms").alias("v"))
    other = totals.select("lang", F.col("source").alias("two"), F.col("total").alias("n2"))
    zero = F.lit(0).cast("long")

    def f(x, y, back: bool):
        p, q = _share(x, F.col("n1"), F.col("v")), _share(y, F.col("n2"), F.col("v"))
        return _value(q, p) if back else _value(p, q)

    # every term as if neither source held it
    every = me.join(other, "lang").where((F.col("one") < F.col("two")) & (F.col("v") > 0))
    start = every.select("lang", "one", "two", *[(F.col("v").cast("decimal(18,0)") * f(zero, zero, back).cast("decimal(20,0)"))
                                                 .alias(name) for name, back in (("there", False), ("back", True))])
    # what one source's own counts change
    own = cells.groupBy("lang", "source", "n").agg(F.sum("mult").alias("mult"))
    alone = []
    for name, swap in (("one", False), ("two", True)):
        rows = own.withColumnRenamed("source", name).join(every, ["lang", name])
        x, y = (zero, F.col("n")) if swap else (F.col("n"), zero)
        alone.append(rows.groupBy("lang", "one", "two").agg(
            *[_sum(F.col("mult"), f(x, y, back) - f(zero, zero, back)).alias(n) for n, back in (("there", False), ("back", True))]))
    # what terms of both change beyond that
    a, b = F.col("a"), F.col("b")
    rows = joint.join(every, ["lang", "one", "two"])
    both = rows.groupBy("lang", "one", "two").agg(
        *[_sum(F.col("mult"), f(a, b, back) - f(a, zero, back) - f(zero, b, back) + f(zero, zero, back)).alias(n)
          for n, back in (("there", False), ("back", True))])
    found = start.unionAll(alone[0]).unionAll(alone[1]).unionAll(both).groupBy("lang", "one", "two").agg(
        F.sum("there").alias("there"), F.sum("back").alias("back"))
    none = me.join(other, "lang").where((F.col("one") < F.col("two")) & (F.col("v") == 0)).select(
        "lang", "one", "two", F.lit(0).alias("there"), F.lit(0).alias("back"))
    sides = F.explode(F.array(
        F.struct(F.col("one").alias("source"), F.col("two").alias("item"), F.col("there").cast("long").alias("value")),
        F.struct(F.col("two").alias("source"), F.col("one").alias("item"), F.col("back").cast("long").alias("value"))))
    return found.unionAll(none).select("lang", sides.alias("s")).select("lang", "s.*")


def _terms(kept: DataFrame, cells: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank) of the first ``ranks`` terms."""
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lc"), F.col("lang_total"), F.col("terms"))
    valued = (cells.join(totals, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
              .select("lang", "source", "n", "lc", "mult", _value(F.col("p"), F.col("q")).alias("value")))
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("mult").alias("mult"))
    first = ranked(merged, ["lang", "source"], [F.col("value").desc()], ranks, "value").drop("rank")
    above = Window.partitionBy("lang", "source").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("above", F.coalesce(F.sum("mult").over(above), F.lit(0))).where(F.col("above") < ranks)
    wanted = valued.join(first.select("lang", "source", "value"), ["lang", "source", "value"])
    wanted = materialize(wanted.select("lang", "source", "n", "lc", "value"), "cells-to-expand")
    size = wanted.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    rows = kept.select("lang", "term", "lc", F.explode("held").alias("h")).select("lang", "term", "lc", "h.source", "h.n")
    rows = rows.join(F.broadcast(wanted) if size <= BROADCAST else wanted, ["lang", "source", "n", "lc"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), "value")
    return ranked(rows, ["lang", "source"], [F.col("value").desc(), F.col("item")], ranks, "item")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source).

    Part ``pair``: every other source of the language, how far the group's
    shares of terms are from that source's; part ``term``: the terms that
    the group holds oftener than its language, the first ``ranks``.

    Nulls in text, language and source count as empty; a group without
    terms takes part in pairs; a language that keeps no term has pairs of
    value 0; a language of one source has none.  Every row counts, repeated
    rows too; texts are read whole, at any length; ties go by the bytes of
    the item; an empty table gives an empty one; other columns are not
    read."""
    spark = docs.sparkSession
    prepare(spark)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    src = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    # one shuffle: sums by source and lists by term have the term's partitioning
    held = (_counts(src).repartition("lang", "term").groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lc"), F.collect_list(F.struct("source", "n")).alias("held")))
    kept = materialize(held.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    free_shuffles(spark)
    cells = kept.select("lang", "lc", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source"),
                                                                            F.col("h.n").alias("n"), "lc")
    cells = materialize(cells.agg(F.count(F.lit(1)).alias("mult")), "count-cells")
    joint = _cells(kept).groupBy("lang", "one", "two", "a", "b").agg(F.sum("terms").alias("mult"))
    joint = materialize(joint, "joint-cells")
    free_shuffles(spark)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lc").alias("lang_total"))
    total = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("mult")).alias("total"))
    none = F.lit(0).cast("long")
    totals = (src.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")]))
    totals = materialize(totals, "group-totals")
    pairs = _pairs(cells, totals, joint)
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(place))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionAll(columns(_terms(kept, cells, totals, ranks), "term"))
