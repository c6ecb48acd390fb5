"""Embedding near-dedup: lattice hashing with E8 cells, verified cosine.

In each of ``TABLES`` tables a unit vector is projected to eight dimensions
and decoded to the nearest point of the E8 lattice, its cell; it also probes
the ``PROBES`` neighbouring cells it lies closest to.  Two vectors meet if
one lies in a cell that the other lies in or probes; their cosine is then
taken in double precision.

Equal vectors are one row with a number of copies.  A cell's vectors are
compared in blocks of at most ``BLOCK`` by ``BLOCK``, one matrix product
each, so a crowded cell is spread over tasks; a block returns sums and a
spanning forest, never its pairs.  A pair that meets in several places is
counted where it meets first.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, prepare
from tallyframe.llm.components import connected_components

TABLES, PROBES, SCALE = 4, 16, 2.5
COSINE = 0.93
BLOCK = 1024
SEED = 7


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, a, b) for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for r, (i, j, a, b) in enumerate(pairs):
        whole[r, i], whole[r, j] = a, b
    half = np.array([s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


def nearest(p: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the nearest points of D8 (whole
    numbers of even sum) and of D8 shifted by one half."""
    def even(x):
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        e = x[odd] - r[odd]
        worst = np.abs(e).argmax(1)
        r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r
    a, b = even(p), even(p - 0.5) + 0.5
    return np.where((((p - a) ** 2).sum(1) <= ((p - b) ** 2).sum(1))[:, None], a, b)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Lattice:
    """Projections of one dimension, the same in every task."""

    def __init__(self, dims: int):
        rng = np.random.default_rng([SEED, dims])
        wide = max(dims, 8)
        self.projections = [np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dims] * np.sqrt(wide / 8) * SCALE
                            for _ in range(TABLES)]
        self.near = minimal_vectors()

    def _name(self, table: int, points: np.ndarray, label: np.ndarray) -> np.ndarray:
        h = _mix(label.view(np.uint64) + np.uint64(table))
        for k in range(8):
            h = _mix(h ^ np.rint(points[..., k] * 2).astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def cells(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(rows, TABLES, 1 + PROBES) cell names: own cell, then probed."""
        out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
        for t, projection in enumerate(self.projections):
            p = x @ projection
            own = nearest(p)
            closest = np.argpartition(-((p - own) @ self.near.T), PROBES - 1, axis=1)[:, :PROBES]
            points = np.concatenate([own[:, None], own[:, None] + self.near[closest]], 1)
            out[:, t] = self._name(t, points, np.repeat(label, 1 + PROBES).reshape(len(x), -1))
        return out


def _unit(column, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number reachable over the pairs, for 0 to n - 1."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(table, rep, copies, label, side, x, cells, least):
    """One block: rows (rep, links, root) of its vectors that link."""
    order = np.argsort(rep, kind="stable")
    rep, copies, label, side, x, cells = (a[order] for a in (rep, copies, label, side, x, cells))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    i, j = np.nonzero(x[left] @ x[right].T >= least)
    i, j = left[i], right[j]
    good = (rep[i] != rep[j]) & (label[i] == label[j])
    i, j = i[good], j[good]
    if not len(i):
        return None
    # the first meeting: the earliest table, in it the cell of the smaller one
    base_j = cells[j, table, 0] == cells[i, table, 0]
    back = (cells[i, table, 1:] == cells[j, table, :1]).any(1)
    first = ~((base_j | back) & (rep[j] < rep[i]))
    for t in range(table):
        first &= ~((cells[i, t, :1] == cells[j, t]).any(1) | (cells[j, t, :1] == cells[i, t]).any(1))
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, i[first], copies[j[first]])
    np.add.at(links, j[first], copies[i[first]])
    # one vector may stand on both sides of a block: rows of one rep are one
    one = np.searchsorted(rep, rep)
    root = _forest(len(rep), one[i], one[j])
    named = np.unique(one[np.concatenate([i, j])])
    total = np.zeros(len(rep), np.int64)
    np.add.at(total, one, links)
    return rep[named], total[named], rep[root[named]]


def _blocks(batches, dims: int, least: float):
    """Blocks of a partition, whose rows come sorted by block."""
    lattice = Lattice(dims)
    rest = None

    def done(block, rep, copies, label, side, table, x, last):
        edge = np.flatnonzero((block[1:] != block[:-1]).any(1)) + 1
        starts = [0, *edge.tolist(), len(block)]
        upto = len(starts) - 1 if last else len(starts) - 2
        found = []
        at = starts[upto]
        if upto:
            cells = lattice.cells(x[:at], label[:at])
            for a, b in zip(starts[:upto], starts[1:upto + 1]):
                if b - a > 1:
                    got = _compare(int(table[a]), rep[a:b], copies[a:b], label[a:b], side[a:b], x[a:b], cells[a:b], least)
                    if got:
                        found.append(got)
        out = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        tail = [v[at:] for v in (block, rep, copies, label, side, table, x)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "links", "root"]), tail

    for b in batches:
        n = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        now = [np.stack(n[:3], 1), *n[3:8], _unit(b.column(8), dims)]
        if rest is not None:
            now = [np.concatenate(c) for c in zip(rest, now)]
        out, rest = done(*now, last=False)
        yield out
    if rest is not None:
        yield done(*rest, last=True)[0]


def links(vectors: DataFrame, dims: int, least: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """``vectors``: (rep, label, copies, x), rep unique, label a hash, x of
    ``dims`` floats.  Returns (rep, links) and edges that connect what is
    linked."""
    def listed(batches):
        lattice = Lattice(dims)
        for b in batches:
            rep, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a in range(0, len(rep), 4096):
                own = lattice.cells(_unit(b.column(2).slice(a, 4096), dims), label[a:a + 4096])
                n = len(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.reshape(-1)), pa.array(np.repeat(rep[a:a + n], TABLES * (1 + PROBES))),
                    pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)),
                    pa.array(np.tile(np.arange(1 + PROBES) == 0, n * TABLES))], names=["cell", "rep", "t", "base"])

    listed_in = materialize(vectors.select("rep", "label", "x").mapInArrow(listed, "cell long, rep long, t int, base boolean"),
                            "cells")
    sizes = (listed_in.groupBy("cell").agg(F.sum(F.col("base").cast("long")).alias("held"), F.count(F.lit(1)).alias("n"))
             .where("held > 0 and n > 1"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    met = listed_in.join(sizes.select("cell", parts("held").alias("rows"), parts("n").alias("cols")), "cell")
    turn = F.xxhash64("rep")
    every = lambda n, use: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), use)
    part = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"),
                                       F.lit(side).cast("long").alias("side"))
    zero = F.lit(0)
    as_row = every("cols", lambda j: part(F.pmod(turn, F.col("rows")), j, 0))
    as_col = every("rows", lambda i: part(i, F.pmod(turn, F.col("cols")), 1))
    spread = (F.when(~F.col("base"), as_col).when((F.col("rows") == 1) & (F.col("cols") == 1), F.array(part(zero, zero, 2)))
              .otherwise(F.concat(as_row, as_col)))
    dealt = met.withColumn("b", F.explode(spread)).select("cell", "b.*", "rep", F.col("t").cast("long").alias("t"))
    rows = dealt.join(vectors, "rep").select("cell", "i", "j", "rep", "copies", "label", "side", "t", "x")
    blocks = (rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
              .mapInArrow(lambda it: _blocks(it, dims, least), "rep long, links long, root long"))
    found = materialize(blocks, "vector-links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("rep <> root").select("rep", "root")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers,
    and those without a label, link with nothing; vectors of different
    length never link.  Equal vectors link; repeated rows count as vectors.
    A null id is the smallest of a component only if no other is there.  An
    empty table gives an empty one; other columns are not read."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(f"`{vector_col}`")
    whole = F.transform(v, lambda e: e.cast("float") if _is_float(vectors, vector_col) else e.cast("double"))
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("lab"), whole.alias("x"))
    fine = (F.col("lab").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
            & F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False)))
    h = [F.xxhash64("lab", "x"), F.xxhash64(F.lit("again"), "x", "lab")]
    src = src.select("id", F.coalesce(fine, F.lit(False)).alias("fine"), h[0].alias("h1"), h[1].alias("h2"), "lab", "x")
    same = (src.where("fine").groupBy("h1", "h2")
            .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("lab").alias("lab"),
                 F.first("x").alias("x")))
    same = materialize(same.withColumn("rep", F.monotonically_increasing_id()).withColumn("label", F.xxhash64("lab")), "vectors")
    counts, edges = None, None
    for dims in sorted(r[0] for r in same.select(F.size("x")).distinct().collect()):
        c, e = links(same.where(F.size("x") == dims).select("rep", "label", "copies", "x"), dims, least)
        counts, edges = (c, e) if counts is None else (counts.unionAll(c), edges.unionAll(e))
    if counts is None:
        same = same.select("h1", "h2", "copies", F.lit(0).cast("long").alias("links"), F.col("first_id").alias("component"))
    else:
        roots = connected_components(edges)
        same = materialize(same.join(counts, "rep", "left").join(roots, same["rep"] == roots["node"], "left")
                           .select("h1", "h2", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                                   F.coalesce("root", "rep").alias("root")), "vector-roots")
        names = same.groupBy("root").agg(F.min("first_id").alias("component"))
        same = same.join(names, "root").select("h1", "h2", "copies", "links", "component")
    same = materialize(same, "vector-components")
    out = (src.select("id", "fine", "h1", "h2").alias("v")
           .join(same.alias("s"), F.col("fine") & (F.col("v.h1") == F.col("s.h1")) & (F.col("v.h2") == F.col("s.h2")), "left"))
    comp = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col),
                      F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _is_float(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.elementType.typeName() == "float"
