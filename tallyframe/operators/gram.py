"""Gram matrices of many columns in one scan (X1 for wide tables, M7).

Tasks multiply blocks of rows (as Arrow batches) and send one row for each
pair of columns and segment: counts, sums and products of the rows where
both columns have a value; many segments are sorted first, so that a task
sends each but once.  Correlations and ridge regressions follow from
these sums alone, so neither the number of rows nor the number of pairs
shapes the plan; k columns cost k (k + 1) / 2 small rows a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
#: Beyond so many segments, rows are dealt and sorted by segment first.
FEW_SEGMENTS = 1000
_SUMS = ["n", "si", "sj", "sii", "sjj", "sij"]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def gram(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., i, j, n, si, sj, sii, sjj, sij) for positions i <= j of
    ``cols``: sums over rows where both are present (NULL and NaN aren't),
    of values less those of the first row, which keeps large offsets from
    eating digits.  An empty table gives no rows."""
    by, k = list(by), len(cols)
    number = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
    rows = df.select(*[_q(b) for b in by], *[number(c).alias(f"__{i}") for i, c in enumerate(cols)])
    first = rows.select(*[f"__{i}" for i in range(k)]).limit(1).collect()
    shift = np.array([x or 0.0 for x in first[0]] if first else [0.0] * k)
    names = [*by, "i", "j", *_SUMS]
    ends_i, ends_j = np.triu_indices(k)
    many = bool(by) and df.agg(F.approx_count_distinct(F.xxhash64(*[_q(b) for b in by]))).first()[0] > FEW_SEGMENTS
    if many:   # a segment's rows meet in a task; Spark splits a large one
        rows = rows.hint("rebalance", *[f"`{b}`" for b in by]).sortWithinPartitions(*[_q(b) for b in by])

    def blocks(batches, size):
        for whole in batches:
            for a in range(0, whole.num_rows, size):
                b = whole.slice(a, size)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[len(by):]], 1)
                has = ~np.isnan(x)
                yield b, np.where(has, x - shift, 0.0), has

    def products(x, has):
        """Sums (n, si, sj, sii, sjj, sij) of all pairs of columns over rows where
        both are present; ``x`` is 0 where it isn't.  A column without gaps adds
        nothing to a mask, so only those with gaps are multiplied as masks."""
        gaps = np.flatnonzero(~has.all(0))
        square, mask = x * x, has[:, gaps].astype(np.float64)
        n, si, sii = (np.array(np.broadcast_to(c[:, None], (k, k)), np.float64) for c in (has.sum(0), x.sum(0), square.sum(0)))
        if len(gaps):
            n[:, gaps], si[:, gaps], sii[:, gaps] = has.T.astype(np.float64) @ mask, x.T @ mask, square.T @ mask
        return np.stack([n, si, si.T, sii, sii.T, x.T @ x])

    def run(batches):
        held: dict = {}
        kinds = None
        for b, x, has in blocks(batches, BLOCK_ROWS):
            kinds = [c.type for c in b.columns[:len(by)]]
            codes, values = pd.factorize(pd.MultiIndex.from_arrays([c.to_pylist() for c in b.columns[:len(by)]])) if by else (None, [()])
            for at, key in enumerate(values):
                new = products(x, has) if codes is None else products(x[codes == at], has[codes == at])
                key = tuple(None if v != v else v for v in (key if isinstance(key, tuple) else (key,)))
                held[key] = held[key] + new if key in held else new
            if len(held) * k * k > 4_000_000:
                yield from send(held, kinds)
                held = {}
        if held:
            yield from send(held, kinds)

    def run_many(batches):
        """Rows in the order of segments: sums between the ends of each."""
        for b, x, has in blocks(batches, max(1, 2_000_000 // len(ends_i))):
            keys = b.select(list(range(len(by))))
            new = np.zeros(b.num_rows, bool)
            for c in keys.columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            at = np.flatnonzero(new)
            m = has.astype(np.float64)
            xi, xj, mi, mj = x[:, ends_i], x[:, ends_j], m[:, ends_i], m[:, ends_j]
            sums = [np.add.reduceat(s, at, axis=0).ravel() for s in (mi * mj, xi * mj, xj * mi, xi * xi * mj, xj * xj * mi, xi * xj)]
            take = pa.array(np.repeat(at, len(ends_i)))
            yield pa.RecordBatch.from_arrays(
                [c.take(take) for c in keys.columns] + [pa.array(np.tile(e, len(at)).astype(np.int32)) for e in (ends_i, ends_j)]
                + [pa.array(sums[0].astype(np.int64))] + [pa.array(s) for s in sums[1:]], names=names)

    def send(held, kinds):
        for key, sums in held.items():
            flat = [s[ends_i, ends_j] for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * len(ends_i), t) for v, t in zip(key, kinds)]
                + [pa.array(ends_i.astype(np.int32)), pa.array(ends_j.astype(np.int32)), pa.array(flat[0].astype(np.int64))]
                + [pa.array(s) for s in flat[1:]], names=names)

    head = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    schema = head + "i int, j int, n long, si double, sj double, sii double, sjj double, sij double"
    return rows.mapInArrow(run_many if many else run, schema).groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def wide_correlation_pairs(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """X1 for any number of columns: (by..., i, j, c1, c2, n, r) for i < j,
    Pearson over pairwise complete rows; NULL without spread."""
    names = F.array(*[F.lit(c) for c in cols])
    g = gram(df, cols, by).where("i < j")
    n = F.col("n").cast("double")
    vi, vj = n * F.col("sii") - F.col("si") * F.col("si"), n * F.col("sjj") - F.col("sj") * F.col("sj")
    r = F.when((vi > 0) & (vj > 0), (n * F.col("sij") - F.col("si") * F.col("sj")) / F.sqrt(vi) / F.sqrt(vj))
    return g.select(*by, "i", "j", names[F.col("i")].alias("c1"), names[F.col("j")].alias("c2"), "n", r.alias("r"))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, by: list[str] = ()) -> DataFrame:
    """M7 in closed form: (by..., feature, position, coefficient, intercept,
    r2_pct, n), a row for each feature and segment.

    Least squares with a penalty of ``alpha`` on the squared coefficients
    (not on the intercept), solved from the Gram matrix of the rows that
    have all features and the target.  A segment without such rows has no
    rows; r2_pct is on the fitted rows, NULL for a constant target."""
    by, cols = list(by), [*features, target]
    whole = df
    for c in cols:
        whole = whole.where(_q(c).isNotNull() & ~F.isnan(_q(c).cast("double")))
    means = whole.groupBy(*by).agg(F.array(*[F.avg(_q(c).cast("double")) for c in cols]).alias("__m"))
    sums = gram(whole, cols, by).groupBy(*by).agg(F.collect_list(F.struct("i", "j", *_SUMS)).alias("__g"))   # k (k + 1) / 2
    k = len(features)

    def solve(batches):
        for b in batches:
            out = []
            for at, (entries, mean) in enumerate(zip(b.column("__g").to_pylist(), b.column("__m").to_pylist())):
                c, n = np.zeros((k + 1, k + 1)), max(e["n"] for e in entries)
                for e in entries:
                    c[e["i"], e["j"]] = c[e["j"], e["i"]] = e["sij"] - e["si"] * e["sj"] / n
                a = np.linalg.cholesky(c[:k, :k] + alpha * np.eye(k))
                w = np.linalg.solve(a.T, np.linalg.solve(a, c[:k, k]))
                rest = c[k, k] - 2 * w @ c[:k, k] + w @ c[:k, :k] @ w
                r2 = float(100 * (1 - rest / c[k, k])) if c[k, k] > 0 else None
                bias = mean[k] - float(w @ np.array(mean[:k]))
                out += [(at, f, i, float(w[i]), bias, r2, n) for i, f in enumerate(features)]
            take = pa.array([o[0] for o in out], pa.int64())
            cols = list(zip(*[o[1:] for o in out])) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(take) for i in range(len(by))] + [pa.array(list(c), t) for c, t in zip(cols, kinds)],
                names=[*by, "feature", "position", "coefficient", "intercept", "r2_pct", "n"])

    if by:
        same = None
        for c in by:
            hit = F.col(f"s.`{c}`").eqNullSafe(F.col(f"m.`{c}`"))
            same = hit if same is None else same & hit
        both = sums.alias("s").join(means.alias("m"), same).select(*[F.col(f"s.`{c}`") for c in by], "__g", "__m")
    else:   # one row each
        both = (sums.withColumn("__o", F.lit(1)).join(means.withColumn("__o", F.lit(1)), "__o").select("__g", "__m")
                .where(F.size("__g") > 0))
    head = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    return both.mapInArrow(solve, head + "feature string, position int, coefficient double, intercept double, r2_pct double, n long")
