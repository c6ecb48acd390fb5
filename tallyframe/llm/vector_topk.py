"""Exact top-k by inner product: vectors in buckets of similar length.

Vectors become whole numbers and are sorted by length; runs of neighbours
are buckets.  A query needs a cosine of its k-th product over (its length
times the bucket's greatest length) inside a bucket, its local threshold
there; above 1 the bucket is skipped.  Every bucket picks, from the local
thresholds of the queries at hand, from which one on a query prunes by
coordinates (a few of its largest fix ranges that a close vector must lie
in, read off sorted lists); the others prune by length, a prefix of the
bucket.  What is left is verified by its exact product.

The first thresholds come from the longest bucket.  Then queries go in
blocks, sorted by the length they need, against groups of buckets; a bucket
that is too short for a whole block isn't sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import free_shuffles, materialize, prepare, ranked

SCALE = 256.0
#: Numbers in a bucket and in a block of queries at most, and rows.
BUCKET_NUMBERS, BUCKET_ROWS, GROUP = 1 << 19, 4096, 8
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 20, 16_384
#: Coordinates looked at, queries tried to choose a bucket's way, share of
#: a bucket's prefix that coordinates must get below to be worth it.
FOCUS, TRIED, WORTH = 4, 24, 0.25
SLACK = 1e-9
CHUNK = 256
LIMIT = 2**63 - 1


def usable(vec: Column) -> Column:
    """Neither null nor with a component that is null or not finite, times
    ``SCALE`` too."""
    most = np.finfo(np.float64).max / SCALE
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) <= most, F.lit(False))), F.lit(False))


def whole(vec: Column) -> Column:
    """floor(SCALE * x) as doubles; from 2^53 on doubles are whole."""
    def one(x: Column) -> Column:
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vec, one)


def _numbered(rows: DataFrame, order: list, numbers: int, most: int, name: str) -> DataFrame:
    """``rows`` sorted by dims and ``order``, written down, with own (their
    rank), run (``most`` neighbours, fewer where they hold more than
    ``numbers`` numbers) and team (GROUP runs), whatever the partitions."""
    by = ["dims", *order]
    held = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id())
    held = materialize(held, name).withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("dims", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))   # a row a partition
    parts = parts.select("dims", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    size = F.greatest(F.lit(1), F.least(F.lit(most), F.call_function("div", F.lit(numbers), F.greatest(F.col("dims"), F.lit(1)))))
    mark = F.shiftleft(F.col("dims").cast("long"), 40)
    rank = F.col("row") - F.col("first") + F.col("before")
    return (held.join(parts, ["dims", "part"]).withColumn("own", mark + rank)
            .withColumn("run", mark + F.call_function("div", rank, size))
            .withColumn("team", mark + F.call_function("div", rank, size * GROUP)).drop("row", "part", "first", "before"))


def _stretches(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal values."""
    n = len(columns[0])
    if n:
        new = np.zeros(n - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edge = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        yield from zip(edge[:-1], edge[1:])


class Bucket:
    """Vectors by falling length, unit vectors and sorted coordinates."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.order, self.v, self.norms = order, vectors[order], norms[order]
        self.top = float(self.norms[0])
        self.size = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.good = bool(np.isfinite(self.norms).all() and self.norms[-1] > 0)   # else no unit vectors
        self.lists = None

    def sort(self) -> None:
        if self.lists is None:
            self.unit = self.v / self.norms[:, None]
            self.lists = np.argsort(self.unit, axis=0, kind="stable")
            self.values = np.take_along_axis(self.unit, self.lists, axis=0)

    def near(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Positions that may have the cosine with the unit vector q, by the
        ranges of q's largest coordinates."""
        focus = np.argsort(-np.abs(q))[:FOCUS]
        angle, wide = np.arccos(np.clip(q[focus], -1, 1)), np.arccos(min(1.0, max(-1.0, cosine - SLACK)))
        low = np.cos(np.minimum(np.pi, angle + wide)) - SLACK
        high = np.cos(np.maximum(0.0, angle - wide)) + SLACK
        ends = [(np.searchsorted(self.values[:, f], a), np.searchsorted(self.values[:, f], b, "right"))
                for f, a, b in zip(focus, low, high)]
        short = min(range(len(focus)), key=lambda i: ends[i][1] - ends[i][0])
        found = self.lists[ends[short][0]:ends[short][1], focus[short]]
        for i, f in enumerate(focus):
            if i != short and len(found):
                x = self.unit[found, f]
                found = found[(x >= low[i]) & (x <= high[i])]
        return found

    def prefix(self, least: np.ndarray) -> np.ndarray:
        """How many vectors are as long as needed."""
        return np.searchsorted(-self.norms, -(least * (1 - SLACK)), "right")


def products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Products of whole numbers: exact in doubles, 64 bits or Python's
    numbers, whose results are limited to 64 bits."""
    if bound < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    big = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(big(q) @ big(v).T, -LIMIT, LIMIT).astype(np.int64)


class _Block:
    """Queries with the best k products each so far."""

    def __init__(self, own, ids, norms, theta, vectors, k):
        self.own, self.ids, self.norms, self.q, self.k = own, ids, norms, vectors, k
        self.bar = np.array([-np.inf if t is None else t for t in theta], np.float64)
        self.size = float(np.abs(vectors).max()) if vectors.size else 0.0
        none = np.zeros(0, np.int64)
        self.best = (none, none, none, none, none)   # query, score, no id, id, own

    def add(self, query, score, null, ids, own) -> None:
        rows = [np.concatenate([a, b]) for a, b in zip(self.best, (query, score, null, ids, own))]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(first)) - first
        rows = [r[place < self.k] for r in rows]
        last = place[place < self.k] == self.k - 1
        self.bar[rows[0][last]] = np.maximum(self.bar[rows[0][last]], rows[1][last].astype(np.float64))
        self.best = tuple(rows)

    def meet(self, bucket: Bucket, own: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        own, null, ids = own[bucket.order], null[bucket.order], ids[bucket.order]
        bound = self.size * bucket.size * max(1, self.q.shape[1])
        with np.errstate(all="ignore"):
            least = np.where(self.bar > 0, self.bar / self.norms, 0.0)   # the length that a query needs
            need = np.where(np.isfinite(least), least, 0.0)
            local = need / bucket.top if bucket.good else np.zeros(len(need))
        live = np.flatnonzero(bucket.prefix(need) > 0)
        cut = self._cut(bucket, live, local, need)
        by_list = live[local[live] >= cut]
        for i in by_list.tolist():
            found = bucket.near(self.q[i] / self.norms[i], float(local[i]))
            if len(found):
                self._keep(np.array([i]), found, products(self.q[i:i + 1], bucket.v[found], bound), own, null, ids)
        by_length = live[local[live] < cut]
        by_length = by_length[np.argsort(need[by_length], kind="stable")]
        for a in range(0, len(by_length), CHUNK):
            part = by_length[a:a + CHUNK]
            n = int(bucket.prefix(need[part[:1]])[0])
            self._keep(part, np.arange(n), products(self.q[part], bucket.v[:n], bound), own, null, ids)

    def _cut(self, bucket: Bucket, live, local, need) -> float:
        """Local threshold from which coordinates leave fewer vectors."""
        hopeful = live[local[live] > 0]
        if not len(hopeful) or not self.q.shape[1]:
            return np.inf
        bucket.sort()
        tried = hopeful[np.argsort(-local[hopeful], kind="stable")]
        tried = tried[np.unique(np.linspace(0, len(tried) - 1, TRIED).astype(int))]
        cut = np.inf
        for i in tried.tolist():
            if len(bucket.near(self.q[i] / self.norms[i], float(local[i]))) > WORTH * int(bucket.prefix(need[i:i + 1])[0]):
                break
            cut = float(local[i])
        return cut

    def _keep(self, query, found, score, own, null, ids) -> None:
        bar = self.bar[query].copy()
        if score.shape[1] > self.k:   # the own row may be among them: one more
            at = score.shape[1] - self.k - 1
            bar = np.maximum(bar, np.partition(score, at, axis=1)[:, at])
        good = (score >= bar[:, None]) & (self.own[query][:, None] != own[found][None, :])
        r, c = np.nonzero(good)
        if len(r):
            at = found[c]
            self.add(query[r], score[r, c], null[at], ids[at], own[at])

    def rows(self) -> pa.RecordBatch:
        query, score, null, ids, own = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.own[query]), pa.array(self.ids[query]), pa.array(ids, mask=null.astype(bool)), pa.array(own),
             pa.array(score)], names=["own", "query_id", "vec_id", "vec_own", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


_MET = "own long, query_id long, vec_id long, vec_own long, score long"


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best k of each query of a block within each team sent to it.
    ``queries``: block, team, own, id, norm, theta, x; ``vectors``: block,
    team, run, own, id, norm, x."""
    cols = ["block", "team", "kind", "run", "own", "id", "norm", "theta", "x"]
    rows = (queries.withColumn("kind", F.lit(0)).withColumn("run", F.lit(0).cast("long")).select(*cols)
            .unionAll(vectors.withColumn("kind", F.lit(1)).withColumn("theta", F.lit(None).cast("double")).select(*cols)))

    def run(batches):
        block, where, held = None, None, []

        def end():
            nonlocal block
            if where is None:
                return None
            t = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(t["x"].combine_chunks() if isinstance(t["x"], pa.ChunkedArray) else t["x"])
            own, norm = t["own"].to_numpy(), t["norm"].to_numpy()
            ids = t["id"].fill_null(0).to_numpy()
            if where[2] == 0:
                block = _Block(own, ids, norm, t["theta"].to_pylist(), x, k)
            elif block is not None:
                block.meet(Bucket(x, norm), own, t["id"].is_null().to_numpy().astype(np.int64), ids)

        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(4)]
            for a, z in _stretches(keys):
                key = tuple(int(c[a]) for c in keys)
                if key != where:
                    end()
                    if block is not None and where[:2] != key[:2]:
                        yield block.rows()
                        block = None
                    where, held = key, []
                held.append(b.slice(a, z - a))
        end()
        if block is not None:
            yield block.rows()

    return (rows.repartition("block", "team").sortWithinPartitions("block", "team", "kind", "run")
            .mapInArrow(run, _MET))


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a
    condition on column ``id``) holds for, the k largest products with other
    rows of its number of components, equal ones by rising id (null last).

    Components x count as floor(256 x).  A vector that is null or holds a
    null or non-finite component (also times 256) takes no part.  Every row
    is a candidate, repeated rows too; a query leaves out its own row only,
    so repeated query rows come out once each.  A score beyond 64 bits is
    the largest or smallest long, in ranking too.  Fewer than k candidates
    give fewer rows; an empty table gives an empty one;
    other columns are not read."""
    spark = vectors.sparkSession
    prepare(spark)
    vec = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("v")).where(usable(F.col("v")))
    rows = rows.select("id", F.size("v").alias("dims"), whole(F.col("v")).alias("x"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.withColumn("seed", F.xxhash64("id", "x")).select("id", "dims", "norm", "seed", "x")
    held = _numbered(rows, [F.col("norm").desc(), "seed"], BUCKET_NUMBERS, BUCKET_ROWS, "vector-buckets")
    free_shuffles(spark)
    buckets = materialize(held.groupBy("dims", "team", "run").agg(F.max("norm").alias("top")), "bucket-lengths")
    asked = held.where(F.coalesce(is_query, F.lit(False))).drop("seed", "run").withColumnRenamed("team", "block")

    # first thresholds, from the longest bucket
    longest = buckets.groupBy("dims").agg(F.max(F.struct("top", "run", "team")).alias("b")).select("dims", "b.run", "b.team")
    first = asked.join(longest.select("dims", "team"), "dims").withColumn("theta", F.lit(None).cast("double"))
    blocks = asked.select("dims", "block").distinct()
    seeds = held.join(longest.join(blocks, "dims").select("run", "block"), "run")
    found = _meet(first, seeds, k)
    theta = (found.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("theta")).where(F.col("n") >= k)
             .select("own", F.col("theta").cast("double").alias("theta")))
    ready = asked.drop("block").join(theta, "own", "left")
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm")).otherwise(0.0)
    ready = ready.select("id", "dims", "norm", "theta", "x", F.col("own").alias("mine"), need.alias("need"))
    ready = _numbered(ready, ["need", "mine"], BLOCK_NUMBERS, BLOCK_ROWS, "query-blocks")
    ready = ready.select("id", "dims", "norm", "theta", "x", "need", F.col("mine").alias("own"), F.col("run").alias("block"))
    free_shuffles(spark)

    # buckets that are long enough for some query of a block
    least = ready.groupBy("dims", "block").agg(F.min("need").alias("least"))
    pairs = (buckets.join(least, "dims").where(F.col("top") >= F.col("least") * (1 - SLACK))
             .select("dims", "block", "run", "team"))
    pairs = materialize(pairs, "blocks-and-buckets")
    teams = pairs.select("block", "team").distinct()
    met = _meet(ready.join(teams, "block"), held.drop("team").join(pairs.select("run", "block", "team"), "run"), k)
    met = materialize(met, "best-of-teams")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("vec_own")]
    return ranked(met, ["own"], order, k, "vec_own").select("query_id", "rank", "vec_id", "score")
