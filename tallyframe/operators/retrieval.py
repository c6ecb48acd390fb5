"""T3, approximate: cosine top-k through buckets of random projections.

A vector's bucket is the signs of its products with random directions.  A
query visits the buckets in the order of how far its own projections would
have to move to get there, up to a number of visits; the vectors it finds
are scored exactly.  The number of visits isn't guessed: the exact search
runs for a bounded sample of queries, and the visits are as many as found
the wanted share of their true neighbours.

Every corpus row is in one bucket, so a query meets it once.  Rows and
queries of a bucket travel as blocks of at most BLOCK vectors, which meet by
an equi-join on the bucket; a pair of blocks is one matrix product and gives
back the best k for each query.  Queries of a checked size go to all tasks
once, which score the corpus where it lies and keep k rows for each query;
of more, Spark splits a crowded bucket's blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.operators.text import BROADCAST_BYTES, l2_normalize  # noqa: F401 - the tests read it here

#: About so many corpus rows share a bucket, of at most 2**MAX_BITS.
BUCKET_ROWS, MAX_BITS = 64, 12
BLOCK = 256
#: Queries whose true neighbours fix the number of visits.
SAMPLE_QUERIES = 128
#: Bytes of query vectors that the driver gathers and sends to all tasks.
QUERY_BYTES = 16 << 20
SEED = 20


def _q(c: str):
    return F.col(f"`{c}`")


def directions(bits: int, size: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, bits))


def visit_order(projected: np.ndarray) -> np.ndarray:
    """All buckets for every row of projections, nearest first: a bucket
    costs the squares of the projections whose sign it flips."""
    bits = projected.shape[1]
    masks = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    cost = (projected ** 2) @ masks.T
    own = (projected > 0) @ (1 << np.arange(bits))
    return np.argsort(cost, axis=1, kind="stable") ^ own[:, None]


def _vectors(df: DataFrame, id_col: str, vec_col: str, size: int | None = None) -> DataFrame:
    """(id, v) as unit vectors of doubles; null, zero and other vectors that
    hold a null or no number or are of another size are left out."""
    v = _q(vec_col).cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    if size is not None:
        sound &= F.size(v) == size
    return df.where(sound).select(_q(id_col).alias("id"), l2_normalize(v).alias("v"))


def _with(df: DataFrame, planes: np.ndarray, name: str, kind: pa.DataType, of) -> DataFrame:
    """(id, v) and a column made of the projections of a batch."""
    size = planes.shape[0]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(v @ planes), kind)], names=["id", "v", name])

    spark_kind = "array<int>" if pa.types.is_list(kind) else "int"
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, v array<double>, {name} {spark_kind}")


def _bucketed(df: DataFrame, planes: np.ndarray) -> DataFrame:
    return _with(df, planes, "bucket", pa.int32(), lambda p: (p > 0) @ (1 << np.arange(p.shape[1])))


def _visits(df: DataFrame, planes: np.ndarray, n: int) -> DataFrame:
    return _with(df, planes, "buckets", pa.list_(pa.int32()), lambda p: list(visit_order(p)[:, :n].astype(np.int32)))


def _blocks(df: DataFrame, size: int, side: str) -> DataFrame:
    """(bucket, ids, vectors end to end): blocks of the rows (id, v, bucket),
    in the order of ids."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), b.num_rows]
            cuts = [x for a, z in zip(edges, edges[1:]) for x in range(a, z, BLOCK)]
            at = np.array([*cuts, b.num_rows], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts]), pa.ListArray.from_arrays(pa.array(at), b.column("id")),
                 pa.ListArray.from_arrays(pa.array(at * size), b.column("v").flatten())], names=["bucket", f"{side}_ids", f"{side}v"])

    kind = df.schema["id"].dataType.simpleString()
    rows = df.select("id", "v", "bucket").sortWithinPartitions("bucket", "id")
    return rows.mapInArrow(run, f"bucket int, {side}_ids array<{kind}>, {side}v array<double>")


def _scored(pairs: DataFrame, size: int, k: int) -> DataFrame:
    """(q_id, c_id, score): the best ``k`` of a corpus block for each query
    of a query block."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q, c = (b.column(n)[r].values.to_numpy(zero_copy_only=False).reshape(-1, size) for n in ("qv", "cv"))
                score = q @ c.T
                top = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :k]   # ids rise in a block
                yield pa.RecordBatch.from_arrays(
                    [b.column("q_ids")[r].values.take(pa.array(np.repeat(np.arange(len(q)), top.shape[1]))),
                     b.column("c_ids")[r].values.take(pa.array(top.ravel())),
                     pa.array(np.take_along_axis(score, top, 1).ravel())], names=["q_id", "c_id", "score"])

    of = {f.name: f.dataType.elementType.simpleString() for f in pairs.schema.fields if f.name in ("q_ids", "c_ids")}
    return (pairs.select("q_ids", "qv", "c_ids", "cv")
            .mapInArrow(run, f"q_id {of['q_ids']}, c_id {of['c_ids']}, score double"))


def _scored_here(known: DataFrame, asked: pa.Table, planes: np.ndarray, visits: int, k: int) -> DataFrame:
    """(q_id, c_id, score): the best ``k`` corpus rows of a task for each
    query, of the buckets that the query visits.  Queries are numbered by
    their row; the corpus stays where it lies, and a task holds k places a
    query and the ids of its rows."""
    size, bits = planes.shape
    v = asked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
    shared = known.sparkSession.sparkContext.broadcast(v)

    def run(batches) -> Iterator[pa.RecordBatch]:
        qv = shared.value
        visited = np.empty((len(qv), visits), np.int32)
        for a in range(0, len(qv), BLOCK):
            visited[a:a + BLOCK] = visit_order(qv[a:a + BLOCK] @ planes)[:, :visits]
        order = np.argsort(visited.ravel(), kind="stable")
        visitor = order // visits
        edge = np.searchsorted(visited.ravel()[order], np.arange((1 << bits) + 1))
        del visited, order
        best, place = np.full((len(qv), k), -np.inf), np.full((len(qv), k), -1, np.int64)
        ids, seen = [], 0
        for b in batches:
            ids.append(b.select(["id"]))
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            bucket = (x @ planes > 0) @ (1 << np.arange(bits))
            rows = np.argsort(bucket, kind="stable")   # ids rise in a batch
            cuts = np.searchsorted(bucket[rows], np.arange((1 << bits) + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                q, r = visitor[edge[c]:edge[c + 1]], rows[cuts[c]:cuts[c + 1]]
                for a in range(0, len(q), BLOCK):
                    at = q[a:a + BLOCK]
                    score = qv[at] @ x[r].T
                    near = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :k]
                    both = np.concatenate([best[at], np.take_along_axis(score, near, 1)], 1)
                    where = np.concatenate([place[at], seen + r[near]], 1)
                    first = np.lexsort((where, -np.round(both, 12)), axis=1)[:, :k]   # of equal scores the smaller id
                    best[at], place[at] = np.take_along_axis(both, first, 1), np.take_along_axis(where, first, 1)
            seen += b.num_rows
        q, at = np.nonzero(place >= 0)
        if len(q):
            kept = pa.Table.from_batches(ids).column("id").take(pa.array(place[q, at])).combine_chunks()
            out = pa.table({"q": pa.array(q.astype(np.int64)), "c_id": kept, "score": pa.array(best[q, at])})
            yield from out.to_batches(max_chunksize=10_000)

    kind = known.schema["id"].dataType.simpleString()
    return known.select("id", "v").sortWithinPartitions("id").mapInArrow(run, f"q long, c_id {kind}, score double")


def _first(scored: DataFrame, q: str, k: int) -> DataFrame:
    w = Window.partitionBy(q).orderBy(F.round("score", 12).desc(), F.col("c_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def needed_visits(queries: DataFrame, corpus: DataFrame, planes: np.ndarray, k: int, recall: float) -> int:
    """Visits that find ``recall`` of the true ``k`` neighbours of at most
    SAMPLE_QUERIES queries, drawn by a hash of their ids (unit vectors)."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("id", "v").toArrow()
    if not asked.num_rows:
        return 1
    true = _first(_scored_here(corpus, asked, planes[:, :0], 1, k), "q", k)   # without planes all rows are in one bucket
    found = true.select("q", "c_id").join(corpus.select(F.col("id").alias("c_id"), F.col("v").alias("cv")), "c_id")
    found = found.select("q", "cv").toArrow()   # SAMPLE_QUERIES * k rows
    if not found.num_rows:
        return 1
    size = planes.shape[0]
    vectors = lambda c: c.combine_chunks().flatten().to_numpy().reshape(-1, size)
    order = visit_order(vectors(asked.column("v"))[found.column("q").to_numpy()] @ planes)
    own = (vectors(found.column("cv")) @ planes > 0) @ (1 << np.arange(planes.shape[1]))
    place = np.sort(np.argmax(order == own[:, None], axis=1))
    return int(place[math.ceil(recall * len(place)) - 1]) + 1


def probed_topk(queries: DataFrame, q_id: str, q_vec: str, corpus: DataFrame, c_id: str, c_vec: str,
                k: int = fixed.RETRIEVE_K, recall: float = 0.95, bits: int | None = None,
                broadcast_bytes: int = QUERY_BYTES) -> DataFrame:
    """(q_id, c_id, score, rank), nearly the k corpus rows of the
    largest cosine for each query; ties by corpus id.

    ``recall`` is the share of true neighbours wanted on a sample of the
    queries.  Vectors that are null, zero, hold nulls or non-finite numbers,
    or differ in size from the corpus's first sound vector by id, take no
    part; an empty side gives an empty table; repeated corpus ids are rows
    of their own, repeated query ids one query each that share ranks."""
    known = _vectors(corpus, c_id, c_vec)
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("v"), "id").alias("size")).first()
    size = shape["size"] or 1
    known, asked = known.where(F.size("v") == size), _vectors(queries, q_id, q_vec, size)
    if bits is None:
        bits = min(MAX_BITS, max(2, math.ceil(math.log2(max(shape["n"], 1) / BUCKET_ROWS + 1))))
    planes = directions(bits, size)
    visits = needed_visits(asked, known, planes, k, recall)
    told = asked.agg(F.count(F.lit(1))).first()[0] * (8 * size + 40)
    if told <= broadcast_bytes:
        here = asked.select("id", "v").toArrow()   # at most broadcast_bytes
        names = queries.sparkSession.createDataFrame(
            pa.table({"q": pa.array(np.arange(here.num_rows)), "q_id": here.column("id")}),
            f"q long, q_id {asked.schema['id'].dataType.simpleString()}")
        scored = _scored_here(known, here, planes, visits, k).join(names, "q").select("q_id", "c_id", "score")
    else:
        spread = _visits(asked, planes, visits).select("id", "v", F.explode("buckets").alias("bucket"))
        q = _blocks(spread.repartition("bucket"), size, "q")
        scored = _scored(_blocks(_bucketed(known, planes), size, "c").join(q, "bucket"), size, k)
    return _first(scored, "q_id", k)
