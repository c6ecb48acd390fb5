"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

Words and bigrams of words are hashed into ``DIMENSIONS`` weights; a text's
features are the shares of its grams.  The model is fitted on a bounded
sample of labelled rows (``TRAIN_ROWS``): shards run follow-the-regularised-
leader over their rows in parallel, and after each round the accumulators
that shards touched are averaged.  Every text is then scored whole, as a
sparse dot product with broadcast weights (``DIMENSIONS`` doubles).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, free_shuffles, materialize, prepare

DIMENSIONS = 1 << 18   # a power of two
#: The model sees at most so many labelled rows (smallest hash of the id).
TRAIN_ROWS = 20_000
SHARDS, ROUNDS = 8, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.02
SCALE = 20.0
THRESHOLD = 0.3
_WORDS = re.compile(r"\w+|[^\w\s]+")
_MEMORY = 200_000
_HASHES: dict[str, int] = {}


def grams(text: str) -> np.ndarray:
    """Weight numbers of the words and bigrams of a text, repeats included.
    Words are runs of letters and digits, or of other signs;
    a word after itself is the same bigram for all words."""
    words = _WORDS.findall(text)
    if not words:
        return np.zeros(0, np.int64)
    if len(_HASHES) > _MEMORY:
        _HASHES.clear()
    known = _HASHES
    for w in words:
        if w not in known:
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    h = np.array([known[w] for w in words], np.uint64)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)
    pair[h[:-1] == h[1:]] = 1   # a word after itself is one gram, whichever word
    both = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pair * np.uint64(0xC2B2AE3D27D4EB4F)])
    return (both >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64)   # the top bits of a product mix best


def _weights(z, n):
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def follow(z: np.ndarray, n: np.ndarray, rows) -> np.ndarray:
    """FTRL over (label, weight numbers, counts) in their order; ``z`` and
    ``n`` change in place.  Returns which weights were met."""
    touched = np.zeros(len(z), bool)
    for y, at, count in rows:
        at = np.append(at, len(z) - 1)
        x = np.append(count / max(1, count.sum()) * SCALE, 1.0)
        w = _weights(z[at], n[at])
        g = (_sigmoid(w @ x) - y) * x
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g * g
        touched[at] = True
    return touched


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (the last one is the intercept).  ``labels`` has the id and
    a label 0 or 1; null ids and labels are left out, repeated labels of an
    id are averaged.  Repeated documents of a labelled id are a row each.
    Without any labelled text all weights are 0.

    A row's shard is its id's hash modulo SHARDS and its turn in a round a
    hash of id and round, so the fit doesn't depend on partitions."""
    spark = docs.sparkSession
    prepare(spark)
    i, y, t = (F.col(f"`{c}`") for c in (id_col, label_col, text_col))
    known = (labels.where(i.isNotNull() & y.isNotNull()).groupBy(i.alias("label_id")).agg(F.avg(y).alias("y"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows))
    # at most train_rows ids and numbers: small enough to broadcast
    rows = docs.select(i.alias("id"), t.alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.xxhash64("id").alias("h"))

    def counted(batches):
        for b in batches:
            found = [np.unique(grams(x), return_counts=True) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([k.astype(np.int32) for k, _ in found], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], names=["y", "h", "at", "x"])

    sample = rows.mapInArrow(counted, "y double, h bigint, at array<int>, x array<int>")
    sample = materialize(sample.withColumn("shard", F.pmod("h", F.lit(SHARDS))), "training")
    free_shuffles(spark)
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast((z, n))

        def shard(frame: pd.DataFrame) -> pd.DataFrame:   # at most train_rows rows in all shards
            z, n = (a.copy() for a in start.value)
            frame = frame.sort_values("turn", kind="stable")
            at = np.flatnonzero(follow(z, n, zip(frame["y"], frame["at"], frame["x"])))
            return pd.DataFrame({"shard": int(frame["shard"].iloc[0]), "at": at, "z": z[at], "n": n[at]})

        mean = lambda c: (F.aggregate("of", F.lit(0.0), lambda a, s: a + s[c]) / F.size("of")).alias(c)
        moved = (sample.withColumn("turn", F.xxhash64("h", F.lit(turn))).groupBy("shard")
                 .applyInPandas(shard, "shard bigint, at bigint, z double, n double")
                 .groupBy("at").agg(F.sort_array(F.collect_list(F.struct("shard", "z", "n"))).alias("of"))   # at most SHARDS
                 .select("at", mean("z"), mean("n")))
        got = moved.toPandas()   # at most DIMENSIONS + 1 rows
        z[got["at"]], n[got["at"]] = got["z"], got["n"]
        start.destroy()
        del moved
        free_shuffles(spark)
    discard(sample)
    return _weights(z, n)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of ``docs``: the probability of label 1.  Null
    and empty texts have no grams and get the intercept's score; texts of
    any length are scored whole; equal rows get equal scores; an empty
    table gives an empty one; other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(weights)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        w = model.value
        for b in batches:
            out = []
            for x in b.column(1):
                at = grams(x.as_py())
                out.append(float(_sigmoid(w[-1] + (w[at].mean() * SCALE if len(at) else 0.0))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, score double")
