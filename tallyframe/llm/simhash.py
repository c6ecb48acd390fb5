"""SimHash near-dedup: pigeonhole blocks, join on blocks, verified distance.

A fingerprint is cut into blocks of 16 bits.  Two fingerprints that differ
in at most two bits differ in at most two of the four blocks, so they share
the other two: each fingerprint is listed under its six pairs of blocks,
those under one key are joined, and the Hamming distance is verified.

Equal fingerprints are one row from the start.  A key shared by more than
``CROWDED`` fingerprints isn't joined with itself; its fingerprints are
linked exactly by single flips: two fingerprints at most two bits apart
both reach some value by at most one flip, and all that reach one value are
at most two bits apart.  Such a group has at most 65 members, so nothing
grows with the square of a crowd.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, materialize, prepare
from tallyframe.llm.components import connected_components

BITS = 64
BLOCKS = 4
DISTANCE = 2
SEED = 42
#: A block key with more fingerprints is linked by single flips.
CROWDED = 32
_SLICE = 1 << 16


def fingerprint_of(text: bytes, shingle_words: int = 3) -> int:
    """Fingerprint of a UTF-8 text, as a signed 64-bit number.  A-Z are
    lower-cased; words end at ASCII white space; fewer words than a shingle
    has make one shingle, no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        top = min(at + _SLICE, n)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:top], ends[at + k - 1:top + k - 1])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """(id, fingerprint, mark) per row; ``mark`` hashes the text, to tell
    rows apart that share an id.  A null text has no words."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
                      F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint_of(t.as_py(), shingle_words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2)], names=["id", "fingerprint", "mark"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fingerprint bigint, mark bigint")


def links(distinct: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (column ``fp``, distinct,
    not null) at most ``distance`` bits apart: every such pair is joined by
    a path of returned edges, and every edge is such a pair."""
    if distance != DISTANCE:
        raise ValueError("the blocks are laid out for two differing bits")
    width = BITS // BLOCKS
    part = [f"(shiftrightunsigned(fp, {i * width}) & {(1 << width) - 1})" for i in range(BLOCKS)]
    keys = [f"({t}L << {2 * width} | {part[i]} << {width} | {part[j]})"
            for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))]
    listed = distinct.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = materialize(listed.join(sizes, "key").select("key", "fp", (F.col("n") > crowded).alias("crowd")), "blocks")
    few = listed.where("not crowd")
    close = F.expr("a.fp < b.fp and bit_count(a.fp ^ b.fp) <= " + str(distance))
    pairs = (few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & close)
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    flips = F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
    met = (listed.where("crowd").select("fp").distinct().select("fp", F.explode(flips).alias("m"))
           .groupBy("m").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1"))
    stars = met.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, mark, root, component) per row: ``root`` names the
    group of rows connected by links of fingerprints, ``component`` is its
    smallest id.

    Null and empty texts have fingerprint 0 and link like any other; equal
    texts share a component; repeated rows come back as often as given; a
    null id is never the smallest unless no other is there; an empty table
    gives an empty one; other columns of ``docs`` are not looked at."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    same = materialize(fps.groupBy(F.col("fingerprint").alias("fp"))
                       .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows")), "fingerprint-groups")
    comp = connected_components(links(same.select("fp"), distance))
    rooted = (same.join(comp, same["fp"] == comp["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    rooted = materialize(rooted, "fingerprint-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = materialize(rooted.join(smallest, "root").select("fp", "root", "component"), "fingerprint-components")
    return (fps.join(named, fps["fingerprint"] == named["fp"])
            .select("id", "fingerprint", "mark", "root", "component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (null
    last), then of the smallest text hash.  Rows alike in id and text are
    one row; all columns are kept."""
    found = near_duplicates(docs, id_col, text_col, shingle_words, distance)
    keep = (found.groupBy("root")
            .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("k"))
            .select(F.col("k.id").alias("k_id"), F.col("k.mark").alias("k_mark")))
    k_id, k_mark, mark = fresh(docs, "keep_id", "keep_mark", "mark")
    keep = materialize(keep.select(F.col("k_id").alias(k_id), F.col("k_mark").alias(k_mark)).distinct(), "kept")
    marked = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)) & (F.col(mark) == F.col(k_mark))
    return marked.join(keep, on, "left_semi").dropDuplicates([id_col, mark]).drop(mark)
