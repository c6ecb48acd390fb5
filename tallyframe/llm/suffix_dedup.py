"""Suffix dedup: difference-cover samples, then one bucket of hashes at a time.

Bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere go.
The construction is blockwise.  A difference cover modulo v (a set D whose
differences give every number modulo v) fixes sample suffixes: for any two
equal strings of LENGTH bytes, one of their first v positions is a sample in
both.  So the samples' first LENGTH - v + 1 bytes are compared first; a
suffix without a tied sample in its first v bytes can't repeat, and only the
others are dealt to buckets.  No suffix is sorted and no sample ranked: the
hashes of a bucket are sorted in one task, and equal ones are ties; memory
is bounded by the bucket, and the number of buckets grows with the input.

Strings are compared by 64-bit rolling hashes within buckets that a second,
independent rolling hash chooses; the bytes themselves aren't compared.  What repeats inside one run of documents
is settled there and leaves one mark, so a passage that stands in a third of
all documents reaches a bucket once for each run, not once for each place.
Documents with equal texts are one document from the second phase on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, free_shuffles, materialize, prepare

LENGTH = 400
PRIME = 13
#: A run of documents ends at so many bytes or starts (about 80 bytes each).
RUN_BYTES, RUN_STARTS = 16 << 20, 1_000_000
SEGMENT = 1 << 20
#: Bytes of text for each bucket of samples, and of full suffixes.
SAMPLE_BUCKET, SUFFIX_BUCKET = 40 << 20, 2 << 20


def difference_cover(p: int = PRIME) -> tuple[int, list[int]]:
    """(v, D) with v = p*p + p + 1 and p + 1 elements in D: the zeros of a
    linear recurrence of order three over a prime field with full period."""
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                state, zeros = (0, 0, 1), []
                for k in range(p ** 3 - 1):
                    if state[0] == 0:
                        zeros.append(k)
                    state = (state[1], state[2], (a * state[2] + b * state[1] + c * state[0]) % p)
                    if state == (0, 0, 1):
                        break
                if k == p ** 3 - 2:
                    v = p * p + p + 1
                    return v, sorted({z % v for z in zeros})
    raise ValueError("the recurrence needs a prime")


class Rolling:
    """64-bit hashes of all windows of a byte string, by prefix sums."""

    def __init__(self, seed: int, room: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2**62)) * 4 + 3
        power = lambda b: np.multiply.accumulate(
            np.concatenate([np.ones(1, np.uint64), np.full(room, b, np.uint64)]))
        self.up, self.down = power(base), power(pow(base, -1, 2**64))

    def at(self, raw: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[:len(raw)], out=sums[1:])
        h = (sums[starts + width] - sums[starts]) * self.down[starts]
        return h ^ (h >> np.uint64(32))


def pack(numbers: np.ndarray) -> bytes:
    """Rising numbers as bytes of their steps (255: add 255 and go on)."""
    step = np.diff(numbers, prepend=0)
    size = step // 255 + 1
    out = np.full(int(size.sum()), 255, np.uint8)
    out[np.cumsum(size) - 1] = step % 255
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def _segments(batches, starts_of) -> Iterator[tuple]:
    """(k1, k2, offset, bytes, starts, width) with at most SEGMENT starts."""
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
        extra = b.column("at") if "at" in b.schema.names else None
        for r in range(b.num_rows):
            raw = np.frombuffer(b.column("raw")[r].as_buffer(), np.uint8)
            starts, width = starts_of(len(raw), extra[r].as_py() if extra is not None else None)
            if not len(starts):
                continue
            for a in range(0, int(starts[-1]) + 1, SEGMENT):
                part = starts[np.searchsorted(starts, a):np.searchsorted(starts, a + SEGMENT)]
                if len(part):
                    yield k1[r], k2[r], a, raw[a:a + SEGMENT + width], part - a, width


def _runs(segments) -> Iterator[list]:
    run, size, starts = [], 0, 0
    for s in segments:
        if run and (size + len(s[3]) > RUN_BYTES or starts + len(s[4]) > RUN_STARTS):
            yield run
            run, size, starts = [], 0, 0
        run.append(s)
        size += len(s[3])
        starts += len(s[4])
    if run:
        yield run


_DEALT = "bucket long, run long, h binary, twice binary, docs binary, p binary"


def _dealt(batches, starts_of, buckets: int):
    """Hashed starts of runs of documents, packed by bucket; starts that
    repeat inside a run come back at once, as a row without hashes."""
    first, second = Rolling(11, SEGMENT + LENGTH), Rolling(12, SEGMENT + LENGTH)
    mark = TaskContext.get().partitionId() << 32
    for run in _runs(_segments(batches, starts_of)):
        mark += 1
        h = np.concatenate([first.at(raw, s, w) for _, _, _, raw, s, w in run])
        g = np.concatenate([second.at(raw, s, w) for _, _, _, raw, s, w in run])
        bounds = np.cumsum([0] + [len(s) for *_, s, _ in run])
        begin = np.cumsum([0] + [len(raw) for _, _, _, raw, _, _ in run])[:-1]   # below 2**32, as offsets are
        place = np.concatenate([s + b for (*_, s, _), b in zip(run, begin)])
        owner = np.repeat(np.arange(len(run), dtype=np.int32), np.diff(bounds))
        keys = np.array([(k1, k2, off) for k1, k2, off, *_ in run], np.int64)
        order = np.argsort(h, kind="stable")
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        multi = np.zeros(len(h), bool)
        multi[order] = np.append(same, False) | np.append(False, same)
        lead = np.zeros(len(h), bool)
        lead[order] = np.append(False, ~same) | (np.arange(len(h)) == 0)
        lead &= multi
        bucket = (g % np.uint64(buckets)).astype(np.int64)
        rows = []
        for kind, pick in (("one", ~multi), ("two", lead)):
            idx = np.flatnonzero(pick)
            idx = idx[np.argsort(bucket[idx], kind="stable")]
            names, edge = np.unique(bucket[idx], return_index=True)
            for name, part in zip(names.tolist(), np.split(idx, edge[1:])):
                if kind == "two":
                    rows.append((name, mark, b"", h[part].tobytes(), b"", b""))
                else:
                    here = np.unique(owner[part])
                    docs = np.stack([keys[here, 0], keys[here, 1], keys[here, 2] << 32 | begin[here]], 1)
                    rows.append((name, mark, h[part].tobytes(), b"", docs.tobytes(), pack(place[part])))
        if multi.any():
            idx = np.flatnonzero(multi)
            here = np.unique(owner[idx])
            docs = np.stack([keys[here, 0], keys[here, 1], keys[here, 2] << 32 | begin[here]], 1)
            low = np.minimum.reduceat(h[idx], np.searchsorted(owner[idx], here))   # a mark of each document's ties
            rows.append((mark % buckets, mark, b"", low.tobytes(), docs.tobytes(), pack(place[idx])))
        if rows:
            kinds = [pa.int64()] * 2 + [pa.binary()] * 4
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a:a + 4096]), kinds)],
                                                 names=["bucket", "run", "h", "twice", "docs", "p"])


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: sorted, the ties of each run returned in one row, with
    the documents they stand in (k1, k2, offset, begin) and a mark of each."""
    own = (frame["h"].str.len() == 0) & (frame["docs"].str.len() > 0)
    out = list(frame.loc[own, ["run", "docs", "twice", "p"]].itertuples(index=False, name=None))
    blobs = frame[frame["h"].str.len() > 0]
    if len(blobs):
        parts = [np.frombuffer(x, np.uint64) for x in blobs["h"]]
        h = np.concatenate(parts)
        order = np.argsort(h)
        ranked = h[order]
        tie = np.zeros(len(h), bool)
        near = ranked[1:] == ranked[:-1]
        tie[order] = np.append(near, False) | np.append(False, near)
        twice = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x, o in zip(frame["twice"], own) if not o]))
        if len(twice):
            tie |= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        edge = np.cumsum([0] + [len(x) for x in parts])
        for a, b, run, docs, p in zip(edge[:-1], edge[1:], blobs["run"], blobs["docs"], blobs["p"]):
            hit = np.flatnonzero(tie[a:b])
            if not len(hit):
                continue
            docs = np.frombuffer(docs, np.int64).reshape(-1, 3)   # keys; offset and begin, 32 bits each
            place = unpack(p)[hit]
            owner = np.searchsorted(docs[:, 2] & 0xFFFFFFFF, place, side="right") - 1
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(h[a:b][hit], first)
            out.append((run, docs[owner[first]].tobytes(), low.tobytes(), pack(place)))
    return pd.DataFrame(out, columns=["run", "docs", "low", "p"])


def _by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """The ties of one run from all buckets, by document: at most a run's
    starts."""
    place = np.concatenate([unpack(x) for x in frame["p"]])
    docs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in frame["docs"]])
    low = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["low"]])
    begin = docs[:, 2] & 0xFFFFFFFF
    order = np.lexsort((low, begin))
    order = order[np.append(True, begin[order][1:] != begin[order][:-1])]   # a document's least mark
    docs, low, begin = docs[order], low[order], begin[order]
    place = np.sort(place)
    edge = np.append(np.searchsorted(place, begin), len(place))
    rows = [(k1, k2, both >> 32, mark, pack(place[a:z] - b)) for (k1, k2, both), mark, b, a, z in zip(
        docs.tolist(), low.view(np.int64).tolist(), begin.tolist(), edge[:-1].tolist(), edge[1:].tolist())]
    return pd.DataFrame(rows, columns=["k1", "k2", "off", "low", "p"])


def _tied(rows: DataFrame, starts_of, buckets: int) -> DataFrame:
    """(k1, k2, at, low): per document, the packed starts that repeat."""
    dealt = rows.mapInArrow(lambda it: _dealt(it, starts_of, buckets), _DEALT)
    ties = dealt.groupBy("bucket").applyInPandas(_settled, "run long, docs binary, low binary, p binary")
    ties = ties.groupBy("run").applyInPandas(_by_document, "k1 long, k2 long, off long, low long, p binary")
    return ties.groupBy("k1", "k2").agg(F.collect_list(F.struct("off", "p")).alias("at"), F.min("low").alias("low"))


def _numbers(at) -> np.ndarray:
    return np.unique(np.concatenate([unpack(x["p"]) + x["off"] for x in at]))


def spans(starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` at rising starts."""
    new = np.append(True, starts[1:] > starts[:-1] + length)
    last = np.append(new[1:], True)
    return starts[new], starts[last] + length


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (arrays of
    starts and ends of the maximal removed runs, in bytes) and kept_sha256.

    A null text is empty; a text below ``length`` bytes keeps all; a text
    that another row equals is removed whole (from ``length`` bytes on), as
    are repeated rows; an empty table gives an empty one; other columns are
    not read.  A kept text may end inside a character: it is bytes."""
    spark = docs.sparkSession
    prepare(spark)
    v, cover = difference_cover()
    sample = length - v + 1
    if sample < 32:
        raise ValueError("strings are too short for the difference cover")
    mask = np.zeros(v, bool)
    mask[cover] = True

    def samples(n: int, _):
        top = n - sample + 1 if n >= length else 0
        return np.flatnonzero(np.resize(mask, max(top, 0))), sample

    def full(n: int, at):
        live = _numbers(at)
        change = np.zeros(n + v + 1, np.int32)
        np.add.at(change, np.maximum(live - v + 1, 0), 1)
        np.add.at(change, live + 1, -1)
        return np.flatnonzero(np.cumsum(change[:n - length + 1])), length

    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), raw.alias("raw"))
    src = src.select("id", F.xxhash64("id").alias("k1"), F.xxhash64("raw").alias("k2"), "raw")
    known = materialize(src.select("id", "k1", "k2", F.octet_length("raw").cast("long").alias("n"),
                                   F.sha2("raw", 256).alias("sha")), "texts")
    size = known.agg(F.sum("n")).first()[0] or 0
    copied = materialize(known.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("k1", "k2")).alias("rep"))
                         .where("rows > 1"), "copied-texts")
    samples_found = materialize(_tied(src.select("k1", "k2", "raw"), samples, max(12, -(-size // SAMPLE_BUCKET))), "tied-samples")
    free_shuffles(spark)
    others = (known.join(copied, "sha").where((F.col("k1") != F.col("rep.k1")) | (F.col("k2") != F.col("rep.k2")))
              .select("k1", "k2").distinct())
    live = samples_found.join(others, ["k1", "k2"], "left_anti")
    # texts with a tied sample, those that share one side by side
    whole = src.select("k1", "k2", "raw").join(live, ["k1", "k2"]).hint("rebalance", "low")
    whole = materialize(whole.sortWithinPartitions("low").select("k1", "k2", "raw", "at"), "tied-texts", "zstd")
    discard(samples_found)
    free_shuffles(spark)
    left = whole.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    found = materialize(_tied(whole, full, max(12, -(-left // SUFFIX_BUCKET))).select("k1", "k2", F.col("at").alias("hit")),
                        "tied-suffixes")
    free_shuffles(spark)

    def cut(batches):
        for b in batches:
            rows = []
            for x, at in zip(b.column("raw"), b.column("hit").to_pylist()):
                raw = np.frombuffer(x.as_buffer(), np.uint8)
                starts, ends = spans(_numbers(at), length)
                change = np.zeros(len(raw) + 1, np.int32)
                change[starts] += 1
                np.add.at(change, ends, -1)
                kept = raw[np.cumsum(change[:-1]) == 0]
                rows.append((starts.tolist(), ends.tolist(), hashlib.sha256(kept.tobytes()).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), pa.array(cols[0], pa.list_(pa.int64())),
                 pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.string())],
                names=["k1", "k2", "starts", "ends", "kept"])

    result = (whole.select("k1", "k2", "raw").join(found, ["k1", "k2"])
              .mapInArrow(cut, "k1 long, k2 long, starts array<long>, ends array<long>, kept string"))
    result = materialize(result, "removed").dropDuplicates(["k1", "k2"])
    discard(whole, found)
    free_shuffles(spark)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = known.join(copied.select("sha", "rows"), "sha", "left").join(result, ["k1", "k2"], "left")
    gone = F.col("rows").isNotNull() & (F.col("n") >= length)
    zero = F.array(F.lit(0).cast("long"))
    none = F.slice(zero, 1, 0)
    starts = F.when(gone, zero).otherwise(F.coalesce("starts", none))
    ends = F.when(gone, F.array("n")).otherwise(F.coalesce("ends", none))
    kept = F.when(gone, empty).otherwise(F.coalesce("kept", "sha"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), starts.alias("starts"), ends.alias("ends"),
                      F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("long"),
                                  lambda a, x: a + x).alias("n_removed"), kept.alias("kept_sha256"))
