"""Line dedup: near-equal lines by MinHash, verified, one line per component.

Lines are sets of character shingles.  Each gets a signature of ``BINS``
minima (one hash per shingle, dealt to bins; empty bins borrow from others)
and one key per band of ``ROWS`` minima.  Lines that share a band key are
compared through pivots: every member with the group's most frequent line,
then, where a group still holds several components, members of different
components, in blocks of ``BLOCK`` lines that return a spanning forest and
never their pairs.  Jaccard similarity is exact, on the lines themselves.
So no pair of a group is skipped unless its lines are already connected, and
a crowd around one line costs a comparison per member.

Before two lines are compared, bits of their shingles' hashes bound their
similarity from above; only pairs that the bound lets through need the lines.

Of all places of a component's lines, the first stays: the smallest id
(null last), then the smallest line number.  Two passes read the documents:
one for band keys, packed by bucket of keys, one for the places of lines that
repeat or may have a partner and the text of the latter (bitmaps of fixed
size let through a few others).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACES, chunks, free_shuffles, fresh, materialize, prepare
from tallyframe.llm.components import connected_components

SHINGLE = 8
BINS, ROWS = 100, 4
BANDS = BINS // ROWS
SIMILAR = 0.8
RUN_CHARS = 1 << 20
BUCKET_BYTES = 16 << 20
BLOCK, COLUMNS, FEW = 256, 1 << 14, 24
#: Bits of each bitmap that picks lines whose places or text are needed (4 MB).
BITMAP = 1 << 25
#: Characters hashed at once, so that the arrays stay in a core's cache.
LOT_CHARS = 1 << 16
#: Bits of a line's sketch; pairs of a task bounded at once.
SKETCH, PAIRS = 4096, 1 << 12
#: Lines of a component from which on its row goes to SALTS places.
SALTS, CROWD = 64, 2000
_FULL = np.uint64(2**64 - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def shingles(line: str) -> set[str]:
    """Character shingles; a shorter line is one shingle."""
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def codes(line: str) -> np.ndarray | None:
    """Distinct shingles of a line as numbers, which eight Latin-1 characters
    are; none for other lines and shorter ones."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(raw) < SHINGLE or SHINGLE != 8:
        return None
    out = np.sort(np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,)))
    return out[np.append(True, out[1:] != out[:-1])]


def similar(x: tuple, y: tuple) -> bool:
    """Whether two lines, each given with its ``codes``, are near."""
    (s, a), (t, b) = x, y
    if a is None or b is None:
        return jaccard(shingles(s), shingles(t)) >= SIMILAR
    both = np.concatenate([a, b])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(a) + len(b) - n) >= SIMILAR


def _hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lines' numbers times ``width``, places without one) of all
    shingles."""
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lens)
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)) * width, lens)
    for k in (1, 2, 4):   # a place past the end counts as zero
        step = h * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64))
        step[:-k] += h[k:]
        h = step
    h = _mix(h)
    back = ends[:, None] - np.arange(1, SHINGLE)
    none = back[back >= (ends - lens)[:, None]]   # places with less than a shingle to the line's end
    short = np.flatnonzero(lens < SHINGLE)
    if len(short):
        own = np.array([xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in short], np.uint64)
        h, owner = np.append(h, _mix(own)), np.append(owner, short * width)
    return h, owner, none


def _minima(lines: list[str]) -> np.ndarray:
    """(lines, BINS) least hashes of each bin."""
    h, place, none = _hashes(lines, BINS)
    bin_of = h >> np.uint64(32)
    bin_of *= np.uint64(BINS)
    bin_of >>= np.uint64(32)
    place += bin_of.view(np.int64)
    h *= np.uint64(0xD1342543DE82EF95)
    h[none] = _FULL
    table = np.full(len(lines) * BINS, _FULL)
    np.minimum.at(table, place, h)
    return table.reshape(-1, BINS)


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys; equal shingle sets have equal keys."""
    if not lines:
        return np.zeros((0, BANDS), np.uint64)
    table = np.concatenate([_minima(x) for x in chunks(lines, LOT_CHARS, len)])
    filled = table.copy()
    turn, turns = 1, 1
    rows, cols = np.nonzero(table == _FULL)
    while len(rows):   # an empty bin borrows from bins in an order of its own
        ahead = np.arange(turn, turn + turns, dtype=np.uint64)
        pick = _mix(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + ahead) % np.uint64(BINS)
        got = table[rows[:, None], pick.astype(np.int64)[cols]]
        full = got != _FULL
        first = full.argmax(1)
        got, hit = got[np.arange(len(rows)), first], full.any(1)
        filled[rows[hit], cols[hit]] = got[hit]
        rows, cols = rows[~hit], cols[~hit]
        turn, turns = turn + turns, min(64, 2 * turns)
    keys = np.zeros((len(lines), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + filled[:, r::ROWS][:, :BANDS])
    return keys


def sketches(lines: list[str]) -> np.ndarray:
    """(lines, SKETCH / 64) words: a bit for each shingle's hash."""
    out = [np.zeros((0, SKETCH // 64), np.uint64)]
    for lot in chunks(lines, LOT_CHARS, len):
        h, slot, none = _hashes(lot, SKETCH)
        h &= np.uint64(SKETCH - 1)
        slot += h.view(np.int64)
        held = np.zeros(len(lot) * SKETCH, bool)
        held[np.delete(slot, none)] = True
        out.append(np.packbits(held).view(np.uint64).reshape(len(lot), -1))
    return np.concatenate(out)


def may_be_similar(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False only for pairs below SIMILAR: ``m`` and ``n`` are at least the
    numbers of shingles, ``a`` and ``b`` the sketches.  A bit that one sketch
    alone has stands for a shingle at least that the other line hasn't."""
    one = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    two = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    both = np.minimum(m - one, n - two)
    return both >= SIMILAR * (both + one + two) - 1e-6


def _lines(texts: list) -> tuple[list[int], list[int], list[str]]:
    """Row, line number and text of every line with a word."""
    rows, numbers, lines = [], [], []
    for r, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if line.strip(SPACES):
                rows.append(r)
                numbers.append(n)
                lines.append(line)
    return rows, numbers, lines


def _hash64(raw: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64)


def _groups(docs: DataFrame, buckets: int) -> DataFrame:
    """(g, k): lines (64-bit hash) that share a band key.  A group's name is
    made of its members, so lines that share many bands make one group.
    Lines that stand in several places come without a group as well."""
    def packed(batches):
        for b in batches:
            for texts in chunks(b.column(0).to_pylist(), RUN_CHARS, len):
                count = Counter(_lines(texts)[2])
                lines = list(count)
                if not lines:
                    continue
                keys = band_keys(lines)
                keys &= ~np.uint64(1)
                keys[:, 0] |= np.uint64(1)   # tells the first band from others
                k = _hash64([x.encode("utf-8", "surrogatepass") for x in lines])
                more = np.fromiter(count.values(), np.int64, len(lines)) > 1
                keys, k = np.append(keys.reshape(-1), keys[more, 0]), np.append(np.repeat(k, BANDS), k[more])
                at = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                both = np.stack([keys[order], k[order]], 1)
                ids, first = np.unique(at[order], return_index=True)
                blobs = [x.tobytes() for x in np.split(both, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in frame["blob"]])
        key = np.ascontiguousarray(both[:, 0])
        order = np.argsort(key)
        near = key[order][1:] == key[order][:-1]
        both = both[order[np.append(False, near) | np.append(near, False)]]   # most keys come once
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        same = (both[1:] == both[:-1]).all(1)
        again = np.unique(both[1:][same & (both[1:, 0] & np.uint64(1) == 1), 1])
        both = both[np.append(True, ~same)[:len(both)]]
        near = both[1:, 0] == both[:-1, 0]
        both = both[(np.append(False, near) | np.append(near, False))[:len(both)]]
        k = np.append(both[:, 1], again).view(np.int64)
        if not len(both):
            return pd.DataFrame({"g": pd.array([None] * len(k), "Int64"), "k": k})
        first = np.flatnonzero(np.append(True, both[1:, 0] != both[:-1, 0]))
        name = np.bitwise_xor.reduceat(_mix(both[:, 1] + np.uint64(0x9E3779B97F4A7C15)), first)
        size = np.diff(np.append(first, len(both)))
        g = np.repeat(_mix(name), size)
        # a group whose name came before in this bucket is left out
        new = np.zeros(len(first), bool)
        new[np.unique(name, return_index=True)[1]] = True
        keep = np.append(np.repeat(new, size), np.ones(len(again), bool))
        g = pd.array(np.append(g.view(np.int64), np.zeros(len(again), np.int64)), "Int64")
        g[len(both):] = pd.NA
        return pd.DataFrame({"g": g, "k": k})[keep]

    return (docs.select("text").mapInArrow(packed, "bucket long, blob binary")
            .groupBy("bucket").applyInPandas(shared, "g long, k long").distinct())


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys, gathered as at most BITMAP / 64 words."""
    slot = F.pmod(F.col("k"), F.lit(BITMAP).cast("long"))
    words = (keys.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toPandas()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _places(docs: DataFrame, near: np.ndarray, again: np.ndarray) -> DataFrame:
    """(key, k, id, mark, n, hit, line) of every line with a word whose bit
    is set in a bitmap; ``key`` is its 128-bit hash, ``hit`` says that it is
    set in the first, ``line`` is given once in a while for such lines."""
    shared = docs.sparkSession.sparkContext.broadcast((near, near | again))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at = 0
            for texts in chunks(b.column(2).to_pylist(), RUN_CHARS, len):
                rows, numbers, lines = _lines(texts)
                k = _hash64([x.encode("utf-8", "surrogatepass") for x in lines])
                slot = (k.view(np.int64) % BITMAP).astype(np.uint64)
                word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
                hit, take = ((m[word] >> bit & np.uint64(1)).astype(bool) for m in shared.value)
                first = np.zeros(len(k), bool)
                first[np.unique(k, return_index=True)[1]] = True
                take = np.flatnonzero(take)
                hit, keep, lines = hit[take], (hit & first)[take].tolist(), [lines[i] for i in take]
                doc = pa.array(np.asarray(rows, np.int64)[take] + at)
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines], pa.binary()),
                    pa.array(k[take].view(np.int64)), b.column(0).take(doc), b.column(1).take(doc),
                    pa.array(np.asarray(numbers, np.int32)[take]), pa.array(hit),
                    pa.array([x if y else None for x, y in zip(lines, keep)], pa.string())],
                    names=["key", "k", "id", "mark", "n", "hit", "line"])
                at += len(texts)

    return docs.select("id", "mark", "text").mapInArrow(
        run, f"key binary, k long, id {kind}, mark long, n int, hit boolean, line string")


def _sketched(lines: DataFrame) -> DataFrame:
    """(k, key, line) with the sketch and at least the number of shingles."""
    def run(batches):
        for b in batches:
            now = b.column(2).to_pylist()
            size = np.array([max(1, len(x) - SHINGLE + 1) for x in now], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(size), pa.array([x.tobytes() for x in sketches(now)], pa.binary())],
                names=["k", "key", "line", "size", "sketch"])

    return lines.select("k", "key", "line").mapInArrow(run, "k long, key binary, line string, size long, sketch binary")


def _words(column) -> np.ndarray:
    """Sketches of a batch as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of line hashes, as (a, b) of keys that are similar."""
    def bound(batches):
        for b in batches:
            sizes = (b.column(k).to_numpy() for k in (2, 3))
            mask = pa.array(may_be_similar(*sizes, _words(b.column(4)), _words(b.column(5))))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["key_a", "key_b"])

    def run(batches):
        last, have = None, None
        for b in batches:
            ka, kb, ta, tb = (c.to_pylist() for c in b.columns)
            good = []
            for i, a in enumerate(ka):
                if a != last:
                    last, have = a, (ta[i], codes(ta[i]))
                good.append(similar(have, (tb[i], codes(tb[i]))))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    def side(x: str, *names: str) -> DataFrame:
        return texts.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))

    rows = (pairs.join(side("b", "key", "size", "sketch"), "b").join(side("a", "key", "size", "sketch"), "a")
            .where("key_a <> key_b").select("key_a", "key_b", "size_a", "size_b", "sketch_a", "sketch_b"))
    rows = rows.mapInArrow(bound, "key_a binary, key_b binary")
    rows = (rows.join(side("b", "key", "line").drop("b"), "key_b").join(side("a", "key", "line").drop("a"), "key_a")
            .select("key_a", "key_b", "line_a", "line_b"))
    return rows.mapInArrow(run, "a binary, b binary")


def _shared(sets: list[set]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    number: dict[str, int] = {}
    rows = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(r) for r in rows])
    item = np.concatenate([np.asarray(r, np.int64) for r in rows])
    common = np.bincount(item) > 1
    place = np.cumsum(common) - 1
    owner, item = owner[common[item]], place[item[common[item]]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(common.sum()), COLUMNS):
        part = (item >= at) & (item < at + COLUMNS)
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[part], item[part] - at] = 1
        both += held @ held.T
    return both


def _untested(rows: DataFrame) -> DataFrame:
    """(g, key, root) of the groups that need a second look.  The pivot's
    own pairs are known, so it stays out (unless a line of the same 64 bits
    is with it); groups of one root need nothing; of several groups with the
    same members one will do."""
    heads = rows.groupBy("g").agg(F.sum((F.col("k") == F.col("p")).cast("int")).alias("heads"))
    rest = rows.join(heads, "g").where((F.col("k") != F.col("p")) | (F.col("heads") > 1)).select("g", "key", "root")
    mark = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    torn = rest.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *mark)
    one = torn.where("low <> high").groupBy("n", "m1", "m2").agg(F.min("g").alias("g")).select("g")
    return rest.join(one, "g")


def _linked(roots: list, x: np.ndarray, y: np.ndarray, line_of) -> list[tuple[bytes, bytes]]:
    """Roots that similar pairs among (x, y) connect: one block's forest."""
    up: dict = {}

    def top(r):
        while r in up:
            r = up[r]
        return r

    lines: dict[int, tuple] = {}
    near = None
    at = {i: n for n, i in enumerate(sorted({*x.tolist(), *y.tolist()}))}
    if len(x) > FEW * len(at):   # a matrix is quicker than sets
        have = [shingles(line_of(i)) for i in at]
        size = np.array([len(s) for s in have], np.float64)
        both = _shared(have)
        near = both / (size[:, None] + size - both) >= SIMILAR
    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        a, b = top(roots[i]), top(roots[j])
        if a == b:   # the two are one already
            continue
        if near is None:
            for k in (i, j):
                if k not in lines:
                    lines[k] = (line_of(k), codes(line_of(k)))
        if near[at[i], at[j]] if near is not None else similar(lines[i], lines[j]):
            up[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _forest(table: pa.Table) -> list[tuple[bytes, bytes]]:
    """Rows of whole blocks, side by side."""
    g, i, j = (table.column(c).to_numpy() for c in ("g", "i", "j"))
    new = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    block = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(g))[block]
    roots, line, size = table.column("root").to_pylist(), table.column("line"), table.column("size").to_numpy()
    sketch = _words(table.column("sketch"))
    name = np.unique(np.array(roots, "S16"), return_inverse=True)[1] if roots else np.zeros(0, np.int64)
    out, xs, ys = [], [], []
    after = end - np.arange(len(g)) - 1   # a row is paired with the later ones of its block
    edge = np.append(0, np.cumsum(after))
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + PAIRS, side="right")) - 1)
        x = np.repeat(np.arange(at, to), after[at:to])
        y = np.arange(len(x)) - np.repeat(edge[at:to] - edge[at], after[at:to]) + x + 1
        torn = name[x] != name[y]
        x, y = x[torn], y[torn]
        good = may_be_similar(size[x], size[y], sketch[x], sketch[y])
        xs.append(x[good])
        ys.append(y[good])
        at = to
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    first = np.flatnonzero(np.append(True, block[x][1:] != block[x][:-1])) if len(x) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(x))):
        out += _linked(roots, x[a:b], y[a:b], lambda n: line[n].as_py())
    return out


def _across(torn: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between roots of similar lines of different roots within
    groups: ``torn`` has (g, key, root)."""
    parts = torn.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    rows = (torn.join(parts, "g").join(texts.select("key", "line", "size", "sketch"), "key").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    "root", "line", "size", "sketch"))

    def run(batches):
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            if held is not None:
                now = pa.concat_tables([held, now])
            if not len(now):
                continue
            g, i, j = (now.column(c).to_numpy() for c in ("g", "i", "j"))
            whole = len(now) - int(np.argmax(((g != g[-1]) | (i != i[-1]) | (j != j[-1]))[::-1]))
            whole = whole if (g[0], i[0], j[0]) != (g[-1], i[-1], j[-1]) else 0
            held = now.slice(whole)
            if whole:
                yield _pairs(_forest(now.slice(0, whole).combine_chunks()))
        if held is not None:
            yield _pairs(_forest(held.combine_chunks()))

    return (rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
            .mapInArrow(run, "a binary, b binary"))


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["a", "b"])


def near_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``: (id, mark, text).  Returns the places of all lines with a
    word that repeat or have a similar other line (and of a few others), and
    (key, root) of the lines that have a similar other line."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialize(_groups(docs, max(16, -(-size // BUCKET_BYTES))), "band-groups")
    free_shuffles(spark)
    groups = found.where("g is not null")
    places = materialize(_places(docs, _bitmap(groups), _bitmap(found.where("g is null"))), "line-places")
    texts = (places.where("line is not null").groupBy("k", "key").agg(F.first("line").alias("line"))
             .join(groups.select("k").distinct(), "k", "left_semi"))
    texts = materialize(_sketched(texts), "line-texts")
    often = places.where("hit").groupBy("k").agg(F.count(F.lit(1)).alias("often"))
    ranked = groups.join(often, "k").select("g", "k", F.struct("often", "k").alias("rank"))
    pivots = materialize(ranked.groupBy("g").agg(F.max("rank").alias("p")).select("g", F.col("p.k").alias("p")), "pivots")
    pairs = groups.join(pivots, "g").where("k <> p").select(F.col("p").alias("a"), F.col("k").alias("b")).distinct()
    # members of a group that pivots left in several components
    roots = connected_components(materialize(_verified(pairs, texts), "similar-lines"))
    member = (texts.select("k", "key").join(roots, F.col("key") == F.col("node"), "left")
              .select("k", "key", F.coalesce("root", "key").alias("root")))
    member = materialize(member, "line-roots")
    torn = materialize(_untested(groups.join(pivots, "g").join(member, "k").select("g", "k", "p", "key", "root")), "torn-groups")
    more = materialize(_across(torn, texts), "similar-lines")
    roots = roots.select(F.col("node").alias("key"), "root")
    if not more.isEmpty():   # roots of several lines, and lines alone, become one
        over = materialize(connected_components(more), "joined-roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = member.select("key", "root").join(over, "root", "left").where("top is not null or key <> root").select(
            "key", F.coalesce("top", "root").alias("root")).unionAll(
            roots.where("key = root").join(over, "root", "left_anti").select("key", "root"))
    return places, roots


def drops(docs: DataFrame) -> DataFrame:
    """(id, mark, gone): numbers of the lines that go, for each document
    (rows alike in id and text are one document) that loses any."""
    places, roots = near_lines(docs)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "mark")
    firsts = places.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("often"))
    firsts = materialize(firsts.join(roots, "key", "left").where("often > 1 or root is not null"), "repeated-lines")
    best = (firsts.where("root is not null").groupBy("root")
            .agg(F.min("first").alias("best"), (F.count(F.lit(1)) > CROWD).alias("crowd")))
    best = materialize(best, "first-places")
    # a component may hold a third of all lines: its row goes to SALTS places
    crowds = F.broadcast(best.where("crowd").select("root", "crowd"))   # at most a row for each CROWD lines
    copies = F.sequence(F.lit(0), F.when(F.col("crowd"), SALTS - 1).otherwise(0))
    best = best.withColumn("salt", F.explode(copies.cast("array<bigint>"))).drop("crowd")
    own = F.xxhash64("key")
    salt = F.when(F.col("root").isNull(), own).when(F.col("crowd"), F.pmod(own, F.lit(SALTS))).otherwise(0).cast("long")
    firsts = firsts.join(crowds, "root", "left").withColumn("salt", salt)
    stay = firsts.join(best, ["root", "salt"], "left").select("key", F.coalesce("best", "first").alias("stay"))
    gone = places.join(stay, "key").where(place != F.col("stay")).select("id", "mark", "n")
    return materialize(gone.groupBy("id", "mark").agg(F.collect_set("n").alias("gone")), "dropped-lines")


def _without(text: Column, gone: Column) -> Column:
    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.element_at(F.transform(F.array(F.split(text, "\n")), rest), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with repeated and near-equal lines gone from ``text_col``
    and one struct column (its name is returned too): lines, lines gone.

    Lines end at \\n; lines without a word stay.  A null text stays null; an
    empty one, and one that loses all lines, is empty.  Rows alike in id and
    text are one document and come out alike; rows of one id with different
    texts are different documents, ordered by a hash of the text; an empty
    table gives an empty one; other columns are unchanged."""
    prepare(docs.sparkSession)
    t = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("mark"), F.coalesce(t, F.lit("")).alias("text"))
    found = drops(src)
    free_shuffles(docs.sparkSession)
    name, d_id, d_mark, d_gone, mark = fresh(docs, "lines", "drop_id", "drop_mark", "drop_gone", "mark")
    found = found.select(F.col("id").alias(d_id), F.col("mark").alias(d_mark), F.col("gone").alias(d_gone))
    out = docs.withColumn(mark, F.xxhash64(t))
    out = out.join(found.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col(d_id)) & (F.col(mark) == F.col(d_mark)), "left")
    ends = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    n = F.when(t.isNull(), 0).otherwise(ends + 1).cast("long")
    lost = F.coalesce(F.size(d_gone), F.lit(0)).cast("long")
    out = out.withColumn(name, F.struct(n.alias("n_lines"), lost.alias("n_gone")))
    out = out.withColumn(text_col, F.when(F.col(d_gone).isNotNull(), _without(t, F.col(d_gone))).otherwise(t))
    return out.drop(d_id, d_mark, d_gone, mark), name
