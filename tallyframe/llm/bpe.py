"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold ``rank << bits | position`` of each symbol
with its right neighbour, inner nodes the smaller child.  The root so is the
leftmost pair of the lowest rank.  A merge changes three leaves (the pair's
own, the dead one, the left neighbour's) and their paths to the root; it
ends when the root holds no pair.  Short words run through the same steps
side by side in arrays, long ones one at a time.

Spark deals out documents; a task cuts whole texts into pre-tokens, encodes
those that its bounded cache doesn't know and joins the ids.  Vocabulary
tables are broadcast: their size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import chunks, prepare

NONE = np.int64(2**62)
#: Words of more symbols are merged one at a time.
WIDE = 128
RUN_CHARS = 1 << 20
CACHE_WORDS = 200_000
CACHED_LENGTH = 64
#: Fixed pattern: pre-tokens of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


class Pairs:
    """Mergeable pairs: (left, right) -> (rank, merged), in sorted arrays."""

    def __init__(self, left, right, rank, merged, symbols: int):
        key = np.asarray(left, np.int64) * symbols + np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.symbols = symbols
        self.key = np.append(key[order], NONE)
        self.rank = np.append(np.asarray(rank, np.int64)[order], 0)
        self.merged = np.append(np.asarray(merged, np.int32)[order], 0)

    def find(self, left, right):
        """(rank or NONE, merged) of pairs; a negative symbol has no pair."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.key, key)
        hit = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def find_one(self, left: int, right: int):
        key = left * self.symbols + right
        at = int(np.searchsorted(self.key, key))
        return (int(self.rank[at]), int(self.merged[at])) if self.key[at] == key else None


def _leaf(rank, at, bits):
    return np.where(rank == NONE, NONE, rank << bits | at)


def merge_many(words: list[list[int]], pairs: Pairs, leaves: int) -> list[list[int]]:
    """Merge words of at most ``leaves`` symbols (a power of two) together."""
    n, bits = len(words), leaves.bit_length() - 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    inside = np.arange(leaves) < lengths[:, None]
    sym = np.full((n, leaves + 1), -1, np.int32)   # the last column is the end of every list
    sym[:, :leaves][inside] = np.fromiter(chain.from_iterable(words), np.int32)
    nxt = np.tile(np.minimum(np.arange(1, leaves + 2), leaves).astype(np.int32), (n, 1))
    nxt[:, :leaves][np.arange(leaves) >= lengths[:, None] - 1] = leaves
    prv = np.tile(np.arange(-1, leaves, dtype=np.int32), (n, 1))
    rank, made = pairs.find(sym[:, :-1], sym[:, 1:])
    made = made.copy()
    tree = np.full((n, 2 * leaves), NONE)
    tree[:, leaves:] = _leaf(rank, np.arange(leaves), bits)
    for level in range(bits - 1, -1, -1):
        a = 1 << level
        tree[:, a:2 * a] = np.minimum(tree[:, 2 * a:4 * a:2], tree[:, 2 * a + 1:4 * a:2])
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        at = (tree[rows, 1] & (leaves - 1)).astype(np.int64)
        gone = nxt[rows, at]
        after, before = nxt[rows, gone], prv[rows, at]
        sym[rows, at] = made[rows, at]
        sym[rows, gone] = -1
        nxt[rows, at] = after
        prv[rows, after] = at
        tree[rows, leaves + gone] = NONE
        rank, new = pairs.find(sym[rows, at], sym[rows, after])
        tree[rows, leaves + at], made[rows, at] = _leaf(rank, at, bits), new
        has = before >= 0
        r, b = rows[has], before[has].astype(np.int64)
        rank, new = pairs.find(sym[r, b], sym[r, at[has]])
        tree[r, leaves + b], made[r, b] = _leaf(rank, b, bits), new
        r, node = np.concatenate([rows, rows, r]), leaves + np.concatenate([at, gone, b])
        for _ in range(bits):
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] < NONE]
    alive = sym[:, :-1] >= 0
    flat, ends = sym[:, :-1][alive].tolist(), np.cumsum(alive.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_one(word: list[int], pairs: Pairs) -> list[int]:
    """The same steps for one long word."""
    n = len(word)
    bits = max(1, (n - 1).bit_length())
    leaves, none = 1 << bits, int(NONE)
    sym, nxt, prv = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
    rank, made = pairs.find(np.asarray(word[:-1], np.int64), np.asarray(word[1:], np.int64))
    made = made.tolist() + [0]
    tree = [none] * leaves + _leaf(rank, np.arange(n - 1), bits).tolist()
    tree += [none] * (2 * leaves - len(tree))
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    def pair_up(i: int) -> None:
        j = nxt[i]
        got = pairs.find_one(sym[i], sym[j]) if j < n and sym[i] >= 0 and sym[j] >= 0 else None
        if got:
            made[i] = got[1]
        put(i, got[0] << bits | i if got else none)

    while tree[1] < none:
        i = tree[1] & (leaves - 1)
        gone = nxt[i]
        sym[i], nxt[i] = made[i], nxt[gone]
        sym[gone] = None
        if nxt[i] < n:
            prv[nxt[i]] = i
        put(gone, none)
        pair_up(i)
        if prv[i] >= 0:
            pair_up(prv[i])
    return [s for s in sym if s is not None]


def merge_all(words: list[list[int]], pairs: Pairs) -> list[list[int]]:
    """Merged symbols of every word, in order."""
    out: list = [None] * len(words)
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) < 2:
            out[i] = list(w)
        elif len(w) > WIDE:
            out[i] = merge_one(w, pairs)
        else:
            classes.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
    for leaves, members in classes.items():
        step = max(1, (1 << 18) // leaves)
        for a in range(0, len(members), step):
            part = members[a:a + step]
            for i, ids in zip(part, merge_many([words[j] for j in part], pairs, leaves)):
                out[i] = ids
    return out


class ByteVocabulary:
    """Tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens are matched as they stand only")
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # visible bytes stand for themselves, the others for characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.byte_ids = [0] * 256
        for c, b in self.byte_of.items():
            self.byte_ids[b] = vocab[c]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        left, right = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges]
        self.pairs = Pairs(left, right, range(len(merges)), [vocab[a + b] for a, b in merges], size)
        self.bytes_of: list = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            plain = all(c in self.byte_of for c in token)
            self.bytes_of[i] = bytes(self.byte_of[c] for c in token) if plain else token.encode()
        self.name = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


_CACHES: dict[str, dict] = {}


class ByteEncoder:
    """Encodes texts with a vocabulary; remembers short pre-tokens."""

    def __init__(self, vocabulary: ByteVocabulary):
        self.v = vocabulary
        self.pre = regex.compile(PATTERN)
        marks = sorted(vocabulary.added, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.known = _CACHES.setdefault(vocabulary.name, {})

    def cut(self, text: str) -> list:
        """Pre-tokens; an added token stands as its number."""
        if not self.marks or not self.marks.search(text):
            return self.pre.findall(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.pre.findall(text[at:m.start()])
            out.append(self.v.added[m[0]])
            at = m.end()
        return out + self.pre.findall(text[at:])

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text: ids joined by commas, their number, decoded bytes."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        cut = [self.cut(t) for t in texts]
        new = [w for w in set().union(*cut) if w not in known]
        plain = [w for w in new if isinstance(w, str)]
        ids = merge_all([[self.v.byte_ids[b] for b in w.encode("utf-8", "surrogatepass")] for w in plain], self.v.pairs)
        bytes_of = self.v.bytes_of
        for w, found in [*zip(plain, ids), *((w, [w]) for w in new if not isinstance(w, str))]:
            known[w] = (",".join(map(str, found)), len(found), b"".join([bytes_of[i] for i in found]))
        out = []
        for ws in cut:
            if ws:
                text, n, raw = zip(*[known[w] for w in ws])
                out.append((",".join(text), sum(n), b"".join(raw)))
            else:
                out.append(("", 0, b""))
        for w in plain:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``, and
    the ids themselves (array<int>) if asked for.  A null text is empty: no
    ids, the hashes of empty strings.  Texts of any length are encoded
    whole; equal rows give equal rows; an empty table gives an empty one;
    other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(ByteVocabulary(path))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        encoder = ByteEncoder(vocabulary.value)
        for b in batches:
            at = 0
            for texts in chunks(b.column(1).to_pylist(), RUN_CHARS, len):
                rows = [(n, hashlib.sha256(ids.encode()).hexdigest(),
                         hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest(), ids)
                        for ids, n, raw in encoder.encode(texts)]
                columns = [b.column(0).slice(at, len(texts)), pa.array([r[0] for r in rows], pa.int64()),
                           pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                if with_ids:
                    columns.append(pa.array([[int(x) for x in r[3].split(",")] if r[3] else [] for r in rows],
                                            pa.list_(pa.int32())))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                          + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in a column ``text_col`` (added
    or replaced); null ids give a null text."""
    spark = encoded.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(ByteVocabulary(path))

    @F.pandas_udf("string")
    def text_of(ids):
        table = vocabulary.value.bytes_of
        return ids.map(lambda x: None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace"))

    return encoded.withColumn(text_col, text_of(F.col(f"`{ids_col}`")))
