"""Token counts of a piece BPE vocabulary by the whole-token shortcut.

Two facts are proved from the vocabulary before any text is read.  No piece
holds a word mark after another character, so no merge crosses the start of
a marked run and a text may be cut there (likewise at a character that no
longer piece holds).  And each vocabulary string that merges into itself
when encoded alone counts as one token wherever it is a whole pre-token.
Pre-tokens found in that table are counted directly; only the rest are
merged, on a segment tree of pair ranks, once per task and bounded cache.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.bpe import CACHE_WORDS, CACHED_LENGTH, RUN_CHARS, Pairs, merge_all
from tallyframe.llm.common import chunks, prepare

#: Fixed character that stands for a space in the vocabulary.
MARK = "▁"


class PieceVocabulary:
    """Tables of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as schema
        proto = schema.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or not norm.add_dummy_prefix or not train.byte_fallback or train.model_type != train.BPE
                or train.treat_whitespace_as_suffix):
            raise ValueError("not a plain BPE model with byte fallback")
        kind = schema.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined or unused pieces aren't handled")
        pieces = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after another character")
        # symbols: pieces, then characters that occur in pieces only, then
        # one for unknown characters of each UTF-8 length
        self.ids = {p: i for i, p in enumerate(pieces)}
        cost = [1] * len(pieces)
        for c in sorted({c for p in pieces for c in p} - pieces.keys()):
            self.ids[c] = len(cost)
            cost.append(len(c.encode()))
        self.unknown = len(cost) - 1
        self.cost = cost + [1, 2, 3, 4]
        levels = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        found = [(self.ids[p[:k]], self.ids[p[k:]], levels[s], self.ids[p]) for p, s in pieces.items()
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.pairs = Pairs(*zip(*found), len(self.cost))
        held = {c for p in pieces if len(p) > 1 for c in p}
        self.cuts = "".join(c for c in "\n\t\r" if c not in held)
        alone = merge_all([self.symbols(p) for p in pieces], self.pairs)
        self.whole = frozenset(p for p, got in zip(pieces, alone) if len(got) == 1)
        self.name = f"{spm.__version__}:{hash(tuple(sorted(pieces.items())))}"

    def symbols(self, word: str) -> list[int]:
        ids, unknown = self.ids, self.unknown
        return [ids[c] if c in ids else unknown + len(c.encode("utf-8", "surrogatepass")) for c in word]


_KNOWN: dict[str, dict[str, int]] = {}


class PieceCounter:
    """Counts tokens of texts; remembers short merged pre-tokens."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.v = vocabulary
        cuts = re.escape(vocabulary.cuts)
        self.cut = re.compile(f"{MARK}*[^{MARK}{cuts}]+|{MARK}+" + (f"|[{cuts}]" if cuts else "")).findall
        self.known = _KNOWN.setdefault(vocabulary.name, dict.fromkeys(vocabulary.whole, 1))

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known.update(dict.fromkeys(self.v.whole, 1))
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        rest = [w for w in set().union(*cut) if w not in known]
        cost = self.v.cost
        for w, ids in zip(rest, merge_all([self.v.symbols(w) for w in rest], self.v.pairs)):
            known[w] = sum([cost[i] for i in ids])
        out = [sum(map(known.__getitem__, ws)) for ws in cut]
        for w in rest:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) per row of ``docs``.  A null text is empty and has no
    tokens; whole texts of any length are counted; equal rows give equal
    rows; an empty table gives an empty one; other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(PieceVocabulary(path))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        counter = PieceCounter(vocabulary.value)
        for b in batches:
            counts = [n for texts in chunks(b.column(1).to_pylist(), RUN_CHARS, len) for n in counter.count(texts)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
