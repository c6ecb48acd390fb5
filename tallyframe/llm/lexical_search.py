"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

One pass over the texts writes postings, by document: its length and, for
terms that some item asks for, their counts.  The corpus counts (documents,
all terms, documents with a term) are aggregates of that table.  A second
pass goes over runs of documents, each an inverted index of its own.  An
item's terms are taken rarest first; a document gets an accumulator when a
term first meets it, until the terms left can't lift a new document to the
k-th best score known so far.  From then on only documents with an
accumulator are updated, to the end, so their scores are exact.  The k-th
score of earlier runs of the task counts too.

Items go through in blocks of at most ``ITEM_BYTES`` of text, whose terms
are broadcast; nothing is shuffled but the best k of each task.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.llm.common import discard, materialize, prepare, ranked

#: Bytes of terms: digits, letters lower-cased, anything beyond ASCII.
TERM, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SCALE, PERCENT = 1_000_000_000, 75
#: Text of items whose terms are broadcast at a time.
ITEM_BYTES = 4 << 20
#: Long texts are read in pieces, runs end at so many documents or postings.
PIECE, RUN_DOCS, RUN_POSTINGS = 1 << 20, 1 << 15, 1 << 22


def pieces(raw: bytes) -> Iterator[bytes]:
    """A UTF-8 text in pieces of about PIECE bytes that cut no term."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        stop = BREAK.search(raw, end) if end < len(raw) else None
        end = stop.start() if stop else len(raw)
        yield raw[at:end]
        at = end


def term_counts(raw: bytes) -> Counter:
    """Terms of a UTF-8 text, lower-cased in A to Z only."""
    found: Counter = Counter()
    for part in pieces(raw):
        found.update(TERM.findall(part.lower()))
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, known) -> DataFrame:
    """(id, n, at, tf): number of terms, numbers and counts of asked terms."""
    def run(batches):
        number = known.value
        for b in batches:
            n, at, tf = [], [], []
            for x in b.column(1):
                found = term_counts(x.as_buffer().to_pybytes()) if x.is_valid else Counter()
                n.append(found.total())
                here = sorted((number[t], c) for t, c in found.items() if t in number)
                at.append([a for a, _ in here])
                tf.append([c for _, c in here])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                names=["id", "n", "at", "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, at array<int>, tf array<long>")


def _runs(batches) -> Iterator[pa.Table]:
    held, docs, posts = [], 0, 0
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            part = b.slice(a, 1024)
            held.append(part)
            docs += part.num_rows
            posts += len(part.column(2).flatten())
            if docs >= RUN_DOCS or posts >= RUN_POSTINGS:
                yield pa.Table.from_batches(held)
                held, docs, posts = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


class _Index:
    """Postings of a run by term: documents (rising) and impacts."""

    def __init__(self, run: pa.Table, n_docs: int, length: int):
        run = run.combine_chunks()
        at, tf = run["at"].combine_chunks(), run["tf"].combine_chunks()
        size = np.diff(at.offsets.to_numpy())
        term, tf = at.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        m = [100 - PERCENT + PERCENT * n * n_docs // length for n in run["n"].to_pylist()]   # exact at any size
        doc = np.repeat(np.arange(run.num_rows, dtype=np.int64), size)
        below = 1000 * tf + 8 * np.array(m, np.int64)[doc] if len(m) else tf
        order = np.argsort(term, kind="stable")
        self.ids, self.size = run["id"].to_pylist(), run.num_rows
        self.doc, self.impact = doc[order], (SCALE * tf // np.maximum(below, 1))[order]
        terms, first = np.unique(term[order], return_index=True)
        edge = np.append(first, len(order))
        most = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.slices = {t: (a, b, top) for t, a, b, top in zip(terms.tolist(), edge[:-1].tolist(), edge[1:].tolist(), most.tolist())}


def search_run(index: _Index, terms: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a run that may be among the best k, with exact scores.
    ``terms``: (number, weight times repeats), rarest first; ``floor``: a
    k-th score already reached elsewhere, 0 if none."""
    here = [(index.slices[t], w) for t, w in terms if t in index.slices and w > 0]
    left = np.cumsum([0] + [w * top for (_, _, top), w in reversed(here)])[::-1]   # bounds of the terms left
    score = np.zeros(index.size, np.int64)
    has = np.zeros(index.size, bool)
    open_, live = True, 0
    for turn, ((a, b, _), w) in enumerate(here):
        doc, gain = index.doc[a:b], index.impact[a:b] * w
        if open_:
            bar = floor
            if live >= k and left[turn] < int(score.max()):
                held = score[has]
                bar = max(bar, int(np.partition(held, len(held) - k)[len(held) - k]))
            open_ = left[turn] >= bar   # an equal score may win by its id
        if open_:
            has[doc] = True
            live = int(np.count_nonzero(has))
        else:
            keep = has[doc]
            doc, gain = doc[keep], gain[keep]
        score[doc] += gain
    found = np.flatnonzero(has & (score > 0))
    values = score[found]
    if len(found) > k:
        bar = np.partition(values, len(values) - k)[len(values) - k]
        found, values = found[values >= bar], values[values >= bar]
    return found, values


def _order(x) -> tuple:
    return -x[0], x[1] is None, x[1]


def _best(postings: DataFrame, items, corpus: tuple[int, int], k: int) -> DataFrame:
    n_docs, length = corpus
    kind = postings.schema["id"].dataType.simpleString()

    def run(batches):
        best: list[list] = [[] for _ in items.value]
        for part in _runs(batches):
            index = _Index(part, n_docs, length)
            for item, terms in enumerate(items.value):
                have = best[item]
                found, values = search_run(index, terms, k, have[-1][0] if len(have) == k else 0)
                if len(found):
                    new = ((v, index.ids[d]) for d, v in zip(found.tolist(), values.tolist()))
                    best[item] = heapq.nsmallest(k, [*have, *new], key=_order)
        rows = [(item, *x) for item, have in enumerate(best) for x in have]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], ids_type),
             pa.array([r[1] for r in rows], pa.int64())], names=["item", "id", "score"])

    ids_type = to_arrow_type(postings.schema["id"].dataType)
    return postings.mapInArrow(run, f"item int, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the best k documents of every item, scores
    above 0, equal ones by rising id (null last).

    Every row of ``docs`` is a document, repeated rows too; a null or empty
    text has no terms and is never found; texts of any length are read
    whole.  Distinct rows of ``items`` are searched for; one without terms
    of the corpus, and any item on an empty table, finds nothing.  Only the
    id and text columns are read."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text")).distinct()
    volume = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-volume // ITEM_BYTES)
    out = None
    for block in range(blocks):   # a block's terms fit the broadcast, however many items there are
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        wanted = [term_counts(r.text.encode("utf-8", "surrogatepass")) for r in part]
        number = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        postings = materialize(_postings(src, spark.sparkContext.broadcast(number)), "postings")
        stats = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        n_docs, length = stats[0], stats[1] or 0
        df = {r.t: r.df for r in postings.select(F.explode("at").alias("t")).groupBy("t")
              .agg(F.count(F.lit(1)).alias("df")).collect()}   # asked terms only
        plans = []
        for counts in wanted:
            here = sorted((df[number[t]], number[t], c) for t, c in counts.items() if number[t] in df)
            plans.append([(t, weight(n_docs, d) * c) for d, t, c in here])
        best = materialize(_best(postings, spark.sparkContext.broadcast(plans), (n_docs, max(length, 1)), k), "best-of-tasks")
        discard(postings)
        top = ranked(best, ["item"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k, "id")
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)],
                                      f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        top = top.join(names, "item").select("item_id", "rank", "id", "score")
        out = top if out is None else out.unionAll(top)
    if out is None:
        out = asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(src.schema["id"].dataType).alias("id"),
                           F.lit(0).cast("long").alias("score")).limit(0)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
