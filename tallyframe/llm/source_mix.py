"""Mixing sources to target weights: min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to.  Such a
pattern offers its words up to ``REPEATS`` times, at a cost that rises with
each repetition; every source asks for its target.  Cheapest flows from
patterns to sources say how often each pattern's words are taken.  Sources
that share no document (directly or through others) don't interact, so each
connected part is solved by itself, over its patterns, never documents.
Within a pattern, documents are then taken whole in seeded order up to the
words that its flow asks for.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE_CLASS, fresh, let, materialize, prepare
from tallyframe.llm.components import connected_components

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = "mix-1"
#: Seeded order is cut by the leading hex digits of a hash, twice, before
#: documents themselves are ordered.
DIGITS = 3


def number_of_words(text: Column) -> Column:
    """Words of a text, by its pieces between white space: the first and
    last piece are empty where the text begins or ends with it."""
    def counted(pieces: Column) -> Column:
        n = F.size(pieces)
        edge = lambda i: F.when(F.get(pieces, i) == "", 1).otherwise(0)
        return F.when(n == 1, 1 - edge(F.lit(0))).otherwise(n - edge(F.lit(0)) - edge(n - 1)).cast("long")
    return let(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), counted)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without a single task: sorted
    by ranges, counted by range, offset by the ranges before (one number
    for each range goes through the driver)."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).agg(F.max("__at")).collect())
    offset, base = {}, 0
    for p, last in sizes:
        offset[p] = base
        base += (last & ((1 << 33) - 1)) + 1
    if not offset:
        return ranged.drop("__at").withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x).cast("long") for kv in offset.items() for x in kv])
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, F.element_at(starts, part.cast("long")) + row).drop("__at")


def targets(sources: DataFrame, total: int, weights=WEIGHTS, most: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with weight and target: shares of
    ``total`` by weight in code point order (null last), no target above
    ``most`` times its source, the excess reshared by weight."""
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked, "ranked")
    level, cap, ask = -1.0, F.col("source_size") * float(most), F.col("weight")
    while True:   # the level rises until no further source meets its bound
        held = cap < ask * F.lit(level)
        kept, open_weight = ranked.agg(F.coalesce(F.sum(F.when(held, F.col("source_size") * most)), F.lit(0)),
                                       F.sum(F.when(~held, ask))).first()
        if not open_weight:
            break
        new = (total - kept) / open_weight
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, ask * F.lit(float(level))))


def cheapest_flow(supply: list[int], ask: list[int], arcs: list[list[int]], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: as many as fit, at the
    least sum of repetition costs (the r-th copy of a word costs r - 1).
    Successive cheapest paths; every path fills a supply or a quota."""
    n, m = len(supply), len(ask)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(u: int, v: int, size: int, cost: int) -> int:
        graph[u].append(len(to))
        graph[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((size, 0))
        price.extend((cost, -cost))
        return len(to) - 2

    for i, s in enumerate(supply):
        for r in range(repeats):
            arc(start, i, s, r)
    flows = {(i, j): arc(i, n + j, repeats * supply[i], 0) for i, js in enumerate(arcs) for j in js}
    for j, a in enumerate(ask):
        arc(n + j, end, a, 0)
    height = [0] * len(graph)
    while True:
        far, via = [math.inf] * len(graph), [-1] * len(graph)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                v = to[e]
                if room[e] and (c := d + price[e] + height[u] - height[v]) < far[v]:
                    far[v], via[v] = c, e
                    heapq.heappush(heap, (c, v))
        if far[end] == math.inf:
            break
        height = [h + f if f < math.inf else h for h, f in zip(height, far)]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [{j: room[flows[i, j] ^ 1] for j in js} for i, js in enumerate(arcs)]


def _flows(frame: pd.DataFrame, repeats: int) -> pd.DataFrame:
    """Flows of one connected part: rows of (pattern, supply, source, ask)."""
    patterns = frame.drop_duplicates("pattern").sort_values("pattern")
    sources = frame.drop_duplicates("rank").sort_values("rank")
    at = {r: j for j, r in enumerate(sources["rank"])}
    by = frame.sort_values("rank").groupby("pattern")["rank"].apply(lambda x: [at[r] for r in x])
    got = cheapest_flow([int(s) for s in patterns["supply"]], [int(a) for a in sources["ask"]],
                        [by[p] for p in patterns["pattern"]], repeats)
    return pd.DataFrame([(p, int(sources["rank"].iloc[j]), int(w)) for p, f in zip(patterns["pattern"], got)
                         for j, w in f.items()], columns=["pattern", "rank", "words"])


def plan(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """``docs``: (id, mark, size, sources array).  Returns the sources with
    their targets, and the patterns (sources, supply, words to take)."""
    spark = docs.sparkSession
    supply = materialize(docs.groupBy("sources").agg(F.sum("size").alias("supply")), "patterns")
    total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    member = supply.select("sources", "supply", F.explode("sources").alias("source"))
    sizes = member.groupBy("source").agg(F.sum("supply").alias("source_size"))
    named = materialize(targets(sizes, total, weights, repeats), "targets")
    order = [F.array_join("sources", "\x00", "\x01"), F.col("sources")]
    supply = materialize(numbered(supply, order, "pattern"), "patterns")
    ties = (supply.select("pattern", "supply", F.explode("sources").alias("source")).alias("p")
            .join(named.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
            .select("pattern", "supply", "rank", F.round("target").cast("long").alias("ask")))
    ties = materialize(ties, "memberships")
    first = ties.groupBy("pattern").agg(F.min("rank").alias("low"))
    edges = ties.join(first, "pattern").where("low <> rank").select(F.col("low").alias("a"), F.col("rank").alias("b"))
    parts = connected_components(edges)
    whole = ties.join(parts, ties["rank"] == parts["node"], "left").select(
        "pattern", "supply", "rank", "ask", F.coalesce("root", "rank").alias("part"))
    prepare(spark)
    flow = whole.groupBy("part").applyInPandas(lambda x: _flows(x, repeats), "pattern long, rank long, words long")
    flow = flow.groupBy("pattern").agg(F.sum("words").alias("words"))
    return named, materialize(supply.join(flow, "pattern").drop("pattern"), "flows")


def choose(docs: DataFrame, patterns: DataFrame, seed: str = SEED) -> DataFrame:
    """Patterns with what decides on a document: copies that all take
    (``full``), and the last place in seeded order that takes one more
    (``cut``), plus one later document that fills most of what is left."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    want = patterns.select("sources", F.when(F.col("supply") > 0, F.floor(F.col("words") / F.col("supply")))
                           .otherwise(0).cast("long").alias("full"),
                           F.when(F.col("supply") > 0, F.col("words") % F.col("supply")).otherwise(0).alias("part"))
    want = materialize(want.withColumn("part", F.col("part").cast("long")), "wanted")
    same = lambda a, b: F.col(f"{a}.sources") == F.col(f"{b}.sources")  # noqa: E731  null elements are equal
    rows = docs.select("sources", "id", "mark", "size", draw.alias("draw"))
    left = want.select("sources", F.col("part").alias("rest"), F.lit("").alias("head"))
    for depth in (1, 2):
        digits = F.substring("draw", 1, DIGITS * depth)
        inside = (rows.alias("d").join(left.alias("w"), same("d", "w") & F.col("d.draw").startswith(F.col("w.head")))
                  .groupBy("d.sources", "rest", digits.alias("head")).agg(F.sum("size").alias("size")))
        before = F.sum("size").over(Window.partitionBy("sources").orderBy("head")) - F.col("size")
        left = (inside.withColumn("before", before).where("before <= rest")
                .groupBy("sources").agg(F.max_by(F.struct("head", (F.col("rest") - F.col("before")).alias("rest")), "head")
                                        .alias("x")).select("sources", "x.*"))
        left = materialize(left, "cut")
    last = rows.alias("d").join(left.alias("w"), same("d", "w") & F.col("d.draw").startswith(F.col("w.head")))
    place = F.struct("draw", F.col("id").isNull().alias("no_id"), "id", "size", "mark")
    last = last.select("d.*", "rest", place.alias("place"))
    taken = last.withColumn("upto", F.sum("size").over(Window.partitionBy("sources").orderBy("place"))).where("upto <= rest")
    taken = taken.groupBy("sources").agg(F.max("place").alias("cut"), F.max("upto").alias("upto"))
    cut = (left.join(taken, "sources", "left")
           .select("sources", "head", "cut", (F.col("rest") - F.coalesce("upto", F.lit(0))).alias("short")))
    cut = materialize(cut, "cut")
    later = (rows.alias("d").join(cut.alias("w"), same("d", "w") & (F.col("d.size") <= F.col("w.short")))
             .where("d.size > 0").where(~_inside(place, F.col("w.cut"), F.col("draw"), F.col("w.head")))
             .select("d.sources", "size", place.alias("place")))
    extra = later.groupBy("sources").agg(F.max_by("place", F.struct("size", "place")).alias("extra"))
    return materialize(want.join(cut, "sources", "left").join(extra, "sources", "left")
                       .select("sources", "full", "head", "cut", "extra"), "choice")


def _inside(place: Column, cut: Column, draw: Column, head: Column) -> Column:
    """In seeded order up to the cut; without a cut, before its range."""
    return F.coalesce(place <= cut, draw < head, F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a struct column (its name is returned too) of size,
    sources and copies (how often the mix takes the document), and the
    table of sources (source, source_size, weight, target).

    ``source_col`` is a string, or an array of the sources that a document
    belongs to (repeats in it count once, an empty or null array is the
    null source).  A null text has no words; texts without words are never
    taken; rows alike in id and text are taken alike; an empty table gives
    empty results; all columns of ``docs`` are kept."""
    prepare(docs.sparkSession)
    members = _members(docs, source_col)
    name, = fresh(docs, "mix")
    t = F.col(f"`{text_col}`")
    seen = docs.withColumn(name, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("mark"),
                                          number_of_words(t).alias("size"), members.alias("sources")))
    rows = materialize(seen.select(f"{name}.*"), "sizes")
    named, patterns = plan(rows, weights, repeats)
    choice = choose(rows, patterns, seed)
    return apply_choice(seen, name, choice, seed), name, named


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights=WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(id, size, sources, copies) per row of ``docs``, and the table of
    sources: as ``mix``, without the documents, whose texts are read once."""
    prepare(docs.sparkSession)
    t, members = F.col(f"`{text_col}`"), _members(docs, source_col)
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("mark"),
                                   number_of_words(t).alias("size"), members.alias("sources")), "sizes")
    named, patterns = plan(rows, weights, repeats)
    out = apply_choice(rows.select(F.struct("*").alias("mix")), "mix", choose(rows, patterns, seed), seed)
    return out.select("mix.*"), named


def _members(docs: DataFrame, source_col: str) -> Column:
    given = F.col(f"`{source_col}`")
    if docs.schema[source_col].dataType.typeName() != "array":
        return F.array(given.cast("string"))
    none = F.array(F.lit(None).cast("string"))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, F.sort_array(F.array_distinct(given))).otherwise(none)


def apply_choice(seen: DataFrame, name: str, choice: DataFrame, seed: str) -> DataFrame:
    c, = fresh(seen, "choice")
    choice = choice.select(F.struct("*").alias(c))
    at = lambda x: F.col(f"{name}.{x}")
    to = lambda x: F.col(f"{c}.{x}")
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(at("id").cast("string"), F.lit(""))).cast("binary"))
    place = F.struct(draw.alias("draw"), at("id").isNull().alias("no_id"), at("id").alias("id"), at("size").alias("size"),
                     at("mark").alias("mark"))
    more = _inside(place, to("cut"), draw, to("head")) | F.coalesce(place == to("extra"), F.lit(False))
    copies = F.when(at("size") > 0, F.coalesce(to("full"), F.lit(0)) + more.cast("long")).otherwise(0).cast("long")
    joined = seen.join(choice, at("sources") == to("sources"), "left")
    return joined.withColumn(name, F.struct(at("id").alias("id"), at("size").alias("size"), at("sources").alias("sources"),
                                            copies.alias("copies"))).drop(c)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns
    unchanged (repeats are repeated rows)."""
    out, name, _ = mix(docs, **options)
    copies, = fresh(out, "copy")
    often = F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))
    return (out.where(F.col(f"{name}.copies") > 0).withColumn(copies, F.explode(often))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
