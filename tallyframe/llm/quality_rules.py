"""Quality rules: weak supervision in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text.  Expectation
maximisation over the counts of vote patterns (at most 3 to the number of
rules, however large the corpus) estimates how often each rule is right on
good and on bad texts; a text's verdict is its posterior probability of
being good.  A rule that seldom speaks against good texts so weighs much
when it does.  A rule that speaks alone can't be told from a rule that errs,
so each known kind of bad text is covered by two rules or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, let, materialize, word_array

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MARKS = r"[!-/:-@\[-`{-~]"
LINE_END = r"[.!?:;\"')\]»“”…。][\x20\x09-\x0D]*$"
MIN_WORDS = 20
REPEAT_PERCENT = 30
ROUNDS = 30
KEEP_AT = 0.5
#: Start values, each as strong as so many texts, hold which class is good.
#: The ranges only keep a rule from being counted as worse than chance on
#: good texts and leave it to know one kind of bad text; a rule that speaks
#: against a whole kind of good texts is found to err and loses its weight.
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD, PSEUDO = 0.85, 0.99, 0.3, 10
PRIOR_RANGE, GOOD_RANGE, BAD_RANGE = (0.5, 0.95), (0.6, 0.999), (0.1, 0.9)

#: Rules: name, condition for good, condition for bad, over the features.
RULES = [
    ("word_length", "word_chars >= 3 * n_words and word_chars <= 10 * n_words",
     "2 * word_chars < 5 * n_words or word_chars > 14 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("punctuation", "20 * n_marks <= word_chars", "100 * n_marks > 8 * word_chars"),
    ("line_copies", "n_lines >= 3 and n_dup_lines = 0", "n_lines >= 3 and 2 * n_dup_lines > n_lines"),
    ("phrase_copies", "n_repeat_words = 0", "4 * n_repeat_words > n_words"),
    ("capitals", "10 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    ("exclaims", "50 * n_exclaims <= n_words", "5 * n_exclaims > n_words"),
    ("sentence_ends", "2 * n_ended_lines >= n_lines", "n_words >= 50 and n_ended_lines = 0"),
    ("length", "n_words >= 50", "n_words < 20"),
]


def _count(text: Column, chars: str) -> Column:
    """Occurrences of any character of a class."""
    return F.size(F.split(text, chars)) - 1


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more."""
    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, i: F.least(
            F.lit(width), F.coalesce(F.get(positions, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marks = let(pairs, lambda s: F.transform(s, lambda x, j: F.when(
            F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
                       F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False)), x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(F.filter(marks, lambda p: p.isNotNull())), covered))

    def windows(x: Column, i: Column) -> Column:   # by index: cheaper than a slice for each window
        return F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)])

    whole = F.slice(F.transform(words, windows), 1, F.size(words) - (width - 1))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(whole, repeated))


def features(text: Column) -> Column:
    """One struct of whole-number features of a text (null: no words)."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            ended = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(LINE_END))))
            big = lambda c: c.cast("long")
            return F.struct(
                big(F.size(w)).alias("n_words"),
                big(F.length(F.array_join(w, ""))).alias("word_chars"),
                big(_count(t, SYMBOLS)).alias("n_symbols"),
                big(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                big(repeat_words(w)).alias("n_repeat_words"),
                big(F.size(lines)).alias("n_lines"),
                big(ended).alias("n_ended_lines"),
                big(_count(t, "[A-Z]")).alias("n_capitals"),
                big(_count(t, "!")).alias("n_exclaims"),
                big(_count(t, MARKS)).alias("n_marks"))
        return let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), of_lines)
    return let(word_array(t), of_words)


def votes() -> Column:
    """Votes in the order of RULES, from columns named as the features."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, good, bad in RULES])


def _log_odds(vote: Column, prior: Column, good: Column, bad: Column) -> Column:
    """Log odds of good, given votes and the rules' rates of being right."""
    each = F.transform(vote, lambda v, j: F.when(v == 1, F.log(F.get(good, j) / (1 - F.get(bad, j))))
                       .when(v == -1, F.log((1 - F.get(good, j)) / F.get(bad, j))).otherwise(F.lit(0.0)))
    return F.aggregate(each, F.log(prior / (1 - prior)), lambda a, x: a + x)


def _posterior(vote, prior, good, bad) -> Column:
    return 1 / (1 + F.exp(-_log_odds(vote, prior, good, bad)))


def _bounded(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def observe(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column of features (its name is returned
    too), written down: texts are taken apart once."""
    name, = fresh(docs, "features")
    return materialize(docs.withColumn(name, features(F.col(f"`{text_col}`"))), "features"), name


def fit(seen: DataFrame, name: str, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """(prior, rates right on good, rates right on bad) from observed rows.
    One aggregate counts the vote patterns; the rounds run over those
    counts in one expression.  No rows leave the start values in place."""
    seen = seen.select(F.col(f"{name}.*")).select(votes().alias("v"))
    counts = (seen.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
              .agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p")).where("size(p) > 0"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    k = len(RULES)
    rate = lambda c: F.array_repeat(F.lit(c), k)
    state = F.struct(F.lit(PRIOR).alias("prior"), rate(RIGHT_ON_GOOD).alias("good"), rate(RIGHT_ON_BAD).alias("bad"))

    def step(s: Column, _: Column) -> Column:
        weighed = F.transform(F.col("p"), lambda x: F.struct(
            x["v"].alias("v"), x["n"].alias("n"), (x["n"] * _posterior(x["v"], s["prior"], s["good"], s["bad"])).alias("g")))

        def rates(w: Column) -> Column:
            n, g = total(F.transform(w, lambda x: x["n"])), total(F.transform(w, lambda x: x["g"]))
            at = F.sequence(F.lit(0), F.lit(k - 1))

            def right(j: Column, vote: int) -> Column:
                mass = (lambda x: x["g"]) if vote == 1 else (lambda x: x["n"] - x["g"])
                hit = total(F.transform(w, lambda x: F.when(F.get(x["v"], j) == vote, mass(x)).otherwise(0.0)))
                spoke = total(F.transform(w, lambda x: F.when(F.get(x["v"], j) != 0, mass(x)).otherwise(0.0)))
                start, span = (RIGHT_ON_GOOD, GOOD_RANGE) if vote == 1 else (RIGHT_ON_BAD, BAD_RANGE)
                return _bounded((hit + PSEUDO * start) / (spoke + PSEUDO), *span)
            return F.struct(_bounded((g + PSEUDO * PRIOR) / (n + PSEUDO), *PRIOR_RANGE).alias("prior"),
                            F.transform(at, lambda j: right(j, 1)).alias("good"),
                            F.transform(at, lambda j: right(j, -1)).alias("bad"))
        return let(weighed, rates)

    row = counts.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step).alias("m")).first()
    if row is None:
        return PRIOR, [RIGHT_ON_GOOD] * k, [RIGHT_ON_BAD] * k
    return row["m"]["prior"], list(row["m"]["good"]), list(row["m"]["bad"])


def judge(seen: DataFrame, name: str, model) -> DataFrame:
    """Observed rows with a verdict in place of the struct's raw votes:
    columns base_failed, quality and kept join the struct."""
    prior, good, bad = model
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rows = seen.select(*seen.columns, F.col(f"{name}.*")).withColumn("quality", let(
        votes(), lambda x: _posterior(x, F.lit(float(prior)), lits(good), lits(bad))))
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= KEEP_AT))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, features, base_failed, quality (the
    posterior) and kept.  Null and empty texts have no words and fail the
    base check; repeated rows get equal rows; an empty table gives an empty
    one; only the id and text columns are read."""
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), features(F.col(f"`{text_col}`")).alias("f"))
    seen = materialize(seen, "features")
    return judge(seen, "f", fit(seen, "f")).drop("f").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    seen, name = observe(docs, text_col)
    row, = fresh(seen, "row")
    whole = seen.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), name)
    kept = judge(whole, name, fit(seen, name)).where("kept")
    return kept.select(*[F.col(f"`{row}`").getField(c).alias(c) for c in docs.columns])
