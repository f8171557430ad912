"""Words that no table knows: n-grams of atoms that hold together and stand freely.

A word's parts meet more often than chance would have it (pointwise mutual
information), and what stands to its left and to its right varies (branching entropy).
Both come from counts of n-grams over distinct runs, each times its occurrences.

Longer n-grams are counted only where both shorter ones inside them are frequent: an
n-gram is at most as frequent as its parts, so nothing is lost, and what is counted at
length k follows the hits of length k - 1, not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termpulse.functions.text import atoms
from termpulse.operators.segment import mixed_run_counts
from termpulse.storage import broadcast_if_small, stored

MAX_LENGTH = 4
MIN_COUNT = 5
MIN_INFORMATION = 1.0
MIN_ENTROPY = 0.5
DECIMALS = 6
#: What stands beside a word at the end of a run.
EDGE = ""


def _places(runs: DataFrame) -> DataFrame:
    """``_key, pos, n, gram, before, after``: every atom with its neighbours."""
    cut = runs.select(F.unhex(F.md5("run")).alias("_key"), "n", atoms(F.col("run")).alias("_a"))
    around = F.transform(
        "_a",
        lambda a, i: F.struct(
            a.alias("gram"),
            F.coalesce(F.get("_a", i - 1), F.lit(EDGE)).alias("before"),
            F.coalesce(F.get("_a", i + 1), F.lit(EDGE)).alias("after"),
        ),
    )
    return cut.select("_key", "n", F.posexplode(around).alias("pos", "x")).select("_key", "pos", "n", "x.*")


def _frequent(places: DataFrame, min_count: int) -> DataFrame:
    """``gram, c`` of the n-grams that occur often enough; counting starts in each task."""
    return places.groupBy("gram").agg(F.sum("n").alias("c")).where(F.col("c") >= min_count)


def _longer(places: DataFrame) -> DataFrame:
    """Places of the n-grams one atom longer, where a frequent one follows a frequent one."""
    in_order = Window.partitionBy("_key").orderBy("pos")
    following = F.lead(F.struct("pos", "after")).over(in_order)
    return (
        places.withColumn("_next", following)
        .where((F.col("_next.pos") == F.col("pos") + 1) & (F.col("after") != EDGE))
        .select("_key", "pos", "n", F.concat("gram", "after").alias("gram"), "before", F.col("_next.after").alias("after"))
    )


def _entropy(places: DataFrame, side: str) -> DataFrame:
    """``gram, <side>_entropy`` in nats: how much the neighbours on one side vary."""
    beside = places.groupBy("gram", side).agg(F.sum("n").cast("double").alias("m"))
    whole = beside.groupBy("gram").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.log("m")).alias("s"))
    return whole.select("gram", F.greatest(F.log("c") - F.col("s") / F.col("c"), F.lit(0.0)).alias(f"{side}_entropy"))


def _parts(found: DataFrame, length: int) -> DataFrame:
    """``gram, c, head, tail``: every way to cut an n-gram in two."""
    a = F.col("_a")
    cuts = F.array(*(
        F.struct(
            F.array_join(F.slice(a, 1, k), "").alias("head"),
            F.array_join(F.slice(a, k + 1, length - k), "").alias("tail"),
        )
        for k in range(1, length)
    ))
    return found.withColumn("_a", atoms(F.col("gram"))).select("gram", "c", F.explode(cuts).alias("x")).select("gram", "c", "x.*")


def new_words(
    posts: DataFrame,
    max_length: int = MAX_LENGTH,
    min_count: int = MIN_COUNT,
    min_information: float = MIN_INFORMATION,
    min_entropy: float = MIN_ENTROPY,
    content: str = "content",
) -> DataFrame:
    """``term, n, information, before_entropy, after_entropy`` of words found in ``posts``.

    A word has two to ``max_length`` atoms, at least one a CJK character, as all runs
    looked at hold one. ``information`` is the least over all cuts in two of
    log2(n * N / (n of the head * n of the tail)), N being the number of atoms; the
    entropies are in nats, the end of a run being one more neighbour. A word reaches
    all thresholds. Figures are rounded to ``DECIMALS`` places before that.

    Eager: the places and counts of each length are written to the scratch folder, as the
    next length is built on them twice. Runs are counted first. The tables of frequent
    n-grams are broadcast once measured small, or else joined by n-gram, where AQE splits
    frequent ones.
    """
    return new_words_of_runs(mixed_run_counts(posts, content), max_length, min_count, min_information, min_entropy)


def new_words_of_runs(
    runs: DataFrame,
    max_length: int = MAX_LENGTH,
    min_count: int = MIN_COUNT,
    min_information: float = MIN_INFORMATION,
    min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """``new_words`` of runs that are counted: ``run, n``."""
    places = stored(_places(runs.select("run", "n")), "places")
    total = places.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).cast("double").alias("t")).scalar()
    counts, levels = [], []
    for length in range(1, max_length + 1):
        frequent = stored(_frequent(places, min_count), "frequent")
        counts.append(frequent)
        # Only places of frequent n-grams go on.
        places = places.join(broadcast_if_small(frequent.select("gram")), "gram", "left_semi")
        if length > 1:
            levels.append((length, frequent, places))
        if length < max_length:
            places = stored(_longer(places), "places")
    known = counts[0]
    for more in counts[1:]:
        known = known.unionByName(more)

    def times(name: str) -> DataFrame:
        return known.select(F.col("gram").alias(name), F.col("c").cast("double").alias(f"c_{name}"))

    found = None
    for length, frequent, there in levels:
        bits = F.log2(F.col("c").cast("double") * total / (F.col("c_head") * F.col("c_tail")))
        cut = _parts(frequent, length).join(times("head"), "head").join(times("tail"), "tail")
        information = cut.groupBy("gram").agg(F.first("c").alias("n"), F.min(bits).alias("information"))
        level = information.join(_entropy(there, "before"), "gram").join(_entropy(there, "after"), "gram")
        found = level if found is None else found.unionByName(level)

    def rounded(name: str) -> Column:
        return F.round(name, DECIMALS).alias(name)

    figures = found.select(
        F.col("gram").alias("term"), "n", rounded("information"), rounded("before_entropy"), rounded("after_entropy")
    )
    return figures.where(
        (F.col("information") >= min_information)
        & (F.least("before_entropy", "after_entropy") >= min_entropy)
    )


def term_table(runs: DataFrame, found: DataFrame) -> DataFrame:
    """``term, n`` for the most likely cut of runs: the words found, and every atom with
    its own count."""
    single = _places(runs.select("run", "n")).groupBy(F.col("gram").alias("term")).agg(F.sum("n").alias("n"))
    return found.select("term", "n").unionByName(single)
