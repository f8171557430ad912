"""Segmentation of runs of word characters with a table of terms.

A run falls into atoms: every CJK character is one, and so is every stretch of other
word characters (``A``, ``OK``, ``2024``), which is never cut. A term is a row of
atoms, so terms that mix scripts (``A股``, ``T恤``, ``卡拉OK``) are found like others.

Of the ways to cut a run two are offered: left to right by the longest match, or, with
the frequencies of the terms, the most likely one. Both work on the hits of the table,
which come from an equi-join, and on one short independent piece of a run at a time: a
place that no hit reaches across is a sure boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.arrays import let
from termpulse.functions.text import CJK, atom_windows, atoms, cjk_runs, keep_word, mixed_runs, word_runs
from termpulse.operators.lookup import WordTable, lookup_words
from termpulse.storage import fits_broadcast

#: Costs are whole millionths of a natural logarithm, so that sums do not hang on
#: their order and equal costs are equal.
COST_UNIT = 1_000_000
#: Places of a piece that are folded together before their result joins the others:
#: appending to a short array copies little.
FOLD = 512


# --- runs -----------------------------------------------------------------------------


def _counted(posts: DataFrame, runs: Column) -> DataFrame:
    return posts.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def cjk_run_counts(posts: DataFrame, content: str = "content") -> DataFrame:
    """``run, n``: distinct runs of CJK characters alone, with the number of their occurrences."""
    return _counted(posts, cjk_runs(F.col(content)))


def mixed_run_counts(posts: DataFrame, content: str = "content") -> DataFrame:
    """``run, n``: distinct runs of word characters that hold a CJK character."""
    return _counted(posts, mixed_runs(F.col(content)))


# --- hits of the table ------------------------------------------------------------------


def _term_table(terms: DataFrame, weight: str | None) -> DataFrame:
    """``_term, _cost``: each term once; the cost of one that occurs n times in all
    ``total`` is ln(total / n). Without weights nothing is said of costs."""
    rows = terms.where(F.length("term") > 0)
    if weight is None:
        return rows.select(F.col("term").alias("_term"), F.lit(0).cast("bigint").alias("_cost")).distinct()
    counted = rows.groupBy(F.col("term").alias("_term")).agg(F.greatest(F.sum(weight), F.lit(1)).cast("double").alias("_n"))
    return counted.select("_term", _cost(_total(terms, weight), F.col("_n")).alias("_cost"))


def _total(terms: DataFrame, weight: str) -> Column:
    rows = terms.where(F.length("term") > 0)
    return rows.agg(F.greatest(F.coalesce(F.sum(weight), F.lit(1)), F.lit(1)).cast("double").alias("t")).scalar()


def _cost(total: Column, n: Column) -> Column:
    return F.round(F.log(total / n) * COST_UNIT).cast("bigint")


def _hits(runs: DataFrame, terms: DataFrame, weight: str | None) -> DataFrame:
    """``_key, pos, len, gram, cost``: every atom of every run, and every term found;
    the rows of a run are in one task.

    Windows of as many atoms as terms have, one per place and number of atoms, meet the
    table. A small table is broadcast; else a window met in a third of all runs is
    spread over ``SALTS`` tasks.
    """
    table = _term_table(terms, weight)
    # A few numbers, whatever the size of the table.
    lengths = table.select(F.size(atoms(F.col("_term"))).alias("k")).where("k > 1").agg(F.collect_set("k").alias("k")).scalar()
    each = F.explode(F.array_union(F.array(F.lit(1)), F.coalesce("_lengths", F.array().cast("array<int>")))).alias("len")
    small = fits_broadcast(table)
    if small:
        # Dealt out before they are cut: no window leaves its task then.
        tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = runs.select("_key", "run").repartition(tasks, "_key")
    cut = runs.select("_key", "run", lengths.alias("_lengths")).select("_key", "run", each)
    places = cut.select("_key", "len", F.posexplode(atom_windows(F.col("run"), F.col("len"))).alias("pos", "gram"))
    if small:
        met = places.join(F.broadcast(table), F.col("gram") == F.col("_term"), "left")
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(S.SALTS - 1))))
        places = places.withColumn("_slice", F.pmod(F.xxhash64("_key", "pos"), F.lit(S.SALTS)).cast("int"))
        # Measured too big to broadcast, whatever Spark takes its size for.
        met = places.join(salted.hint("merge"), (F.col("gram") == F.col("_term")) & (F.col("_slice") == F.col("_salt")), "left")
    # An atom that the table does not know counts as one seen once.
    unknown = F.lit(0).cast("bigint") if weight is None else _cost(_total(terms, weight), F.lit(1.0))
    hits = met.where((F.col("len") == 1) | F.col("_term").isNotNull()).select(
        "_key", "pos", "len", "gram", F.coalesce("_cost", unknown).alias("cost")
    )
    return hits if small else hits.repartition("_key")


def _pieces(hits: DataFrame, all_hits: bool) -> DataFrame:
    """``_key, _piece, blocks``: the places of each piece in blocks of ``FOLD``, each with
    its hits, or only with the longest."""
    hit = F.struct("len", "cost", "gram")
    found = F.sort_array(F.collect_list(hit)) if all_hits else F.array(F.max(hit))
    places = hits.groupBy("_key", "pos").agg(found.alias("hits"))
    in_order = Window.partitionBy("_key").orderBy("pos")
    reach = F.max(F.col("pos") + F.element_at("hits", -1)["len"]).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    cut = (F.coalesce(reach, F.lit(0)) <= F.col("pos")).cast("int")
    places = places.withColumn("_cut", cut)
    places = places.withColumn("_piece", F.sum("_cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("pos", "hits")
    return (
        places.groupBy("_key", "_piece", F.floor(F.col("pos") / FOLD).alias("_block"))
        .agg(F.sort_array(F.collect_list(place)).alias("places"))
        .groupBy("_key", "_piece")
        .agg(F.sort_array(F.collect_list(F.struct("_block", "places"))).alias("b"))
        .select("_key", "_piece", F.col("b.places").alias("blocks"))
    )


# --- two ways to choose --------------------------------------------------------------------


def _fold(blocks: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold an array of arrays: ``step(state, item)`` gives the next state and an array of
    results. Gives the results of each block."""
    none = F.array().cast(f"array<{out_type}>")

    def inside(acc, item):
        after, found = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], found).alias("out"))

    def outside(acc, block):
        start = F.struct(acc["state"].alias("state"), none.alias("out"))
        return let(
            F.aggregate(block, start, inside),
            lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
        )

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.aggregate(blocks, start, outside, lambda acc: acc["out"])


def _walked(blocks: Column, length: Callable[[Column], Column], word: Callable[[Column], Column]) -> Column:
    """Words from left to right, each where the one before ends."""

    def step(free, place):
        taken = place["pos"] >= free
        none = F.array().cast("array<string>")
        return (
            F.when(taken, place["pos"] + length(place)).otherwise(free),
            F.when(taken, F.array(word(place))).otherwise(none),
        )

    return F.flatten(_fold(blocks, F.lit(0), "string", step))


def _longest(blocks: Column) -> Column:
    last = lambda place: F.element_at(place["hits"], -1)  # noqa: E731  hits are sorted by length
    return _walked(blocks, lambda p: last(p)["len"], lambda p: last(p)["gram"])


def _likeliest(blocks: Column, longest: Column) -> Column:
    """The cheapest path: from the last place to the first the best cost of the rest and,
    as a back pointer, the hit that begins it; then along the pointers.

    Only the costs of the next ``longest`` places are carried. Of equal costs the
    longer word counts.
    """

    def step(costs, place):
        options = F.transform(
            place["hits"],
            lambda h: F.struct((h["cost"] + F.get(costs, h["len"] - 1)).alias("cost"), (-h["len"]).alias("short"), h["gram"].alias("gram")),
        )
        best = F.array_min(options)
        pointer = F.struct(place["pos"].alias("pos"), (-best["short"]).alias("len"), best["gram"].alias("gram"))
        return F.slice(F.concat(F.array(best["cost"]), costs), F.lit(1), longest), F.array(pointer)

    backwards = F.transform(F.reverse(blocks), lambda b: F.reverse(b))
    zero = F.array(F.lit(0).cast("bigint"))
    pointers = _fold(backwards, zero, "struct<pos:int,len:int,gram:string>", step)
    forwards = F.transform(F.reverse(pointers), lambda b: F.reverse(b))
    return let(forwards, lambda p: _walked(p, lambda x: x["len"], lambda x: x["gram"]))


def segment_runs(runs: DataFrame, terms: DataFrame, weight: str | None = None) -> DataFrame:
    """The columns of ``runs`` and ``words``: each ``run`` cut into terms and atoms.

    ``runs`` holds every run once; from here on a digest stands for it. ``terms`` has a
    column ``term``. Without ``weight`` the longest match counts, from left to right;
    with it, the name of a column of frequencies, the most likely cut as a whole: the
    product of the shares n / total, an atom that the table lacks counting as seen once.
    Rows of one term add up.
    """
    keyed = runs.withColumn("_key", F.unhex(F.md5("run")))
    pieces = _pieces(_hits(keyed, terms, weight), weight is not None)
    if weight is None:
        words = _longest(F.col("blocks"))
    else:
        # Bounded by the longest term, in atoms.
        longest = terms.agg(F.greatest(F.coalesce(F.max(F.size(atoms(F.col("term")))), F.lit(1)), F.lit(1)).alias("k")).scalar()
        pieces = pieces.withColumn("_longest", longest)
        words = _likeliest(F.col("blocks"), F.col("_longest"))
    found = (
        pieces.select("_key", "_piece", words.alias("out"))
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list(F.struct("_piece", "out"))).alias("parts"))
        .select("_key", F.flatten(F.col("parts.out")).alias("words"))
    )
    return keyed.join(found, "_key").select(*runs.columns, "words")


def segmented_word_counts(runs: DataFrame, terms: DataFrame, weight: str | None = None) -> DataFrame:
    """``word, n`` of the corpus counted in ``run, n``, segmented with ``terms``.

    Runs are counted first, so a run repeated in a third of all posts is cut
    once and its words are multiplied.
    """
    return (
        segment_runs(runs, terms, weight)
        .select("n", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def segmented_rows(
    posts: DataFrame,
    terms: DataFrame,
    keep: Sequence[str] = ("id",),
    stopwords: Iterable[str] = (),
    min_len: int = S.MIN_WORD_LENGTH,
    key: str = "id",
    content: str = "content",
    weight: str | None = None,
) -> DataFrame:
    """``keep`` columns and ``word``: like ``tokens.word_rows``, runs cut with ``terms``.

    For counting (``frequency.count_rows``): rows of a post are in no order.
    ``key`` tells posts apart and spreads frequent runs.
    """
    columns = list(dict.fromkeys([key, *keep]))
    runs = posts.select(*columns, F.explode(word_runs(F.col(content))).alias("word"))
    holds_cjk = F.col("word").rlike(rf"[{CJK}]")
    mixed = runs.where(holds_cjk)
    distinct = mixed.groupBy(F.col("word").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    table = WordTable.fit(segment_runs(distinct, terms, weight).withColumnRenamed("run", "word"), "n")
    cut = lookup_words(mixed, table, ["words"], key).select(*keep, F.explode("words").alias("word"))
    rows = runs.where(~holds_cjk).select(*keep, "word").unionByName(cut)
    return rows.where(keep_word(F.col("word"), min_len, stopwords))


def with_segments(
    posts: DataFrame, terms: DataFrame, key: str = "id", content: str = "content", weight: str | None = None
) -> DataFrame:
    """``key, run_no, word_no, word``: the words of each post's mixed runs in order."""
    cut = segment_runs(mixed_run_counts(posts, content), terms, weight).withColumnRenamed("run", "word")
    runs = posts.select(
        key, F.posexplode(mixed_runs(F.col(content))).alias("run_no", "word")
    )
    return lookup_words(runs, WordTable.fit(cut, "n"), ["words"], key).select(
        key, "run_no", F.posexplode("words").alias("word_no", "word")
    )
