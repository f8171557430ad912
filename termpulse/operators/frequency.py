"""Word counts and rankings.

Ties are broken everywhere the same way: higher count first, then the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.text import Tokenizer
from termpulse.operators.ranking import first_per_group
from termpulse.operators.segment import segmented_rows
from termpulse.operators.tokens import Stopwords, remove_stopwords, word_rows


def word_frequency(
    posts: DataFrame,
    by_date: bool = True,
    stopwords: Stopwords = (),
    min_len: int = S.MIN_WORD_LENGTH,
    cjk: str = "bigram",
    tokenizer: Tokenizer | None = None,
    content: str = "content",
    missing: str | None = S.UNKNOWN_DATE,
    terms: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``date, word, n`` or ``word, n``; no posts or no words give no rows.

    Dates group as written; a missing date counts under ``missing``. With a table
    ``terms`` (column ``term``) runs that hold CJK characters are cut into its terms,
    by the longest match or, with ``weight`` (its column of frequencies), into the most
    likely words; posts then need an ``id``. Counting starts inside each task, so a
    word holding a third of all tokens reaches the shuffle as one row per task.
    """
    if by_date and "date" not in posts.columns:
        posts = posts.withColumn("date", F.lit(None).cast("string"))
    in_rows = () if isinstance(stopwords, DataFrame) else stopwords
    keep = ["date"] if by_date else []
    if terms is None:
        rows = word_rows(posts, keep, in_rows, min_len, cjk, tokenizer, content)
    else:
        rows = segmented_rows(posts, terms, keep, in_rows, min_len, content=content, weight=weight)
    counts = count_rows(rows, missing)
    # A stopword table meets the counts, not the far more numerous tokens.
    return remove_stopwords(counts, stopwords) if isinstance(stopwords, DataFrame) else counts


def count_rows(rows: DataFrame, missing: str | None = S.UNKNOWN_DATE) -> DataFrame:
    """Count token rows per word, and per date if they have one."""
    keys = [F.col("word")]
    if "date" in rows.columns:
        day = F.coalesce(F.col("date").cast("string"), F.lit(missing))
        keys = [day.alias("date"), *keys]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def name_missing_dates(dated: DataFrame, missing: str = S.UNKNOWN_DATE) -> DataFrame:
    """Counts whose missing dates are null, with these under a name; posts dated by
    that very text count with them."""
    day = F.coalesce("date", F.lit(missing)).alias("date")
    return dated.groupBy(day, "word").agg(F.sum("n").alias("n"))


def roll_up(dated: DataFrame) -> DataFrame:
    """Per-word totals of a dated count table."""
    return dated.groupBy("word").agg(F.sum("n").alias("n"))


def top_words(counts: DataFrame, top_n: int | None = S.TOP_N) -> DataFrame:
    """The ``top_n`` most frequent words; 0 or None mean the default."""
    return counts.select("word", "n").orderBy(F.desc("n"), "word").limit(top_n or S.TOP_N)


def with_rank(ranked: DataFrame, order: str = "n") -> DataFrame:
    """Number an already limited ranking from 1.

    The window has no partition: use it on top-N tables only.
    """
    w = Window.orderBy(F.desc(order), "word")
    return ranked.select(F.row_number().over(w).alias("rank"), *ranked.columns)


def top_words_by_date(dated: DataFrame, top_n: int | None = S.TOP_N) -> DataFrame:
    """``date, rank, word, n``: each date's most frequent words.

    Groups are cut before they are shuffled, so a date holding a third of all
    words is no hot spot. A table without dates ranks under the single key
    ``all``. Every date of the table is ranked, ``unknown`` like any other: to
    leave out posts without a date, count those with one.
    """
    top_n = top_n or S.TOP_N
    if "date" not in dated.columns:
        return with_rank(top_words(dated, top_n)).select(
            F.lit("all").alias("date"), "rank", "word", "n"
        )
    ranked = first_per_group(dated, ["date"], [F.desc("n"), "word"], top_n, "rank", ["word"])
    return ranked.select("date", "rank", "word", "n")


def as_nested_lists(lists: DataFrame) -> DataFrame:
    """One row per date with its ranked ``(word, n)`` pairs as an array."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "word", "n")))
    return lists.groupBy("date").agg(
        F.transform(pairs, lambda p: F.struct(p["word"].alias("word"), p["n"].alias("n"))).alias("words")
    )


def bar_words(counts: DataFrame, bars: int = S.BAR_WORDS) -> DataFrame:
    """Bar chart rows: the first ``bars`` of the ranking."""
    return with_rank(top_words(counts, bars))


def cloud_weights(counts: DataFrame, words: int = S.CLOUD_WORDS) -> DataFrame:
    """Word cloud rows: the most frequent words, weighted by the largest count."""
    top = top_words(counts, words)
    weight = F.bround(F.col("n") / F.max("n").over(Window.partitionBy()), 6)
    return top.select("word", "n", weight.alias("weight"))


def trend_matrix(lists: DataFrame, dates: DataFrame, words: int = S.TREND_WORDS) -> DataFrame:
    """``date, word, n``: the leading words over all dates, 0 where missing.

    Leading words come from the summed per-date lists, so a word outside a
    date's list counts 0 there. ``dates`` supplies the days, among them those
    without any word. The few leading words travel as one array value, and the
    grid is an explode of it.
    """
    leading = (
        top_words(roll_up(lists), words).agg(F.sort_array(F.collect_list("word")).alias("w")).scalar()
    )
    grid = (
        dates.select("date").where(F.col("date").isNotNull()).distinct()
        .withColumn("_words", leading)
        .select("date", F.explode("_words").alias("word"))
    )
    return grid.join(lists.select("date", "word", "n"), ["date", "word"], "left").select(
        "date", "word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
