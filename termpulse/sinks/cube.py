"""Sentiment figures of words and days in one table, from one scan of the posts.

``sentiment_cube`` holds sums: per word, and per word and day, the number of posts, their
scores in cents and their classes; a null word stands for all posts. The distribution, the
sentiment of words, of top words and of words per day are read from it, with the same rows
as the operators that scan the posts. Sums of whole cents do not depend on any order.

Defined cases: posts with null or blank text count among all posts and hold no word, but
for words of blanks; posts without a readable day count under the null day; no posts give
no rows, and what is read from them shows zeros and neutral averages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions import score as X
from termpulse.functions.dates import day_of, timestamp_of
from termpulse.operators.matching import literal_words, with_found_words, word_post_matches
from termpulse.operators.sentiment import (
    DEFAULT_LEXICON,
    Lexicon,
    distribution_of_sums,
    narrow_scores,
    word_sentiment_of_sums,
)

_CUBE = "word string, day string, by_day boolean, n long, cents long, positive long, negative long, neutral long"


def sentiment_cube(
    posts: DataFrame,
    words: Sequence[str] | DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    content: str = "content",
    date_col: str = "date",
) -> DataFrame:
    """``word, day, by_day, n, cents, positive, negative, neutral``.

    Rows with ``by_day`` are of one word and day, the others of one word. Up to
    ``INLINE_WORDS`` listed words take one scan; a longer list or a table with a column
    ``word`` takes one for the words and one for all posts. A row per word, day and task
    is shuffled.
    """
    day = day_of(timestamp_of(posts, date_col))
    keep = ("day", "cents", "sentiment")
    scored = narrow_scores(posts.withColumn("day", day), lexicon, content)
    everything = F.lit(None).cast("string")
    if not isinstance(words, DataFrame) and len(set(words)) <= S.INLINE_WORDS:
        found = with_found_words(scored, literal_words(words), content, "_found")
        # explode_outer, as explode would have the texts searched twice.
        tagged = found.select(F.explode_outer(F.array_append("_found", everything)).alias("word"), *keep)
    else:
        hits = word_post_matches(scored, words, ("id", *keep), content).select("word", *keep)
        tagged = hits.unionByName(scored.select(everything.alias("word"), *keep))
    sums = tagged.groupingSets([["word", "day"], ["word"]], "word", "day").agg(
        (F.grouping("day") == 0).alias("by_day"),
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").cast("long").alias("cents"),
        *[F.count_if(F.col("sentiment") == c).alias(c) for c in ("positive", "negative", "neutral")],
    )
    return sums


def write_cube(cube: DataFrame, folder: str) -> None:
    """Store a cube in a new folder; totals and days apart, so that each is read alone."""
    cube.write.partitionBy("by_day").parquet(folder)


def read_cube(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_CUBE).parquet(folder)


def distribution(cube: DataFrame) -> DataFrame:
    """As ``sentiment_distribution``: ``sentiment, n, ratio, avg_score``."""
    everything = cube.where(~F.col("by_day") & F.col("word").isNull())
    zero = F.lit(0)
    # One row at most; the aggregate gives one for an empty cube, too.
    one = everything.agg(
        F.coalesce(F.sum("n"), zero).alias("total"),
        F.coalesce(F.sum("cents"), zero).alias("cents"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in S.SENTIMENT_TITLES],
    )
    return distribution_of_sums(one)


def words_sentiment(cube: DataFrame, words: DataFrame) -> DataFrame:
    """As ``word_sentiment`` for the rows of ``words``, whose other columns stay.

    With a ranking's ``word, word_count`` this is ``top_words_sentiment``. A word that the
    cube was not made for shows zeros.
    """
    totals = cube.where(~F.col("by_day") & F.col("word").isNotNull())
    sums = totals.select(
        "word",
        F.col("n").alias("total_count"),
        F.col("n").alias("_n"),
        F.col("cents").alias("_cents"),
        *[F.col(c).alias(f"_{c}") for c in S.SENTIMENT_TITLES],
    )
    return word_sentiment_of_sums(sums, words)


def words_sentiment_by_date(cube: DataFrame) -> DataFrame:
    """As ``word_sentiment_by_date``: ``word, day, avg_score``."""
    dated = cube.where("by_day AND word IS NOT NULL AND day IS NOT NULL")
    return dated.select("word", "day", X.mean_of_cents(F.col("cents"), F.col("n")).alias("avg_score"))
