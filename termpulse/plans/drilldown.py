"""One word over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termpulse.functions.score import mean_of_cents, to_cents
from termpulse.operators.filters import Bound, filter_by_date
from termpulse.operators.sentiment import (
    DEFAULT_LEXICON,
    Lexicon,
    trend_sides,
    trend_summary,
    word_sentiment_by_date,
)


@dataclass(frozen=True)
class WordTrend:
    """``series``: word, day, avg_score, side. ``summary``: one row per word."""

    series: DataFrame
    summary: DataFrame

    def marked(self) -> DataFrame:
        """The series with flags on the first highest and first lowest day."""
        # One row per day and word, so a word's days fit into a task: one pass over
        # the series instead of a join with its own summary.
        whole = Window.partitionBy("word")
        cents = to_cents(F.col("avg_score"))
        high = F.min(F.struct((-cents).alias("c"), F.col("day"))).over(whole)["day"]
        low = F.min(F.struct(cents.alias("c"), F.col("day"))).over(whole)["day"]
        points = F.count(F.lit(1)).over(whole)
        return self.series.select(
            "word", "day", "avg_score", "side",
            points.alias("points"),
            mean_of_cents(F.sum(cents).over(whole), points).alias("mean_score"),
            (F.col("day") == high).cast("int").alias("is_max"),
            (F.col("day") == low).cast("int").alias("is_min"),
        )


def word_trend(
    posts: DataFrame,
    word: str,
    start: Bound = None,
    end: Bound = None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    end_of_day: bool = False,
    max_samples: int | None = None,
    regex: bool = False,
) -> WordTrend:
    """Daily sentiment of ``word`` with its summary; no match gives empty tables.

    Every post with the word is scored; ``max_samples`` scores a sample per day.
    """
    chosen = filter_by_date(posts, start, end, end_of_day=end_of_day)
    series = word_sentiment_by_date(chosen, word, lexicon, max_samples=max_samples, regex=regex)
    return WordTrend(trend_sides(series), trend_summary(series))
