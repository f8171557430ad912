"""The full hot-word report over a date range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.text import Tokenizer
from termpulse.operators import frequency as freq
from termpulse.operators.filters import Bound, filter_by_date
from termpulse.operators.matching import subquery_words, with_found_words, word_post_matches
from termpulse.operators.sentiment import (
    DEFAULT_LEXICON,
    Lexicon,
    narrow_scores,
    sentiment_distribution,
    word_sentiment,
)
from termpulse.operators.tokens import Stopwords


@dataclass(frozen=True)
class HotWordReport:
    """The report's tables, all lazy.

    ``words``: rank, word, word_count, total_count, avg_score, sentiment,
    positive_ratio, negative_ratio. ``daily``: date, rank, word, n.
    ``distribution``: sentiment, n, ratio, avg_score. ``frequencies``: date,
    word, n.
    """

    words: DataFrame
    daily: DataFrame
    distribution: DataFrame
    frequencies: DataFrame
    _kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give up what the tables share on the executors."""
        for df in self._kept:
            df.unpersist()

    def __enter__(self) -> HotWordReport:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def hot_word_report(
    posts: DataFrame,
    start: Bound = None,
    end: Bound = None,
    top_n: int | None = S.TOP_N,
    stopwords: Stopwords = (),
    lexicon: Lexicon = DEFAULT_LEXICON,
    tokenizer: Tokenizer | None = None,
    end_of_day: bool = False,
    max_samples: int | None = None,
    terms: DataFrame | None = None,
    weight: str | None = None,
) -> HotWordReport:
    """Count, rank and score the words of a date range.

    Every post with a hot word is scored; ``max_samples`` scores a sample per word.
    ``terms`` is a table of any size into whose terms runs with CJK characters are cut,
    by their frequencies if ``weight`` names a column of it.

    Raises ``ValueError`` for an unreadable bound; an empty range gives empty
    tables. The texts are read once to count words, once, when the hot words are
    known, to score posts and find the words in them, and once for
    ``distribution``, which waits for no ranking. What several tables need is
    kept on the executors in narrow form: the counts, and per post its id, score,
    class and hot words, without the text.
    """
    top_n = top_n or S.TOP_N
    posts = filter_by_date(posts, start, end, end_of_day=end_of_day, strict=True)

    dated = freq.word_frequency(posts, True, stopwords, tokenizer=tokenizer, missing=None, terms=terms, weight=weight)
    dated = dated.persist(StorageLevel.MEMORY_AND_DISK)
    ranked = freq.top_words(freq.roll_up(dated), top_n)

    scored = narrow_scores(posts, lexicon)
    if top_n <= S.INLINE_WORDS:
        scored = with_found_words(scored, subquery_words(ranked)).select(
            "id", "cents", "sentiment", "words"
        )
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        hits = scored.select("id", "cents", "sentiment", F.explode("words").alias("word"))
    else:
        hits = word_post_matches(scored, ranked, ("id", "cents", "sentiment"))
        scored = scored.select("id", "cents", "sentiment").persist(StorageLevel.MEMORY_AND_DISK)

    numbered = freq.with_rank(ranked).withColumnRenamed("n", "word_count")
    words = word_sentiment(hits, numbered, max_samples).select(
        "rank", "word", "word_count", "total_count", "avg_score", "sentiment",
        "positive_ratio", "negative_ratio",
    )
    return HotWordReport(
        words=words,
        daily=freq.top_words_by_date(dated.where(F.col("date").isNotNull()), top_n),
        distribution=sentiment_distribution(narrow_scores(posts, lexicon)),
        frequencies=freq.name_missing_dates(dated),
        _kept=(scored, dated),
    )
