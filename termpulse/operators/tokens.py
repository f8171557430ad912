"""Posts to token rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.text import Tokenizer, keep_word, raw_words, tokenize
from termpulse.storage import broadcast_if_small

Stopwords = Iterable[str] | DataFrame


def remove_stopwords(words: DataFrame, stopwords: Stopwords, column: str = "word") -> DataFrame:
    """Drop stopwords from word rows, keeping order and repeats of the others.

    A list becomes a hash-set test. A table becomes an anti-join, broadcast once
    it has been measured small.
    """
    if isinstance(stopwords, DataFrame):
        stop = broadcast_if_small(stopwords.select(F.col("word").alias("_stop")))
        return words.join(stop, F.col(column) == F.col("_stop"), "left_anti")
    stop = sorted(set(stopwords))
    return words.where(~F.col(column).isin(stop)) if stop else words


def word_rows(
    posts: DataFrame,
    keep: Sequence[str] = ("id",),
    stopwords: Stopwords = (),
    min_len: int = S.MIN_WORD_LENGTH,
    cjk: str = "bigram",
    tokenizer: Tokenizer | None = None,
    content: str = "content",
) -> DataFrame:
    """One row per token: the ``keep`` columns and ``word``.

    For counting: word filters run after the explode, inside generated code,
    and nothing but ``keep`` and the words leaves the task. Null and empty posts
    explode to nothing. A custom tokeniser is trusted to have filtered its
    words; stopwords are still removed.
    """
    if tokenizer is not None:
        rows = posts.select(*keep, F.explode(tokenizer(F.col(content))).alias("word"))
    else:
        rows = posts.select(*keep, F.explode(raw_words(F.col(content), min_len, cjk)).alias("word"))
        rows = rows.where(keep_word(F.col("word"), min_len, word_runs=True))
    return remove_stopwords(rows, stopwords)


def explode_tokens(
    posts: DataFrame,
    keep: Sequence[str] = ("id", "date"),
    stopwords: Iterable[str] = (),
    min_len: int = S.MIN_WORD_LENGTH,
    cjk: str = "bigram",
    content: str = "content",
) -> DataFrame:
    """Token rows with ``pos``, the place of the word among the kept words."""
    words = tokenize(F.col(content), stopwords, min_len, cjk)
    return posts.select(*keep, F.posexplode(words).alias("pos", "word"))


def with_tokens(
    posts: DataFrame,
    stopwords: Iterable[str] = (),
    min_len: int = S.MIN_WORD_LENGTH,
    cjk: str = "bigram",
    content: str = "content",
    column: str = "tokens",
) -> DataFrame:
    return posts.withColumn(column, tokenize(F.col(content), stopwords, min_len, cjk))
