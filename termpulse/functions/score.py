"""Sentiment arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.text import is_blank

SENTIMENT_COLUMNS = ("sentiment_raw_score", "sentiment_score", "sentiment", "sentiment_label")


def _present(text: Column, terms: Iterable[str]) -> Column:
    hits = [F.contains(text, F.lit(t)).cast("int") for t in dict.fromkeys(terms)]
    return reduce(add, hits, F.lit(0))


def share_positive(pos: Column, neg: Column) -> Column:
    """``pos / (pos + neg)``, or the neutral value when nothing was found."""
    return F.when(pos + neg == 0, F.lit(S.NEUTRAL_RAW)).otherwise(pos / (pos + neg))


def lexicon_raw_score(
    text: Column,
    positive: Iterable[str] = S.POSITIVE_TERMS,
    negative: Iterable[str] = S.NEGATIVE_TERMS,
) -> Column:
    """Raw 0-1 score of uncleaned text; each term counts once if it occurs.

    Blank text is neutral. Suits lexicons of a few dozen terms, which stay
    inside generated code; see ``operators.sentiment.lexicon_scores_by_join``
    for lexicon tables.
    """
    raw = share_positive(_present(text, positive), _present(text, negative))
    return F.when(is_blank(text), F.lit(S.NEUTRAL_RAW)).otherwise(raw)


def scale_score(raw: Column) -> Column:
    """0-1 to 1-10, two decimals, half-even."""
    return F.bround(raw * 9 + 1, 2)


def sentiment_class(raw: Column) -> Column:
    return (
        F.when(raw >= S.POSITIVE_THRESHOLD, "positive")
        .when(raw <= S.NEGATIVE_THRESHOLD, "negative")
        .otherwise("neutral")
    )


def sentiment_label(raw: Column) -> Column:
    return (
        F.when(raw >= S.POSITIVE_THRESHOLD, F.lit(1))
        .when(raw <= S.NEGATIVE_THRESHOLD, F.lit(0))
        .otherwise(F.lit(-1))
    )


def sentiment_columns(raw: Column) -> list[Column]:
    """The four columns of a scored post; classes follow the unrounded score."""
    values = (F.bround(raw, 4), scale_score(raw), sentiment_class(raw), sentiment_label(raw))
    return [v.alias(name) for v, name in zip(values, SENTIMENT_COLUMNS)]


def to_cents(score: Column) -> Column:
    """Two-decimal score as an integer, so sums do not depend on row order."""
    return F.bround(score * 100, 0).cast("bigint")


def mean_of_cents(total: Column, n: Column) -> Column:
    """Average score from summed cents; neutral when there was nothing."""
    return F.when(n > 0, F.bround(total / (n * F.lit(100.0)), 2)).otherwise(F.lit(S.NEUTRAL_SCORE))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(F.lit(0.0))


def majority(positive: Column, negative: Column) -> Column:
    """Verdict of the larger side; neutral posts do not vote, a tie is neutral."""
    return (
        F.when(positive > negative, "positive")
        .when(negative > positive, "negative")
        .otherwise("neutral")
    )


def score_band(score: Column) -> Column:
    """Display band of an average score."""
    return (
        F.when(score >= S.BAND_POSITIVE, "positive")
        .when(score <= S.BAND_NEGATIVE, "negative")
        .otherwise("neutral")
    )


def trend_side(score: Column) -> Column:
    """Side of the neutral line; the line itself is positive."""
    return F.when(score >= S.NEUTRAL_LINE, "positive").otherwise("negative")


def sentiment_title(sentiment: Column) -> Column:
    """Display name of a class; unknown classes show as neutral."""
    titles = F.create_map([F.lit(x) for pair in S.SENTIMENT_TITLES.items() for x in pair])
    return F.coalesce(titles[sentiment], F.lit(S.SENTIMENT_TITLES["neutral"]))
