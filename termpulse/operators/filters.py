"""Row filters over posts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termpulse.functions.dates import parse_bound, timestamp_of

Bound = str | date | datetime | None


def filter_by_date(
    posts: DataFrame,
    start: Bound = None,
    end: Bound = None,
    date_col: str = "date",
    end_of_day: bool = False,
    strict: bool = False,
    day_col: str | None = None,
) -> DataFrame:
    """Posts between two bounds, both inclusive and both optional.

    A bare end date means its midnight, so later posts of that day drop out
    unless ``end_of_day`` is set. Any bound drops unreadable dates; without
    bounds everything stays. An unreadable bound or a table without the date
    column leaves the input as it is; ``strict`` raises ``ValueError`` for an
    unreadable bound instead.

    ``day_col`` names a stored day column (``DATE``) that goes with the
    timestamp: it is bounded too, so that a table partitioned by day is read
    only where needed.
    """
    if date_col not in posts.columns:
        return posts
    try:
        low, high = parse_bound(start), parse_bound(end)
    except ValueError:
        if strict:
            raise
        return posts
    ts = timestamp_of(posts, date_col)
    if low is not None:
        posts = posts.where(ts >= _literal(low))
        if day_col is not None:
            posts = posts.where(F.col(day_col) >= F.lit(low.date()))
    if high is not None:
        whole_day = end_of_day and (high.hour, high.minute, high.second, high.microsecond) == (0, 0, 0, 0)
        posts = posts.where(
            ts < _literal(high + timedelta(days=1)) if whole_day else ts <= _literal(high)
        )
        if day_col is not None:
            posts = posts.where(F.col(day_col) <= F.lit(high.date()))
    return posts


def _literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def non_empty(posts: DataFrame, content: str = "content") -> DataFrame:
    """Posts whose content is neither null nor empty; blanks stay."""
    return posts.where(F.col(content).isNotNull() & (F.col(content) != ""))


def containing(posts: DataFrame, word: str, content: str = "content", regex: bool = False) -> DataFrame:
    """Posts holding ``word``, literally or as a Java regular expression."""
    text = F.col(content)
    return posts.where(text.rlike(word) if regex else F.contains(text, F.lit(word)))


def word_context(posts: DataFrame, word: str, k: int, content: str = "content", order: str = "id") -> DataFrame:
    """The first ``k`` posts holding ``word``, in input order."""
    if content not in posts.columns:
        return posts.limit(0)
    return containing(posts, word, content).orderBy(order).limit(k)
