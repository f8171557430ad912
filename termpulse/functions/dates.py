"""Tolerant timestamp parsing."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIMESTAMP_TYPES = {"timestamp", "timestamp_ntz", "date"}
_BOUND = re.compile(
    r"(\d{4})(?:-(\d{1,2})-(\d{1,2})|(\d{2})(\d{2}))"
    r"(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?"
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Forms besides ISO, as patterns that Java and Python read alike. A time of day may follow.
_YEAR_FIRST = r"^([0-9]{4})[./年]([0-9]{1,2})[./月]([0-9]{1,2})日?"
_DIGITS = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
_DAY_FIRST = r"^(1[3-9]|[23][0-9])/([0-9]{1,2})/([0-9]{4})"
_YEAR_LAST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
_NAMED_MONTH = r"^([0-9]{1,2}) ([A-Za-z]{3})[a-z]* ([0-9]{4})"
_LOGGED = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) ([0-9]{1,2}) ([0-9:]{5,8})(?: [+-][0-9]{4})? ([0-9]{4})$"


def parse_timestamp(text: Column) -> Column:
    """Text to TIMESTAMP_NTZ; anything unreadable becomes null.

    Reads ISO dates and times, ``20200120``, ``2020/1/20``, ``2020.01.20``,
    ``2020年1月20日``, ``01/20/2020`` (the month first, unless it would exceed 12),
    ``20 Jan 2020`` and ``Mon Jan 20 13:45:00 +0800 2020``. Times are those of the
    text's own clock; an offset is passed over.
    """
    t = F.trim(text)
    iso = t
    # Each form is rewritten to ISO; what has another form passes unchanged.
    for pattern, order in (
        (_DIGITS, "$1-$2-$3"),
        (_YEAR_FIRST, "$1-$2-$3"),
        (_DAY_FIRST, "$3-$2-$1"),
        (_YEAR_LAST, "$3-$1-$2"),
        (_NAMED_MONTH, "$3-$2-$1"),
        (_LOGGED, "$4-$1-$2 $3"),
        *((f"(?i)^([0-9]{{4}})-{name}-", f"$1-{k:02d}-") for k, name in enumerate(_MONTHS, 1)),
    ):
        iso = F.regexp_replace(iso, pattern, order)
    return F.when(t.rlike("^[0-9]{4}-[0-9]"), t).otherwise(iso).try_cast("timestamp_ntz")


def _iso(text: str) -> str:
    """The same rewriting for one bound."""

    if m := re.match(_LOGGED, text):
        text = f"{m[2]} {m[1]} {m[4]} {m[3]}"
    if (m := re.match(_NAMED_MONTH, text)) and m[2].lower() in _MONTHS:
        return f"{m[3]}-{_MONTHS.index(m[2].lower()) + 1}-{m[1]}{text[m.end():]}"
    for pattern, order in ((_DAY_FIRST, (3, 2, 1)), (_YEAR_LAST, (3, 1, 2)), (_YEAR_FIRST, (1, 2, 3))):
        if m := re.match(pattern, text):
            return "-".join(m[k] for k in order) + text[m.end() :]
    return text


def timestamp_of(df: DataFrame, name: str = "date") -> Column:
    """The column as a timestamp.

    A column already stored as a timestamp is used untouched, so comparisons
    with it reach the file scan as pushed filters and prune day partitions.
    """
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp_ntz", "timestamp"):
        return F.col(name)
    if kind == "date":
        return F.col(name).cast("timestamp_ntz")
    return parse_timestamp(F.col(name))


def parse_bound(bound: str | date | datetime | None) -> datetime | None:
    """One end of a range; empty means open, unreadable raises ``ValueError``."""
    if bound is None or bound == "":
        return None
    if isinstance(bound, datetime):
        return bound
    if isinstance(bound, date):
        return datetime(bound.year, bound.month, bound.day)
    m = _BOUND.fullmatch(_iso(bound.strip()))
    if m is None:
        raise ValueError(f"not a date: {bound!r}")
    year, month, day, month8, day8, hour, minute, second, micros = m.groups()
    return datetime(
        int(year), int(month or month8), int(day or day8), int(hour or 0),
        int(minute or 0), int(second or 0), int((micros or "0").ljust(6, "0")),
    )


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
