"""Small building blocks for work inside one row's arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A plain column reference could be inlined into a lambda by the optimizer and
    then run once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _group_starts(items: Column, key: Callable[[Column], Column]) -> Column:
    """Offsets in a sorted array at which ``key`` changes."""
    return F.filter(
        F.transform(items, lambda _, i: i),
        lambda i: ~key(F.get(items, i)).eqNullSafe(key(F.get(items, i - 1))),
    )


def count_words(tokens: Column) -> Column:
    """``array<struct<word, tf>>`` of a token array, sorted by word."""
    return let(
        F.sort_array(tokens),
        lambda ws: let(
            _group_starts(ws, lambda w: w),
            lambda starts: F.transform(
                starts,
                lambda s, g: F.struct(
                    F.get(ws, s).alias("word"),
                    (F.coalesce(F.get(starts, g + 1), F.size(ws)) - s).cast("bigint").alias("tf"),
                ),
            ),
        ),
    )


def word_positions(tokens: Column) -> Column:
    """``array<struct<word, at array<int>>>`` of a token array, sorted by word."""
    placed = F.sort_array(
        F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    )
    return let(
        placed,
        lambda ws: let(
            _group_starts(ws, lambda w: w["word"]),
            lambda starts: F.transform(
                starts,
                lambda s, g: F.struct(
                    F.get(ws, s)["word"].alias("word"),
                    F.transform(
                        F.slice(ws, s + 1, F.coalesce(F.get(starts, g + 1), F.size(ws)) - s),
                        lambda w: w["pos"],
                    ).alias("at"),
                ),
            ),
        ),
    )


def heaviest(weighted: Column, k: int) -> Column:
    """The first ``k`` of ``array<struct<word, weight>>``: weight descending, then word."""
    order = F.sort_array(
        F.transform(weighted, lambda x: F.struct((-x["weight"]).alias("w"), x["word"].alias("word")))
    )
    return F.transform(
        F.slice(order, 1, k), lambda x: F.struct(x["word"].alias("word"), (-x["w"]).alias("weight"))
    )
