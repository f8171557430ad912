"""Words against a word-keyed table, safe for hot words and big tables: token rows, or the
words of a post all at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.storage import fits_broadcast, row_width


@dataclass(frozen=True)
class WordTable:
    """A fitted table: one row per ``word``, some values, and a weight column.

    Fitting is eager, as with a Spark ML estimator: the table is kept on the
    executors (and rebuilt by Spark if one is lost) and its size is known when
    a join with it is planned.
    """

    words: DataFrame
    weight: str
    small: bool

    @classmethod
    def fit(cls, words: DataFrame, weight: str) -> WordTable:
        kept = words.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return cls(kept, weight, fits_broadcast(kept))

    def release(self) -> None:
        self.words.unpersist()


@dataclass(frozen=True)
class FrequentWords:
    """``word, value`` of the most frequent words of a table, as many as a broadcast holds,
    for lookups in the Python workers; ``rest`` has the other words, and ``highest`` is the
    highest value of all.
    """

    entries: Broadcast[pa.Table]
    highest: float | None
    rest: DataFrame | None

    @classmethod
    def of(cls, table: WordTable, value: str) -> FrequentWords:
        """Weights are taken by eighths of a power of two. Counting these is one aggregate
        over the table, a row each; a small table is taken whole. The words that are
        broadcast are the only ones that pass through the driver."""
        words = table.words.select("word", value, F.floor(F.log2(table.weight) * 8).alias("_class"))
        classes = words.groupBy("_class").agg(
            F.count(F.lit(1)).alias("n"), F.sum(row_width(words)).alias("size"), F.max(value).alias("highest")
        )
        by_class = sorted(classes.collect(), key=lambda c: (c["_class"] is None, -(c["_class"] or 0)))
        highest = max((c["highest"] for c in by_class if c["highest"] is not None), default=None)
        head, rest = words, None
        if not table.small:
            n = size = 0
            least = None
            for c in by_class:
                n, size = n + c["n"], size + c["size"]
                if c["_class"] is None or n > S.BROADCAST_ROWS or size > S.BROADCAST_BYTES:
                    break
                least = c["_class"]
            frequent = F.coalesce(F.col("_class") >= F.lit(least), F.lit(False))
            head, rest = words.where(frequent), words.where(~frequent).drop("_class")
        listed = head.select("word", F.col(value).cast("double").alias("value")).dropna().toArrow()
        return cls(table.words.sparkSession.sparkContext.broadcast(listed.combine_chunks()), highest, rest)


def lookup_words(
    tokens: DataFrame, table: WordTable, values: Sequence[str], spread: str = "id", hot: int = S.HOT_WORDS
) -> DataFrame:
    """Inner join of ``tokens`` with ``table`` on ``word``, adding ``values``.

    A table measured small is broadcast. Otherwise the ``hot`` most frequent
    words, a bounded number, are looked up in a broadcast of their own; their
    token rows then take a join key made from ``spread`` instead of the word, so
    that no task receives all rows of one frequent word. All other words are
    joined by a shuffle on the word, in ``SALTS`` slices: a word rare in the
    table may still be frequent in these tokens.
    """
    columns = table.words.select("word", *values)
    if table.small:
        return tokens.join(F.broadcast(columns), "word")
    packed = F.struct(*values)
    head = (
        table.words.orderBy(F.desc(table.weight), "word").limit(hot)
        .select("word", packed.alias("_hot"))
    )
    marked = tokens.join(F.broadcast(head), "word", "left")
    joined = lookup_rest(marked, table.words, values, F.col("_hot").isNotNull(), spread)
    found = F.coalesce("_hot", "_rest")
    return joined.where(found.isNotNull()).select(
        *tokens.columns, *[found[v].alias(v) for v in values]
    )


def lookup_rest(
    tokens: DataFrame,
    words: DataFrame,
    values: Sequence[str],
    known: Column,
    spread: str = "id",
    slices: int = S.SALTS,
) -> DataFrame:
    """Left join of ``tokens`` with ``words``, adding the struct ``_rest`` of ``values``.

    Rows already ``known`` are joined with nothing, and spread over the tasks. The rows of any
    other word are dealt to ``slices`` tasks, for which the table is copied as often.
    """
    # A leading NUL keeps the made-up keys apart from every word.
    spread_key = F.concat(F.lit("\0"), F.col(spread).cast("string"))
    keyed = tokens.withColumn("_key", F.when(known, spread_key).otherwise(F.col("word")))
    tail = words.select(F.col("word").alias("_tail_word"), F.struct(*values).alias("_rest"))
    same = F.col("_key") == F.col("_tail_word")
    if slices > 1:
        keyed = keyed.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
        tail = tail.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        same = same & (F.col("_slice") == F.col("_salt"))
    # Spark takes the copies for as small as the stored table and might broadcast them all.
    return keyed.join(tail.hint("merge"), same, "left").drop("_key", "_slice", "_tail_word", "_salt")
