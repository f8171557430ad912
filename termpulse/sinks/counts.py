"""Word counts per day that are kept up to date.

A store holds two tables: ``counts``, the words of each day, in a folder per day and
generation, and ``days``, one row per day that names the generation that counts. An
update counts the posts of its days, writes them as a new generation and then replaces
the rows of these days. What is read in between, or after a failure, is the generation
before; running the update again puts it right, and running it twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.text import Tokenizer
from termpulse.operators.filters import Bound
from termpulse.operators.models import ModelMismatch, fingerprint
from termpulse.operators.tokens import word_rows
from termpulse.storage import broadcast_if_small

_COUNTS = "word string, n long, day date, generation string"
_DAYS = "generation string, n_posts long, n_words long, words string, day date"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def update_counts(
    posts: DataFrame,
    folder: str,
    days: Sequence[date] | None = None,
    stopwords: Sequence[str] = (),
    min_len: int = S.MIN_WORD_LENGTH,
    tokenizer: Tokenizer | None = None,
    content: str = "content",
) -> None:
    """Count the posts of some days anew, or of all days that occur.

    ``posts`` has a column ``day``, as ``write_posts`` stores it: with ``days`` only the
    folders of these are read. A day without posts counts as empty from then on. Posts
    without a day are not counted. Counts of other words than those in the store (other
    stopwords, another tokeniser or word length) are refused.
    """
    spark = posts.sparkSession
    words = f"{min_len} {fingerprint(spark, stopwords, tokenizer)}"
    known = _read(spark, f"{folder}/days", _DAYS)
    if known.where(F.col("words") != words).limit(1).count():
        raise ModelMismatch(f"the counts in {folder} are of other words")
    rows = posts.where(F.col("day").isNotNull())
    if days is not None:
        rows = rows.where(F.col("day").isin(list(days)))
    generation = uuid.uuid4().hex
    tokens = word_rows(rows, ("day",), stopwords, min_len, tokenizer=tokenizer, content=content)
    counts = tokens.groupBy("day", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("generation", F.lit(generation))
    # Days are dealt out in slices, so that no task writes all words of a busy day.
    counts.hint("rebalance", "day").write.mode("append").partitionBy("day", "generation").parquet(f"{folder}/counts")
    done = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n_posts"))
    if days is not None:
        wanted = spark.createDataFrame([(d,) for d in dict.fromkeys(days)], "day date")
        done = wanted.join(done, "day", "left")
    written = _read(spark, f"{folder}/counts", _COUNTS).where(F.col("generation") == generation)
    done = done.join(written.groupBy("day").agg(F.count(F.lit(1)).alias("n_words")), "day", "left")
    # One row per day. Only the folders of these days are replaced.
    done.select(
        F.lit(generation).alias("generation"),
        F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.lit(words).alias("words"),
        "day",
    ).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/days")


def counted_days(spark: SparkSession, folder: str) -> DataFrame:
    """``day, n_posts, n_words`` of the days in the store."""
    return _read(spark, f"{folder}/days", _DAYS).select("day", "n_posts", "n_words")


def read_counts(spark: SparkSession, folder: str, start: Bound = None, end: Bound = None) -> DataFrame:
    """``day, word, n`` of the generations that count, from ``start`` to ``end``, both days
    included; only the folders of the range are read."""

    def inside(df: DataFrame) -> DataFrame:
        if start is not None:
            df = df.where(F.col("day") >= F.lit(start).cast("date"))
        return df if end is None else df.where(F.col("day") <= F.lit(end).cast("date"))

    valid = inside(_read(spark, f"{folder}/days", _DAYS)).select("day", "generation")
    counts = inside(_read(spark, f"{folder}/counts", _COUNTS))
    # Both keys are folders: Spark prunes those of older generations while it runs.
    return counts.join(broadcast_if_small(valid), ["day", "generation"], "left_semi").select("day", "word", "n")


def drop_old_generations(spark: SparkSession, folder: str) -> int:
    """Remove what no reader that starts from now on will read; the number of folders.

    For times when no update and no reader is at work.
    """
    valid = _read(spark, f"{folder}/days", _DAYS).select("day", "generation")
    found = _read(spark, f"{folder}/counts", _COUNTS).select("day", "generation").distinct()
    old = found.join(valid, ["day", "generation"], "left_anti")
    removed = 0
    for row in old.toLocalIterator():  # folders, not words
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts/day={row.day}/generation={row.generation}")
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def word_totals(counts: DataFrame) -> DataFrame:
    """``word, n`` over all days of ``counts``."""
    return counts.groupBy("word").agg(F.sum("n").alias("n"))
