"""What a corpus holds: its size and its dates; of a stored one, from its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.functions.dates import day_of, timestamp_of

# What ``write_posts`` adds to the posts.
_STORED = "ts timestamp_ntz, day date"


def date_range(posts: DataFrame, date_col: str = "date") -> DataFrame:
    """One row ``first_ts, last_ts``; nulls without readable dates or without the column."""
    if date_col not in posts.columns:
        empty = F.lit(None).cast("timestamp_ntz")
        return posts.sparkSession.range(1).select(empty.alias("first_ts"), empty.alias("last_ts"))
    ts = timestamp_of(posts, date_col)
    return posts.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def corpus_summary(posts: DataFrame, date_col: str = "date") -> DataFrame:
    """One row ``posts, first_day, last_day``, days as ``yyyy-MM-dd``."""
    ts = timestamp_of(posts, date_col) if date_col in posts.columns else F.lit(None).cast("timestamp_ntz")
    return posts.agg(
        F.count(F.lit(1)).alias("posts"),
        day_of(F.min(ts)).alias("first_day"),
        day_of(F.max(ts)).alias("last_day"),
    )


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """``day, posts`` of a corpus that ``write_posts`` stored: no column is read.

    Days are folders, and numbers of rows are in the footers. Spark takes them from there
    in its newer reader only, so this has a session of its own with that reader; the
    caller's keeps its settings.
    """
    own = spark.newSession()
    v1 = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in v1 if s.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.schema(_STORED).parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("posts"))


def stored_summary(spark: SparkSession, path: str) -> DataFrame:
    """As ``corpus_summary``, of a corpus that ``write_posts`` stored, from metadata only."""
    return stored_days(spark, path).agg(
        F.coalesce(F.sum("posts"), F.lit(0)).alias("posts"),
        F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"),
    )


def stored_date_range(spark: SparkSession, path: str) -> DataFrame:
    """As ``date_range``, of a corpus that ``write_posts`` stored: only the times of its
    first and its last day are read. The days are found at once."""
    days = stored_summary(spark, path).first()
    posts = spark.read.schema(_STORED).parquet(path)
    if days.first_day is None:
        return date_range(posts.limit(0), "ts")
    ends = F.col("day").isin(*(F.lit(d).cast("date") for d in (days.first_day, days.last_day)))
    return posts.where(ends).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
