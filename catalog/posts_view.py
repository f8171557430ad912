"""Dated posts derived from the ``documents`` and ``labels`` tables.

The rules plant missing and unreadable dates, times, empty and blank contents,
URLs and unknown emotions at fixed places, over every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.sources.posts import read_table
from termpulse.storage import broadcast_if_small

START, END = "2020-01-25", "2020-03-31"
STOPWORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "on",
    "de", "la", "le", "en", "un", "der", "die", "und", "el", "los",
)
POSITIVE = ("that", "with", "pour", "nicht", "para")
NEGATIVE = (
    "trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser",
    "stupid", "disgusting",
)
LEXICON = (POSITIVE, NEGATIVE)
WORDS = ("der", "scum", "the", "zzzz")
EMOTIONS = ("happy", "neutral", "angry", "sad", "fear", "surprise", "unknown_tag")
LATIN = "abcdefghijklmnopqrstuvwxyz"
# One CJK character per Latin letter gives Chinese-looking text for whole documents.
HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")


def _every(divisor: int, rest: int):
    return F.col("doc_id") % divisor == rest


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, date, content, emotion, source``."""
    day = F.date_format(
        F.date_add(F.lit("2020-01-20").cast("date"), (F.col("doc_id") % 102).cast("int")), "yyyy-MM-dd"
    )
    date = (
        F.when(_every(97, 5), "not-a-date")
        .when(_every(89, 7), F.lit(None))
        .when(_every(11, 3), F.concat(day, F.lit(" 13:45:00")))
        .otherwise(day)
    )
    link = F.concat(F.col("text"), F.lit(" http://t.co/x"), F.col("doc_id").cast("string"), F.lit(" tail"))
    content = (
        F.when(_every(101, 11), F.lit(None))
        .when(_every(103, 13), "")
        .when(_every(107, 17), "   ")
        .when(_every(5, 0), link)
        .otherwise(F.col("text"))
    )
    emotion = F.element_at(F.array(*map(F.lit, EMOTIONS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        date.alias("date"),
        content.alias("content"),
        emotion.alias("emotion"),
        "source",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_posts(spark, sf_dir).drop("emotion")


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with ``train_label``: 1 good, 0 toxic, -1 other, null unlabelled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(-1).alias("train_label"),
    )
    # Measured first: texts are shuffled only for labels too many to broadcast.
    return posts(spark, sf_dir).join(broadcast_if_small(labels), "id", "left")


def han_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, content`` with every Latin letter replaced by a CJK character."""
    return posts(spark, sf_dir).select(
        "id", F.translate(F.lower("content"), LATIN, HAN).alias("content")
    )
