"""Multinomial Naive Bayes sentiment, trained and applied as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions.score import sentiment_columns
from termpulse.functions.text import Tokenizer
from termpulse.operators.lookup import WordTable, lookup_words
from termpulse.operators.tokens import word_rows

# exp() of anything beyond would overflow or vanish.
EXPONENT_LIMIT = 700.0


@dataclass(frozen=True)
class BayesModel:
    """``table``: ``word, pos_n, neg_n, log_pos, log_neg``; and the class priors.

    ``log_prior`` is ln(P(positive) / P(negative)) over training posts.
    """

    table: WordTable
    log_prior: float


def train_counts(
    posts: DataFrame,
    label: str = "train_label",
    stopwords: Iterable[str] = (),
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Token counts per word and class; posts labelled neither 1 nor 0 are left out."""
    labelled = posts.where(F.col(label).isin(0, 1))
    return (
        word_rows(labelled, (label,), stopwords, content=content, tokenizer=tokenizer)
        .groupBy("word")
        .agg(
            F.count_if(F.col(label) == 1).alias("pos_n"),
            F.count_if(F.col(label) == 0).alias("neg_n"),
        )
    )


def log_probabilities(counts: DataFrame) -> DataFrame:
    """Add-one smoothed log probabilities over the trained vocabulary."""
    totals = counts.agg(
        F.struct(
            F.sum("pos_n").alias("pos"), F.sum("neg_n").alias("neg"), F.count(F.lit(1)).alias("v")
        ).alias("t")
    ).scalar()

    def log_p(n: str, total: str):
        return F.log((F.col(n) + 1) / (F.col(f"_t.{total}") + F.col("_t.v")))

    return counts.withColumn("_t", totals).select(
        "word", "pos_n", "neg_n", log_p("pos_n", "pos").alias("log_pos"), log_p("neg_n", "neg").alias("log_neg")
    )


def train(
    posts: DataFrame,
    label: str = "train_label",
    stopwords: Iterable[str] = (),
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> BayesModel:
    """Fit a model; raises ``ValueError`` unless both classes occur."""
    sizes = posts.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    pos, neg = sizes.first()
    if not pos or not neg:
        raise ValueError("training needs posts of both classes")
    fitted = log_probabilities(train_counts(posts, label, stopwords, content, tokenizer)).withColumn(
        "n", F.col("pos_n") + F.col("neg_n")
    )
    return BayesModel(WordTable.fit(fitted, "n"), math.log(pos / neg))


def raw_scores(
    posts: DataFrame,
    model: BayesModel,
    stopwords: Iterable[str] = (),
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """``key, raw``: probability of the positive class; unknown words are skipped.

    Posts without a known word have no row. Each token contributes one log
    ratio; sums are partial inside each task when the model is broadcast.
    """
    known = lookup_words(
        word_rows(posts, (key,), stopwords, content=content, tokenizer=tokenizer), model.table, ["log_pos", "log_neg"], key
    )
    margin = F.sum(F.col("log_neg") - F.col("log_pos")) - F.lit(model.log_prior)
    clamped = F.greatest(F.least(margin, F.lit(EXPONENT_LIMIT)), F.lit(-EXPONENT_LIMIT))
    return known.groupBy(key).agg((1 / (1 + F.exp(clamped))).alias("raw"))


def predict(
    posts: DataFrame,
    model: BayesModel,
    stopwords: Iterable[str] = (),
    key: str = "id",
    content: str = "content",
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """``key`` and the four sentiment columns, one row per post.

    Neutral where a post has no known word, as blank posts have none. Texts are
    not part of the final join: only keys and scores are.
    """
    raw = raw_scores(posts, model, stopwords, key, content, tokenizer)
    scored = posts.select(key).join(raw, key, "left")
    return scored.select(key, *sentiment_columns(F.coalesce("raw", F.lit(S.NEUTRAL_RAW))))
