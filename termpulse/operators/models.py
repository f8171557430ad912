"""Fitted tables in a folder: Naive Bayes models and idf tables, used without fitting again.

A model is worth something only with the words it was fitted on. What a tokeniser makes
of ``PROBES`` and the list of stopwords give a fingerprint that is stored beside the
table; loading with others is refused, as is an unfinished or an unknown store.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termpulse.functions.text import Tokenizer, tokens_of
from termpulse.operators.bayes import BayesModel
from termpulse.operators.lookup import WordTable
from termpulse.storage import fits_broadcast

#: Of the layout of a store; a store of another one is refused.
FORMAT = 1
BAYES, IDF = "bayes", "idf"
#: Texts on which tokenisers differ: scripts, case, digits, links, marks, long words.
PROBES = (
    "The quick brown Fox; it's 2024, e-mail a.b@c.de or https://x.y/z?q=1 now_here",
    "今天A股大涨，去卡拉OK唱歌 买T恤和iPhone手机 研究生命起源",
    "Ünïcödé naïve façade ÉCOLE straße ÅNGSTRÖM",
    "١٢٣ ①② Ⅳ x y zz __ -- 😊😊 a　b\tc\nd",
    "word " * 3 + "pneumonoultramicroscopicsilicovolcanoconiosis",
    "",
)


class ModelMismatch(ValueError):
    """The store was written for other words, by another layout, or not to its end."""


def fingerprint(spark: SparkSession, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None) -> str:
    """Digest of the stopwords and of what the tokeniser makes of the probes: one small job."""
    rows = spark.createDataFrame(list(enumerate(PROBES)), "i int, x string")
    made = rows.select("i", tokens_of(F.col("x"), (), tokenizer).alias("words")).collect()
    said = [list(r.words or []) for r in sorted(made)]
    return hashlib.sha256(json.dumps([sorted(set(stopwords)), said]).encode()).hexdigest()


def _save(table: WordTable, folder: str, about: dict, stopwords: Iterable[str], tokenizer: Tokenizer | None) -> None:
    spark = table.words.sparkSession
    table.words.write.parquet(f"{folder}/words")  # an error if there is a store already
    about = {
        **about,
        "format": FORMAT,
        "weight": table.weight,
        "rows": table.words.count(),
        "fingerprint": fingerprint(spark, stopwords, tokenizer),
    }
    # Written last: a store without it was not finished.
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")


def _load(
    spark: SparkSession, folder: str, kind: str, stopwords: Iterable[str], tokenizer: Tokenizer | None
) -> tuple[WordTable, dict]:
    try:
        lines = spark.read.text(f"{folder}/about").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ModelMismatch(f"no finished model in {folder}") from e
        raise
    about = json.loads(lines[0].value)
    if about["format"] != FORMAT or about["kind"] != kind:
        raise ModelMismatch(f"{folder} holds a {about['kind']} model of format {about['format']}, not {kind} of {FORMAT}")
    if about["fingerprint"] != fingerprint(spark, stopwords, tokenizer):
        raise ModelMismatch(f"the model in {folder} was fitted with other stopwords or another tokeniser")
    words = spark.read.parquet(f"{folder}/words")
    if words.count() != about["rows"]:
        raise ModelMismatch(f"the model in {folder} is not complete")
    return WordTable(words, about["weight"], fits_broadcast(words)), about


def save_bayes(model: BayesModel, folder: str, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None) -> None:
    """Store a model in a new folder, for the words it was trained on."""
    _save(model.table, folder, {"kind": BAYES, "log_prior": model.log_prior}, stopwords, tokenizer)


def load_bayes(
    spark: SparkSession, folder: str, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None
) -> BayesModel:
    """A stored model, for the same stopwords and tokeniser; ``ModelMismatch`` otherwise."""
    table, about = _load(spark, folder, BAYES, stopwords, tokenizer)
    return BayesModel(table, about["log_prior"])


def save_idf(table: WordTable, folder: str, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None) -> None:
    """Store an idf table in a new folder, for the words it was fitted on."""
    _save(table, folder, {"kind": IDF}, stopwords, tokenizer)


def load_idf(
    spark: SparkSession, folder: str, stopwords: Iterable[str] = (), tokenizer: Tokenizer | None = None
) -> WordTable:
    """A stored idf table, for the same stopwords and tokeniser; ``ModelMismatch`` otherwise."""
    return _load(spark, folder, IDF, stopwords, tokenizer)[0]
