"""Stopword lists."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.functions.text import SPACE

# A short list of Chinese function words; single characters are left out since
# the default minimum word length drops them anyway.
CHINESE = (
    "一个", "一些", "什么", "他们", "你们", "我们", "她们", "不是", "但是", "因为",
    "所以", "如果", "虽然", "然后", "这个", "那个", "这样", "那样", "还是", "已经",
)


def stopwords_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One stopword a line: trim, drop blanks, drop repeats."""
    word = F.regexp_replace(F.col(column), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    return lines.select(word.alias("word")).where(F.col("word") != "").distinct()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Stopwords from a UTF-8 text file; a missing file gives an empty table."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no stopword file at {path}; going on without stopwords", stacklevel=2)
        return spark.createDataFrame([], "word string")
    return stopwords_of_lines(lines)


def default_stopwords(
    languages: tuple[str, ...] = ("english", "french", "german", "spanish"), chinese: bool = True
) -> list[str]:
    """Spark's own lists for the given languages plus a short Chinese one."""
    from pyspark.ml.feature import StopWordsRemover

    words = {w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)}
    return sorted(words | set(CHINESE if chinese else ()))
