"""Report files: one CSV with a byte-order mark, for spreadsheet programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse import settings as S

BOM = "\ufeff"


def report_table(report: DataFrame) -> DataFrame:
    """Ranked hot words under the exported headers.

    The count column is ``word_count``, or ``total_count`` where that is
    missing, or 0.
    """
    counts = [F.col(c) for c in ("word_count", "total_count") if c in report.columns]
    fields = (
        F.col("rank"),
        F.col("word"),
        F.coalesce(*counts, F.lit(0)),
        F.col("avg_score"),
        F.col("sentiment"),
        F.col("positive_ratio"),
        F.col("negative_ratio"),
    )
    return report.select(*[c.alias(h) for c, h in zip(fields, S.REPORT_HEADERS)])


def trend_table(series: DataFrame, word: str | None = None) -> DataFrame:
    """Daily scores under the exported headers.

    With ``word`` those of one word. Without, a ``word`` column of the series is
    kept, so that days of several words can be told apart.
    """
    day, score = (F.col(c).alias(h) for c, h in zip(("day", "avg_score"), S.TREND_HEADERS))
    if word is not None:
        series = series.where(F.col("word") == word)
    named = [F.col("word").alias(S.REPORT_HEADERS[1])] if word is None and "word" in series.columns else []
    return series.select(day, score, *named)


def _write(table: DataFrame, path: str) -> None:
    """One CSV file at ``path``, on any file system that Spark reaches; an older
    file there is replaced."""
    spark = table.sparkSession
    # A ranked report or a day series: at most a few hundred rows, hence one file.
    first = table.columns[0]
    marked = table.orderBy(*map(F.col, table.columns)).coalesce(1).withColumnRenamed(first, BOM + first)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = target.suffix(".writing")
    marked.write.mode("overwrite").csv(staged.toString(), header=True, encoding="UTF-8")
    (part,) = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(staged, "part-*"))
    fs.delete(target, True)
    if not fs.rename(part.getPath(), target):
        raise OSError(f"cannot write {path}")
    fs.delete(staged, True)


def write_report(report: DataFrame, path: str) -> None:
    _write(report_table(report), path)


def write_trend(series: DataFrame, path: str, word: str | None = None) -> None:
    _write(trend_table(series, word), path)


def trend_file_name(word: str) -> str:
    return f"{word}_sentiment_trend.csv"
