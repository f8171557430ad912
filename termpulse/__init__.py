"""Trend and sentiment analytics over dated text, as Spark DataFrame operators."""

from termpulse.plans.drilldown import WordTrend, word_trend
from termpulse.plans.report import HotWordReport, hot_word_report
from termpulse.plans.summary import corpus_summary, date_range
from termpulse.sources.posts import posts_from_pandas, read_custom_posts, read_labelled_posts

__all__ = [
    "HotWordReport",
    "WordTrend",
    "corpus_summary",
    "date_range",
    "hot_word_report",
    "posts_from_pandas",
    "read_custom_posts",
    "read_labelled_posts",
    "word_trend",
]
