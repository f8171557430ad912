"""Sentiment of posts, of the corpus, of words and of words per day."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termpulse import settings as S
from termpulse.functions import score as X
from termpulse.functions.dates import day_of, timestamp_of
from termpulse.functions.text import is_blank
from termpulse.operators.matching import literal_words, terms_in_posts, word_post_matches
from termpulse.operators.sampling import sample_per_group

Lexicon = tuple[Iterable[str], Iterable[str]]
DEFAULT_LEXICON: Lexicon = (S.POSITIVE_TERMS, S.NEGATIVE_TERMS)


# --- posts -----------------------------------------------------------------------


def with_raw_score(
    posts: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, content: str = "content", column: str = "raw"
) -> DataFrame:
    """Unrounded lexicon score of each post."""
    return posts.withColumn(column, X.lexicon_raw_score(F.col(content), *lexicon))


def score_posts(
    posts: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, content: str = "content"
) -> DataFrame:
    """Add raw score, score, class and label; a loaded ``sentiment_label`` is replaced."""
    kept = [c for c in posts.columns if c not in X.SENTIMENT_COLUMNS]
    scored = with_raw_score(posts, lexicon, content, "_raw")
    return scored.select(*kept, *X.sentiment_columns(F.col("_raw")))


def lexicon_scores_by_join(
    posts: DataFrame, lexicon: DataFrame, content: str = "content", key: str = "id"
) -> DataFrame:
    """``key, raw`` from a lexicon table ``term, polarity`` (+1 or -1) of any size.

    Terms found in a post are counted per polarity. Posts without terms, and
    blank posts, come out neutral.
    """
    found = terms_in_posts(
        posts.where(~is_blank(F.col(content))), lexicon.select("term", "polarity"), keep=(key,), content=content
    )
    counts = found.groupBy(key).agg(
        F.count_if(F.col("polarity") > 0).alias("pos"), F.count_if(F.col("polarity") < 0).alias("neg")
    )
    raw = X.share_positive(F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0)))
    return posts.select(key).join(counts, key, "left").select(key, raw.alias("raw"))


def narrow_scores(
    posts: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    content: str = "content",
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """What aggregates need of a scored post: the score in cents and the class."""
    r = F.col("_raw")
    return with_raw_score(posts, lexicon, content, "_raw").withColumns(
        {"cents": X.to_cents(X.scale_score(r)), "sentiment": X.sentiment_class(r)}
    ).drop("_raw")


# --- corpus ----------------------------------------------------------------------


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """``sentiment, n, ratio, avg_score`` from rows with ``cents`` and ``sentiment``.

    Always three rows: a class without posts shows 0, an empty input shows
    zeros and the neutral average. One global aggregate, one row per task.
    """
    classes = tuple(S.SENTIMENT_TITLES)
    one = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        *[F.count_if(F.col("sentiment") == c).alias(c) for c in classes],
    )
    return distribution_of_sums(one)


def distribution_of_sums(one: DataFrame) -> DataFrame:
    """The distribution from one row ``total, cents`` and a count per class."""
    long = F.explode(
        F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("n")) for c in S.SENTIMENT_TITLES])
    )
    return one.select("total", "cents", long.alias("c")).select(
        "c.sentiment",
        "c.n",
        X.ratio(F.col("c.n"), F.col("total")).alias("ratio"),
        X.mean_of_cents(F.col("cents"), F.col("total")).alias("avg_score"),
    )


def distribution_shares(distribution: DataFrame) -> DataFrame:
    """Pie chart rows: titles and percentages; classes without posts are hidden."""
    shown = distribution.where(F.col("n") > 0)
    # Three rows at most, so the window may do without a partition.
    total = F.sum("n").over(Window.partitionBy())
    return shown.select(
        X.sentiment_title(F.col("sentiment")).alias("title"),
        "n",
        F.bround(F.col("n") * 100 / total, 1).alias("percent"),
    )


# --- words -----------------------------------------------------------------------


def word_sentiment(
    hits: DataFrame,
    words: DataFrame,
    max_samples: int | None = None,
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    """Sentiment of each word from its matches ``word, id, cents, sentiment``.

    All matching posts count, in one aggregate with one row per word and task.
    With ``max_samples`` only ``total_count`` covers them all, and the other
    figures a sample, for which the matches are worked out twice. ``words``
    supplies the words to report and may carry more columns; a word without
    matches is neutral with zeros.
    """
    figures = [
        F.count(F.lit(1)).alias("_n"),
        F.sum("cents").alias("_cents"),
        *[F.count_if(F.col("sentiment") == c).alias(f"_{c}") for c in S.SENTIMENT_TITLES],
    ]
    sums = sample_per_group(hits, ["word"], max_samples, seed).groupBy("word").agg(*figures)
    if max_samples is None:
        sums = sums.withColumn("total_count", F.col("_n"))
    else:
        totals = hits.groupBy("word").agg(F.count(F.lit(1)).alias("total_count"))
        sums = totals.join(sums, "word", "left")
    return word_sentiment_of_sums(sums, words)


def word_sentiment_of_sums(sums: DataFrame, words: DataFrame) -> DataFrame:
    """Sentiment of each word from ``word, total_count`` and the sums ``_n, _cents`` and a
    count per class."""
    zero = F.lit(0).cast("bigint")
    n, cents, pos, neg, neu = (
        F.coalesce(F.col(c), zero) for c in ("_n", "_cents", "_positive", "_negative", "_neutral")
    )
    joined = words.join(sums, "word", "left")
    return joined.select(
        *words.columns,
        F.coalesce("total_count", zero).alias("total_count"),
        X.mean_of_cents(cents, n).alias("avg_score"),
        X.majority(pos, neg).alias("sentiment"),
        pos.alias("positive_count"),
        neg.alias("negative_count"),
        neu.alias("neutral_count"),
        X.ratio(pos, n).alias("positive_ratio"),
        X.ratio(neg, n).alias("negative_ratio"),
    )


def analyze_words(
    posts: DataFrame,
    words: Sequence[str],
    lexicon: Lexicon = DEFAULT_LEXICON,
    content: str = "content",
    max_samples: int | None = None,
    seed: int = S.SAMPLE_SEED,
    regex: bool = False,
) -> DataFrame:
    """Sentiment of given words, all of them in one pass over the posts."""
    scored = narrow_scores(posts, lexicon, content)
    hits = word_post_matches(scored, words, ("id", "cents", "sentiment"), content, regex)
    asked = posts.sparkSession.range(1).select(F.explode(literal_words(words)).alias("word"))
    return word_sentiment(hits, asked, max_samples, seed)


def top_words_sentiment(
    posts: DataFrame,
    ranked: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    content: str = "content",
    max_samples: int | None = None,
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    """Sentiment of the words of a top-N table ``word, n``, next to ``word_count``.

    ``word_count`` counts token occurrences, ``total_count`` posts holding the
    word as a substring. The ranking runs at once, for its first
    ``INLINE_WORDS + 1`` rows. If that is all of it, its words travel inside the
    plan; a longer table meets the posts in a join.
    """
    scored = narrow_scores(posts, lexicon, content)
    first = ranked.select("word", "n").limit(S.INLINE_WORDS + 1).collect()
    if len(first) > S.INLINE_WORDS:
        words = ranked.select("word", F.col("n").alias("word_count"))
        hits = word_post_matches(scored, words, ("id", "cents", "sentiment"), content)
    else:
        rows = [F.struct(F.lit(r.word).alias("word"), F.lit(r.n).alias("word_count")) for r in first]
        rows = F.array(*rows).cast("array<struct<word:string,word_count:bigint>>")
        words = posts.sparkSession.range(1).select(F.inline(rows))
        hits = word_post_matches(scored, [r.word for r in first], ("id", "cents", "sentiment"), content)
    return word_sentiment(hits, words, max_samples, seed)


# --- words per day ---------------------------------------------------------------


def word_sentiment_by_date(
    posts: DataFrame,
    words: str | Sequence[str],
    lexicon: Lexicon = DEFAULT_LEXICON,
    content: str = "content",
    date_col: str = "date",
    max_samples: int | None = None,
    seed: int = S.SAMPLE_SEED,
    regex: bool = False,
) -> DataFrame:
    """``word, day, avg_score``; unreadable dates drop out, no match gives no rows."""
    words = [words] if isinstance(words, str) else list(words)
    ts = timestamp_of(posts, date_col)
    dated = posts.withColumn("day", day_of(ts)).where(F.col("day").isNotNull())
    hits = word_post_matches(
        narrow_scores(dated, lexicon, content), words, ("id", "day", "cents"), content, regex
    )
    return (
        sample_per_group(hits, ["word", "day"], max_samples, seed)
        .groupBy("word", "day")
        .agg(X.mean_of_cents(F.sum("cents"), F.count(F.lit(1))).alias("avg_score"))
    )


def trend_summary(series: DataFrame) -> DataFrame:
    """Per word: days, mean, highest and lowest score with their first day."""
    cents = X.to_cents(F.col("avg_score"))
    high = F.min(F.struct((-cents).alias("c"), F.col("day"), F.col("avg_score")))
    low = F.min(F.struct(cents.alias("c"), F.col("day"), F.col("avg_score")))
    return (
        series.groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.sum(cents).alias("_cents"),
            high.alias("_high"),
            low.alias("_low"),
        )
        .select(
            "word",
            "points",
            X.mean_of_cents(F.col("_cents"), F.col("points")).alias("mean_score"),
            F.col("_high.avg_score").alias("max_score"),
            F.col("_high.day").alias("max_day"),
            F.col("_low.avg_score").alias("min_score"),
            F.col("_low.day").alias("min_day"),
        )
    )


def trend_sides(series: DataFrame) -> DataFrame:
    return series.withColumn("side", X.trend_side(F.col("avg_score")))


# --- display ---------------------------------------------------------------------


def score_bands(words: DataFrame, bars: int = S.BAR_WORDS) -> DataFrame:
    """Score chart rows: the first ``bars`` ranked words with score and band."""
    return words.where(F.col("rank") <= bars).select(
        "rank", "word", "avg_score", X.score_band(F.col("avg_score")).alias("band")
    )


def hot_word_table(words: DataFrame) -> DataFrame:
    """Table rows: rank, word, count, score to one decimal, class title."""
    shown = F.format_string("%.1f", F.bround("avg_score", 1))
    return words.select(
        "rank", "word", "word_count", shown.alias("score"),
        X.sentiment_title(F.col("sentiment")).alias("title"),
    )
